"""Toxicity, quality and language: exact scoring against the definitions, held-out accuracy, odd input."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import language, quality, toxicity
from foliant.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
INSULTS = ["idiot", "moron", "worthless", "disgusting"]


def sentences(n, seed, insult):
    rng = np.random.default_rng(seed)
    syllables = ["th", "er", "an", "re", "he", "in", "ed", "nd", "on", "at", "en", "es", "or", "ing", "tion"]
    out = []
    for _ in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(8, 40))]
        if insult:
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(INSULTS)))
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def machine():
    return toxicity.train(sentences(150, 1, True) + sentences(150, 2, False), np.array([1] * 150 + [0] * 150))


def kernel(x, z):
    """The kernel by its definition: pairs of equal subsequences, weighed by decay to their gaps."""

    def spots(s):
        for c in itertools.combinations(range(len(s)), 4):
            if c[3] - c[0] < toxicity.SPAN:
                yield bytes(s[i] for i in c), toxicity.DECAY ** (c[3] - c[0] - 3)

    a = {}
    for u, w in spots(x):
        a[u] = a.get(u, 0) + w
    return sum(w * a.get(u, 0) for u, w in spots(z))


def test_feature_map_is_the_kernel():
    for x, z in (("idiot", "idxiot"), ("pathetic", "apathetics"), ("abc", "abcd"), ("aaaaaa", "aaaaa")):
        a, b = (np.frombuffer(s.encode(), np.uint8) - 96 for s in (x, z))
        fa, fb = toxicity.features(a), toxicity.features(b)
        assert sum(v * fb.get(u, 0) for u, v in fa.items()) == pytest.approx(kernel(a, b))


def test_table_scores_windows_like_the_landmark_machine():
    strings = [b"\0" + bytes(c - 96 for c in w.encode()) + b"\0" for w in INSULTS]
    marks = toxicity.Landmarks(strings)
    w = np.random.default_rng(0).normal(size=marks.nystrom.shape[1])
    model = toxicity.StringMachine(marks.table(w), np.array([1.0, 0.0]))
    s = toxicity.fold_text("some idixot and a mooron are here")
    width = toxicity.STARTS + toxicity.SPAN - 1
    padded = np.r_[s, np.full(width, toxicity.NOTHING, np.uint8)]
    windows = np.array([padded[i : i + width] for i in range(len(s))])
    # A window's subsequences start at its first STARTS symbols.
    assert np.allclose(model.windows(s), marks.of_windows(windows) @ w, atol=1e-4)


def test_long_text_scores_like_its_parts(machine):
    s = toxicity.fold_text(" ".join(sentences(300, 5, True)))
    old = toxicity.AT_ONCE
    try:
        toxicity.AT_ONCE = 500
        assert np.allclose(machine.windows(s), machine._windows(s)[: len(s)])
    finally:
        toxicity.AT_ONCE = old


def test_toxicity_finds_held_out_and_obfuscated_insults(machine):
    toxic, clean = sentences(100, 7, True), sentences(100, 8, False)
    assert (machine.score(toxic) >= 0.5).mean() > 0.95
    assert (machine.score(clean) >= 0.5).mean() < 0.05
    for text in ("you i-d-i-o-t there", "you i d i o t there", "an ID*IOT here", "a worthxless one"):
        assert machine.score([text])[0] >= 0.5, text


def test_toxicity_finds_inserted_letters_in_held_out_documents(spark):
    """An insult with a random letter inside, put into held-out clean documents of the driver's tables."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    machine = toxicity.fit(docs, labels)
    held = docs.join(labels, "doc_id").where("lang = 'en' AND toxic = 0 AND crc32(CAST(doc_id AS STRING)) % 5 = 0 AND length(text) < 20000").orderBy("doc_id").limit(60)
    texts, rng, caught = [r.text for r in held.collect()], np.random.default_rng(0), []
    for insult in ("trash", "clown", "idiot", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid"):
        for t in texts:
            at, k = int(rng.integers(0, len(t.split(" ")) + 1)), int(rng.integers(1, len(insult)))
            words = t.split(" ")
            words.insert(at, insult[:k] + chr(97 + int(rng.integers(0, 26))) + insult[k:])
            caught.append(" ".join(words))
    assert (machine.score(texts) >= 0.5).mean() < 0.05
    assert (machine.score(caught) >= 0.5).mean() >= 0.9


def test_toxicity_odd_input(spark, machine):
    rows = [(1, None, "a"), (2, "", "b"), (3, "  \n ", "c"), (4, "an idiot", "d"), (4, "an idiot", "d"), (None, "x" * 300_000 + " moron", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    out = toxicity.with_toxicity(df, machine).collect()
    assert len(out) == 6 and set(out[0].asDict()) == {"doc_id", "text", "toxicity"}
    by = {(r.doc_id, (r.text or "")[:3]): r.toxicity for r in out}
    assert by[1, ""] == by[2, ""] and by[4, "an "] >= 0.5 and by[None, "xxx"] >= 0.5
    assert all(0 <= r.toxicity <= 1 for r in out)
    assert toxicity.with_toxicity(df.where("false"), machine).count() == 0
    assert [r.toxicity for r in toxicity.with_toxicity(df, None).collect()] == [0.0] * 6
    assert toxicity.fit(df.where("false"), spark.createDataFrame([], "doc_id long, toxic int")) is None


def test_quality_odd_input_and_transforms(spark):
    texts = [None, "", " ", "One line. Another, with words here.", "NOISE!! NOISE!! NOISE!! NOISE!!", "a | b | c | d", "é" * 50_000]
    stats = np.array([quality._statistics(t) for t in texts])
    assert np.isfinite(stats).all() and (stats[0] == stats[1]).all() and stats.shape[1] == len(quality.STATISTICS)
    good, bad = sentences(60, 3, False), ["!! ".join(s.upper().split()) for s in sentences(60, 4, False)]
    model = quality.fit_quadratic(np.array([quality._statistics(t) for t in good + bad]), np.array([1] * 60 + [0] * 60))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, good[0], bad[0]])], "doc_id long, text string")
    out = {r.doc_id: r.quality_score for r in quality.with_quality(df, model, keep=["doc_id"]).collect()}
    assert out[0] == out[1] and out[7] > 0.5 > out[8] and all(0 <= v <= 1 for v in out.values())
    assert [r.quality_score for r in quality.with_quality(df, None).collect()] == [0.5] * 9
    assert quality.fit_quadratic(stats, np.ones(len(stats))) is None


def test_quadratic_matches_gaussian_densities():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(80, 3)), rng.normal(2, 3, size=(80, 3))]
    y = np.array([1] * 80 + [0] * 80)
    m = quality.fit_quadratic(x, y, to_pooled=0, to_identity=0)
    z = (x - m.center) / m.scale

    def log_density(p, rows):
        c = np.cov(rows.T, bias=True)
        d = p - rows.mean(axis=0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]

    assert np.allclose(m.difference(x), log_density(z, z[y == 1]) - log_density(z, z[y == 0]))


def test_codewords_are_apart():
    for k in range(1, 12):
        code = language.codewords(k)
        assert code.shape[0] == k and set(np.unique(code)) <= {-1, 1}
        assert len({tuple(r) for r in code}) == k
        if k > 2:
            assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= 2 ** min(k - 2, 2) - 1


def test_language_odd_input(spark):
    texts = ["the cat and the dog", "le chat et le chien", "der hund und die katze"] * 8
    model = language.fit_ecoc(np.array([language._counts(t) for t in texts]), ["en", "fr", "de"] * 8)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog and the cat"), (4, "the dog and the cat"), (5, "die katze " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(1))
    out = language.with_language(df, model).collect()
    by = {r.doc_id: (r.lang_pred, r.lang_score) for r in out}
    assert len(out) == 6 and [by[k][0] for k in (1, 2, 3)] == ["und"] * 3 and by[4][0] == "en" and by[5][0] == "de"
    assert language.with_language(df.where("false"), model).count() == 0
    assert {r.lang_pred for r in language.with_language(df, None).collect()} == {"und"}
    assert language.fit(df.where("false").withColumn("lang", F.lit("en"))) is None


def test_counts_do_not_depend_on_pieces():
    text = " ".join(sentences(50, 9, False))
    whole = language._counts(text)
    old = language.AT_ONCE
    try:
        language.AT_ONCE = 997
        assert (whole == language._counts(text)).all()
        for at_once in (1, 2, 3):
            language.AT_ONCE = at_once
            for t in ("a, b", "ab  c", "...ab", "ab...", "a", ". .", " x. y "):
                language.AT_ONCE = old
                want = language._counts(t)
                language.AT_ONCE = at_once
                got = language._counts(t)
                assert (want is None and got is None) or (want == got).all(), (t, at_once)
    finally:
        language.AT_ONCE = old


@pytest.mark.parametrize("name,label,parts,out", [("op1_toxicity", "toxic", 5, 0), ("op3_quality", "quality", 3, 1)])
def test_held_out_accuracy(spark, name, label, parts, out):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES[name](spark, DATA).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == out) and r.predicted == int(r.score >= 0.5) for r in got.values())
    known = spark.read.parquet(f"{DATA}/labels.parquet").join(docs.select("doc_id"), "doc_id").collect()
    held = [(got[r.doc_id].predicted, r[label]) for r in known if got[r.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9


def test_language_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op8_language"](spark, DATA).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in got if r.held_out]) > 0.98


def test_labels_that_disagree_or_are_null_teach_nothing(spark):
    from foliant.llm.training import labelled_sample

    docs = spark.createDataFrame([(i, t) for i in range(1, 6) for t in (f"text {i}", f"other {i}")] * 2, "doc_id long, text string")
    rows = [(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (None, 1), (4, 0), (4, 0), (5, 0), (9, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, label int")
    for part in (1, 7):
        assert labelled_sample(docs.repartition(part), labels.repartition(part), F.lit(True)) == (["other 2", "other 4", "other 5"], [1, 0, 0])
    one = labelled_sample(docs, labels, F.lit(True), per_label=1)
    assert len(one[0]) == 2 and sorted(one[1]) == [0, 1]


def test_a_sample_is_full_though_most_candidates_cannot_be_used(spark):
    from foliant.llm.training import labelled_sample

    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 6 = 0, 'fits', repeat('x', 50)) AS text")
    labels = spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS label")
    texts, y = labelled_sample(docs, labels, F.lit(True), per_label=100, longest=10)
    assert y.count(0) == 100 and y.count(1) == 0 and set(texts) == {"fits"}
    texts, y = labelled_sample(docs, labels.selectExpr("doc_id", "CAST(doc_id % 5 AS INT) AS label"), F.lit(True), per_label=10, longest=10)
    assert [y.count(k) for k in range(5)] == [10] * 5


def test_an_id_in_two_languages_teaches_nothing_and_over_500_languages_raise(spark):
    rows = [(1, "aa bb", "x"), (1, "aa bb", "y"), (2, "cc dd", "x"), (3, "ee ff", "y"), (3, "ee ff", "y")]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    a = language.fit(docs, parts=1, held_out=9)
    b = language.fit(docs.where("doc_id > 1").dropDuplicates(["doc_id"]), parts=1, held_out=9)
    assert a.languages == b.languages == ["x", "y"] and (a.weights == b.weights).all()
    many = spark.range(501).selectExpr("id AS doc_id", "'some text' AS text", "CAST(id AS STRING) AS lang")
    with pytest.raises(ValueError, match="more than 500 labels"):
        language.fit(many, parts=1, held_out=9)
    assert len(language.fit(many, parts=1, held_out=9, most_languages=600).languages) == 501


def test_a_language_of_long_texts_alone_is_learnt_and_too_many_languages_raise(spark):
    rows = [(i, "der die das und nicht " * 1500, "de") if i % 2 else (i, "the and of that with " * 3, "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(docs).languages == ["de", "en"]
    with pytest.raises(ValueError, match="more than 1 labels"):
        language.fit(docs, most_languages=1)
