"""Registered queries over the driver's tables against plain versions of what the contracts ask."""

import hashlib
import math
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_dedup import brute, vectors

from foliant.llm import language, png_media, toxicity
from foliant.llm.common import table
from foliant.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in table(spark, DATA, "documents").collect()}


def crc(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


# ---- op1: every window summed by the definition ----


def plain_fold(text):
    out = [0]
    for ch in text or "":
        if ch.isspace():
            out.append(0)
        elif ch.isalpha():
            base = unicodedata.normalize("NFKD", ch)[0].lower()
            out.append(ord(base) - 96 if "a" <= base <= "z" else ord(ch) % 26 + 1)
    out.append(0)
    out = [x for k, x in enumerate(out) if x or not k or out[k - 1]]
    # A letter that stands alone before another one that does is joined with it.
    zero = lambda k: not 0 <= k < len(out) or out[k] == 0
    return [x for k, x in enumerate(out) if not (x == 0 and 0 < k < len(out) - 1 and zero(k - 2) and zero(k + 2))]


def plain_worst(machine, text):
    s = plain_fold(text)
    n = len(s)
    s = s + [toxicity.NOTHING] * (toxicity.STARTS + toxicity.SPAN)
    base, total = toxicity.SYMBOLS, []
    for i in range(n + toxicity.STARTS - 1):
        here = 0.0
        for a, b, d in toxicity.PATTERNS:
            if i + d < len(s):
                here += float(machine.table[((s[i] * base + s[i + a]) * base + s[i + b]) * base + s[i + d]]) * toxicity.DECAY ** (d - 3)
        total.append(here)
    return max(sum(total[i : i + toxicity.STARTS]) for i in range(n))


def plain_toxicity(machine, text):
    return 1 / (1 + math.exp(-(plain_worst(machine, text) * machine.calibration[0] + machine.calibration[1])))


def test_toxicity_query(spark, docs):
    machine = toxicity.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, DATA).collect()}
    assert set(got) == set(docs)
    for k, r in got.items():
        assert r.held_out == (crc(k, 5) == 0) and r.predicted == int(r.score >= 0.5)
        if len(docs[k].text or "") < 4000:
            assert r.score == pytest.approx(plain_toxicity(machine, docs[k].text) if machine else 0.0, abs=1e-4)


# ---- op3: the model fitted anew from plain statistics ----


def plain_statistics(text):
    text = text or ""
    kinds = Counter()
    for ch in text:
        cat = unicodedata.category(ch)
        special = next((k for k, cs in (("quote", "'\"()-’‘“”«»–"), ("comma", ",;:"), ("stop", ".?!…"), ("line", "\n\r\x0b\x0c  "), ("space", " \t")) if ch in cs), None)
        kinds[special or {"Lu": "upper", "Lt": "upper"}.get(cat) or {"L": "letter", "M": "letter", "N": "digit", "Z": "space"}.get(cat[0], "symbol")] += 1
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, seen = len(words), sum(kinds.values()) - kinds["space"] - kinds["line"]
    root = lambda a, b: math.sqrt(a / b) if b else 0.0
    sizes, counts = [len(w) for w in words], Counter(words)
    mean = sum(sizes) / n if n else 0.0
    return [
        math.log1p(n), math.log1p(mean), math.log1p(math.sqrt(sum((x - mean) ** 2 for x in sizes) / n)) if n else 0.0,
        root(kinds["upper"], kinds["upper"] + kinds["letter"]), root(kinds["digit"], seen), root(kinds["symbol"], seen),
        root(min(kinds["stop"], 4 * n), n), root(min(kinds["comma"], 4 * n), n), root(kinds["quote"], seen),
        root(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), math.log(len(counts) / n) / math.log1p(n) if n else 0.0,
        root(max(counts.values()), n) if n else 0.0, math.log1p(n / len(lines)) if lines else 0.0,
        root(len(lines) - len(set(lines)), len(lines)), root(sum(not w[0].isalnum() for w in counts), len(counts)),
    ]


def test_quality_query(spark):
    data = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    known = {r.doc_id: r.quality for r in table(spark, data, "labels").collect()}
    stats = {k: plain_statistics(t) for k, t in docs.items()}
    learn = [k for k in known if k in docs and crc(k, 3) != 1 and docs[k] is not None and len(docs[k]) <= 20_000]
    x, y = np.array([stats[k] for k in learn]), np.array([known[k] for k in learn])
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - mean) / sd
    each = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * each[k] for k in (0, 1))
    shrunk = []
    for c in each:
        c = 0.9 * c + 0.1 * pooled
        shrunk.append(0.95 * c + 0.05 * np.trace(c) / 15 * np.eye(15))

    def value(rows):
        logs = []
        for k in (0, 1):
            d = (np.array(rows) - mean) / sd - z[y == k].mean(axis=0)
            logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(shrunk[k]), d) - 0.5 * np.linalg.slogdet(shrunk[k])[1])
        d = logs[1] - logs[0]
        return np.sign(d) * np.log1p(np.abs(d))

    v, w, b = value(x), np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()), np.zeros(2)
    for _ in range(200):  # the calibration's loss is convex: any way to its minimum will do
        p = 1 / (1 + np.exp(-(b[0] * v + b[1])))
        grad = np.array([(w * (p - y) * v).sum(), (w * (p - y)).sum()]) + b
        curve = w * p * (1 - p)
        b -= np.linalg.solve(np.array([[(curve * v * v).sum() + 1, (curve * v).sum()], [(curve * v).sum(), curve.sum() + 1]]), grad)
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, data).collect()}
    assert set(got) == set(docs)
    ids = list(docs)
    want = 1 / (1 + np.exp(-np.clip(b[0] * value([stats[k] for k in ids]) + b[1], -30, 30)))
    assert [got[k].score for k in ids] == pytest.approx(want.tolist(), abs=1e-6)
    assert all(got[k].held_out == (crc(k, 3) == 1) and got[k].predicted == int(got[k].score >= 0.5) for k in ids)


# ---- op8: n-grams counted one by one, bits learnt by plain gradient steps ----


def plain_counts(text):
    symbols = [0]
    for ch in (text or "").lower():
        c = ord(ch) if ch.isalpha() else 0
        if c or symbols[-1]:
            symbols.append(c)
    if symbols == [0]:
        return None
    symbols.append(0)
    full, total = 2**32 - 1, np.zeros(language.BUCKETS)
    a = [c * 2654435761 & full for c in symbols]
    two = [((a[i] >> 7) + (symbols[i + 1] * 40503 & full) & full) ^ a[i + 1] for i in range(len(a) - 1)]
    three = [(two[i] * 31 & full) + (a[i + 2] >> 3) & full for i in range(len(a) - 2)]
    for h, on in ((a, symbols), (two, [p or q for p, q in zip(symbols, symbols[1:], strict=False)]), (three, symbols[1:-1])):
        for value, use in zip(h, on, strict=True):
            if use:
                total[(value * 2246822519 & full) >> 19] += 1
    return np.sqrt(total / total.sum())


def plain_languages(rows):
    """Languages, codewords, weights and trust learnt from (text, lang) rows."""
    learn = [(c, lang) for t, lang in rows if (c := plain_counts(t)) is not None]
    names = sorted({lang for _, lang in learn})
    code = language.codewords(len(names))
    x, y = np.array([c for c, _ in learn]), np.array([names.index(lang) for _, lang in learn])
    each, target = (1 / (np.bincount(y)[y] * len(names)))[:, None], code[y]
    w, b = [np.zeros((language.BUCKETS, code.shape[1]))] * 2, [np.zeros(code.shape[1])] * 2
    for t in range(150):
        at, bt = w[1] + t / (t + 3) * (w[1] - w[0]), b[1] + t / (t + 3) * (b[1] - b[0])
        pull = -target * each / (1 + np.exp(np.clip(target * (x @ at + bt), -30, 30)))
        w, b = [w[1], at - 8.0 * (x.T @ pull + 1e-5 * at)], [b[1], bt - 8.0 * pull.sum(axis=0)]
    right = np.clip(((target * (x @ w[1] + b[1]) > 0) * each).sum(axis=0), 0.5, 0.999)
    trust = np.clip(np.log(right / (1 - right)), 0.05, None)
    return names, code, w[1], b[1], trust / trust.mean()


def plain_language(model, text):
    """(language, probability, that of the second) of a text; None without a letter."""
    names, code, w, b, trust = model
    c = plain_counts(text)
    if c is None:
        return None
    loss = (np.log1p(np.exp(-np.clip((c @ w + b) * code, -30, 30))) * trust).sum(axis=1)
    p = np.exp(-loss) / np.exp(-loss).sum()
    return names[int(loss.argmin())], float(p.max()), float(np.sort(p)[-2])


def test_language_query(spark, docs):
    model = plain_languages([(r.text, r.lang) for k, r in sorted(docs.items()) if r.lang is not None and r.text is not None and crc(k, 4) != 2 and len(r.text) <= 20_000])
    got = {r.doc_id: r for r in QUERIES["op8_language"](spark, DATA).collect()}
    assert set(got) == set(docs)
    for k, r in got.items():
        want = plain_language(model, docs[k].text)
        assert r.held_out == (crc(k, 4) == 2)
        if want is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == want[0] and r.score == pytest.approx(want[1], abs=0.02)


# ---- op2, op4, op7, op10 ----


def test_embedding_query_and_sql_over_planted_pairs(spark, tmp_path):
    own = [(r.vec_id, [float(x) for x in r.embedding]) for r in table(spark, DATA, "embeddings").collect()]
    more = vectors(11, 10, 12, dims=64, noise=0.02) + vectors(12, 20, 2, dims=64, noise=0.02)
    odd = [own[0][1], own[0][1], [0.0] * 64, [float("nan")] * 64, [float("inf")] * 64, None, [], own[1][1][:8]]
    rows = own + [(10_000 + i, v) for i, v in enumerate([*more, *odd])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in QUERIES["op2_embedding_dedup"](spark, str(tmp_path)).collect()}
    exact = [(r.vec_id, None if r.embedding is None else list(r.embedding)) for r in df.collect()]
    links, comps = brute(exact)
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (links[k], comps[k], k == comps[k]) for k in links}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    said = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({SQL['op2_embedding_dedup']})").fetchall()
    assert {r[0]: r[1:] for r in said} == {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} and sum(links.values()) > 200


def test_media_query(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op4_png_media"](spark, DATA).collect()}
    assert set(got) == set(docs)
    alike = {}
    for k, r in got.items():
        data = (docs[k].text or "").encode()
        full = data + b"\0" * (max(1, -(-len(data) // 64)) * 64 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        media = png_media.encode_png(full, len(data))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert alike.setdefault(data, r.feature) == r.feature


def test_packing_query(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, Counter()
    for r in QUERIES["op7_packing"](spark, DATA).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences[r.sequence_id] += 1
        assert r.offset == 0 and r.length <= 2048 and r.length & (r.length - 1) == 0
    assert set(pieces) == set(docs) and set(sequences.values()) == {1}
    for k, rows in pieces.items():
        ids = np.array([*lib.encode(docs[k].text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_bpe_query(spark, docs):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    lib = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, DATA).collect()}
    assert set(got) == set(docs)
    for k, r in got.items():
        ids = lib.encode_ordinary(docs[k].text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[k].text or "").encode()).hexdigest()
