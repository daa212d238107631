"""Components, SimHash anchors and embedding passes against brute force."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import embedding_dedup as E
from foliant.llm import simhash as S
from foliant.llm.common import Scratch
from foliant.llm.components import connected_components
from foliant.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(60)]
    df = spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b", Scratch(spark, "t")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(df.where("false"), "a", "b", Scratch(spark, "t")).count() == 0


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for t in [None, "", "\x0b \t", "one", "Two words", "A b C d e a b c", "é É x y", "a b c " * 50]:
        assert S.fingerprint(t) == slow_fingerprint(t)


def test_words_are_cut_at_ascii_space_only():
    assert S.fingerprint("a b c d") != S.fingerprint("a b c d")
    assert S.fingerprint("A\x0cB\x0bC") == S.fingerprint("a b c")


@pytest.mark.parametrize("blocks", [S.BLOCKS, (S.GOLAY_23, S.GOLAY_23, S.HAMMING_15), (S.HAMMING_7, S.HAMMING_15)])
def test_every_near_pair_meets_at_both_homes(blocks):
    code = S.Anchors(blocks, 2)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(300):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    for u, v in ((x, y), (y, x)):
        at, anchor = code.visits(v)
        visited = set(zip(at.tolist(), anchor.tolist(), strict=True))
        assert len(visited) == len(at)
        assert all((i, a) in visited for i, a in enumerate(code.home(u).tolist()))


def test_perfect_codes_cover():
    for code in (S.GOLAY_23, S.HAMMING_15, S.HAMMING_7):
        leaders = code.near(0)[0]
        assert [len(x) for x in leaders] == [1] * len(leaders)


def test_links_and_components_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = list(base)
    for f in base[:20]:
        for _ in range(6):
            g = f
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                g ^= np.uint64(1) << np.uint64(b)
            fps.append(g)
    fps = sorted({int(f) for f in fps})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = S.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert len(got) == len(want) and {tuple(sorted((r.a, r.b))) for r in got} == want


def near_copy_docs():
    rng = np.random.default_rng(5)
    docs = []
    for g in range(12):
        words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(150 + g)]
        for k in range(4):
            w = list(words)
            for _ in range(k):
                w[int(rng.integers(0, len(w)))] = "changed"
            docs.append(" ".join(w))
    return docs + ["", None, " ", "single", "single", "two words"]


def test_visits_are_never_broadcast(spark):
    prints = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = S.fingerprint_links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_duplicates_of_texts(spark):
    docs = near_copy_docs()
    rows = [(100 - i, t, "x") for i, t in enumerate(docs)] + [(None, docs[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fp = {r[0]: slow_fingerprint(r[1]) for r in rows if r[0] is not None}
    ids = list(fp)
    want = roots(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    out = S.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
    kept = S.drop_near_duplicates(df.union(df.where("doc_id = 100")))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in ids if want[i] == i)
    assert S.near_duplicates(df.where("false")).count() == 0 and S.drop_near_duplicates(df.where("false")).count() == 0


def test_no_unique_text_goes_where_an_id_is_repeated(spark):
    base = near_copy_docs()
    a, b, c = base[0], base[4], base[8]
    rows = [(1, a, 0), (1, b, 1), (1, b, 1), (2, b, 2), (3, c, 3), (2, c, 4), (4, "lone", 5), (None, a, 6)]
    for part in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(part)
        kept = S.drop_near_duplicates(df)
        assert kept.columns == df.columns
        got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
        assert got == sorted([(0, a), (1, a), (1, b), (2, c), (4, "lone")])


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from foliant.llm.common import _shared_folder

    context = N(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        _shared_folder(N(sparkContext=context))
    context.getConf = lambda: {"spark.checkpoint.dir": "s3://shared"}
    assert _shared_folder(N(sparkContext=context)) == "s3://shared"


def test_scratch_inside_deletes_what_was_written_within(spark):
    outer = Scratch(spark, "t")
    with outer.inside():
        own = Scratch(spark, "inner")
        lost = own.write(spark.range(3), "a")
        assert own.root.startswith(outer.root) and lost.count() == 3
        kept = outer.write(lost, "b")
    with pytest.raises(Exception, match="(?i)not exist"):
        spark.read.parquet(own.root + "/a-1").count()
    assert kept.count() == 3 and not Scratch(spark, "x").root.startswith(outer.root)


def test_op9_collects_no_visits(spark, monkeypatch):
    plans = []

    def noted(links, *rest):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return connected_components(links, *rest)

    monkeypatch.setattr(S, "connected_components", noted)
    rows = QUERIES["op9_simhash"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_op9_collects_no_rows_fingerprints_or_links(spark, monkeypatch):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    plans, write = {}, Scratch.write

    def note(df, name):
        plans[f"{len(plans)} {name}"] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(Scratch, "write", lambda self, df, name, **options: write(self, note(df, name), name, **options))
    note(QUERIES["op9_simhash"](spark, "/root/testdata/sf0.001"), "op9")
    docs = spark.createDataFrame(list(enumerate(near_copy_docs())), "doc_id long, text string")
    note(S.near_duplicates(docs), "linked")
    note(S.drop_near_duplicates(docs.union(docs.where("doc_id < 9").withColumn("text", F.lit("another one")))), "kept")
    assert sum("large" in name for name in plans) >= 3
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == []


def test_simhash_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    fp = {k: slow_fingerprint(t) for k, t in docs.items()}
    want = roots(fp, [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, DATA).collect()}
    assert got == {k: (f"{fp[k]:016x}", want[k]) for k in docs}


def vectors(seed, clusters=12, size=20, dims=16, noise=0.04):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(clusters):
        c = rng.normal(size=dims)
        out += [c / np.linalg.norm(c) + noise * rng.normal(size=dims) for _ in range(size)]
    return [v.tolist() for v in out]


def brute(rows, threshold=0.95):
    ok = {}
    for i, v in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i] = x / np.linalg.norm(x)
    links = {i: 0 for i, _ in rows}
    edges = []
    for a, b in itertools.combinations(ok, 2):
        if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold:
            links[a] += 1
            links[b] += 1
            edges.append((a, b))
    return links, roots(links, edges)


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_groups_against_brute_force(spark, block):
    data = vectors(1) + vectors(2, 30, 2) + vectors(3, 1, 60, noise=0.075)
    rows = [(i, v) for i, v in enumerate(data)]
    rows += [(900 + i, data[0]) for i in range(5)] + [(910, [2 * x for x in data[0]])]
    rows += [(950, None), (951, []), (952, [0.0] * 16), (953, [float("nan")] * 16), (954, [None, *data[0][1:]]), (955, [float("inf"), *data[0][1:]]), (956, data[0][:8])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    links, comps = brute(rows)
    out = E.near_duplicates(df, block=block).collect()
    assert len(out) == len(rows)
    assert {r.vec_id: r.component_id for r in out} == comps
    assert {r.vec_id: r.n_links for r in out} == links
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_embedding_repeated_rows_null_ids_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v), (1, v), (2, v), (None, v)], "vec_id long, embedding array<double>")
    out = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in E.near_duplicates(df).collect())
    assert out == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert E.near_duplicates(df.where("false")).count() == 0


def test_embedding_recall_on_pairs_near_the_threshold(spark):
    """Pairs of cosine 0.95 to 0.96 in a crowd: the passes must find nearly all."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        d = rng.normal(size=64)
        d -= (d @ a) * a
        d /= np.linalg.norm(d)
        c = rng.uniform(0.95, 0.96)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * d).tolist())]
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.where("n_links > 0").count() >= 0.97 * len(rows)


def crowd(rng, rows, cosine, dims=64):
    """`rows` vectors of which a third is in a cone of mutual cosine `cosine`, every other one of it with a linked partner."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    axis, n = unit(rng.normal(size=(1, dims))), rows // 6
    side = lambda a: unit((d := rng.normal(size=(len(a), dims))) - (d * a).sum(axis=1, keepdims=True) * a)
    axes = np.repeat(axis, n, axis=0)
    cone = np.sqrt(cosine) * axes + np.sqrt(1 - cosine) * side(axes)
    partner = 0.953 * cone + np.sqrt(1 - 0.953**2) * side(cone)
    return np.r_[cone, partner, unit(rng.normal(size=(rows - 2 * n, dims)))], n


def test_embedding_links_in_a_crowd_are_all_found(spark):
    m, n = crowd(np.random.default_rng(4), 9000, 0.8)
    near = m @ m.T >= 0.95
    want = near.sum(axis=1) - 1
    assert near[np.arange(n), np.arange(n, 2 * n)].all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df).collect()}
    assert np.array([got[i] == want[i] for i in range(len(m))]).mean() >= 0.99
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df, window=64, every_pair=True).collect()}
    assert [got[i] for i in range(len(m))] == want.tolist()


def test_embedding_groups_do_not_need_the_passes(spark):
    rows = list(enumerate(vectors(6, 20, 6) + [v[:8] for v in vectors(7, 10, 4)]))
    links, comps = brute(rows)
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), passes=1, window=1, every_pair=True).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {i: (links[i], comps[i]) for i in links}


@pytest.mark.parametrize("window", [3, 40])
def test_embedding_windows_reach_across_any_number_of_ranges(spark, window):
    """The pairs compared are those of the whole order, however few rows a range has."""
    data = vectors(1, 40, 5) + [v[:8] for v in vectors(2, 20, 3)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    found = []
    try:
        for n in (1, 4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            scratch = Scratch(spark, "t")
            classes = scratch.write(E.keyed(df).where("key is not null").selectExpr("key", "key as component", "v"), "classes")
            edges = [(bytes(r.a), bytes(r.b)) for r in E.pass_edges(classes, scratch, 0.95, 2, window, 64).collect()]
            nodes = {x for e in edges for x in e}
            found.append(roots(nodes, edges))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and found[0]


def test_embedding_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [1.0, 0.01])]
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert out == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_window_edges_stay_within_passes(spark):
    assert E.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).where(F.col("n_links") > 0).count() == 0
