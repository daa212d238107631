"""Embedding near-duplicates by sorted projection passes.

Each pass orders the distinct vectors lexicographically by concatenated random hashes and compares
each with the bounded window of its neighbours; verified pairs are united across passes. The hashes
of a pass are, one after the other, the nearest of some random rows, the nearest of random rows of
that cell, and the signs of random projections of what is left; as the rows are drawn from the data, a
crowded region gets as many cells as it has rows. Passes come in rounds, until a round unites nothing
any more: what a round misses the next one mostly finds, so the links that are missed in the end are few
whatever the number of vectors and however crowded they are. Links inside a component are then counted
exactly: by blocks of bounded size, and in large components by an angle bound, as two vectors whose
angles to a third sum to at most the link angle must be linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import Scratch
from foliant.llm.components import connected_components

THRESHOLD = 0.95
#: Passes of a round, neighbours compared on either side, sign bits of a sort key.
PASSES, WINDOW, BITS = 2, 2048, 64
#: Cells of a pass, rows drawn for a round at most, and numbers that they hold at most.
CELLS, DRAWN, DRAWN_NUMBERS = 64, 4096, 1 << 19
#: Rows of a component that one task compares at once; rows of a matrix product; numbers of a block of vectors.
BLOCK, STEP, NUMBERS = 1024, 512, 1 << 20
#: Blocks at least in the comparison of all pairs.
LEAST_BLOCKS = 8
SEED = 20_240_601

KEY = T.BinaryType()


def _matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _units(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _slack(dims: int) -> float:
    """What single precision may lose of the product of two unit vectors."""
    return 2.0**-22 * (dims + 16)


def keyed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, key, v): the vector as given, and a digest of it in double precision.

    Vectors that are null, empty, zero, or hold null or non-finite components have null key and v.
    """
    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    schema = T.StructType([src.schema["id"], T.StructField("key", KEY), src.schema["v"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()  # without what null lists hold
            x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            ends = np.cumsum(sizes)
            some = sizes > 0
            starts = (ends - sizes)[some]
            good = np.zeros(len(sizes), bool)
            if len(x):
                good[some] = np.logical_and.reduceat(np.isfinite(x), starts) & np.logical_or.reduceat(x != 0, starts)
            raw = memoryview(x).cast("B")
            keys = [
                hashlib.blake2b(raw[8 * (e - n) : 8 * e], digest_size=16).digest() if ok else None
                for e, n, ok in zip(ends.tolist(), sizes.tolist(), good.tolist(), strict=True)
            ]
            v = pc.if_else(pa.array(good), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), v], names=schema.names)

    return src.mapInArrow(run, schema)


class Hashes:
    """The random hashes of one pass over vectors of one length, from rows drawn from the data."""

    def __init__(self, drawn: np.ndarray, dims: int, bits: int, seed: list[int]):
        rng = np.random.default_rng(seed)
        own = drawn[rng.permutation(len(drawn))[: -(-len(drawn) // 2)]]
        self.top = own[:CELLS]
        cell = (own @ self.top.T).argmax(axis=1) if len(own) else np.zeros(0, int)
        self.sub = [own[cell == c][:256] for c in range(len(self.top))]
        self.planes = rng.standard_normal((dims, bits)).astype(np.float32)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One row of bytes for each unit vector: cell, cell within it, signs of the rest."""
        first, second, rest = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8), x
        if len(self.top):
            first = (x @ self.top.T).argmax(axis=1).astype(np.uint8)
            rest = x.copy()
            for c in np.unique(first).tolist():
                at = np.flatnonzero(first == c)
                near = (x[at] @ self.sub[c].T).argmax(axis=1)
                second[at] = near
                rest[at] -= self.sub[c][near]
        return np.c_[first, second, np.packbits(rest @ self.planes > 0, axis=1)]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest node of each component of the graph with edges (a, b)."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _links(
    m: np.ndarray, code: np.ndarray, place: np.ndarray, first: int, window: int, threshold: float, until: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes (two arrays) that linked rows at most `window` places apart unite.

    Of each pair the later row is at index `first` or behind, the other one before `until`; rows are in
    the order of their places.
    """
    rough, slack = m.astype(np.float32), _slack(m.shape[1])
    for s in range(0, len(m) if until is None else until, STEP):
        e = min(s + STEP, len(m))
        lo, hi = max(s, first), int(np.searchsorted(place, place[e - 1] + window, "right"))
        if lo >= hi:
            continue
        near = rough[s:e] @ rough[lo:hi].T
        i, j = np.divmod(np.flatnonzero(near.ravel() >= np.float32(threshold - slack)), hi - lo)
        value = near[i, j]
        i, j = i + s, j + lo
        on = (i < j) & (place[j] - place[i] <= window) & (code[i] != code[j])
        i, j, value = i[on], j[on], value[on]
        for k in np.array_split(np.flatnonzero(value < threshold + slack), len(i) // 50_000 + 1):
            value[k] = np.where(np.einsum("ij,ij->i", m[i[k]], m[j[k]]) >= threshold, 2.0, -2.0)
        i, j = i[value > -2], j[value > -2]
        if len(i):
            yield _forest(code[i], code[j])


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with equal values in all columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    cuts = [*np.flatnonzero(new).tolist(), len(new)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _united(t: pa.Table, place: np.ndarray, first: int, window: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b) components that linked rows of a pass unite; `t` has pass, component and v, in order."""
    comps = t.column("component").combine_chunks().dictionary_encode()
    code, v = comps.indices.to_numpy(), t.column("v").combine_chunks()
    sizes = pc.list_value_length(v).to_numpy()
    for s, e in _runs(t.column("pass").to_numpy(), sizes):
        if e > first:
            for a, b in _links(_matrix(v.slice(s, e - s)), code[s:e], place[s:e], max(0, first - s), window, threshold):
                yield pa.RecordBatch.from_arrays([comps.dictionary.take(pa.array(x)) for x in (a, b)], names=["a", "b"])


def pass_edges(classes: DataFrame, scratch: Scratch, threshold: float, passes: int, window: int, bits: int, round_no: int = 0, seed: int = SEED) -> DataFrame:
    """(a, b) components of (key, component, v) that the passes of a round unite.

    Every row is dealt by range of its sort key once per pass. A task compares the rows of its range as
    they stream by; rows within a window of its ends are compared with those of other ranges by their
    places in the whole order, so the pairs that are compared do not depend on the partitioning.
    """
    n, dims = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    drawn_rows = max(CELLS, min(DRAWN, DRAWN_NUMBERS // max(1, dims)))
    cut = min(2**63 - 1, 2**64 * drawn_rows // max(1, n) - 2**63)
    drawn: dict[int, list[np.ndarray]] = {}
    for r in classes.where(F.xxhash64(F.lit(f"{seed}-{round_no}"), "key") <= cut).select("key", "v").limit(2 * drawn_rows).toArrow().sort_by("key").column("v"):
        x = r.values.to_numpy(zero_copy_only=False).astype(np.float64)
        drawn.setdefault(len(x), []).append(_units(x[None, :])[0].astype(np.float32))
    rows_of = {d: np.array(x) for d, x in drawn.items()}
    v_field = classes.schema["v"]
    own = [T.StructField("pass", T.LongType()), T.StructField("sort_key", KEY), T.StructField("component", KEY), T.StructField("key", KEY), v_field]
    hashed_schema = T.StructType(own)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], Hashes] = {}
        for b in batches:
            lengths = pc.list_value_length(b.column(2)).to_numpy()
            for d in np.unique(lengths).tolist():
                some = b.filter(pa.array(lengths == d))
                for s in range(0, some.num_rows, 4096):
                    part = some.slice(s, 4096)
                    x = _matrix(part.column(2)).astype(np.float32)
                    for p in range(passes):
                        if (d, p) not in made:
                            made[d, p] = Hashes(rows_of.get(d, np.zeros((0, d), np.float32)), d, bits, [seed, round_no, p, d])
                        head = d.to_bytes(4, "big")
                        keys = [head + k.tobytes() for k in made[d, p].keys(x)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(part.num_rows, p)), pa.array(keys, pa.binary()), part.column(1), part.column(0), part.column(2)],
                            names=hashed_schema.names,
                        )

    found = T.StructType(
        [T.StructField("a", KEY), T.StructField("b", KEY), T.StructField("part", T.LongType()), T.StructField("at", T.LongType()), own[0], own[2], v_field]
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges within the range; its rows near the ends, with their places in it; its number of rows."""
        me, seen, tail = TaskContext.get().partitionId(), 0, None

        def kept(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            made = pa.table([pa.nulls(len(at), pa.binary())] * 2 + [pa.array(np.full(len(at), me)), pa.array(at), *t.select(["pass", "component", "v"]).columns], names=found.names)
            yield from made.to_batches()

        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = pa.Table.from_batches([b.slice(s, 4096)])
                old = 0 if tail is None else tail.num_rows
                both = part if tail is None else pa.concat_tables([tail, part]).combine_chunks()
                for e in _united(both, np.arange(seen - old, seen + part.num_rows), old, window, threshold):
                    none = [pa.nulls(e.num_rows, f.type) for f in (pa.field("part", pa.int64()), pa.field("at", pa.int64()), *(part.schema.field(c) for c in ("pass", "component", "v")))]
                    yield pa.RecordBatch.from_arrays([*e.columns, *none], names=found.names)
                if seen < window:
                    yield from kept(part.slice(0, window - seen), np.arange(seen, min(window, seen + part.num_rows)))
                seen += part.num_rows
                tail = both.slice(max(0, both.num_rows - window))
        if tail is not None:
            last = tail.slice(max(0, tail.num_rows - max(0, seen - window)))  # the first ones were given before
            yield from kept(last, np.arange(seen - last.num_rows, seen))
            nothing = [pa.nulls(1, pa.binary())] * 2
            kinds = [tail.schema.field(c).type for c in ("pass", "component", "v")]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([me]), pa.array([seen]), *(pa.nulls(1, k) for k in kinds)], names=found.names)

    order = ["pass", "sort_key", "key"]
    dealt = classes.select("key", "component", "v").mapInArrow(hashed, hashed_schema).repartitionByRange(*order).sortWithinPartitions(*order)
    once = scratch.write(dealt.mapInArrow(compared, found), "windows")
    counts = sorted((r["part"], r["at"]) for r in once.where("a is null and pass is null").select("part", "at").collect())
    ends = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offsets = classes.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(counts, ends, strict=False)], "of long, before long")
    pair = T.StructType(found.fields[:2])
    tile = 2 * window

    def across(t: pa.Table) -> pa.Table:
        t = t.sort_by("place").combine_chunks()
        edges = list(_united(t, t.column("place").to_numpy(), 0, window, threshold))
        return pa.Table.from_batches(edges) if edges else pa.table([pa.array([], pa.binary())] * 2, names=["a", "b"])

    place = F.col("before") + F.col("at")
    tiles = F.when(F.pmod(place, F.lit(tile)) < window, F.array(F.floor(place / tile), F.floor(place / tile) - 1)).otherwise(F.array(F.floor(place / tile)))
    borders = (
        once.where("a is null and pass is not null")
        .join(F.broadcast(offsets), F.col("part") == F.col("of"))
        .select(F.explode(tiles).alias("tile"), place.alias("place"), "pass", "component", "v")
        .groupBy("tile")
        .applyInArrow(across, pair)
    )
    return once.where("a is not null").select("a", "b").union(borders)


def all_edges(classes: DataFrame, scratch: Scratch, threshold: float, numbers: int = NUMBERS, least: int = LEAST_BLOCKS) -> DataFrame:
    """(a, b) components that a linked pair of (key, component, v) joins, from all pairs of vectors.

    The vectors of each length are dealt to blocks of about `numbers` numbers, and each task compares
    two blocks. Work and exchange grow with the square of the rows; no task grows.
    """
    sized = classes.select("key", "component", "v", F.size("v").alias("dims"))
    blocks = scratch.write(
        sized.groupBy(F.col("dims").alias("of")).agg(F.count("*").alias("n")).select(
            "of", F.greatest(F.lit(least), F.ceil(F.col("n") * F.col("of") / numbers)).cast("long").alias("blocks")
        ),
        "blocks",
    )
    mine, other = F.pmod(F.xxhash64("key"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = sized.join(F.broadcast(blocks), F.col("dims") == F.col("of")).select("dims", "component", "v", mine.alias("block"), other.alias("other"))
    dealt = dealt.select("dims", "component", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    out = T.StructType([T.StructField("a", KEY), T.StructField("b", KEY)])

    def compare(t: pa.Table) -> pa.Table:
        comps = t.column("component").combine_chunks().dictionary_encode()
        order = np.argsort(t.column("block").to_numpy(), kind="stable")
        split = int((t.column("block").to_numpy() == t.column("i")[0].as_py()).sum())
        code, m = comps.indices.to_numpy()[order], _matrix(t.column("v"))[order]
        found = list(_links(m, code, np.arange(len(m)), split if split < len(m) else 0, len(m), threshold, split))
        a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, int) for k in (0, 1))
        return pa.table([comps.dictionary.take(pa.array(x)) for x in (a, b)], names=["a", "b"])

    return dealt.groupBy("dims", "i", "j").applyInArrow(compare, out)


def _count_small(members: DataFrame, threshold: float) -> DataFrame:
    """(key, links): copies of the linked classes, for components of at most BLOCK classes, many in a task."""
    out = T.StructType([T.StructField("key", KEY), T.StructField("links", T.LongType())])
    n, dims = members.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    buckets = n * max(1, dims) // NUMBERS + 1

    def count(t: pa.Table) -> pa.Table:
        comp = t.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(comp, kind="stable")
        t, comp = t.take(pa.array(order)), comp[order]
        copies, links = t.column("copies").to_numpy(), np.zeros(len(comp), np.int64)
        sizes = pc.list_value_length(t.column("v")).to_numpy()
        for s, e in _grouped(_runs(comp), STEP, sizes):
            m = _matrix(t.column("v").slice(s, e - s))
            near = (m @ m.T >= threshold) & (comp[s:e, None] == comp[None, s:e])
            np.fill_diagonal(near, False)
            links[s:e] = near @ copies[s:e]
        return pa.table([t.column("key"), pa.array(links)], names=["key", "links"])

    bucket = F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket")
    return members.select("key", "component", "copies", "v", bucket).groupBy("bucket").applyInArrow(count, out)


def _grouped(runs: list[tuple[int, int]], rows: int, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole runs, of about `rows` rows and vectors of one length (those of a component are)."""
    start = None
    for s, e in runs:
        if start is not None and (s - start >= rows or sizes[s] != sizes[start]):
            yield start, s
            start = None
        start = s if start is None else start
    if start is not None:
        yield start, runs[-1][1]


def _count_large(members: DataFrame, scratch: Scratch, threshold: float, numbers: int) -> DataFrame:
    """(key, links) for larger components, in tasks of bounded size.

    Vectors within half the link angle of their component's mean are all linked with one another, by
    the triangle inequality for angles, and are only counted. What lies farther out is compared with
    the whole component, in blocks of about `numbers` numbers.
    """
    sums = T.StructType([T.StructField("of", KEY), T.StructField("pivot", T.ArrayType(T.DoubleType()))])

    def added(comps: pa.Array, m: np.ndarray) -> pa.Table:
        comps = comps.dictionary_encode()
        made = np.zeros((len(comps.dictionary), m.shape[1]))
        np.add.at(made, comps.indices.to_numpy(), m)
        return pa.table([comps.dictionary, pa.array(list(made), pa.list_(pa.float64()))], names=["of", "pivot"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).to_numpy()
            for d in np.unique(sizes).tolist():
                own = b.filter(pa.array(sizes == d))
                yield from added(own.column(0), _matrix(own.column(1))).to_batches()

    def total(t: pa.Table) -> pa.Table:
        flat = t.column("pivot").combine_chunks()
        return added(t.column("of").combine_chunks(), flat.flatten().to_numpy().reshape(len(flat), -1))

    pivots = scratch.write(members.select("component", "v").mapInArrow(partial, sums).groupBy("of").applyInArrow(total, sums), "pivots")
    half = float(np.arccos(threshold)) / 2 - 1e-9
    kept = members.select("component", "key", "copies", "v", F.size("v").alias("dims"))
    placed_schema = T.StructType([*kept.schema.fields, T.StructField("core", T.BooleanType())])

    def placed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core = np.zeros(b.num_rows, bool)
            sizes = b.column(4).to_numpy()
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                own = b.take(pa.array(at))
                pivot = own.column(5).flatten().to_numpy().reshape(len(at), d)
                norm = np.sqrt((pivot * pivot).sum(axis=1))
                cos = np.einsum("ij,ij->i", _matrix(own.column(3)), pivot) / np.maximum(norm, 1e-300)
                core[at] = (norm > 0) & (np.arccos(np.clip(cos, -1, 1)) <= half)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(core)], names=placed_schema.names)

    placed = kept.join(pivots, F.col("component") == F.col("of")).select(*kept.columns, "pivot").mapInArrow(placed_rows, placed_schema)
    placed = scratch.write(placed, "placed")
    rows = F.greatest(F.lit(1), F.floor(F.lit(numbers) / F.max("dims")))
    totals = scratch.write(
        placed.groupBy(F.col("component").alias("of")).agg(
            F.coalesce(F.sum(F.when(F.col("core"), F.col("copies"))), F.lit(0)).alias("core_copies"),
            F.ceil(F.count_if(~F.col("core")) / rows).alias("outer_blocks"),
            F.ceil(F.count("*") / rows).alias("blocks"),
        ),
        "totals",
    )
    known = placed.join(totals, F.col("component") == F.col("of"))
    counted = known.where("core").select("key", (F.col("core_copies") - F.col("copies")).alias("links"))
    sides = known.where("outer_blocks > 0")
    spread = lambda n: F.pmod(F.xxhash64("key"), n)
    outer = sides.where("not core").select(
        "component", "key", "copies", "v", F.lit(True).alias("outer"), F.lit(False).alias("core"),
        spread(F.col("outer_blocks")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"),
    )
    all_ = sides.select(
        "component", "key", "copies", "v", F.lit(False).alias("outer"), "core",
        F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)).alias("i"), spread(F.col("blocks")).alias("j"),
    )
    out = T.StructType([T.StructField("key", KEY), T.StructField("links", T.LongType())])

    def count(t: pa.Table) -> pa.Table:
        is_outer = t.column("outer").combine_chunks()
        a, b = t.filter(is_outer), t.filter(pc.invert(is_outer))
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.nulls(0, pa.binary()), pa.array([], pa.int64())], names=["key", "links"])
        x, y = _matrix(a.column("v")), np.ascontiguousarray(_matrix(b.column("v")).T)
        seat = {k: n for n, k in enumerate(b.column("key").to_pylist())}
        own = np.array([seat.get(k, -1) for k in a.column("key").to_pylist()])
        mine, theirs = a.column("copies").to_numpy(), b.column("copies").to_numpy()
        core = b.column("core").to_numpy()
        here, there = np.zeros(len(x), np.int64), np.zeros(len(core), np.int64)
        for s in range(0, len(x), STEP):
            near = x[s : s + STEP] @ y >= threshold
            itself = np.flatnonzero(own[s : s + STEP] >= 0)
            near[itself, own[s : s + STEP][itself]] = False
            here[s : s + STEP] = near @ theirs
            there += mine[s : s + STEP] @ near
        keys = pa.chunked_array([*a.column("key").chunks, *b.filter(b.column("core")).column("key").chunks], pa.binary())
        return pa.table([keys, pa.array(np.r_[here, there[core]])], names=["key", "links"])

    compared = outer.union(all_).groupBy("component", "i", "j").applyInArrow(count, out)
    return counted.union(compared).groupBy("key").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    passes: int = PASSES,
    window: int = WINDOW,
    bits: int = BITS,
    block: int = BLOCK,
    numbers: int = NUMBERS,
    every_pair: bool = False,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Equal vectors are one class: they are compared once and linked with each other. Vectors of
    different lengths, null, empty and zero ones, and those with null or non-finite components link
    with nothing (n_links 0, a component of their own). Rounds of `passes` passes go on until one unites
    nothing; with `every_pair` what they leave apart is then compared in full, at a cost that grows with
    the square of the rows, and no pair can be missed whatever `passes` and `window`. Rows with a null id
    link with nothing. Repeated rows count as copies; of an id with several vectors each has its own row.
    Other columns are not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = scratch.write(keyed(vectors, id_col, vector_col), "rows")
    usable = F.col("key").isNotNull() & F.col("id").isNotNull()
    classes = scratch.write(rows.where(usable).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("v").alias("v")), "classes")
    joined = None
    for n in count():  # every round but the last unites something
        now = _with_components(classes, joined)
        with scratch.inside() as inner:
            edges = scratch.write(pass_edges(now, inner, threshold, passes, window, bits, n), "edges")
        if not edges.limit(1).count():
            break
        joined = _joined(joined, edges, scratch)
    if every_pair:
        with scratch.inside() as inner:
            edges = scratch.write(all_edges(_with_components(classes, joined), inner, threshold, numbers), "edges")
        joined = _joined(joined, edges, scratch)
    if joined is None:
        named = classes.select("key", F.col("id").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
    else:
        with scratch.inside() as inner:
            sizes = joined.groupBy(F.col("component").alias("of")).agg(F.count("*").alias("classes"))
            members = classes.join(joined, classes.key == joined.node).join(inner.write(sizes, "sizes"), F.col("component") == F.col("of"))
            members = inner.write(members.select("component", "key", "id", "copies", "v", "classes"), "members")
            large = members.where(F.col("classes") > block)
            links = _count_small(members.where(F.col("classes") <= block), threshold)
            if large.limit(1).count():
                links = links.union(_count_large(large, inner, threshold, numbers))
            least = inner.write(members.groupBy(F.col("component").alias("of")).agg(F.min("id").alias("component_id")), "least")
            links = inner.write(links, "links").withColumnRenamed("key", "linked")
            known = members.select("key", "component", "copies").join(least, F.col("component") == F.col("of")).join(links, F.col("key") == F.col("linked"))
            known = inner.write(known.select("key", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "known")
            alone = classes.join(known.select("key"), "key", "left_anti").select("key", F.col("id").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
            named = scratch.write(known.union(alone), "named")
    out = rows.where(usable).select("id", "key").join(named, "key").select("id", F.col("n_links").cast("long"), "component_id")
    rest = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _with_components(classes: DataFrame, joined: DataFrame | None) -> DataFrame:
    """(key, component, v): the component that the rounds so far found, or the class's own key."""
    if joined is None:
        return classes.select("key", F.col("key").alias("component"), "v")
    return classes.join(joined, classes.key == joined.node, "left").select("key", F.coalesce("component", "key").alias("component"), "v")


def _joined(joined: DataFrame | None, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the edges so far and new ones between components."""
    if joined is not None:
        edges = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(edges)
    with scratch.inside() as inner:
        return scratch.write(connected_components(edges, "a", "b", inner), "joined")
