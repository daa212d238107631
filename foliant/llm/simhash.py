"""SimHash near-duplicates by anchor-point covering.

A covering code gives the anchors. Every fingerprint is at home at its nearest anchor and visits
every anchor within covering radius plus threshold; a pair within the threshold therefore meets at
the home of either, and is compared there. The code is a product of perfect codes on blocks of the
fingerprint: block i of a point is within radius R_i of its home, so a visitor t bits away from that
point has excesses max(0, d_i - R_i) that sum to at most t. Bits outside the blocks are only compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import Scratch, append_arrow
from foliant.llm.components import connected_components

SEED, WORDS, THRESHOLD = 42, 3, 2
#: Rows that one call of the anchor enumeration makes at most.
ROWS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class PerfectCode:
    """A cyclic perfect code: length, generator polynomial, covering radius."""

    length: int
    generator: int
    radius: int

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        """Remainders of the words as polynomials over GF(2)."""
        degree = self.generator.bit_length() - 1
        rest = words.astype(np.int64)
        for k in range(self.length - 1, degree - 1, -1):
            rest ^= np.where(rest >> k & 1, self.generator << (k - degree), 0)
        return rest

    def near(self, reach: int) -> list[list[np.ndarray]]:
        """near[e][s]: what leads from a word of syndrome s to the anchors with excess e."""
        out = [[[] for _ in range(1 << (self.generator.bit_length() - 1))] for _ in range(reach + 1)]
        for weight in range(self.radius + reach + 1):
            masks = np.array([sum(1 << i for i in c) for c in combinations(range(self.length), weight)], np.int64)
            for mask, s in zip(masks, self.syndrome(masks), strict=True):
                out[max(0, weight - self.radius)][s].append(mask)
        return [[np.array(x, np.int64) for x in level] for level in out]


#: The binary Golay code of length 23, and Hamming codes.
GOLAY_23 = PerfectCode(23, 0b110001110101, 3)
HAMMING_15, HAMMING_7 = PerfectCode(15, 0b10011, 1), PerfectCode(7, 0b1011, 1)
#: 2^24 anchors, up to 68 visits a fingerprint. For more than some 10^8 distinct fingerprints add
#: HAMMING_15: 2^35 anchors, up to 173 visits. Any choice finds the same pairs.
BLOCKS = (GOLAY_23, GOLAY_23)


class Anchors:
    """Enumerates the anchors of 64-bit fingerprints as integers over the blocks' bits."""

    def __init__(self, blocks: Sequence[PerfectCode] = BLOCKS, reach: int = THRESHOLD):
        if sum(b.length for b in blocks) > 63:
            raise ValueError("the blocks must leave an anchor in 63 bits")
        self.blocks, self.reach = tuple(blocks), reach
        self.shifts = np.cumsum([0, *(b.length for b in blocks)])[:-1].tolist()
        self.near = [b.near(reach) for b in blocks]

    def _parts(self, fps: np.ndarray) -> Iterator[tuple[PerfectCode, int, np.ndarray]]:
        for b, at in zip(self.blocks, self.shifts, strict=True):
            yield b, at, (fps >> np.uint64(at) & np.uint64((1 << b.length) - 1)).astype(np.int64)

    def home(self, fps: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fps), np.int64)
        for k, (b, at, part) in enumerate(self._parts(fps)):
            leader = np.array([x[0] for x in self.near[k][0]])
            out |= (part ^ leader[b.syndrome(part)]) << at
        return out

    def visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into fps, anchor) for every anchor whose block excesses sum to at most `reach`."""
        rows, anchors = [], []
        parts = list(self._parts(fps))
        syndromes = [b.syndrome(part) for b, _, part in parts]
        for excess in product(range(self.reach + 1), repeat=len(self.blocks)):
            if sum(excess) > self.reach:
                continue
            at, found = np.arange(len(fps)), np.zeros(len(fps), np.int64)
            for k, e in enumerate(excess):
                lists = self.near[k][e]
                count = np.array([len(x) for x in lists])
                first = np.cumsum(count) - count
                flat = np.concatenate(lists) if count.any() else np.zeros(0, np.int64)
                s = syndromes[k][at]
                n = count[s]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                mask = flat[np.repeat(first[s], n) + step]
                at, found = np.repeat(at, n), np.repeat(found, n)
                found |= (parts[k][2][at] ^ mask) << parts[k][1]
            rows.append(at)
            anchors.append(found)
        return np.concatenate(rows), np.concatenate(anchors)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of XXH64 over the word shingles of the whole text; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and \x20 \x09-\x0d
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = [h(b" ".join(w[j : j + words]), seed) for j in range(i, min(n, i + (1 << 16)))]
        ones += np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = WORDS, keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """Adds `fp` (long, the 64 bits as a signed number), or `name`. A null text counts as one without words."""

    def prints(texts: list[str | None]) -> list:
        return [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return append_arrow(docs, [text_col], prints, [T.StructField(name, T.LongType())], keep)


def fingerprint_links(prints: DataFrame, threshold: int = THRESHOLD, blocks: Sequence[PerfectCode] = BLOCKS) -> DataFrame:
    """(a, b) once for every two values of the distinct `fp` that differ in 1 to `threshold` bits.

    Spark takes the visits for as small as the fingerprints, and would collect and broadcast them, so
    the join is a sort-merge one at every size.
    """
    code = Anchors(blocks, threshold)
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("fp", T.LongType())])
    step = 1 << 13

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(code.home(fp.view(np.uint64))), b.column(0)], names=["anchor", "fp"])

    def visitors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(whole), step):
                fp = whole[i : i + step]
                at, anchor = code.visits(fp.view(np.uint64))
                for j in range(0, len(at), ROWS_AT_ONCE):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[j : j + ROWS_AT_ONCE]), pa.array(fp[at[j : j + ROWS_AT_ONCE]])], names=["anchor", "fp"]
                    )

    only = prints.select("fp")
    home = only.mapInArrow(homes, schema).alias("h")
    visit = only.mapInArrow(visitors, schema).alias("v").hint("merge")
    return home.join(
        visit,
        (F.col("h.anchor") == F.col("v.anchor"))
        & (F.col("h.fp") < F.col("v.fp"))
        & (F.bit_count(F.col("h.fp").bitwiseXOR(F.col("v.fp"))) <= threshold),
    ).select(F.col("h.fp").alias("a"), F.col("v.fp").alias("b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: int = THRESHOLD,
    blocks: Sequence[PerfectCode] = BLOCKS,
) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable by links.

    Only distinct fingerprints are covered and compared, so copies cost one row each, however many.
    Texts without words have fingerprint zero and link like any other. Null ids never become a
    component's id unless it has no other. Repeated rows give repeated results; other columns are
    not read; an empty table gives an empty one. Rows, fingerprints and links grow with the documents,
    so all joins of them are sort-merge ones at every size, and none is collected.
    """
    rows, named = _groups(Scratch(docs.sparkSession, "simhash"), docs, id_col, text_col, words, threshold, blocks)
    return rows.join(named.hint("merge"), "fp").select(id_col, "fp", "component_id")


def _groups(
    scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, threshold: int = THRESHOLD, blocks: Sequence[PerfectCode] = BLOCKS
) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and (fp, root, least, component_id) of every fingerprint: root names its
    component, which an id alone does not where rows repeat it with other texts; least is its smallest id."""
    rows = scratch.write(with_fingerprint(docs.select(id_col, text_col), text_col, words, [id_col]), "rows")
    distinct = scratch.write(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    joined = connected_components(fingerprint_links(distinct, threshold, blocks), "a", "b", scratch)
    rooted = distinct.join(joined.hint("merge"), distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    least = scratch.write(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = scratch.write(rooted.join(least.hint("merge"), "root").select("fp", "root", "least", "component_id"), "named")
    scratch.drop(distinct, joined, rooted, least)
    return rows, named


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of `docs` for each component: one with its smallest id, of those with that id the one with
    the smallest fingerprint, of rows alike in both any.

    An id that stands on rows of different texts can so be kept with several of them; no component goes.
    Rows with a null id cannot be told apart and stay. The ids to keep grow with the documents, so the
    joins are sort-merge ones at every size.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    rows, named = _groups(scratch, docs, id_col, text_col, **options)
    first = named.where(F.col("least") == F.col("component_id")).groupBy("root").agg(F.min(F.struct("least", "fp")).alias("first"))
    kept = scratch.write(first.select(F.col("first.least").alias(id_col), F.col("first.fp").alias("fp")), "ids")
    repeated = scratch.write(rows.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "repeated")
    known = docs.where(F.col(id_col).isNotNull()).hint("merge")
    nameless = docs.where(F.col(id_col).isNull())
    if not repeated.limit(1).count():
        return known.join(kept.select(id_col), id_col, "left_semi").select(docs.columns).union(nameless)
    single = kept.join(repeated.hint("merge"), id_col, "left_anti").select(id_col)
    once = known.join(single, id_col, "left_semi").select(docs.columns)
    # Only rows whose id is repeated need their own fingerprint again, under a name that no column has.
    own = next(c for c in ("fp", *(f"fp_{k}" for k in range(len(docs.columns) + 1))) if c not in docs.columns)
    more = known.join(repeated, id_col, "left_semi").select(docs.columns)
    more = with_fingerprint(more, text_col, options.get("words", WORDS), name=own).join(kept.withColumnRenamed("fp", own).hint("merge"), [id_col, own], "left_semi")
    return once.union(more.dropDuplicates([id_col, own]).select(docs.columns)).union(nameless)
