"""Byte-level BPE by a rank queue over a hierarchical bitmap.

Pre-tokens are doubly linked lists of tokens; many share a pass. For every merge rank there is a bucket of list
positions whose pair has that rank; a bitmap of three levels of 64-bit words marks the buckets that
are not empty, so the next rank is found by find-first-set on three words. A merge puts its two new
pairs into their buckets and leaves old entries where they are: an entry whose pair has changed
since is stale and is skipped. Work is O(n log n) for a pre-token of n bytes (the logarithm is that
of sorting a bucket), where a scan for the lowest pair would be O(n^2).
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm.chunks import CUT_AT_SPACES, Chunks
from foliant.llm.common import append_arrow

#: Chunks between spaces, and pre-tokens, whose ids a worker remembers; the longest pre-token of them.
CHUNKS, PIECES, LONGEST = 1_500_000, 800_000, 64
#: Bytes of new pre-tokens that share a pass of the queue.
PASS_BYTES = 100_000


class Bpe:
    """Encoder and decoder for a file of ranks; ids are ranks."""

    _loaded: dict[tuple[str, str], Bpe] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.bytes[v] = k
        self.decimal = [str(i).encode() for i in range(len(self.bytes))]
        self.single = [ranks.get(bytes([i]), -1) for i in range(256)]
        if min(self.single) < 0:
            raise ValueError("the ranks must hold all 256 single bytes")
        self.cut = regex.compile(pattern).findall
        if len(self.bytes) > 1 << 18:
            raise ValueError("three levels of 64-bit words hold 2^18 ranks")
        # The queue, empty between calls: which words of the level below are not zero, and the buckets.
        self.level0, self.level1, self.buckets = [0] * (1 << 12), [0] * (1 << 6), {}
        self.merges = self._merges()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.chunks = Chunks(self._each, CHUNKS)
        self.by_chunk = pattern in CUT_AT_SPACES

    def _merges(self) -> dict[int, int]:
        """Rank of the merge of tokens a and b under a << 18 | b."""
        rank = self.ranks.get
        out = {}
        for whole, r in self.ranks.items():
            for k in range(1, len(whole)):
                a, b = rank(whole[:k]), rank(whole[k:])
                if a is not None and b is not None:
                    out[a << 18 | b] = r
        return out

    @classmethod
    def of(cls, path: str, pattern: str) -> Bpe:
        if (path, pattern) not in cls._loaded:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
            cls._loaded[path, pattern] = cls(ranks, pattern)
        return cls._loaded[path, pattern]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token, in one pass of the queue.

        The pre-tokens lie one behind the other with a barrier, -1, after each, which merges with
        nothing. The lowest rank goes first and, of its places, the leftmost; as pre-tokens don't
        touch, that is each one's own order too.
        """
        level0, level1, buckets, merge = self.level0, self.level1, self.buckets, self.merges.get
        bucket, single = buckets.get, self.single
        level2 = 0
        tok: list[int] = []
        for p in pieces:
            tok += [single[c] for c in p]
            tok.append(-1)
        n = len(tok)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))  # of the first place the last barrier
        now = [merge(a << 18 | b, -1) for a, b in zip(tok, tok[1:])]  # noqa: B905  rank of the pair that starts here
        now.append(-1)
        waiting, at = now, range(n)  # ranks, and where their pairs start, that go into their buckets
        while True:
            for r, i in zip(waiting, at):  # noqa: B905
                if r >= 0:
                    b = bucket(r)
                    if b is not None:
                        b.append(i)
                    else:
                        buckets[r] = [i]
                        level0[r >> 6] |= 1 << (r & 63)
                        level1[r >> 12] |= 1 << (r >> 6 & 63)
                        level2 |= 1 << (r >> 12)
            if not level2:
                break
            # Find-first-set on each level gives the lowest rank; its bucket leaves the queue.
            top = (level2 & -level2).bit_length() - 1
            word = level1[top]
            mid = top << 6 | (word & -word).bit_length() - 1
            word = level0[mid]
            rank = mid << 6 | (word & -word).bit_length() - 1
            word &= word - 1
            level0[mid] = word
            if not word:
                word = level1[top] = level1[top] & ~(1 << (mid & 63))
                if not word:
                    level2 &= ~(1 << top)
            places = buckets.pop(rank)
            if len(places) > 1:
                places.sort()
            waiting, at = [], []
            wait_until = 0
            for i in places:
                if now[i] != rank:
                    continue  # stale
                if i < wait_until:
                    waiting.append(rank)
                    at.append(i)
                    continue
                j = nxt[i]
                after = nxt[j]
                before = prv[i]
                tok[i] = rank
                now[j] = -1
                tok[j] = -2
                nxt[i] = after
                prv[after] = i
                now[i] = low = merge(rank << 18 | tok[after], -1)
                now[before] = r = merge(tok[before] << 18 | rank, -1)
                if low >= 0:
                    waiting.append(low)
                    at.append(i)
                if r >= 0:
                    waiting.append(r)
                    at.append(before)
                    if r < low or low < 0:
                        low = r
                if 0 <= low < rank:  # a lower rank has come up: it goes first, what is left of this pre-token waits
                    wait_until = tok.index(-1, i)
        left = [t for t in tok if t != -2]
        out, start = [], 0
        for _ in pieces:
            end = left.index(-1, start)
            out.append(left[start:end])
            start = end + 1
        return out

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new pre-tokens, some PASS_BYTES of them to a pass; remembers those that are not too long."""
        made: dict[str, bytes] = {}
        group: list[str] = []
        data: list[bytes] = []
        size = 0
        for k, m in enumerate(new):
            piece = m.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(piece)
            if whole is not None:
                made[m] = struct.pack("<I", whole)
            else:
                group.append(m)
                data.append(piece)
                size += len(piece)
            if group and (size > PASS_BYTES or k == len(new) - 1):
                for x, ids in zip(group, self.encode_pieces(data), strict=True):
                    made[x] = struct.pack(f"<{len(ids)}I", *ids)
                group, data, size = [], [], 0
        if len(self.known) + len(made) > PIECES // 2:  # what has been in use of late outlives this
            self.known, self.before = {}, self.known
        self.known.update((m, ids) for m, ids in made.items() if len(m) <= LONGEST)
        return made

    def _each(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        cut = [self.cut(t) for t in texts]
        known = self.known
        new = set().union(*cut).difference(known)
        again = {m: self.before[m] for m in new & self.before.keys()}
        found = self._learn(sorted(new - again.keys())) | again
        self.known.update(again)
        return [b"".join([found[m] if m in found else known[m] for m in c]) for c in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        return [np.frombuffer(x, "<u4") for x in (self.chunks.ids(texts) if self.by_chunk else self._each(texts))]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def bpe_digests(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False
) -> DataFrame:
    """`keep` (all if None) with n_tokens, ids_sha256, decoded_sha256 (and ids, little-endian u32 bytes).

    A null text counts as empty: no ids, digests of nothing. Every row is encoded by itself, so
    repeated rows give repeated results. An input column with the name of a new one is replaced.
    Texts are encoded whole; there is no shuffle. `ranks_path` is a file at the same place on all
    machines, or the name of one that was sent with SparkContext.addFile.
    """

    def digest(texts: list[str | None]) -> list:
        import os

        bpe = Bpe.of(ranks_path if os.path.exists(ranks_path) else SparkFiles.get(ranks_path), pattern)
        n, a, b, raw = [], [], [], []
        for ids in bpe.encode([t or "" for t in texts]):
            n.append(len(ids))
            a.append(hashlib.sha256(b" ".join(map(bpe.decimal.__getitem__, ids.tolist()))).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            if with_ids:
                raw.append(ids.tobytes())
        return [n, a, b, pa.array(raw, pa.binary())] if with_ids else [n, a, b]

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ] + [T.StructField("ids", T.BinaryType())] * with_ids
    return append_arrow(docs, [text_col], digest, fields, keep)


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds `decoded` (binary): the bytes of the ids in `ids_col`; null ids give null."""

    def back(rows: list[bytes | None]) -> list:
        bpe = Bpe.of(ranks_path, pattern)
        return [[None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in rows]]

    return append_arrow(df, [ids_col], back, [T.StructField("decoded", T.BinaryType())], keep)
