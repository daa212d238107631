"""Packing by power-of-two decomposition.

A document's token count is written in binary and the document is cut into pieces of those lengths,
longest first; lengths beyond the context become whole contexts. Pieces of equal length share a
bucket and each is a sequence of its own, so no sequence crosses documents and none is padded.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.chunks import Chunks
from foliant.llm.common import _pieces

#: Chunks whose ids a worker remembers, at some 200 bytes each.
REMEMBERED = 1_500_000

_loaded: dict[tuple[str, int], PieceTokenizer] = {}


class PieceTokenizer:
    """Ids of a `tokenizers` file, as little-endian unsigned 32-bit bytes.

    A byte-level tokenizer is asked once for each distinct chunk between spaces and the ids are
    remembered. Texts that hold an added token's string, and files of another kind, go to the library
    whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        spec = json.loads(self.lib.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and not spec.get("normalizer")
            and spec["model"].get("dropout") is None
        )
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.chunks = Chunks(self._each, remembered, encode_words=self._words)

    @staticmethod
    def of(path: str, remembered: int = REMEMBERED) -> PieceTokenizer:
        if (path, remembered) not in _loaded:
            _loaded[path, remembered] = PieceTokenizer(path, remembered)
        return _loaded[path, remembered]

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.lib.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _words(self, words: list[str], together: int = 256) -> list[bytes]:
        """Ids of words, many to a call: a line end between them is a token of its own."""
        (line_end,) = self.lib.encode("\n", add_special_tokens=False).ids
        lines = ["\n".join(words[i : i + together]) for i in range(0, len(words), together)]
        out: list[bytes] = []
        for e in self.lib.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            data = ids.tobytes()
            ends = (np.flatnonzero(ids == line_end) * 4).tolist()
            out += [data[a:b] for a, b in zip([0, *(x + 4 for x in ends)], [*ends, len(data)], strict=True)]
        if len(out) != len(words):
            raise AssertionError("a line end was not a token of its own")
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._each(texts)
        special = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        out = self.chunks.ids(["" if k in special else t for k, t in enumerate(texts)]) if special else self.chunks.ids(texts)
        for k, x in zip(special, self._each([texts[k] for k in special]), strict=True):
            out[k] = x
        return out


def binary_lengths(n: int, context: int) -> list[int]:
    """Whole contexts, then the powers of two of what is left, longest first."""
    out = [context] * (n // context)
    left = n % context
    out += [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    context: int = 2048,
    end_id: int = 1,
    with_ids: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids).

    `context` is a power of two. A null or empty text has the one token `end_id`. Documents are
    taken row by row: repeated rows, null ids and ties each give pieces of their own. Other columns
    are not read. Sequence ids are unique, not consecutive. Each text is cut whole; a task holds a
    few megabytes of texts at a time. There is no shuffle.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")
    src = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    fields = [
        src.schema[id_col],
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = end_id.to_bytes(4, "little")
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PieceTokenizer.of(tokenizer_path, remembered)
        for whole in batches:
            for batch in _pieces(whole):
                at, start, length, crc, total, ids = [], [], [], [], [], []
                for row, data in enumerate(tokens.encode([x or "" for x in batch.column(1).to_pylist()])):
                    data += end
                    n, here = len(data) // 4, 0
                    for size in binary_lengths(n, context):
                        piece = data[4 * here : 4 * (here + size)]
                        at.append(row)
                        start.append(here)
                        length.append(size)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            ids.append(piece)
                        here += size
                cols = [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc, total, [0] * len(at))),
                    pa.array([x.bit_length() - 1 for x in length], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=names)

    return src.mapInArrow(run, T.StructType(fields)).withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the pieces with a folder for each length, as a trainer with a batch per length reads them."""
    packed.write.partitionBy("bucket").parquet(path)
