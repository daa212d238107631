"""What several operators share: Arrow mapping, scratch tables and bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handed to Python code in groups of about this many characters.
GROUP_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append_arrow(
    df: DataFrame,
    inputs: Sequence[str],
    fn: Callable[..., list],
    fields: Sequence[T.StructField],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """`df` with the columns of `fields`, which `fn` makes from lists of the `inputs`.

    `fn` gets one Python list per input (nulls as None) and returns one list or array per field.
    `keep` names the input columns that go to the output (all if None); one that has the name of
    a new column is replaced by it.
    """
    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    extra = [c for c in inputs if c not in keep]
    src = df.select(*[F.col(f"`{c}`") for c in (*keep, *extra)])
    at = [(*keep, *extra).index(c) for c in inputs]
    n = len(keep)
    schema = T.StructType([*(src.schema[c] for c in keep), *fields])
    names = schema.names
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                made = fn(*(batch.column(i).to_pylist() for i in at))
                made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=names)
        pa.default_memory_pool().release_unused()  # workers are used again by other stages

    return src.mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about GROUP_CHARS bytes, so that a batch of long texts is not all in Python at once."""
    rows = batch.num_rows
    step = max(1, int(rows * GROUP_CHARS / max(batch.nbytes, 1)))
    for i in range(0, rows, step):
        yield batch.slice(i, step)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts


class Scratch:
    """Parquet tables in the folder that the cluster shares, to cut lineage.

    The folder is spark.checkpoint.dir of the session. Where that is unset a session of one machine
    gets a temporary one; on a cluster that is an error, as executors would write to their own disks.
    Within `inside` of another one the tables are that one's, and go with it.
    """

    _outer: Scratch | None = None

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        base = Scratch._outer.root if Scratch._outer else _shared_folder(spark)
        self.root = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = self.path(name)
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{name}-{self.n}"

    @contextmanager
    def inside(self) -> Iterator[Scratch]:
        """What is written within goes into this one's folder, and is deleted at the end."""
        was, inner = Scratch._outer, Scratch.__new__(Scratch)
        inner.spark, inner.root, inner.n = self.spark, self.path("within"), 0
        Scratch._outer = inner
        try:
            yield inner
        finally:
            Scratch._outer = was
            self._delete(inner.root)

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that write() returned and nothing reads any more."""
        for df in tables:
            for f in df.inputFiles()[:1]:
                self._delete(f.rpartition("/")[0])

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-"))
        base = sc.getCheckpointDir()
    return base
