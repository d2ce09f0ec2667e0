"""Shared pieces of the training-data operators: word rule, kept tables, Arrow row helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a longest run of characters other than space and U+0009..U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_SPACE = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that a Python task turns into objects at once; a single longer row is taken alone.
SLICE = 2 << 20
#: Tables kept in the innermost ``own_tables`` of this thread; None outside of it.
_KEPT: ContextVar[list[DataFrame] | None] = ContextVar("kept tables", default=None)
#: The folder of this driver's tables, and the one that stands in for the shared one in local mode.
_RUN = uuid.uuid4().hex
_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the dataset in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named u0, u1 .., so that no name of a user's meets one of ours; ``toDF(*df.columns)`` turns them back."""
    return df.toDF(*[f"u{i}" for i in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> Column:
    """The column that was called ``name`` in ``df``, in ``by_place(df)``."""
    return F.col(f"u{df.columns.index(name)}")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="folio-checkpoint-"))
        path = _LOCAL[0]
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors.

    The driver's tables lie in one folder, which goes when the driver ends.
    """
    spark = df.sparkSession
    run = f"{shared_dir(spark)}/folio/{_RUN}"
    path = f"{run}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _file_system(spark, run)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    mine = _KEPT.get()
    if mine is not None:
        mine.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``keep`` which nothing reads any more."""
    mine = _KEPT.get()
    for df in tables:
        if mine is not None:
            mine[:] = [x for x in mine if x is not df]
        files, where = _file_system(df.sparkSession, df._kept_at)
        files.delete(where, True)


@contextmanager
def own_tables() -> Iterator[list[DataFrame]]:
    """Of what is kept inside, by this thread, only the tables put into the list that this gives are there afterwards."""
    wanted: list[DataFrame] = []
    token = _KEPT.set([])
    try:
        yield wanted
        drop(*[x for x in _KEPT.get() if all(x is not w for w in wanted)])
    finally:
        _KEPT.reset(token)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of at most ``size`` bytes or of one row."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            n = part.num_rows
            if n > 1 and part.nbytes > size:
                todo += [part.slice(n // 2), part.slice(0, n // 2)]
            else:
                yield part
    pa.default_memory_pool().release_unused()


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``mapInArrow`` for a function from column lists to column lists, a slice of bounded bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(b.to_pydict() for b in slices(batches)):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, fn: Callable[[list[pa.Array]], list[pa.Array]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for a function from the columns of a slice to those of its result, whatever their names."""
    inner = [f"c{i}" for i in range(len(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(fn(b.columns), inner)

    plain = T.StructType([T.StructField(c, f.dataType) for c, f in zip(inner, schema.fields, strict=True)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, plain).toDF(*schema.names)


def with_length(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, from ``df``; n_chars, where there is one, becomes the length of the text."""
    length = F.length("text").cast(like.schema["n_chars"].dataType) if "n_chars" in like.columns else None
    return df.select(*[length.alias(c) if c == "n_chars" else named(c) for c in like.columns])
