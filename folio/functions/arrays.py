"""Groups as array rows: one row holds a group's members in order, so that many groups share a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that are turned into objects at once; a longer row is taken alone.
SLICE = 2 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last(array: Column) -> Column:
    """The last element, null if there is none."""
    return F.get(array, F.size(array) - 1)


def gathered(rows: DataFrame, by: list[str], order: str, *columns: str) -> DataFrame:
    """One row a group: the keys and ``members``, the array of structs (order, columns..) sorted by order."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("members"))


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows in order, in slices of bounded bytes or of one row."""
    todo = [batch]
    while todo:
        part = todo.pop()
        half = part.num_rows // 2
        if half and part.nbytes > SLICE:
            todo += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def each_row(df: DataFrame, fn: Callable[[dict], Iterator[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``mapInArrow`` for a function from a row to the rows it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts(b)):
            found = [x for row in part.to_pylist() for x in fn(row)]
            columns = zip(*found, strict=True) if found else ((),) * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
