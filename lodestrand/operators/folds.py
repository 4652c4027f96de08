"""Sequential operators: what depends on all that went before. Rows are dealt by key, sorted once by Spark, and folded as
they stream by, so a group of any length takes the memory of its state and many small groups share a task.
A fold can't be split: one key's rows are one task's, but they are never held together."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Fold = Callable[[tuple, Iterator[tuple]], Iterable[tuple]]
_OUT_ROWS = 10_000


def sorted_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, schema: str | StructType) -> DataFrame:
    """``fold`` gets each key and its rows, whole rows in the columns' order, sorted by ``order`` and then by all other columns (so
    repeated and tied rows come in one order), nulls first; it gives rows of ``schema``. An empty table gives an empty one."""
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    columns = df.columns
    rest = [c for c in columns if c not in keys and c not in order]
    at = [columns.index(k) for k in keys]
    target = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        out = (made for key, own in groupby(rows, key=lambda r: tuple(r[k] for k in at)) for made in fold(key, own))
        while part := list(islice(out, _OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), target)], schema=target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order, *rest).mapInArrow(run, kind)
