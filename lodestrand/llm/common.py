"""Helpers that all training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch. Texts can be long, so batches are small enough for a worker's memory.
BATCH_ROWS = 512

_written: set[tuple[int, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A cluster names it in ``spark.checkpoint.dir``. Where that
    is unset, a session on one machine (tests) gets a folder of that machine, any other an error."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = tempfile.mkdtemp(prefix="lodestrand-")
        spark.sparkContext.setCheckpointDir(name)
    return name


def tune(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Small Arrow batches, so that a batch of long texts stays within a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def place_for(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there is deleted by :func:`release`, at the end of the
    :func:`scratch` around, or when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lodestrand-{name}-{uuid.uuid4().hex}"
    _written.add((id(spark), path))
    _sessions[id(spark)] = spark
    return path


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back. This cuts the lineage: a lost
    executor costs the tasks that ran on it, not the steps before. Gives the table and its path."""
    spark = df.sparkSession
    path = place_for(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`materialize` that no later step reads."""
    for path in paths:
        _remove(spark, path)
        _written.discard((id(spark), path))


_sessions: dict[int, SparkSession] = {}


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Deletes, at its end, the tables written inside of it, but for those whose paths were put into the set it gives."""
    before, kept = set(_written), set()
    yield kept
    release(spark, *(path for key, path in _written - before if key == id(spark) and path not in kept))


@atexit.register
def _release_all() -> None:
    for key, path in list(_written):
        with contextlib.suppress(Exception):
            _remove(_sessions[key], path)


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with the batch size of :func:`tune`."""
    tune(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of any table that has them, whatever other columns it carries."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
