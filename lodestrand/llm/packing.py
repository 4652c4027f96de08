"""Best-fit packing, planned over a histogram of lengths.

Best fit decreasing looks at counts of equal lengths at once: a run of sequences with equal room
takes a run of equal pieces. The plan has a few rows a length, whatever the number of documents;
pieces then take their slots by a join on their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.llm import tokens
from lodestrand.llm.common import map_batches, materialize, texts_of

#: Pieces, about, of one length that are ranked in one group; a length of more is dealt into as many groups as that takes.
RANK_ROWS = 20_000


def plan(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, n, first_sequence, offset, each): pieces of a length with ranks
    first_rank .. first_rank + n lie ``each`` to a sequence, from ``offset`` on, in sequences from first_sequence on.

    Longest first, each piece into the fullest sequence with room for it; equal to placing piece by
    piece. Lengths above the capacity or below one are an error.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free places: runs (first sequence, sequences)
    order: list[int] = []
    fresh = 0

    def give(free: int, first: int, n: int) -> None:
        if n and free:
            if free not in room:
                room[free] = []
                insort(order, free)
            room[free].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if left and not 1 <= length <= capacity:
            raise ValueError(f"length {length} doesn't fit a sequence of {capacity}")
        while left:
            at = bisect_left(order, length)
            if at < len(order):
                free = order[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], order[at]
            else:
                free, first, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            each = free // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, first, capacity - free, each))
                give(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                rows.append((length, rank, left, first + full, capacity - free, left))
                give(free - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            give(free, first + full, n - full)
    return rows


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as pieces of at most ``capacity`` ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.Encoder(tokenizer)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encode(text.as_py()) + end)
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    size = (n % capacity or capacity) if not piece else capacity
                    for col, v in zip(rows, (name, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]))):
                        col.append(v)
                    at, piece = at + size, piece + 1
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = texts_of(docs, id_col, text_col)
    return map_batches(texts, run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    A row of at most ``capacity`` ids is one piece; a longer one is cut into pieces of ``capacity``
    ids after a first one with what remains. Null and empty texts are the end id alone. Null ids and
    repeated rows are packed like any other. An empty table gives an empty one. Other columns are not read.

    Texts are encoded once; what is written, counted and ranked has a few numbers a piece. The driver
    gets the histogram, at most ``capacity`` rows, and the plan it broadcasts has a few rows a length.
    """
    spark = docs.sparkSession
    cut, _ = materialize(pieces_of(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").agg(F.count("*")).collect()}
    groups = spark.createDataFrame([(size, -(-n // RANK_ROWS)) for size, n in histogram.items()], "length long, groups long")
    cut = cut.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups")))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start"))
    ranked = cut.withColumn("own", own).join(counts, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("own") - 1)
    slots = spark.createDataFrame(plan(histogram, capacity) or [(1, 0, 0, 0, 0, 1)], "length long, first_rank long, n long, first_sequence long, base long, each long")
    slots = slots.withColumnRenamed("length", "size")
    inside = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    step = F.col("rank") - F.col("first_rank")
    return ranked.join(F.broadcast(slots), inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.expr("(rank - first_rank) div each")).alias("sequence_id"),
        (F.col("base") + step % F.col("each") * F.col("length")).alias("offset"),
    )
