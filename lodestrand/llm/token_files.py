"""Token files: ids of fixed bit width in blocks that are read alone.

A token file is a folder of rows (shard, block, n_docs, n_ids, content), in Spark's own writer, so
any store that Spark reaches will do and a lost task leaves nothing half-written. ``content`` is
one block, all little-endian:

    4 bytes  magic ``LTB1``          1 byte   bits of an id
    4 bytes  documents in the block  8 bytes  ids in the block
    8 bytes  ids of the shard's earlier blocks
    8 bytes x documents  ids of documents
    1 byte x documents   1 where the document's id is null
    8 bytes x (documents + 1)  first id of each document in the block, then the end
    the ids, lowest bits first, each in the given number of bits

Id k of a block starts at bit k * bits, so any document or any slice is read without the rest.
Shards and blocks in ascending order hold the documents in ascending order of their ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.llm import tokens
from lodestrand.llm.common import map_batches, texts_of

MAGIC = b"LTB1"
HEAD = struct.Struct("<4sBIQQ")
#: Ids after which a block is closed. A longer document is a block of its own.
BLOCK_IDS = 1 << 18


def bits_of(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Unsigned ids, each in ``bits`` bits, lowest bits first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):  # a multiple of eight ids, so every part ends on a byte
        part = ids[at : at + (1 << 16), None] >> np.arange(bits, dtype=np.uint32) & np.uint32(1)
        out.append(np.packbits(part.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data, bits: int, start: int, n: int) -> np.ndarray:
    """Ids start .. start + n of packed bytes, as unsigned 32-bit integers; reads only their bytes."""
    if n <= 0:
        return np.empty(0, np.uint32)
    first, last = start * bits // 8, -(-(start + n) * bits // 8)
    raw = np.frombuffer(data, np.uint8, last - first, first)
    if bits == 16:
        return raw.view("<u2").astype(np.uint32)
    if bits % 8 == 0:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, : bits // 8] = raw.reshape(n, -1)
        return wide.view("<u4").ravel()
    at = np.arange(n, dtype=np.int64) * bits + (start * bits - first * 8)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    wide = np.zeros(n, np.uint64)
    for k in range((bits + 7) // 8 + 1):
        wide |= padded[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (wide >> shift & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_block(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, before: int) -> bytes:
    ends = np.cumsum([0, *map(len, ids)], dtype="<u8")
    return b"".join(
        [
            HEAD.pack(MAGIC, bits, len(doc_ids), int(ends[-1]), before),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            ends.tobytes(),
            pack(np.concatenate(ids) if ids else np.empty(0, "<u4"), bits),
        ]
    )


class Block:
    """One block, opened from its bytes; nothing is unpacked before it is asked for."""

    def __init__(self, content: bytes):
        magic, self.bits, n, self.n_ids, self.before = HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a block of a token file")
        at = HEAD.size
        held, at = np.frombuffer(content, "<i8", n, at), at + 8 * n
        null, at = np.frombuffer(content, np.uint8, n, at), at + n
        self.doc_ids = [None if z else int(x) for x, z in zip(held, null)]
        self.ends, at = np.frombuffer(content, "<u8", n + 1, at).astype(np.int64), at + 8 * (n + 1)
        self.data = memoryview(content)[at:]

    def document(self, k: int) -> np.ndarray:
        return unpack(self.data, self.bits, int(self.ends[k]), int(self.ends[k + 1] - self.ends[k]))

    def slice(self, start: int, n: int) -> np.ndarray:
        return unpack(self.data, self.bits, start, n)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row and write a token file to the folder ``path``.

    The texts are dealt out by ranges of ids and sorted in their range, one shuffle; a task encodes
    its range in order and closes a block after BLOCK_IDS ids, so it holds one block at most. Null and empty
    texts have just the end id. Null ids come first; equal ids lie in the order of their texts. An
    empty table makes an empty folder. Other columns are not read.
    """
    bits = bits_of(max(tokens.vocabulary_size(tokenizer), end_id + 1))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = tokens.Encoder(tokenizer), TaskContext.get().partitionId()
        names, ids, held, before, block = [], [], 0, 0, 0

        def row():
            content = write_block(names, ids, bits, before)
            cols = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64()), pa.array([content], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "block", "n_docs", "n_ids", "content"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(encode(text.as_py()) + end, "<u4")
                names.append(name)
                ids.append(one)
                held += len(one)
                if held >= BLOCK_IDS:
                    yield row()
                    names, ids, before, held, block = [], [], before + held, 0, block + 1
        if names:
            yield row()

    texts = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_batches(ordered, run, "shard int, block int, n_docs long, n_ids long, content binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a token file, from its blocks.
    ``start`` counts the ids of all documents before it. What is broadcast has a row a shard."""
    blocks = spark.read.parquet(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1)):
                b = Block(content.as_py())
                n = len(b.doc_ids)
                ids = b.slice(0, b.n_ids).astype("<u4", copy=False)
                crc = [zlib.crc32(ids[b.ends[k] : b.ends[k + 1]]) for k in range(n)]
                cols = [pa.array([shard.as_py()] * n, pa.int32()), pa.array(b.doc_ids, pa.int64()), pa.array(b.ends[:-1] + b.before, pa.int64()), pa.array(np.diff(b.ends), pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "doc_id", "own", "n_tokens", "ids_crc32"])

    rows = map_batches(blocks.select("shard", "content"), run, "shard int, doc_id long, own long, n_tokens long, ids_crc32 long")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(shards), "shard").select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
