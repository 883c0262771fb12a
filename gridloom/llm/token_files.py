"""Token ids in fixed-width bit packing, in files that give random access.

Format: a Parquet folder whose rows are blocks. A block holds whole documents, closed at the first document end after
``BLOCK_IDS`` ids: ``shard``, ``block`` (in the shard), ``first`` (ids of the shard before it), ``n_ids``, ``width`` (bits
of an id), ``bits`` (packed ids, little-endian 64-bit words, cut to whole bytes), ``doc_ids`` and ``ends`` (per document:
where its ids end in the block). Shards in number order, blocks and documents in order within them, are the documents by
ascending doc_id, nulls first. One row is enough to read a document, and any 64 ids lie in ``width`` whole words.

Defined results: a null or empty text is the end id alone; rows with the same doc_id stay separate documents, ordered
by text; an empty table gives an empty folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.tokens import crc, task_encoder

BLOCK_IDS = 32_768
FILE_SCHEMA = "shard int, block int, first long, n_ids int, width int, bits binary, doc_ids array<long>, ends array<int>"


def width_of(vocabulary: int) -> int:
    """The least bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive ``width``-bit fields. 64 ids fill ``width`` words, so each of 64 places is one vector step."""
    groups = -(-len(ids) // 64)
    table = np.zeros((groups, 64), np.uint64)
    table.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= table[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= table[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()[: (len(ids) * width + 7) // 8]


def unpack(bits: bytes, width: int, lo: int, hi: int) -> np.ndarray:
    """Ids ``lo`` to ``hi`` of a block, from the words of their groups only."""
    first, last = lo // 64, -(-hi // 64)
    part = bits[first * width * 8 : last * width * 8]
    part = part + bytes((last - first) * width * 8 - len(part))
    words = np.frombuffer(part, "<u8").reshape(-1, width)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((len(words), 64), np.uint32)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = v & mask
    return out.reshape(-1)[lo - first * 64 : hi - first * 64]


def write(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end: int, folds: bool, text: str = "text", key: str = "doc_id") -> None:
    """Encodes every text and writes the folder ``path``."""
    width = width_of(vocabulary)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(tokenizer, end, folds)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            ends = np.cumsum([len(p) for p in parts])
            row = {"shard": shard, "block": block, "first": first, "n_ids": len(ids), "width": width,
                   "bits": pack(ids, width), "doc_ids": keys, "ends": ends.tolist()}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t"), strict=True):
                ids = encoder.encode(t.as_py())
                keys.append(k)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield close()
                    first, block = first + held, block + 1
                    keys, parts, held = [], [], 0
        if parts:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k", "t")
    ordered.mapInArrow(blocks, FILE_SCHEMA).write.parquet(path)


_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()),
    ("bits", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())),
])


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ``ids`` if asked."""
    out = "shard int, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["bits"], r["width"], 0, r["n_ids"])
                lo = [0, *r["ends"][:-1]]
                cut = [ids[a:b] for a, b in zip(lo, r["ends"], strict=True)]
                columns = {
                    "shard": pa.array([r["shard"]] * len(cut), pa.int32()),
                    "at": pa.array(np.add(lo, r["first"]), pa.int64()),
                    "doc_id": pa.array(r["doc_ids"], pa.int64()),
                    "n_tokens": pa.array([len(c) for c in cut], pa.int64()),
                    "ids_crc32": pa.array([crc(c) for c in cut], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per file
    shards = shards.withColumn("base", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    found = files.mapInArrow(documents, out).join(shards, "shard")
    ids = ["ids"] if with_ids else []
    return found.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *ids)
