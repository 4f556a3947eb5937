"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking.

Rows get global numbers 0 to N - 1: they are ordered by a hash bucket of (id, size, CRC of the
text) and these values, the words of a bucket's count give its first number. A balanced Feistel
network permutes the power of four that holds N; numbers that it sends beyond N are sent through
it again until they fall below (cycle walking), which permutes 0 to N - 1 exactly. Shard and
slot are the permuted number's remainder and quotient by the number of shards, so that shards
differ by one row at most and slots have no gaps. ``locate`` computes both for any row number.

Edge cases: a null text counts as empty, null ids are ids like any other, in order first;
repeated rows are counted before they are numbered, each gets a slot of its own, and as they are
equal any assignment among them is the same, and many of them are one counted row until then; very
long texts count in whole; an empty table gives an empty result; other columns
aren't carried and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, chunk_of

SHARDS = 24
SEED = 9176
ROUNDS = 8
#: Rows in a bucket of the numbering, about.
BUCKET_ROWS = 200_000
LEAST_BUCKETS = 64


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of x + key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _feistel(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """The permutation of 0 to 4 ** bits - 1 with halves of ``bits`` bits."""
    half = np.uint64(bits)
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> half, x & mask
    for r in range(ROUNDS):
        key = (seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64)
        left, right = right, left ^ (_mixed(right, key) & mask)
    return left << half | right


def permute(numbers: np.ndarray, total: int, seed: int = SEED) -> np.ndarray:
    """Where the seeded permutation of 0 to total - 1 sends ``numbers``."""
    bits = max(1, -(-max(total - 1, 1).bit_length() // 2))
    x = _feistel(numbers.astype(np.uint64), bits, seed)
    while len(out := np.flatnonzero(x >= total)):
        x[out] = _feistel(x[out], bits, seed)
    return x.astype(np.int64)


def locate(numbers: np.ndarray, total: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of rows by their numbers."""
    to = permute(numbers, total, seed)
    return (to % shards).astype(np.int32), to // shards


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """``(id, size, text_crc32, row_number)`` of each row, and the number of rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = checkpointed(slim.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_ROWS))
    dealt = counted.withColumn("bucket", chunk_of(buckets, "id", "size", "text_crc32"))
    sums = dealt.groupBy("bucket").agg(F.sum("n").alias("rows"))
    first = F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")
    sums = sums.select("bucket", first.alias("first"))
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = dealt.withColumn("inside", inside).join(sums, "bucket")
    number = F.explode(F.sequence(F.col("first") + F.col("inside"), F.col("first") + F.col("inside") + F.col("n") - 1))
    return placed.select("id", "size", "text_crc32", number.alias("row_number")), total


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(id, size, text_crc32, row_number, shard, slot)`` of each row."""
    rows, total = numbered(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = locate(batch.column("row_number").to_numpy(), total, shards, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(slot)], [*batch.schema.names, "shard", "slot"])

    id_type = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {id_type}, size long, text_crc32 long, row_number long, shard int, slot long")
