"""Small helpers shared by the corpus operators: columns, chunks, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import saved

#: White space that separates words: space and the ASCII controls 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name made from ``base`` that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only in local mode, and where
    that is unset (tests, a laptop), a local folder is made.
    """
    return saved(df)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts, as a driver-side number (nulls count 0)."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


#: Chunks grow eightfold at most, beyond so many of them.
MANY_CHUNKS, GROWTH = 100_000, 8


def chunk_count(total_bytes: int, target_bytes: int) -> int:
    """Chunks of about ``target_bytes``. Beyond MANY_CHUNKS they grow first, up to GROWTH times that, then in number.

    What is in every chunk (a frequent word, a notice) meets itself from all of them in one task, a row from each.
    """
    size = min(max(target_bytes, total_bytes // MANY_CHUNKS), GROWTH * target_bytes)
    return max(1, -(-total_bytes // size))


def chunk_of(n_chunks: int, *cols: str) -> Column:
    """The chunk of a row: a hash of its columns, so that any rerun deals alike."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit(7)), F.lit(n_chunks)).cast("int")


#: Parts in which the first rows of a key are ranked before they are ranked together.
PARTS = 64


def best_of_each(rows: DataFrame, key: str, order: list[Column], k: int, parts: int = PARTS) -> DataFrame:
    """The first ``k`` rows of each ``key``, with their ``rank``; ranked in parts first, which are dealt by a hash of all columns."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key, part).orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)
