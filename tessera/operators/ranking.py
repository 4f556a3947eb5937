"""Rankings with an id as the last key: vector and keyword search, their fusion, schedules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relevance import cover_density
from .storage import saved


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two number arrays, accumulated in order in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable_vector(v: Column, size: int | Column) -> Column:
    """Whether a vector has the size, only finite numbers and a norm above 0."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (F.size(v) == size) & finite & F.exists(v, lambda x: x != 0)


#: Bytes of query vectors that one pass over the vectors is compared with.
QUERY_BYTES = 4_000_000


def vector_topk_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str, vector_col: str, clamped: bool = True) -> DataFrame:
    """``(query, id, score, rank)``: the k vectors nearest to each of ``queries(query_col, vector_col)`` by cosine, in [0, 1].

    Queries come in blocks of QUERY_BYTES, one pass over the vectors each; a task keeps the k best of its vectors for
    each query, so what is shuffled doesn't grow with the number of vectors. Ties go by id; vectors that aren't usable,
    of queries as of rows, and those of other sizes have no score. Without ``clamped``, score is the cosine itself and
    ranks those below 0 too. A product of matrices finds all that can be among the k best; their cosines are then
    summed in order, so that equal vectors have equal scores in whatever batch they come.
    """
    lowest = 0.0 if clamped else -1.0
    summed = lambda products: np.cumsum(products, axis=-1)[..., -1]
    schema = f"{query_col} long, {id_col} long, score double"
    usable = lambda df, i: df.filter(F.col(i).isNotNull() & usable_vector(F.col(vector_col), F.size(vector_col))).select(F.col(i).cast("long"), F.col(vector_col).cast("array<double>"))
    found = vectors.sparkSession.createDataFrame([], schema)
    rows = usable(vectors, id_col)
    for number, block in enumerate(_blocks(usable(queries, query_col))):
        names = np.array([q for q, _ in block], dtype=np.int64)
        sides = {}
        for n in {len(v) for _, v in block}:
            at = np.array([i for i, (_, v) in enumerate(block) if len(v) == n])
            side = np.array([block[i][1] for i in at])
            sides[n] = at, side, side / np.sqrt((side * side).sum(1, keepdims=True))

        def best(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, sides: dict = sides) -> Iterator[pa.RecordBatch]:
            held = [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in names]
            for batch in batches:
                sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for n, (at, side, unit) in sides.items():
                    some = batch.filter(pa.array(sizes == n))
                    if not some.num_rows:
                        continue
                    ids = some.column(0).to_numpy()
                    x = some.column(1).flatten().to_numpy().reshape(-1, n)
                    near = np.clip(unit @ (x / np.sqrt((x * x).sum(1, keepdims=True))).T, lowest, 1.0)
                    slack = 8 * (n + 8) * np.finfo(float).eps  # more than what two orders of summing can differ by
                    for i, asked, own in zip(at.tolist(), side, near):
                        both = np.concatenate((held[i][1], own))
                        kth = np.partition(both, -k)[-k] if len(both) > k else -np.inf
                        may = ~(own < kth - slack)
                        v = x[may]
                        scores = np.clip(summed(v * asked) / np.sqrt(summed(v * v) * summed(asked * asked)), lowest, 1.0)
                        all_ids, all_scores = np.concatenate((held[i][0], ids[may])), np.concatenate((held[i][1], scores))
                        top = np.lexsort((all_ids, -all_scores))[:k]
                        held[i] = all_ids[top], all_scores[top]
            columns = [pa.array(np.repeat(names, [len(h[0]) for h in held])), *[pa.array(np.concatenate([h[c] for h in held])) for c in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, [query_col, id_col, "score"])

        part = rows.mapInArrow(best, schema)
        found = part if not number else saved(found).unionByName(saved(part))
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, list[float]]]]:
    """Rows of a query set in blocks of QUERY_BYTES, read one partition at a time."""
    block, held = [], 0
    for name, vector in queries.toLocalIterator():
        if block and held + 8 * len(vector) > QUERY_BYTES:
            yield block
            block, held = [], 0
        block.append((name, vector))
        held += 8 * len(vector)
    if block:
        yield block


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """``(id, score, rank)`` of the k vectors nearest to one query by cosine; ranks go by the cosine, score is clamped to [0, 1]."""
    asked = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], f"_query long, {vector_col} array<double>")
    top = vector_topk_many(vectors, asked, k, id_col, "_query", vector_col, clamped=False)
    return top.select(id_col, F.greatest("score", F.lit(0.0)).alias("score"), "rank")


def parse_keywords(query: str) -> list[list[tuple[bool, str]]]:
    """Alternatives (split by ``or``) of terms: quoted phrases stay whole, a leading ``-`` excludes."""
    import re

    groups: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or" and not minus:
            groups.append([])
            continue
        term = " ".join(re.findall(r"[^\W_]+", phrase or word))
        if term:
            groups[-1].append((not minus, term))
    return [g for g in groups if any(wanted for wanted, _ in g)]


def keyword_topk(docs: DataFrame, query: str, k: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, score, rank)`` of matching texts: all terms of an alternative are there and none that it excludes.

    Tokens are runs of letters and digits in lower case; the score is the cover density of the terms.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    groups = parse_keywords(query)
    if not groups:
        return docs.select(id_col, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    rows = docs.select(id_col, F.concat(F.lit(" "), words, F.lit(" ")).alias("_w"))
    has = lambda t: F.contains(F.col("_w"), F.lit(f" {t} "))
    matches = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [has(t) if wanted else ~has(t) for wanted, t in g]) for g in groups])
    found = rows.filter(matches).select(id_col, F.split(F.trim("_w"), " ").alias("_t"))
    top = found.select(id_col, cover_density(F.col("_t"), groups).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def reciprocal_rank_fusion(channels: dict[str, DataFrame], id_col: str, k: int, rrf_k: int = 60) -> DataFrame:
    """``(id, score, channels)``: sums of 1 / (rrf_k + rank) over channels as parts of the highest; the k best."""
    hits = reduce(lambda a, b: a.unionByName(b), [c.select(id_col, "rank").withColumn("channel", F.lit(n)) for n, c in sorted(channels.items())])
    fused = hits.groupBy(id_col).agg(F.sum(1 / (F.lit(float(rrf_k)) + F.col("rank"))).alias("_s"), F.array_sort(F.collect_set("channel")).alias("channels"))
    out = fused.withColumn("score", F.col("_s") / F.max("_s").over(Window.partitionBy()))
    return out.orderBy(F.desc("score"), id_col).limit(k).select(id_col, "score", "channels")


def fair_schedule(tasks: DataFrame, claims: DataFrame, run: str, order: Sequence[Column], place: str = "place") -> DataFrame:
    """Tasks in scheduling order: runs with fewer recent claims go first among equal leading keys.

    ``order`` takes the column ``recent_claims``; claims are counted by run before the join.
    """
    counted = claims.groupBy(run).agg(F.count("*").alias("recent_claims"))
    out = tasks.join(counted, run, "left").withColumn("recent_claims", F.coalesce("recent_claims", F.lit(0)))
    return numbered(out, order, place)


def numbered(rows: DataFrame, order: Sequence[Column], place: str) -> DataFrame:
    """``rows`` with their ``place`` (from 1) in ``order``, which ends with an id: ranges are numbered each, and begin after the ranges before."""
    ranged = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")  # a row for each range
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(place, inside).join(sizes, "_part").withColumn(place, (F.col(place) + F.col("_before")).cast("long")).drop("_part", "_before")
