"""Search, fusion and retrieval quality over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import aggregates, ranking, relevance, resolve
from .registry import Tables, query

#: The stated query: the first vector, and these words.
QUERY_ID = 0
WORDS = "the and -loser"

_VECTOR = """
v AS (
  SELECT vec_id AS id, greatest(0.0, least(1.0, s)) AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS rank
  FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings)
  QUALIFY rank <= 20)"""

_KEYWORD = r"""
w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
k AS (
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank
  FROM (SELECT id, sum(0.1::DOUBLE / (1 + pos - b - (n - bn))) AS score
        FROM (SELECT id, least(t1, t2) AS b, min(pos) AS pos, min(n) AS n, CASE WHEN min(t1) < min(t2) THEN min(n1) ELSE min(n2) END AS bn
              FROM (SELECT id, pos, n, max(CASE WHEN x = 'the' THEN pos END) OVER p AS t1, max(CASE WHEN x = 'and' THEN pos END) OVER p AS t2,
                           max(CASE WHEN x = 'the' THEN n END) OVER p AS n1, max(CASE WHEN x = 'and' THEN n END) OVER p AS n2
                    FROM (SELECT id, x, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS n
                          FROM (SELECT id, unnest(t) AS x, unnest(range(len(t))) AS pos FROM w WHERE list_contains(t, 'the') AND list_contains(t, 'and') AND NOT list_contains(t, 'loser'))
                          WHERE x IN ('the', 'and'))
                    WINDOW p AS (PARTITION BY id ORDER BY pos))
              WHERE t1 IS NOT NULL AND t2 IS NOT NULL GROUP BY id, least(t1, t2))
        GROUP BY id)
  QUALIFY rank <= 20)"""


def _vectors(t: Tables) -> DataFrame:
    probe = t.embeddings.filter(F.col("vec_id") == QUERY_ID).select("embedding").first()
    return ranking.vector_topk(t.embeddings, probe[0] if probe else [0.0], 20, "vec_id", "embedding").withColumnRenamed("vec_id", "id")


def _keywords(t: Tables) -> DataFrame:
    return ranking.keyword_topk(t.documents, WORDS, 20, "doc_id", "text").withColumnRenamed("doc_id", "id")


@query("vector_topk", f"WITH {_VECTOR} SELECT id, round(score, 6) AS score, rank FROM v")
def vector_topk(t: Tables) -> DataFrame:
    return _vectors(t).select("id", F.round("score", 6).alias("score"), "rank")


@query("keyword_topk", f"WITH {_KEYWORD} SELECT id, round(score, 6) AS score, rank FROM k")
def keyword_topk(t: Tables) -> DataFrame:
    return _keywords(t).select("id", F.round("score", 6).alias("score"), "rank")


@query("hybrid_rrf", f"""
WITH {_VECTOR}, {_KEYWORD},
h AS (SELECT id, 'vector' AS channel, rank FROM v UNION ALL SELECT id, 'keyword', rank FROM k),
f AS (SELECT id, sum(1 / (60.0::DOUBLE + rank)) AS s, list_sort(list(DISTINCT channel)) AS channels FROM h GROUP BY id)
SELECT id, round(s / max(s) OVER (), 6) AS score, array_to_string(channels, ',') AS channels FROM f ORDER BY s DESC, id LIMIT 10
""")
def hybrid_rrf(t: Tables) -> DataFrame:
    fused = ranking.reciprocal_rank_fusion({"vector": _vectors(t), "keyword": _keywords(t)}, "id", 10)
    return fused.select("id", F.round("score", 6).alias("score"), F.array_join("channels", ",").alias("channels"))


@query("relevance_first_per_source", """
SELECT source, doc_id, long_text, english, n_chars FROM (
  SELECT source, doc_id, n_chars >= 1000 AS long_text, lang = 'en' AS english, n_chars,
         row_number() OVER (PARTITION BY source ORDER BY n_chars >= 1000 DESC, lang = 'en' DESC, n_chars DESC, doc_id) AS rn
  FROM documents) WHERE rn = 1
ORDER BY long_text DESC, english DESC, n_chars DESC, doc_id LIMIT 10
""")
def relevance_first_per_source(t: Tables) -> DataFrame:
    d = t.documents.select("source", "doc_id", (F.col("n_chars") >= 1000).alias("long_text"), (F.col("lang") == "en").alias("english"), "n_chars")
    order = [F.desc("long_text"), F.desc("english"), F.desc("n_chars"), F.col("doc_id")]
    return resolve.latest_by(d, ["source"], order).orderBy(*order).limit(10)


@query("vector_search", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (
  SELECT query_id, x.vec_id, greatest(0.0, least(1.0, list_cosine_similarity(x.embedding::DOUBLE[], e))) AS s,
         row_number() OVER (PARTITION BY query_id ORDER BY greatest(0.0, least(1.0, list_cosine_similarity(x.embedding::DOUBLE[], e))) DESC, x.vec_id) AS rank
  FROM q CROSS JOIN embeddings x) WHERE rank <= 10
""")
def vector_search(t: Tables) -> DataFrame:
    """Every fiftieth vector asks for its ten nearest among all."""
    q = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ranking.vector_topk_many(t.embeddings, q, 10, "vec_id", "query_id", "embedding").withColumn("score", F.round("score", 6))


@query("rag_quality_metrics", """
WITH q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
r AS (
  SELECT query_id, wanted, label, row_number() OVER (PARTITION BY query_id ORDER BY near) AS rank
  FROM (SELECT query_id, q.label AS wanted, x.vec_id, x.label,
               row_number() OVER (PARTITION BY query_id ORDER BY greatest(0.0, least(1.0, list_cosine_similarity(x.embedding::DOUBLE[], e))) DESC, x.vec_id) AS near
        FROM q CROSS JOIN embeddings x QUALIFY near <= 11) WHERE vec_id <> query_id QUALIFY rank <= 10),
p AS (SELECT query_id, count(*) FILTER (rank <= 5 AND label = wanted) / 5 AS r5, count(*) FILTER (label = wanted) / 10 AS r10,
             coalesce(1 / min(rank) FILTER (label = wanted), 0) AS rr, count(*) FILTER (label <> wanted) AS bad, count(*) AS n FROM r GROUP BY query_id)
SELECT count(*) AS n_queries, round(avg(r5), 6) AS precision_at_5, round(avg(r10), 6) AS precision_at_10, round(avg(rr), 6) AS mrr,
       round(sum(bad) / sum(n), 6) AS irrelevant_rate FROM p
""")
def rag_quality_metrics(t: Tables) -> DataFrame:
    """Labels as relevance; every fiftieth vector asks for the ten nearest to it among all others."""
    e = t.embeddings
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"), "embedding")
    near = ranking.vector_topk_many(e, q.select("query_id", "embedding"), 11, "vec_id", "query_id", "embedding").filter("vec_id <> query_id")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("rank <= 10")
    ranked = e.select("vec_id", "label").join(ranked, "vec_id").join(q.select("query_id", "wanted"), "query_id")
    good = F.col("label") == F.col("wanted")
    per = ranked.groupBy("query_id").agg(
        (F.count_if(good & (F.col("rank") <= 5)) / 5).alias("r5"), (F.count_if(good) / 10).alias("r10"),
        F.coalesce(1 / F.min(F.when(good, F.col("rank"))), F.lit(0.0)).alias("rr"), F.count_if(~good).alias("bad"), F.count("*").alias("n"),
    )
    return per.agg(
        F.count("*").alias("n_queries"), F.round(F.avg("r5"), 6).alias("precision_at_5"), F.round(F.avg("r10"), 6).alias("precision_at_10"),
        F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.sum("bad") / F.sum("n"), 6).alias("irrelevant_rate"),
    )


@query("retrieval_recall", """
WITH r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank
           FROM (SELECT source AS query_id, doc_id, n_chars FROM documents) QUALIFY rank <= 10),
w AS (SELECT source AS query_id, doc_id FROM documents WHERE n_chars > 9000),
b AS (SELECT source AS query_id, doc_id FROM documents WHERE lang <> 'en'),
p AS (SELECT w.query_id, count(*) FILTER (rank <= 5) / count(*) AS r5, count(*) FILTER (rank <= 10) / count(*) AS r10,
             coalesce(1 / min(rank), 0) AS rr FROM w LEFT JOIN r USING (query_id, doc_id) GROUP BY w.query_id)
SELECT count(*) AS n_queries, round(avg(r5), 6) AS recall_at_5, round(avg(r10), 6) AS recall_at_10, round(avg(rr), 6) AS mrr,
       (SELECT round(count(b.doc_id) / count(*), 6) FROM r LEFT JOIN b USING (query_id, doc_id)) AS irrelevant_rate FROM p
""")
def retrieval_recall(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("source").alias("query_id"), "doc_id", "n_chars", "lang")
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id"))).filter("rank <= 10")
    out = aggregates.retrieval_quality(ranked, d.filter("n_chars > 9000").select("query_id", "doc_id"), d.filter("lang <> 'en'"), "query_id", "doc_id")
    return out.select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr", "irrelevant_rate")])


@query("bigram_overlap", r"""
WITH i AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS s FROM benchmark),
b AS (SELECT item_id, list_distinct([substring(s, k, 2) for k in range(1, length(s))]) AS g FROM i),
o AS (SELECT x.item_id AS item_a, y.item_id AS item_b, len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))) AS overlap
      FROM b x JOIN b y ON x.item_id < y.item_id)
SELECT item_a, item_b, round(overlap, 6) AS overlap FROM o WHERE overlap >= 0.5
""")
def bigram_overlap(t: Tables) -> DataFrame:
    """All pairs of items that share half of their character pairs."""
    sets = t.benchmark.select("item_id", fn.bigrams(fn.search_text(F.col("text"))).alias("g"))
    found = aggregates.overlapping_sets(sets, "item_id", "g", 0.5)
    return found.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.round("overlap", 6).alias("overlap"))


@query("token_estimate", r"""
SELECT doc_id, ceil(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) * 0.25 + length(regexp_replace(text, '[\x00-\x7F]', '', 'g')))::BIGINT AS tokens FROM documents
""")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.token_estimate(F.col("text")).alias("tokens"))


@query("canonical_ids", """
SELECT o_orderkey, 'order-' || substring(sha256(concat_ws(chr(0), o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderpriority)), 1, 24) AS fact_id FROM orders
""")
def canonical_ids(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", fn.sha_id("order", F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")).alias("fact_id"))


@query("stable_keys", """
SELECT p_partkey, 'part:' || replace(replace(p_name, '%', '%25'), ' ', '%20') || '/' || replace(p_brand, '#', '%23') AS stable_key FROM part
""")
def stable_keys(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fn.stable_key("part", F.col("p_name"), F.col("p_brand")).alias("stable_key"))


@query("nfkc_normalize")
def nfkc_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(fn.normalized(F.col("text")), 256).alias("digest"))


@query("index_cache_reuse", """
WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents),
c AS (SELECT DISTINCT digest FROM d WHERE doc_id % 3 = 0)
SELECT digest, count(*) AS n_nodes, min(doc_id) AS first_doc FROM d WHERE digest NOT IN (SELECT digest FROM c) GROUP BY digest
""")
def index_cache_reuse(t: Tables) -> DataFrame:
    """Digests that an index has to embed: those that an earlier build (every third document) didn't."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    cached = d.filter(F.col("doc_id") % 3 == 0).select("digest").distinct()
    return d.join(cached, "digest", "left_anti").groupBy("digest").agg(F.count("*").alias("n_nodes"), F.min("doc_id").alias("first_doc"))


_SIGNALS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {' OR '.join(f"contains(%s, '{a}')" for a in aliases)} THEN '{name}' END" for name, aliases in relevance.OPERATION_ALIASES.items()
) + "], lambda x: x IS NOT NULL)"
_PLAIN_SQL = r"regexp_replace(lower(%s), '[^\p{L}\p{N}]', '', 'g')"
ASKED = "search for the edit screen of the ring widget, then submit it"


@query("document_subjects", rf"""
WITH f AS (SELECT p_partkey, p_partkey::VARCHAR || '_' || CASE WHEN p_partkey % 2 = 0 THEN '画面設計書_' ELSE '' END || replace(p_name, ' ', '_') || '.v1.xlsx' AS file FROM part)
SELECT p_partkey, {_PLAIN_SQL % r"regexp_replace(regexp_replace(file, '\.[^.]*$', ''), '^[0-9]+_(画面設計書_)?', '')"} AS subject,
       array_to_string({_SIGNALS_SQL.replace('%s', "lower(file || ' Edit')")}, ',') AS operations FROM f
""")
def document_subjects(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 2 == 0, "画面設計書_").otherwise("")
    f = t.part.select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit("_"), kind, F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".v1.xlsx")).alias("file"))
    signals = relevance.operation_signals(F.concat("file", F.lit(" Edit")))
    return f.select("p_partkey", relevance.document_subject(F.col("file")).alias("subject"), F.array_join(signals, ",").alias("operations"))


@query("requirement_documents", rf"""
WITH h AS (SELECT p_partkey AS id, p_brand AS doc, replace(p_name, ' ', '_') || '.xlsx' AS file, p_type || ' edit' AS summary, p_retailprice AS retrieval FROM part),
q AS (SELECT {_PLAIN_SQL % f"'{ASKED}'"} AS q),
x AS (SELECT *, {_PLAIN_SQL % r"regexp_replace(file, '\.[^.]*$', '')"} AS s, {_PLAIN_SQL % "summary"} AS f FROM h CROSS JOIN q),
g AS (SELECT *, list_distinct([substring(q, k, 2) for k in range(1, length(q))]) AS gq, list_distinct([substring(s, k, 2) for k in range(1, length(s))]) AS gs,
             list_distinct([substring(f, k, 2) for k in range(1, length(f))]) AS gf FROM x),
k AS (SELECT doc, id, contains(q, s)::INT AS subject_contained, len(list_intersect(gs, gq)) / len(gs) AS subject_overlap,
             len(list_intersect({_SIGNALS_SQL.replace('%s', 'q')}, {_SIGNALS_SQL.replace('%s', 'f')})) AS operation_matches,
             len(list_intersect(gf, gq)) / len(gf) AS fragment_overlap, len(list_intersect(gf, gq)) AS fragment_matches, length(s) AS subject_chars, retrieval AS score FROM g)
SELECT doc, id, subject_contained, round(subject_overlap, 6) AS subject_overlap, operation_matches, round(fragment_overlap, 6) AS fragment_overlap, fragment_matches, score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY subject_contained DESC, subject_overlap DESC, operation_matches DESC, fragment_overlap DESC, fragment_matches DESC, subject_chars DESC, score DESC, id) AS rn FROM k)
WHERE rn = 1 ORDER BY subject_contained DESC, k.subject_overlap DESC, operation_matches DESC, k.fragment_overlap DESC, fragment_matches DESC, subject_chars DESC, score DESC, id LIMIT 12
""".replace("k.subject_overlap", "subject_overlap").replace("k.fragment_overlap", "fragment_overlap"))
def requirement_documents(t: Tables) -> DataFrame:
    """The best part of each brand for a request, by the seven relevance keys."""
    h = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("doc"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".xlsx")).alias("file"), F.concat("p_type", F.lit(" edit")).alias("summary"), F.col("p_retailprice").alias("retrieval"), F.array().cast("array<string>").alias("path"))
    best = relevance.best_fragments(relevance.with_relevance(h, ASKED, "file", "path", "summary", "retrieval"), "doc", "id", 12)
    return best.select("doc", "id", "subject_contained", F.round("subject_overlap", 6).alias("subject_overlap"), "operation_matches", F.round("fragment_overlap", 6).alias("fragment_overlap"), "fragment_matches", "score")
