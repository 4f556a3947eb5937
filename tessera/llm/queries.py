"""The registered queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_anchors, class_lm, decontaminate, maxscore, mixing, phrases, pii, quality_rules, sharding, simhash, snapshots, toxic_spans, wrapper
from .common import table


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = wrapper.extract_articles(table(spark, sf_dir, "pages"))
    return pages.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic_spans.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.rendered_conversations(table(spark, sf_dir, "conversations"))


def op5_qgram_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "end", "edits")


def op6_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = class_lm.score_documents(table(spark, sf_dir, "documents"))
    return scored.withColumnRenamed("id", "doc_id")


def op7_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = block_anchors.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", quality_rules.judged(F.col("text")).alias("m")).select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "m.base_failed", "m.kept",
        "m.n_lines", "m.n_stop_words",
    )


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maxscore.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrapper_induction": op1_wrapper_induction,
    "op2_crf_toxicity": op2_crf_toxicity,
    "op3_pareto_mix": op3_pareto_mix,
    "op4_snapshot_collapse": op4_snapshot_collapse,
    "op5_qgram_decontaminate": op5_qgram_decontaminate,
    "op6_brown_classes": op6_brown_classes,
    "op7_block_anchors": op7_block_anchors,
    "op8_feistel_shards": op8_feistel_shards,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash_groups": op10_simhash_groups,
    "op11_suffix_phrases": op11_suffix_phrases,
    "op12_checked_pii": op12_checked_pii,
    "op13_maxscore": op13_maxscore,
}
