"""Rows put together from several tables: facts of changes, labels, bindings, traces, flows and the next stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn


def change_sides(changes: DataFrame, facts: DataFrame) -> DataFrame:
    """``changes(change_id, source_snapshot, target_snapshot, stable_key)`` with ``before`` and ``after``: the fact of either side, null if it has none."""
    side = lambda snapshot, name: facts.select(F.col("snapshot_id").alias(snapshot), "stable_key", F.col("values").alias(name))
    return changes.join(side("source_snapshot", "before"), ["source_snapshot", "stable_key"], "left").join(side("target_snapshot", "after"), ["target_snapshot", "stable_key"], "left")


def labelled(nodes: DataFrame, relations: DataFrame, node: str, source: str, target: str, label: str) -> DataFrame:
    """``nodes`` with ``labels``: the different labels of the relations at either end, in order; an empty list without any."""
    ends = relations.select(F.col(source).alias(node), label).unionByName(relations.select(F.col(target).alias(node), label))
    found = ends.groupBy(node).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return nodes.join(found, node, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def members_of_json(rows: DataFrame, key: str, document: str, path: str) -> DataFrame:
    """``(key, member)``: the different strings of a JSON array in each document; none where it isn't an array."""
    array = F.from_json(F.get_json_object(document, path), "array<string>")
    return rows.select(key, F.explode(array).alias("member")).filter("member is not null").distinct()


#: Pairs that one task makes of a key's nodes and facts before the nodes are dealt over several; places of a node or fact that its rows carry.
PAIRS, MOST_PLACES = 20_000_000, 16


def facts_by_business_key(nodes: DataFrame, facts: DataFrame, memberships: DataFrame) -> DataFrame:
    """``(node_id, fact_ref)``: facts of a snapshot's documents that a node names among its business keys.

    ``nodes(node_id, snapshot_id, document_id, business_keys)``, ``memberships(snapshot_id, document_id, version_id)``,
    ``facts(fact_ref, version_id, stable_key)``. Keys are exploded, so that they meet facts by an equi-join. Pairs may be
    far more than rows, so they aren't shuffled: a pair is made once, at the first place (version and key) that both have.
    Only what has more than MOST_PLACES places is made distinct afterwards. Nulls among versions and keys meet nothing.
    """
    place = ["version_id", "stable_key"]

    def placed(rows: DataFrame, ref: str, own: str) -> DataFrame:
        """``(ref, own, version_id, stable_key)``: each place of a ref once; ``own`` has all of them, null if they are more than MOST_PLACES."""
        known = rows.filter("version_id IS NOT NULL AND stable_key IS NOT NULL").groupBy(ref).agg(F.collect_set(F.struct(*place)).alias("_all"))
        return known.select(ref, F.when(F.size("_all") <= MOST_PLACES, F.col("_all")).alias(own), F.explode("_all").alias("_at")).select(ref, own, "_at.*")

    n = nodes.select("node_id", "snapshot_id", "document_id", F.explode(F.array_distinct("business_keys")).alias("stable_key"))
    n, f = placed(n.join(memberships, ["snapshot_id", "document_id"]), "node_id", "_of_node"), placed(facts, "fact_ref", "_of_fact")
    count = lambda df, c: df.groupBy(*place).agg(F.count("*").alias(c))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = F.least(F.ceil(F.col("_n") / PAIRS * F.col("_f")), F.lit(parts))
    hot = count(n, "_n").join(count(f, "_f"), place).select(*place, slices.alias("_slices")).filter("_slices > 1")  # few: each stands for PAIRS pairs
    many = F.coalesce("_slices", F.lit(1))
    n = n.join(F.broadcast(hot), place, "left").withColumn("_slice", F.pmod(F.xxhash64("node_id"), many)).drop("_slices")
    f = f.join(F.broadcast(hot), place, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("_slices")
    few_n, few_f, rest = F.col("_of_node").isNotNull(), F.col("_of_fact").isNotNull(), [*place, "_slice"]
    # a fixed number of partitions: they are small, but their pairs are many
    pairs = n.filter(few_n).repartition(parts, *rest).join(f.filter(few_f).repartition(parts, *rest), rest)
    first = F.array_min(F.array_intersect("_of_node", "_of_fact")) == F.struct(*place)
    once = pairs.filter((F.size("_of_node") == 1) | (F.size("_of_fact") == 1) | first).select("node_id", "fact_ref")
    others = n.filter(~few_n).join(f, rest).unionByName(n.filter(few_n).join(f.filter(~few_f), rest))
    return once.unionByName(others.select("node_id", "fact_ref").distinct())


def embedding_inputs(nodes: DataFrame, profile_version: str) -> DataFrame:
    """``(node_id, text, keywords, input_digest)``: what is embedded of a node, what is searched by words, and a digest bound to the profile's version."""
    keys = F.array_sort(F.coalesce("business_keys", F.array().cast("array<string>")))
    text = F.to_json(F.struct(keys.alias("business_keys"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("summary", F.lit("")).alias("summary")))
    words = F.concat_ws("\n", "summary", "content", F.array_join(keys, "\n"))
    return nodes.select("node_id", text.alias("text"), words.alias("keywords"), F.sha2(F.concat_ws("\u0000", F.lit(profile_version), text), 256).alias("input_digest"))


def data_traces(data_sets: DataFrame, steps: DataFrame, results: DataFrame) -> DataFrame:
    """``(data_id, status, flows, evidence_refs)``: for each data set, whether a flow makes it, its steps assert, and they passed with evidence.

    ``data_sets(data_id)``, ``steps(flow_id, step_id, data_id, assertions)``, ``results(step_id, status, evidence_ref)``.
    Without a flow it is unmapped, with a step that asserts nothing or has no result unproven, with a failed one failed.
    """
    r = results.groupBy("step_id").agg(F.bool_and(F.col("status") == "passed").alias("ok"), F.collect_set("evidence_ref").alias("refs"))
    s = steps.join(r, "step_id", "left").groupBy("data_id").agg(
        F.array_sort(F.collect_set("flow_id")).alias("flows"), F.bool_or(F.col("ok") == F.lit(False)).alias("failed"), F.bool_or((F.col("assertions") == 0) | F.col("ok").isNull()).alias("open"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("refs", F.array().cast("array<string>")))))).alias("refs"),
    )
    out = data_sets.select("data_id").distinct().join(s, "data_id", "left")
    status = F.when(F.col("flows").isNull(), "unmapped").when(F.col("failed"), "failed").when(F.col("open"), "unproven").otherwise("proven")
    return out.select("data_id", status.alias("status"), "flows", F.col("refs").alias("evidence_refs"))


def flow_violations(steps: DataFrame, flow: str, step: str, sequence: str) -> DataFrame:
    """``(flow, rule)``: flows whose step ids repeat, whose sequence doesn't begin at 1, repeats or has gaps, or which name nothing."""
    per = steps.groupBy(flow).agg(
        F.count("*").alias("n"), F.countDistinct(step).alias("ids"), F.count_if(F.trim(F.coalesce(F.col(step).cast("string"), F.lit(""))) == "").alias("blank"),
        F.min(sequence).alias("low"), F.max(sequence).alias("high"), F.countDistinct(sequence).alias("places"),
    )
    rules = F.array(
        F.when(F.col("ids") + F.col("blank") < F.col("n"), F.lit("step_id_repeated")), F.when(F.col("blank") > 0, F.lit("step_id_blank")),
        F.when((F.col("low") != 1) | (F.col("high") != F.col("places")), F.lit("sequence_gap")), F.when(F.col("places") < F.col("n"), F.lit("sequence_repeated")),
    )
    return per.select(flow, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def next_stage(flows: DataFrame, key: str, stages: Sequence[tuple[str, Column]], blocked: Column) -> DataFrame:
    """``(key, next_stage, action)``: the first stage whose evidence isn't there; blocked flows wait for a person, complete ones close."""
    stage = F.lit(None).cast("string")
    for name, done in reversed(stages):
        stage = F.when(~F.coalesce(done, F.lit(False)), name).otherwise(stage)
    action = F.when(F.coalesce(blocked, F.lit(False)), "wait_for_review").when(stage.isNull(), "close").otherwise("run")
    return flows.select(key, stage.alias("next_stage"), action.alias("action"))


def recovery_order(runs: DataFrame, key: str, classes: Sequence[tuple[str, Column]], at: str, limit: int) -> DataFrame:
    """The first ``limit`` runs that a coordinator takes up: by recovery class (in the given order), then the oldest, then the id."""
    rank, name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (label, meets) in reversed(list(enumerate(classes))):
        rank, name = F.when(F.coalesce(meets, F.lit(False)), i).otherwise(rank), F.when(F.coalesce(meets, F.lit(False)), label).otherwise(name)
    rows = runs.withColumns({"_rank": rank, "recovery_class": name}).filter("_rank is not null")
    return rows.orderBy("_rank", at, key).limit(limit).drop("_rank")


def graph_rows(files: DataFrame, symbols: DataFrame, edges: DataFrame, snapshot_id: str) -> DataFrame:
    """``(snapshot_id, kind, id, path, detail)`` of a whole scan: files, symbols and edges once each, by their identity."""
    part = lambda df, kind, key, path, detail: df.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(kind).alias("kind"), key.alias("id"), path.alias("path"), detail.alias("detail"))
    f = part(files, "file", fn.sha_id("file", F.col("path")), F.col("path"), F.col("content_hash"))
    s = part(symbols, "symbol", F.col("symbol_id"), F.col("path"), F.concat_ws(":", "symbol_type", "name"))
    e = part(edges, "edge", fn.sha_id("edge", F.col("edge_type"), F.col("from_ref"), F.col("to_ref")), F.col("path"), F.concat_ws(":", "edge_type", "resolution_status"))
    return f.unionByName(s).unionByName(e).dropDuplicates(["kind", "id"])
