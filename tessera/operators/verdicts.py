"""Verdicts over evidence: cases, claims, results, confirmations, readiness, workers, profiles and contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import dyadic_bins, point_bins

# Why a node is in a context, the strongest reason first.
CONTEXT_REASONS = ("direct_change", "acceptance", "rag_candidate", "cross_document", "related", "adjacent", "parent")


def _none() -> Column:
    return F.array().cast("array<string>")


def _subset(part: Column | str, whole: Column | str) -> Column:
    return F.size(F.array_except(part, F.coalesce(whole, _none()))) == 0


def scoped(rows: DataFrame, prefix: tuple[str, str] | None = None, **wanted: object) -> DataFrame:
    """Rows whose columns equal the given values: a list means any of it, None no condition; ``prefix``: how a column begins.

    The conditions are plain comparisons, which reach the scan.
    """
    for name, value in wanted.items():
        if isinstance(value, (list, tuple, set, frozenset)):
            rows = rows.filter(F.col(name).isin(*value))
        elif value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows if prefix is None else rows.filter(F.col(prefix[0]).startswith(prefix[1]))


def claim_verdicts(claims: DataFrame, test_files: DataFrame, commands: DataFrame, artifacts: DataFrame, components: DataFrame) -> DataFrame:
    """``(claim_id, valid)``: whether a claim names sources of its kind, all of them allowed, and none of other kinds.

    ``claims(claim_id, kind, test_files, commands, artifacts, components)``, the sources as arrays; the allowed ones as
    tables of one column ``ref``. A code test needs test files and passed commands, command evidence commands, canonical
    evidence artifacts, any other kind components. Sources meet the allowed ones by a join each, not in one list.
    """
    kinds = {"test_files": test_files, "commands": commands, "artifacts": artifacts, "components": components}
    out = claims
    for name, allowed in kinds.items():
        named = claims.select("claim_id", F.explode(name).alias("ref")).distinct()
        bad = named.join(allowed.select("ref"), "ref", "left_anti").groupBy("claim_id").agg(F.count("*").alias(f"_bad_{name}"))
        out = out.join(bad, "claim_id", "left")
    has = lambda n: F.size(F.coalesce(F.col(n), _none())) > 0
    fine = lambda n: has(n) & F.col(f"_bad_{n}").isNull()
    only = lambda *some: [~has(n) for n in kinds if n not in some] + [fine(n) for n in some]

    def all_of(conditions: list[Column]) -> Column:
        held = F.lit(True)
        for c in conditions:
            held = held & c
        return held

    code, command, canonical, plan = (all_of(only(*some)) for some in (("test_files", "commands"), ("commands",), ("artifacts",), ("components",)))
    valid = F.when(F.col("kind") == "code_test", code).when(F.col("kind") == "command_evidence", command).when(F.col("kind") == "canonical_evidence", canonical).otherwise(plan)
    return out.select("claim_id", F.coalesce(valid, F.lit(False)).alias("valid"))


def executable_cases(cases: DataFrame, steps: DataFrame, data_sets: DataFrame, coverage: DataFrame) -> DataFrame:
    """``(case_id)`` of UI cases that a browser can run as planned.

    ``cases(case_id, level, mode, data_refs, criterion_refs, step_ids, expected_results)``, ``steps(case_id, channel, action,
    observations, postconditions, step_refs, data_refs)``, ``data_sets(data_id)``, ``coverage(criterion, case_id, data_id)``.
    All data is there and in a flow of the case, each criterion is covered for each data set, and each step is mapped to
    an action in the browser that is observed and asserted.
    """
    ui = (F.col("channel") == "ui") & (F.trim(F.coalesce("action", F.lit(""))) != "")
    asserted = ui & (F.col("observations") > 0) & (F.col("postconditions") > 0)
    flat = steps.select("case_id", F.explode_outer("step_refs").alias("s"), ui.alias("ui"), asserted.alias("asserted"))
    mapped = flat.groupBy("case_id").agg(F.collect_set(F.when(F.col("ui"), F.col("s"))).alias("mapped"), F.collect_set(F.when(F.col("asserted"), F.col("s"))).alias("asserted"), F.bool_or("ui").alias("any_ui"))
    flow_data = steps.select("case_id", F.explode("data_refs").alias("d")).groupBy("case_id").agg(F.collect_set("d").alias("flow_data"))
    wanted = cases.select("case_id", F.explode(F.array_distinct("data_refs")).alias("data_id"))
    missing = wanted.join(data_sets.select("data_id"), "data_id", "left_anti").select("case_id").distinct()
    pairs = cases.select("case_id", "data_refs", F.explode(F.array_distinct("criterion_refs")).alias("criterion")).select("case_id", "criterion", F.explode(F.array_distinct("data_refs")).alias("data_id"))
    uncovered = pairs.join(coverage.select("criterion", "case_id", "data_id"), ["criterion", "case_id", "data_id"], "left_anti").select("case_id").distinct()
    ok = cases.filter((F.col("level") == "ui") & (F.col("mode") == "browser") & (F.size("data_refs") > 0) & (F.size("criterion_refs") > 0) & (F.size("step_ids") > 0) & (F.size("expected_results") > 0))
    ok = ok.join(mapped, "case_id").filter("any_ui").join(flow_data, "case_id").filter(_subset("data_refs", "flow_data") & _subset("step_ids", "mapped") & _subset("step_ids", "asserted"))
    return ok.join(missing, "case_id", "left_anti").join(uncovered, "case_id", "left_anti").select("case_id")


def test_results(cases: DataFrame, flows: DataFrame, ui_results: DataFrame, edit: DataFrame) -> DataFrame:
    """``(case_id, status, evidence_refs)``: the verdict on each test case.

    ``cases(case_id, level, data_required)``, ``flows(case_id, status, evidence_refs)``, ``ui_results(case_id, status,
    evidence_refs)``, one row or none of ``edit(committed, result_refs, passed)``. Data that is required and failed or
    blocked decides; else a UI case has its UI result, any other the committed command tests; what is missing blocks.
    """
    data = flows.groupBy("case_id").agg(
        F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_or(F.col("status") != "passed"), "blocked").otherwise("passed").alias("data_status"),
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("evidence_refs", _none())))).alias("data_refs"),
    )
    ui = ui_results.groupBy("case_id").agg(F.min(F.struct(F.col("status").alias("s"), F.coalesce("evidence_refs", _none()).alias("r"))).alias("ui"))
    e = edit.agg(F.max(F.struct("committed", "result_refs", "passed")).alias("e"))  # one row
    rows = cases.join(data, "case_id", "left").join(ui, "case_id", "left").crossJoin(e)
    required = F.col("data_required")
    data_status = F.when(required, F.coalesce("data_status", F.lit("blocked")))
    ui_status = F.when(F.col("ui.s").isin("passed", "failed", "blocked"), F.col("ui.s")).otherwise("blocked")
    ran = F.coalesce(F.col("e.committed"), F.lit(False)) & (F.size(F.coalesce("e.result_refs", _none())) > 0)
    own = F.when(F.col("level") == "ui", ui_status).otherwise(F.when(~ran, "blocked").when(F.col("e.passed"), "passed").otherwise("failed"))
    refs = F.concat(F.when(required, F.coalesce("data_refs", _none())).otherwise(_none()), F.when(F.col("level") == "ui", F.coalesce("ui.r", _none())).otherwise(F.when(ran, F.col("e.result_refs")).otherwise(_none())))
    status = F.when(data_status.isin("failed", "blocked"), data_status).otherwise(own)
    return rows.select("case_id", status.alias("status"), F.array_sort(F.array_distinct(refs)).alias("evidence_refs"))


def version_deltas(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``(key, field, before, after)`` of the fields in which two versions' results differ; a version that has no row has nulls."""
    pack = lambda df, name: df.select(key, F.array(*[F.col(f).cast("string") for f in fields]).alias(name))
    both = pack(before, "b").join(pack(after, "a"), key, "full_outer")
    each = both.select(key, F.posexplode(F.array(*[F.lit(f) for f in fields])).alias("i", "field"), "b", "a")
    each = each.select(key, "field", F.get("b", F.col("i")).alias("before"), F.get("a", F.col("i")).alias("after"))
    return each.filter(~F.col("before").eqNullSafe(F.col("after")))


def confirmation_faults(items: DataFrame, decisions: DataFrame, report: str, item: str) -> DataFrame:
    """``(report, item, fault)`` where decisions don't partition a report's items: missing, unknown or repeated ones. None: it may be published."""
    n = decisions.groupBy(report, item).agg(F.count("*").alias("n"))
    both = items.select(report, item).distinct().withColumn("known", F.lit(True)).join(n, [report, item], "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return both.select(report, item, fault.alias("fault")).filter("fault is not null")


def rag_readiness(cases: DataFrame, changes: DataFrame, index: DataFrame) -> DataFrame:
    """``(case_id, status, next_state)`` of ``cases(case_id)``, their ``changes(case_id, review_status)`` and ``index(case_id, targets, indexed)``.

    An index that lacks a target, and a rejected change, block; a change in need of review waits for it; else it is ready.
    """
    c = changes.groupBy("case_id").agg(F.bool_or(F.col("review_status") == "rejected").alias("rejected"), F.bool_or(F.col("review_status") == "needs_review").alias("review"), F.count("*").alias("n"))
    i = index.groupBy("case_id").agg(F.sum("targets").alias("targets"), F.sum("indexed").alias("indexed"))
    rows = cases.select("case_id").distinct().join(c, "case_id", "left").join(i, "case_id", "left")
    full = F.coalesce((F.col("targets") > 0) & (F.col("indexed") == F.col("targets")), F.lit(False))
    status = F.when(~full | F.coalesce("rejected", F.lit(False)) | F.col("n").isNull(), "blocked").when(F.col("review"), "needs_review").otherwise("ready")
    state = F.when(status == "ready", "rag_ready").when(status == "needs_review", "in_review").otherwise("blocked")
    return rows.select("case_id", status.alias("status"), state.alias("next_state"))


def worker_view(workers: DataFrame, claims: DataFrame, as_of: str, timeout_seconds: int) -> DataFrame:
    """``(worker_id, live, active_claims)`` at a time: seen within the timeout and not stopped; claims that are open and unexpired (0 if none).

    ``workers(worker_id, last_seen, stopped)``, ``claims(worker_id, released, expires_at)``; claims are counted before they are joined.
    """
    now = F.lit(as_of).cast("timestamp")
    active = claims.filter(~F.col("released") & (F.col("expires_at") > now)).groupBy("worker_id").agg(F.count("*").alias("active_claims"))
    live = ~F.col("stopped") & (F.col("last_seen") > now - F.make_dt_interval(secs=F.lit(timeout_seconds))) & (F.col("last_seen") <= now)
    return workers.join(active, "worker_id", "left").select("worker_id", live.alias("live"), F.coalesce("active_claims", F.lit(0)).alias("active_claims"))


def match_profiles(scores: DataFrame, tie: float = 1e-9) -> DataFrame:
    """``(document, outcome, profile, score)`` of ``scores(document, profile, score, automatic)``: matched, review or ignored.

    The best automatic profile matches, unless it is tied within ``tie``; documents without an automatic one need a review if any profile scores.
    """
    best = scores.groupBy("document").agg(F.max(F.when(F.col("automatic"), F.col("score"))).alias("best"), F.max("score").alias("top"))
    near = scores.join(best, "document").filter(F.col("automatic") & (F.col("best") - F.col("score") <= tie)).groupBy("document").agg(F.count("*").alias("n"), F.min("profile").alias("p"))
    rows = best.join(near, "document", "left")
    outcome = F.when(F.col("n") == 1, "matched").when((F.col("n") > 1) | (F.col("top") > 0), "review").otherwise("ignored")
    return rows.select("document", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("p")).alias("profile"), F.coalesce("best", "top").alias("score"))


def learning_coverage(samples: DataFrame, assignments: DataFrame, profiles: DataFrame, matches: DataFrame, facts: DataFrame) -> DataFrame:
    """``(sample_id, covered, reason)``: whether each sample's assigned profile exists, alone matches it, and yields facts.

    ``samples(sample_id)``, ``assignments(sample_id, profile, variant)``, ``profiles(profile)``, ``matches(sample_id, profile,
    score, variant, automatic)``, ``facts(sample_id, n)``.
    """
    unique = match_profiles(matches.select(F.col("sample_id").alias("document"), F.concat_ws("\u0000", "profile", "variant").alias("profile"), "score", "automatic"))
    unique = unique.filter("outcome = 'matched'").select(F.col("document").alias("sample_id"), F.col("profile").alias("only"))
    rows = samples.select("sample_id").distinct().join(assignments, "sample_id", "left").join(profiles.select("profile").distinct().withColumn("known", F.lit(True)), "profile", "left")
    rows = rows.join(unique, "sample_id", "left").join(facts.groupBy("sample_id").agg(F.sum("n").alias("n_facts")), "sample_id", "left")
    fits = F.coalesce(F.col("only") == F.concat_ws("\u0000", "profile", "variant"), F.lit(False))
    reason = (
        F.when(F.col("profile").isNull(), "assignment_missing").when(F.col("known").isNull(), "profile_unknown").when(~fits, "no_unique_match")
        .when(F.coalesce("n_facts", F.lit(0)) == 0, "no_facts")
    )
    return rows.select("sample_id", reason.isNull().alias("covered"), reason.alias("reason"))


def failure_view(failures: dict[str, DataFrame], stage_of: dict[str, str]) -> DataFrame:
    """``(project, category, stage, failures, runs, last_at)``: failures of several kinds ``(project, run_id, at)`` side by side."""
    rows = None
    for category in sorted(failures):
        part = failures[category].select("project", "run_id", "at").withColumns({"category": F.lit(category), "stage": F.lit(stage_of.get(category, "other"))})
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("project", "category", "stage").agg(F.count("*").alias("failures"), F.countDistinct("run_id").alias("runs"), F.max("at").alias("last_at"))


def bind_cells(refs: DataFrame, cells: DataFrame) -> DataFrame:
    """``(ref, node_id, reason)``: the one node with a cell in a reference's ranges; of several, the only one in its first range.

    ``refs(ref, document, place, sheet, row1, col1, row2, col2)``: its ranges in order of ``place`` (0 first);
    ``cells(node_id, document, sheet, row, col)``. Ranges meet the cells of their rows in dyadic bins of a sheet.
    """
    inside = F.col("row").between(F.col("row1"), F.col("row2")) & F.col("col").between(F.col("col1"), F.col("col2"))
    tallest = refs.agg(F.max(F.col("row2") - F.col("row1") + 1)).first()[0] or 1
    top = max(0, int(tallest - 1).bit_length())
    binned = refs.withColumn("bin", F.explode(dyadic_bins(F.col("row1").cast("long"), F.col("row2").cast("long"), top)))
    placed = cells.withColumn("bin", F.explode(point_bins(F.col("row").cast("long"), top)))
    hit = binned.join(placed, ["document", "sheet", "bin"]).filter(inside).groupBy("ref", "node_id").agg(F.min("place").alias("first"))
    per = hit.groupBy("ref").agg(F.count("*").alias("n"), F.min("node_id").alias("a"), F.count_if(F.col("first") == 0).alias("n0"), F.min(F.when(F.col("first") == 0, F.col("node_id"))).alias("a0"))
    node = F.when(F.col("n") == 1, F.col("a")).when(F.col("n0") == 1, F.col("a0"))
    reason = F.when(F.col("n").isNull(), "no_node").when(node.isNull(), "ambiguous").otherwise("bound")
    return refs.select("ref").distinct().join(per, "ref", "left").select("ref", node.alias("node_id"), reason.alias("reason"))


def context_items(nodes: DataFrame, reasons: DataFrame, budget: int | None = None) -> DataFrame:
    """``(package, section_id, reason, evidence_refs, details, tokens, within_budget)``: one item a section, for the strongest reason of its nodes.

    ``nodes(package, node_id, section_id, ordinal, summary, content)`` (a section is its own), ``reasons(package, node_id,
    reason)`` of seven kinds. A package's sections go in order of reason and id, and tokens are estimated and summed in that order; beyond ``budget``
    an item isn't within it.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in CONTEXT_REASONS]), F.col("reason"))
    one = reasons.filter(rank > 0).groupBy("package", "node_id").agg(F.min(rank).alias("rank"))
    picked = nodes.join(one, ["package", "node_id"])
    each = F.array_sort(F.collect_list(F.struct("ordinal", "node_id", F.concat_ws(": ", "summary", "content").alias("d"))))
    items = picked.groupBy("package", "section_id").agg(F.min("rank").alias("rank"), each.alias("e"))
    details = F.array_join(F.transform("e", lambda x: x["d"]), " | ")
    wide = F.length(F.regexp_replace(details, r"[\x00-\x7F]", ""))
    items = items.select("package", "section_id", "rank", F.element_at(F.array(*[F.lit(r) for r in CONTEXT_REASONS]), F.col("rank").cast("int")).alias("reason"), F.transform("e", lambda x: x["node_id"]).alias("evidence_refs"), details.alias("details"), F.ceil((F.length(details) - wide) * 0.25 + wide).cast("long").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("package").orderBy("rank", "section_id"))
    return items.withColumn("within_budget", F.lit(True) if budget is None else upto <= budget).drop("rank")


def normalized_key(value: Column, how: str) -> Column:
    """A part of a stable key as it is (``preserve``), or in folded, upper or lower case."""
    return {"preserve": value, "casefold": F.lower(F.upper(value)), "uppercase": F.upper(value), "lowercase": F.lower(value)}[how]


def node_digest(kind: Column, keys: Column, summary: Column, content: Column) -> Column:
    """A digest of what a node says: fields divided by 0x1F, its sorted keys by 0x00."""
    return F.sha2(F.concat_ws("\u001f", kind, F.array_join(F.array_sort(keys), "\u0000"), summary, content), 256)


def query_texts(change: Column, keys: Column, criteria: Column) -> Column:
    """The three questions for a change, in order: what it is about, what it stands on, what has to hold."""
    return F.array(
        F.struct(F.lit("business_intent").alias("purpose"), F.concat(F.lit("Business change: "), change).alias("text")),
        F.struct(F.lit("canonical_anchor").alias("purpose"), F.concat(F.lit("Anchors: "), F.array_join(F.array_sort(keys), ", ")).alias("text")),
        F.struct(F.lit("acceptance").alias("purpose"), F.concat(F.lit("Acceptance: "), F.array_join(F.transform(criteria, lambda c: F.concat(F.lit("- "), c)), "\n")).alias("text")),
    )


def substituted(text: Column, variables: Column) -> Column:
    """``text`` with ``${name}`` replaced by the variables (a map); null if a name in it isn't there."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{([A-Za-z_]\w*)\}"), 1))
    filled = F.aggregate(names, text, lambda t, n: F.replace(t, F.concat(F.lit("${"), n, F.lit("}")), F.coalesce(F.element_at(variables, n), F.lit(""))))
    return F.when(F.forall(names, lambda n: F.map_contains_key(variables, n)), filled)


def satisfies(number: Column, predicate: Column) -> Column:
    """Whether a number meets a predicate such as ``>= 3`` or ``!=0``; null for one that can't be read."""
    op, operand = F.regexp_extract(predicate, r"^\s*(>=|<=|==|!=|>|<|=)\s*(-?\d+(?:\.\d+)?)\s*$", 1), F.regexp_extract(predicate, r"^\s*(>=|<=|==|!=|>|<|=)\s*(-?\d+(?:\.\d+)?)\s*$", 2).try_cast("double")
    return (
        F.when(op == ">=", number >= operand).when(op == "<=", number <= operand).when(op == ">", number > operand).when(op == "<", number < operand)
        .when(op == "!=", number != operand).when(op.isin("=", "=="), number == operand)
    )


def retrieval_verdict(metrics: DataFrame, leaks: DataFrame, case: str, **least: float) -> DataFrame:
    """``(case, verdict, failed)``: which thresholds a case's retrieval metrics miss; leaked candidates of other projects fail it at once.

    ``least``: lower bounds by column; a bound named ``max_<column>`` is an upper one. ``leaks(case)``: a row each.
    """
    checks = [F.when(F.col(c.removeprefix("max_")) > v if c.startswith("max_") else F.coalesce(F.col(c), F.lit(0.0)) < v, F.lit(c)) for c, v in sorted(least.items())]
    counted = leaks.groupBy(case).agg(F.count("*").alias("_leaks"))
    rows = metrics.join(counted, case, "left")
    failed = F.filter(F.array(*checks, F.when(F.coalesce("_leaks", F.lit(0)) > 0, F.lit("project_leak"))), lambda x: x.isNotNull())
    return rows.select(case, F.when(F.size(failed) > 0, "failed").otherwise("passed").alias("verdict"), failed.alias("failed"))
