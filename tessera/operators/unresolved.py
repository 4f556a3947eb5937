"""What a code graph leaves open: targets by kind, candidates, guidance, calls and routes that evidence resolves."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from .storage import saved

# What namespaces of targets are about.
TARGET_CATEGORIES = {
    "call": "call_target", "endpoint": "endpoint_route", "struts_endpoint": "endpoint_route", "table": "data_table", "entity": "entity_mapping", "config_key": "config_key",
    "route": "navigation_target", "struts_action": "navigation_target", "struts_forward": "navigation_target", "struts_global_forward": "navigation_target",
    "struts_jsp_route": "navigation_target", "struts_navigation": "navigation_target", "tiles_definition": "navigation_target",
}
# Reasons with what is missing and what to do.
GUIDANCE = {
    "external_reference_unverified": ("external_dependency_declaration", "verify_external_dependency"),
    "runtime_observation_missing": ("runtime_route_observation", "collect_runtime_route"),
    "dynamic_reference": ("runtime_value_or_static_constant", "configure_framework_adapter,inspect_extractor_diagnostic"),
    "target_ambiguous": ("unique_target_discriminator", "disambiguate_reference,configure_framework_adapter"),
    "unresolved_reference": ("extractor_resolution_proof", "configure_framework_adapter,inspect_extractor_diagnostic"),
    "target_definition_missing": ("target_definition", "add_static_definition,configure_framework_adapter"),
}


def _chosen(key: Column, table: dict[str, str], default: Column) -> Column:
    out = default
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def classified_target(target: Column, edge_type: Column) -> Column:
    """Category, namespace and detail of a target such as ``unresolved:table:users`` or ``external:lib``."""
    parts = F.split(target, ":", 3)
    namespace = F.when(target.startswith("unresolved:"), F.coalesce(F.get(parts, F.lit(1)), F.lit("generic"))).when(target.startswith("external:"), "external").otherwise("generic")
    detail = F.when(target.startswith("unresolved:"), F.coalesce(F.get(parts, F.lit(2)), F.lit(""))).when(target.startswith("external:"), F.regexp_replace(target, "^external:", "")).otherwise(target)
    other = F.when(edge_type == "navigates_to", "navigation_target").otherwise("generic_relation")
    return F.struct(_chosen(namespace, TARGET_CATEGORIES, other).alias("category"), namespace.alias("namespace"), detail.alias("detail"))


def finding_key(static_ref: Column, *identity: Column) -> Column:
    """The key under which a finding is followed from graph to graph: its static edge, else a digest of what and where it is."""
    return F.when(static_ref.isNotNull() & (static_ref != ""), F.concat(F.lit("edge:"), static_ref)).otherwise(fn.sha_id("finding", *identity))


def guidance(target: Column, namespace: Column, detail: Column, candidates: Column) -> Column:
    """The reason why a target is open, what evidence is missing and what to do."""
    dynamic = F.contains(detail, F.lit("dynamic:"))
    reason = (
        F.when(target.startswith("external:"), "external_reference_unverified").when((namespace == "endpoint") & dynamic, "runtime_observation_missing").when(dynamic, "dynamic_reference")
        .when(candidates > 1, "target_ambiguous").when(candidates == 1, "unresolved_reference").otherwise("target_definition_missing")
    )
    return F.struct(reason.alias("reason"), *[_chosen(reason, {k: v[i] for k, v in GUIDANCE.items()}, F.lit(None)).alias(n) for i, n in enumerate(("missing", "suggestions"))])


def unresolved_report(edges: DataFrame, symbols: DataFrame, endpoints: DataFrame) -> DataFrame:
    """A row for each unresolved edge: key, category, reason, missing evidence, suggestions and sorted candidates.

    ``edges(edge_id, edge_type, from_ref, to_ref, resolution_status, extractor, profile_version, path, start_line,
    end_line, static_edge_ref)``, ``symbols(symbol_id, symbol_type, name, signature)``, ``endpoints(endpoint_ref, method,
    template)``. Calls meet methods by name (and number of parameters, if they give one), tables, keys and entities
    their definitions, and endpoints the templates with their method (or ANY) that fit; each by an equi-join on a key
    of the edge. Candidates are counted by key before they meet edges.
    """
    t = classified_target(F.col("to_ref"), F.col("edge_type"))
    key = finding_key(F.col("static_edge_ref"), *[F.col(c) for c in ("edge_type", "from_ref", "extractor", "profile_version", "path", "start_line", "end_line", "to_ref")])
    opened = edges.filter("resolution_status = 'unresolved'").select("edge_id", "edge_type", "from_ref", "to_ref", key.alias("finding_key"), t.alias("t")).select("*", "t.*").drop("t")
    call = F.regexp_extract("detail", r"(?:^|\.)([A-Za-z_$][\w$]*)(?:/\d+)?$", 1)
    arity = F.regexp_extract("detail", r"/(\d+)$", 1)
    name = F.when(F.col("namespace") == "call", call).when(F.col("namespace") == "table", F.lower("detail")).when(F.col("namespace").isin("config_key", "entity"), F.col("detail"))
    opened = opened.withColumns({"look_up": F.when(name != "", name), "arity": F.when(F.col("namespace") == "call", arity).otherwise("")})
    kind = F.when(F.col("symbol_type") == "method", "call").when(F.col("symbol_type") == "db_table", "table").when(F.col("symbol_type") == "config_key", "config_key").when(F.col("symbol_type") == "class", "entity")
    named = F.when(kind == "call", F.col("name")).when(kind == "table", F.lower(F.regexp_replace("signature", "^table:", ""))).when(kind == "config_key", F.regexp_replace("signature", "^config:", "")).otherwise(F.element_at(F.split("name", r"\."), -1))
    any_or_own = F.when(kind == "call", F.array(F.lit(""), fn.signature_arity(F.col("signature")).cast("string"))).otherwise(F.array(F.lit("")))
    known = symbols.filter(kind.isNotNull()).select(kind.alias("namespace"), named.alias("look_up"), F.explode(any_or_own).alias("arity"), "symbol_id").distinct()
    found = known.groupBy("namespace", "look_up", "arity").agg(F.array_sort(F.collect_list("symbol_id")).alias("candidates"))
    plain = F.regexp_replace("detail", "^http:", "")
    asked = opened.filter((F.col("namespace") == "endpoint") & ~F.contains("detail", F.lit("dynamic:")) & F.contains(plain, F.lit(":")))
    asked = asked.select(F.split(plain, ":", 2)[0].alias("method"), F.split(plain, ":", 2)[1].alias("route"), F.col("detail").alias("asked_detail")).distinct()
    served = endpoints_for(asked, endpoints).groupBy("asked_detail").agg(F.array_sort(F.collect_set("endpoint_ref")).alias("served"))
    out = opened.join(found, ["namespace", "look_up", "arity"], "left").join(served, F.col("detail") == F.col("asked_detail"), "left")
    candidates = F.coalesce(F.when(F.col("namespace") == "endpoint", F.col("served")).otherwise(F.col("candidates")), F.array().cast("array<string>"))
    out = out.withColumn("candidates", candidates).withColumn("g", guidance(F.col("to_ref"), F.col("namespace"), F.col("detail"), F.size("candidates")))
    return out.select("finding_key", "edge_id", "edge_type", F.col("from_ref").alias("source_ref"), F.col("to_ref").alias("target_ref"), "category", "g.*", "candidates")


def endpoints_for(asked: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``asked(method, route, ..)`` with each endpoint of that method (or ANY) whose template fits, segment by segment."""
    parts = lambda c: F.split(F.regexp_replace(fn.url_path(F.col(c)), "^/", ""), "/")
    r = asked.withColumn("r_parts", parts("route")).withColumn("n", F.size("r_parts"))
    r = r.withColumn("head", F.explode(F.array(F.get("r_parts", F.lit(0)), F.lit("{*}")))).withColumn("m", F.explode(F.array_distinct(F.array(F.upper("method"), F.lit("ANY")))))
    t = endpoints.select("endpoint_ref", F.upper("method").alias("m"), F.split(F.regexp_replace(fn.route_template(F.col("template")), "^/", ""), "/").alias("t_parts"))
    t = t.withColumn("n", F.size("t_parts")).withColumn("head", F.get("t_parts", F.lit(0)))
    fits = F.forall(F.zip_with("r_parts", "t_parts", lambda x, y: (x == y) | (y == "{*}")), lambda ok: ok)
    return r.join(t, ["m", "n", "head"]).filter(fits).select(*asked.columns, "endpoint_ref").distinct()


def reconcile_routes(observations: DataFrame, routes: DataFrame, unresolved: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``(observation_id, status, reason, endpoint_ref, candidates)``: what runtime observations prove of unresolved route edges.

    ``observations(observation_id, method, path, source_route_ref)``, ``routes(route_ref, route_method)`` are the known
    UI routes, ``unresolved(edge_id, from_ref)`` the open endpoint edges. An observation proves something only if its
    source is one known route with exactly one open edge, of its method, and one endpoint fits; sources that come out at
    different endpoints prove nothing.
    """
    edges = unresolved.groupBy(F.col("from_ref").alias("source_route_ref")).agg(F.countDistinct("edge_id").alias("open"))
    o = observations.join(routes.select(F.col("route_ref").alias("source_route_ref"), "route_method").dropDuplicates(["source_route_ref"]), "source_route_ref", "left").join(edges, "source_route_ref", "left")
    found = endpoints_for(o.select("method", F.col("path").alias("route")).distinct(), endpoints).groupBy("method", F.col("route").alias("path")).agg(F.array_sort(F.collect_set("endpoint_ref")).alias("c"))
    o = o.join(found, ["method", "path"], "left")
    n = F.coalesce(F.size("c"), F.lit(0))
    early = (
        F.when(F.col("source_route_ref").isNull(), "missing_source_route_ref").when(F.col("route_method").isNull(), "source_route_not_found").when(F.col("open").isNull(), "source_route_not_unresolved")
        .when(F.col("open") != 1, "source_route_ambiguous").when(F.col("route_method") != F.upper("method"), "method_mismatch")
    )
    reason = F.coalesce(early, F.when(n == 0, "endpoint_not_found").when(n > 1, "endpoint_ambiguous").otherwise("resolved_unique"))
    o = o.withColumns({"reason": reason, "candidates": F.when(early.isNull() & (n > 0), F.col("c")).otherwise(F.array().cast("array<string>"))})
    targets = o.filter("reason = 'resolved_unique'").groupBy("source_route_ref").agg(F.array_sort(F.collect_set(F.col("candidates")[0])).alias("targets"))
    o = o.join(targets, "source_route_ref", "left")
    clash = (F.col("reason") == "resolved_unique") & (F.size("targets") > 1)
    o = o.withColumns({"candidates": F.when(clash, F.col("targets")).otherwise(F.col("candidates")), "reason": F.when(clash, "source_maps_multiple_endpoints").otherwise(F.col("reason"))})
    resolved = F.col("reason") == "resolved_unique"
    return o.select("observation_id", F.when(resolved, "resolved").otherwise("unresolved").alias("status"), "reason", F.when(resolved, F.col("candidates")[0]).alias("endpoint_ref"), "candidates")


def resolve_calls(calls: DataFrame, methods: DataFrame, fields: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """``(call_id, status, target, candidate_count, owner)`` of method calls by owner, name and number of arguments.

    ``calls(call_id, owner, receiver, name, arity)``: the receiver is null, ``this``, ``super``, a field or type name, or a
    chain ``a.b().c(x, y)`` as an array of steps ``{name, arity}`` behind ``receiver`` in ``chain``. ``methods(method_id,
    owner, name, arity, returns)``, ``fields(owner, name, type)``, ``types(fqn, simple, package)``, ``imports(owner, simple,
    fqn)``. A receiver is a field's declared type, else a type of that name: imported, of the owner's package, or the only
    one of that name. Steps of a chain go on with what their only method returns, a round for each step, until no call has
    one left. One method is a resolution; a type outside of the tree is external; all else is unresolved.
    """
    simple = types.groupBy("simple").agg(F.countDistinct("fqn").alias("n_simple"), F.min("fqn").alias("only"))
    own = types.select(F.col("package").alias("own_package"), F.col("simple").alias("own_simple"), F.col("fqn").alias("own_fqn")).distinct()
    known = types.select(F.col("fqn").alias("known_fqn")).distinct()

    def typed(rows: DataFrame, owner: str, name: str, into: str) -> DataFrame:
        """``rows`` with the full name of the type that ``name`` is in ``owner``, and whether it is outside of the tree."""
        named = F.regexp_replace(F.col(name), r"<.*$|\[\]", "")
        rows = rows.withColumns({"_t": named, "_p": F.regexp_replace(F.col(owner), r"\.?[^.]+$", "")})
        rows = rows.join(imports.select(F.col("owner").alias("_io"), F.col("simple").alias("_is"), F.col("fqn").alias("_if")).dropDuplicates(["_io", "_is"]), (F.col(owner) == F.col("_io")) & (F.col("_t") == F.col("_is")), "left")
        rows = rows.join(own, (F.col("_p") == F.col("own_package")) & (F.col("_t") == F.col("own_simple")), "left").join(simple.withColumnRenamed("simple", "_ss"), F.col("_t") == F.col("_ss"), "left")
        full = F.coalesce("_if", "own_fqn", F.when(F.col("n_simple") == 1, F.col("only")), F.when(F.contains("_t", F.lit(".")), F.col("_t")))
        rows = rows.withColumn("_f", full).join(known, F.col("_f") == F.col("known_fqn"), "left")
        outside = F.col("_f").isNotNull() & F.col("known_fqn").isNull()
        return rows.withColumns({into: F.col("known_fqn"), f"{into}_external": F.coalesce(outside, F.lit(False))}).drop("_t", "_p", "_io", "_is", "_if", "own_package", "own_simple", "own_fqn", "_ss", "n_simple", "only", "_f", "known_fqn")

    one = methods.groupBy("owner", "name", "arity").agg(F.countDistinct("method_id").alias("n"), F.min("method_id").alias("m"), F.min("returns").alias("returns"))
    rows = calls.join(fields.select(F.col("owner").alias("_fo"), F.col("name").alias("_fn"), F.col("type").alias("_ft")).dropDuplicates(["_fo", "_fn"]), (F.col("owner") == F.col("_fo")) & (F.regexp_replace("receiver", r"^this\.", "") == F.col("_fn")), "left")
    here = F.col("receiver").isNull() | F.col("receiver").isin("this", "super")
    rows = rows.withColumn("_r", F.coalesce("_ft", F.when(F.element_at(F.split("receiver", r"\."), -1).rlike("^[A-Z]"), F.col("receiver")))).drop("_fo", "_fn", "_ft")
    rows = typed(rows, "owner", "_r", "at")
    rows = rows.withColumns({"at": F.when(here, F.col("owner")).otherwise(F.col("at")), "at_external": ~here & F.col("at_external")})
    if "chain" in calls.columns:
        rows = _followed(rows.withColumn("_i", F.lit(0)), one, typed)
    found = one.select(F.col("owner").alias("at"), F.col("name"), F.col("arity"), "n", "m")
    rows = rows.join(found, ["at", "name", "arity"], "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("at_external"), "external").when(n == 1, "resolved").otherwise("unresolved")
    return rows.select("call_id", status.alias("status"), F.when(status == "resolved", F.col("m")).alias("target"), n.cast("long").alias("candidate_count"), F.col("at").alias("owner"))


def _followed(rows: DataFrame, one: DataFrame, typed: Callable[[DataFrame, str, str, str], DataFrame]) -> DataFrame:
    """``rows`` with ``at`` after all steps of their ``chain``; those that are through leave before the next round."""
    back = one.select(F.col("owner").alias("_o"), F.col("name").alias("_n"), F.col("arity").alias("_a"), F.when(F.col("n") == 1, F.col("returns")).alias("_back"))
    open_ = F.col("at").isNotNull() & (F.col("_i") < F.size(F.coalesce("chain", F.array())))
    rows = saved(rows)
    done = []
    while True:
        done.append(rows.filter(~open_))
        pending = rows.filter(open_)
        if pending.isEmpty():
            break
        step = F.get("chain", F.col("_i"))
        moved = pending.join(back, (F.col("at") == F.col("_o")) & (step["name"] == F.col("_n")) & (step["arity"] == F.col("_a")), "left").drop("_o", "_n", "_a")
        moved = typed(moved, "at", "_back", "to")
        rows = saved(moved.withColumns({"at": F.col("to"), "at_external": F.col("at_external") | F.col("to_external"), "_i": F.col("_i") + 1}).drop("to", "to_external", "_back"))
    through = reduce(lambda a, b: a.unionByName(b), done)
    return through.withColumn("at", F.when(F.col("_i") >= F.size(F.coalesce("chain", F.array())), F.col("at"))).drop("_i")


def test_bindings(edges: DataFrame, owners: DataFrame, snapshot_id: str) -> DataFrame:
    """``(binding_id, production_file, test_file, edge_id, confidence)``: the best resolved ``tests`` edge of each pair of files.

    ``edges(edge_id, edge_type, resolution_status, from_ref, to_ref, confidence)``, ``owners(ref, file_id, role)``.
    """
    side = lambda ref, s: owners.select(F.col("ref").alias(ref), F.col("file_id").alias(f"{s}_file"), F.col("role").alias(f"{s}_role"))
    e = edges.filter("edge_type = 'tests' AND resolution_status = 'resolved'").join(side("from_ref", "from"), "from_ref").join(side("to_ref", "to"), "to_ref")
    is_test = lambda s: F.col(f"{s}_role") == "test"
    e = e.filter(is_test("from") != is_test("to")).withColumns({"production_file": F.when(is_test("from"), F.col("to_file")).otherwise(F.col("from_file")), "test_file": F.when(is_test("from"), F.col("from_file")).otherwise(F.col("to_file"))})
    order = F.struct(F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2).alias("p"), "edge_id", "confidence")
    best = e.groupBy("production_file", "test_file").agg(F.min(order).alias("b")).select("production_file", "test_file", "b.edge_id", "b.confidence")
    return best.select(fn.sha_id("test-binding", F.lit(snapshot_id), F.col("production_file"), F.col("test_file"), F.col("edge_id")).alias("binding_id"), "*")


def preferred_targets(names: DataFrame, candidates: DataFrame, name: str, candidate_id: str, is_definition: str) -> DataFrame:
    """``(name, target, candidate_count)``: definitions win over references; the only one of the better kind is the target."""
    by_name = candidates.groupBy(name).agg(
        F.countDistinct(F.when(F.col(is_definition), F.col(candidate_id))).alias("nd"), F.min(F.when(F.col(is_definition), F.col(candidate_id))).alias("d"),
        F.countDistinct(candidate_id).alias("nr"), F.min(candidate_id).alias("r"),
    )
    n, target = F.when(F.col("nd") > 0, F.col("nd")).otherwise(F.coalesce("nr", F.lit(0))), F.when(F.col("nd") > 0, F.col("d")).otherwise(F.col("r"))
    return names.select(name).distinct().join(by_name, name, "left").select(name, F.when(n == 1, target).alias("target"), n.alias("candidate_count"))


def scoped_targets(asked: DataFrame, scoped: DataFrame, shared: DataFrame, scope: str, name: str, target: str) -> DataFrame:
    """``(scope, name, target, candidate_count)``: targets of the own scope, else (none there) the shared ones of that name.

    Askers without a scope look among all shared targets. The only target is the result.
    """
    count = lambda df, keys, s: df.groupBy(*keys).agg(F.countDistinct(target).alias(f"n{s}"), F.min(target).alias(f"t{s}"))
    rows = asked.select(scope, name).distinct().join(count(scoped, [scope, name], "1"), [scope, name], "left").join(count(shared, [name], "2"), name, "left")
    n, t = F.coalesce("n1", "n2", F.lit(0)), F.when(F.col("n1").isNotNull(), F.col("t1")).otherwise(F.col("t2"))
    return rows.select(scope, name, F.when(n == 1, t).alias(target), n.alias("candidate_count"))


def action_methods(owners: DataFrame, methods: DataFrame, names: Sequence[str] = ("execute", "perform"), arity: int = 4) -> DataFrame:
    """``(owner, method_id, candidate_count)``: the entry method of an action class, of ``arity`` parameters if there is one, else of any.

    ``owners(owner, dispatches)``: classes that dispatch by a request parameter have no single entry. ``methods(owner, name, arity, method_id)``.
    """
    m = methods.filter(F.col("name").isin(*names)).groupBy("owner").agg(
        F.countDistinct(F.when(F.col("arity") == arity, F.col("method_id"))).alias("n4"), F.min(F.when(F.col("arity") == arity, F.col("method_id"))).alias("m4"),
        F.countDistinct("method_id").alias("n"), F.min("method_id").alias("m"),
    )
    n, found = F.when(F.col("n4") > 0, F.col("n4")).otherwise(F.coalesce("n", F.lit(0))), F.when(F.col("n4") > 0, F.col("m4")).otherwise(F.col("m"))
    return owners.join(m, "owner", "left").select("owner", F.when((n == 1) & ~F.col("dispatches"), found).alias("method_id"), n.alias("candidate_count"))


def endpoint_product(classes: DataFrame) -> DataFrame:
    """``(endpoint, owner, method, path)``: class paths x method paths x HTTP methods, joined by one slash, first ones kept.

    ``classes(owner, class_paths, method_paths, http_methods)``: an empty list of paths is one empty path, of methods is ANY.
    """
    some = lambda c, d: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.col(c)).otherwise(F.array(F.lit(d)))
    trim = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    path = lambda a, b: F.concat(F.lit("/"), F.array_join(F.filter(F.array(trim(a), trim(b)), lambda p: p != ""), "/"))
    paths = F.array_distinct(F.flatten(F.transform(some("class_paths", ""), lambda a: F.transform(some("method_paths", ""), lambda b: path(a, b)))))
    rows = classes.select("owner", F.explode(paths).alias("path"), some("http_methods", "ANY").alias("ms")).select("owner", "path", F.explode(F.array_distinct("ms")).alias("method"))
    return rows.select(fn.sha_id("endpoint", F.col("owner"), F.col("method"), F.col("path")).alias("endpoint"), "owner", "method", "path").distinct()


def field_accesses(tokens: DataFrame, fields: DataFrame, local_names: DataFrame) -> DataFrame:
    """``(method_id, field_id, access)`` of name uses: what ``=`` follows is written, compound assignment and ``++``/``--`` read and write, all else reads.

    ``tokens(method_id, owner, name, operator)``: the operator that follows (or a leading ``++``); names in
    ``local_names(method_id, name)`` shadow fields ``(field_id, owner, name)``, but for tokens that are ``qualified`` (by ``this.``), if there is that column.
    """
    kinds = F.when(F.col("operator") == "=", F.array(F.lit("writes"))).when(F.col("operator").isin("++", "--") | F.col("operator").rlike(r"^(\+|-|\*|/|%|&|\||\^|<<|>>>?)=$"), F.array(F.lit("reads"), F.lit("writes"))).otherwise(F.array(F.lit("reads")))
    plain = tokens if "qualified" not in tokens.columns else tokens.filter(~F.col("qualified"))
    free = plain.join(local_names, ["method_id", "name"], "left_anti")
    free = free if "qualified" not in tokens.columns else free.unionByName(tokens.filter("qualified"))
    used = free.join(fields, ["owner", "name"])
    return used.select("method_id", "field_id", F.explode(kinds).alias("access")).distinct()


def sql_table_refs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, table, line, is_definition)`` of tables in SQL texts, and ``(path, table, access, line)`` of their uses.

    ``files(path, text)``. The first definition of a table is its line, else its first use; CREATE, INSERT, UPDATE and
    others write, FROM and JOIN read. Names are compared in lower case, without quotes. Texts are matched whole, so that
    a table may stand on a line after its keyword; a use has the keyword's line. Paths must be unique.
    """
    pattern = r"(?i)\b(create\s+table(?:\s+if\s+not\s+exists)?|insert\s+into|update|delete\s+from|alter\s+table|from|join)\s+(\"[^\"]+\"|[A-Za-z_][\w.$]*)"
    marked = F.regexp_replace(F.translate("text", "\x01\x02", "  "), pattern, "\x01$1\x02$2\x02$0")  # a mark before each match: what stands between two marks is its part
    parts = files.select("path", F.posexplode(F.split(marked, "\x01")).alias("k", "part"))
    fields = F.split("part", "\x02")
    shown = F.when(F.col("k") == 0, F.col("part")).otherwise(F.get(fields, F.lit(2)))
    parts = parts.withColumn("newlines", F.length(shown) - F.length(F.replace(shown, F.lit("\n"))))
    before = F.sum("newlines").over(Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    found = parts.withColumn("line", (1 + F.coalesce(before, F.lit(0))).cast("int")).filter("k > 0")
    found = found.select("path", "line", "k", F.lower(F.regexp_replace(fields[0], r"\s+", " ")).alias("op"), F.lower(F.replace(fields[1], F.lit('"'))).alias("table"))
    is_definition = F.col("op").startswith("create table")
    tables = found.groupBy("path", "table").agg(F.min(F.struct((~is_definition).alias("later"), "line")).alias("m")).select("path", "table", "m.line", (~F.col("m.later")).alias("is_definition"))
    return tables, found.select("path", "table", F.when(F.col("op").isin("from", "join"), "reads").otherwise("writes").alias("access"), "line")


def changed_files(status: DataFrame) -> DataFrame:
    """``(change, path, old_path)`` of ``git diff --name-status`` lines ``(line)``: added, modified, deleted, renamed, copied."""
    parts = F.split("line", "\t")
    change = F.element_at(F.create_map(*[F.lit(x) for kv in {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "modified"}.items() for x in kv]), F.substring(parts[0], 1, 1))
    two = F.size(parts) > 2
    return status.filter(F.trim("line") != "").select(change.alias("change"), F.when(two, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"), F.when(two, F.get(parts, F.lit(1))).alias("old_path"))


def changed_lines(diff: DataFrame) -> DataFrame:
    """``(path, line)`` of lines that ``diff(pos, line)`` text with ``--unified=0`` hunks adds or changes; a hunk of no lines adds none."""
    upto = Window.partitionBy("file_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    file_no = F.sum(F.when(F.col("line").startswith("diff --git "), 1).otherwise(0)).over(Window.partitionBy("diff_id").orderBy("pos"))
    rows = (diff if "diff_id" in diff.columns else diff.withColumn("diff_id", F.lit(0))).withColumn("file_no", F.struct("diff_id", file_no.alias("n")))
    rows = rows.withColumn("path", F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substring("line", 5, 1 << 20), "^b/", "")), ignorenulls=True).over(upto))
    start, count = (F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", g) for g in (1, 2))
    hunks = rows.filter(F.col("line").startswith("@@ ") & (F.col("path") != "/dev/null")).select("path", start.cast("long").alias("s"), F.when(count == "", 1).otherwise(count.try_cast("long")).alias("n")).filter("n > 0")
    return hunks.select("path", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("line")).distinct()
