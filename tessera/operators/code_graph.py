"""A code graph from source texts: symbols, imports and calls by pattern, resolved by joins.

Input is ``(path, language, text)``. What isn't unique stays unresolved, with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn

#: Patterns of declarations by language, with the name as their only group.
TYPES = {"java": r"\b(?:class|interface|enum|record)\s+([A-Z]\w*)", "kotlin": r"\b(?:class|interface|object)\s+([A-Z]\w*)", "typescript": r"\b(?:class|interface)\s+([A-Z]\w*)", "javascript": r"\bclass\s+([A-Z]\w*)", "python": r"(?m)^\s*class\s+(\w+)"}
IMPORTS = {"java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;", "kotlin": r"(?m)^\s*import\s+([\w.]+)", "python": r"(?m)^\s*(?:from|import)\s+([\w.]+)", "typescript": r"from\s+['\"]([^'\"]+)['\"]", "javascript": r"from\s+['\"]([^'\"]+)['\"]"}
METHODS = {"java": r"(?m)^\s*(?:public|protected|private|static|final|\s)+[\w<>\[\], ?]+\s+(\w+)\s*\(", "kotlin": r"\bfun\s+(\w+)\s*\(", "python": r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(", "typescript": r"\bfunction\s+(\w+)\s*\(", "javascript": r"\bfunction\s+(\w+)\s*\("}
MAPPING = r"@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"]*)\"(?:\s*,\s*method\s*=\s*(?:RequestMethod\.)?([A-Z]+))?"


def _found(patterns: dict[str, str]) -> Column:
    out = F.array().cast("array<string>")
    for language, pattern in patterns.items():
        out = F.when(F.col("language") == language, F.regexp_extract_all("text", F.lit(pattern), 1)).otherwise(out)
    return out


def _package() -> Column:
    return F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)", 1)


def symbols(files: DataFrame) -> DataFrame:
    """``(symbol_id, path, language, symbol_type, name, fqn)`` of declared types and functions."""
    kinds = F.array(F.struct(F.lit("type").alias("t"), _found(TYPES).alias("n")), F.struct(F.lit("callable").alias("t"), _found(METHODS).alias("n")))
    rows = files.select("path", "language", _package().alias("package"), F.explode(kinds).alias("k")).select("path", "language", "package", F.col("k.t").alias("symbol_type"), F.explode(F.array_distinct("k.n")).alias("name"))
    fqn = F.when(F.col("package") != "", F.concat_ws(".", "package", "name")).otherwise(F.col("name"))
    return rows.select(fn.sha_id("symbol", F.col("path"), F.col("symbol_type"), F.col("name")).alias("symbol_id"), "path", "language", "symbol_type", "name", fqn.alias("fqn"))


def imports(files: DataFrame) -> DataFrame:
    return files.select("path", "language", F.explode(F.array_distinct(_found(IMPORTS))).alias("target"))


def import_edges(files: DataFrame) -> DataFrame:
    """``(path, target, to_path, resolution_status, candidate_count)``: imports by qualified name, else by simple name.

    Relative module names are matched by the ending of the path; a name outside the tree is external.
    """
    types = symbols(files).filter("symbol_type = 'type'")
    wanted = imports(files)
    by_fqn = types.groupBy(F.col("fqn").alias("target")).agg(F.countDistinct("path").alias("n"), F.min("path").alias("p"))
    module = F.regexp_replace(F.regexp_replace("path", r"\.[a-z]+$", ""), r"^.*/", "")
    by_module = files.select(module.alias("m"), "language", "path").groupBy("m", "language").agg(F.countDistinct("path").alias("n2"), F.min("path").alias("p2"))
    last = F.element_at(F.split("target", r"[./]"), -1)
    out = wanted.join(by_fqn, "target", "left").withColumn("m", last).join(by_module, ["m", "language"], "left")
    n = F.coalesce("n", F.when(F.col("language").isin("python", "typescript", "javascript"), F.col("n2")), F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "unresolved").otherwise("external")
    return out.select("path", "target", F.when(n == 1, F.coalesce("p", "p2")).alias("to_path"), status.alias("resolution_status"), n.cast("long").alias("candidate_count"))


def type_of(names: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, name, fqn)`` of simple type names used in files: explicit import, then same package, then a unique one."""
    types = symbols(files).filter("symbol_type = 'type'").select("name", "fqn").distinct()
    known = imports(files).select("path", F.element_at(F.split("target", r"\."), -1).alias("name"), F.col("target").alias("imported"))
    known = known.join(types.select(F.col("fqn").alias("imported")), "imported", "left_semi").groupBy("path", "name").agg(F.min("imported").alias("imported"))
    package = files.select("path", _package().alias("package"))
    own = types.withColumnRenamed("fqn", "same_package")
    single = types.groupBy("name").agg(F.count("*").alias("n"), F.min("fqn").alias("only"))
    out = names.join(package, "path", "left").join(known, ["path", "name"], "left").join(single, "name", "left")
    local = out.select("path", "name", F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), "name").alias("same_package")).join(own, ["name", "same_package"], "left_semi")
    out = out.join(local.distinct(), ["path", "name"], "left")
    return out.select("path", "name", F.coalesce("imported", "same_package", F.when(F.col("n") == 1, F.col("only"))).alias("fqn"))


def endpoints(files: DataFrame) -> DataFrame:
    """``(endpoint_id, path, method, template)`` of annotated request mappings; one that names no method answers ``ANY``."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(MAPPING), 1).alias("m"), F.regexp_extract_all("text", F.lit(MAPPING), 2).alias("t"), F.regexp_extract_all("text", F.lit(MAPPING), 3).alias("own"))
    rows = files.filter("language in ('java', 'kotlin')").select("path", F.inline(pairs))
    method = F.when(F.col("m") != "Request", F.upper("m")).when(F.coalesce("own", F.lit("")) != "", F.col("own")).otherwise("ANY")
    rows = rows.select("path", method.alias("method"), fn.route_template(F.col("t")).alias("template"))
    return rows.select(fn.sha_id("endpoint", F.col("path"), F.col("method"), F.col("template")).alias("endpoint_id"), "path", "method", "template")


def preferred_edges(edges: DataFrame, source_rank: str) -> DataFrame:
    """One edge for each id: that of the source with the highest rank (later extractors win)."""
    order = Window.partitionBy("edge_id").orderBy(F.desc(source_rank))
    return edges.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def repository_tables(files: DataFrame) -> DataFrame:
    """``(repository, entity, table_name, resolution_status)``: repository types to their entity's table, unique or unresolved."""
    repos = files.select("path", F.regexp_extract("text", r"interface\s+(\w+)\s+extends\s+\w*Repository\s*<\s*(\w+)", 1).alias("repository"), F.regexp_extract("text", r"interface\s+(\w+)\s+extends\s+\w*Repository\s*<\s*(\w+)", 2).alias("entity"))
    repos = repos.filter("repository <> ''").select("repository", "entity")
    name = F.regexp_extract("text", r"\bclass\s+([A-Z]\w*)", 1)
    stated = F.regexp_extract("text", r"@Table\(\s*name\s*=\s*\"([^\"]+)\"", 1)
    entities = files.filter(F.col("text").rlike(r"@Entity\b") & (name != "")).select(name.alias("entity"), F.when(stated != "", stated).otherwise(F.lower(name)).alias("table"))
    found = entities.groupBy("entity").agg(F.countDistinct("table").alias("n"), F.min("table").alias("t"))
    out = repos.join(found, "entity", "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous_target").otherwise("no_target")
    return out.select("repository", "entity", F.when(F.col("n") == 1, F.col("t")).alias("table_name"), status.alias("resolution_status"))


# How names of repository methods begin that write, and that read.
WRITE_PREFIXES = ("create", "delete", "insert", "remove", "save", "update", "write")
READ_PREFIXES = ("count", "exists", "find", "get", "query", "read", "search", "stream")


def database_operation(method: Column) -> Column:
    """What a repository method does to its table, by the beginning of its name: writes, reads or null."""
    name = F.lower(method)
    return F.when(name.rlike("^(" + "|".join(WRITE_PREFIXES) + ")"), "writes").when(name.rlike("^(" + "|".join(READ_PREFIXES) + ")"), "reads")


def client_calls(files: DataFrame) -> DataFrame:
    """``(path, method, route)`` of HTTP calls in scripts; a route with an inserted expression has ``{*}`` in its place."""
    pattern = r"\b(?:axios|http|client|api)\.(get|post|put|delete|patch)\(\s*[`'\"]([^`'\"]+)[`'\"]"
    calls = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("m"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("r"))
    rows = files.filter("language in ('javascript', 'typescript')").select("path", F.inline(calls))
    return rows.select("path", F.upper("m").alias("method"), fn.url_path(F.regexp_replace("r", r"\$\{[^}]*\}", "{*}")).alias("route"))


def call_endpoints(files: DataFrame) -> DataFrame:
    """``(path, method, route, endpoint_id, reason)``: calls to the only endpoint of their method and normalised route, else of any method there."""
    found = endpoints(files).groupBy("method", F.col("template").alias("route")).agg(F.countDistinct("endpoint_id").alias("n"), F.min("endpoint_id").alias("e"))
    some = found.filter("method = 'ANY'").select("route", F.col("n").alias("any_n"), F.col("e").alias("any_e"))
    out = client_calls(files).join(found, ["method", "route"], "left").join(some, "route", "left")
    n, e = F.coalesce("n", "any_n"), F.when(F.col("n").isNotNull(), F.col("e")).otherwise(F.col("any_e"))
    reason = F.when(n == 1, "resolved_unique").when(n > 1, "endpoint_ambiguous").otherwise("endpoint_not_found")
    return out.select("path", "method", "route", F.when(n == 1, e).alias("endpoint_id"), reason.alias("reason"))
