"""Text, key and identity functions as Spark columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def sha_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """A content-derived id: SHA-256 of the parts joined by NUL (null parts count as empty), cut to hex digits."""
    joined = F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(joined, 256), 1, length))


def plain_text(text: Column) -> Column:
    """Lower case, white space of any kind collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x1C-\x1F]+", " "))


@F.pandas_udf(StringType())
def nfkc_folded(text: pd.Series) -> pd.Series:
    """Compatibility composition, white space collapsed, case folded; null stays null."""
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


def normalized(text: Column) -> Column:
    """``nfkc_folded``, with ASCII texts kept inside the JVM."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), plain_text(text)).otherwise(nfkc_folded(text))


def search_text(text: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def bigrams(text: Column) -> Column:
    """The set of character pairs; empty for texts of under two characters."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def overlap(a: Column, b: Column) -> Column:
    """Shared members over all members of two sets (0 for two empty sets)."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def token_estimate(text: Column) -> Column:
    """A quarter token for each ASCII character and one for each other, rounded up."""
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.ceil((F.length(text) - wide) * 0.25 + wide).cast("long")


def percent_encoded(part: Column) -> Column:
    """Percent encoding that leaves letters, digits and ``-._~`` alone."""
    out = F.url_encode(part)
    for found, put in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def stable_key(fact_type: str, *parts: Column) -> Column:
    """``type:part/part`` with each part percent-encoded; null if any part is null or empty."""
    empty = F.lit(False)
    for p in parts:
        empty = empty | p.isNull() | (F.trim(p.cast("string")) == "")
    joined = F.concat_ws("/", *[percent_encoded(p.cast("string")) for p in parts])
    return F.when(~empty, F.concat(F.lit(f"{fact_type}:"), joined))


def url_path(url: Column) -> Column:
    """The path of a URL or route: without scheme, host, query and fragment, one leading slash, none at its end."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    path = F.regexp_replace(F.concat(F.lit("/"), bare), r"/{2,}", "/")
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/$", ""))


def route_template(route: Column) -> Column:
    """A route with each ``{name}`` or ``:name`` segment as ``{*}``."""
    return F.regexp_replace(url_path(route), r"/(\{[^/}]*\}|:[^/]+)", "/{*}")


def a1_row_col(ref: Column) -> Column:
    """Row and column of a cell reference such as ``B12``; null if it is none."""
    letters = F.regexp_extract(ref, r"^([A-Z]+)([0-9]+)$", 1)
    chars = F.split(letters, "")
    col = F.aggregate(chars, F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64))
    row = F.regexp_extract(ref, r"^([A-Z]+)([0-9]+)$", 2)
    return F.when(letters != "", F.struct(row.cast("int").alias("row"), col.alias("col")))


def signature_arity(signature: Column) -> Column:
    """Parameters of ``name(type, type<a, b>)``: the commas outside of any brackets, plus one; 0 for none."""
    inside = F.regexp_extract(signature, r"\((.*)\)", 1)
    step = lambda acc, c: F.struct(
        (acc["depth"] + F.when(c.isin("<", "(", "["), 1).when(c.isin(">", ")", "]"), -1).otherwise(0)).alias("depth"),
        (acc["commas"] + F.when((c == ",") & (acc["depth"] == 0), 1).otherwise(0)).alias("commas"),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("commas"))
    return F.when(F.trim(inside) == "", 0).otherwise(F.aggregate(F.split(inside, ""), start, step, lambda acc: acc["commas"] + 1))


# Names of secrets.
SECRET_NAMES = (
    "api_key", "authorization", "cookie", "credential", "credentials", "dsn", "passwd", "password", "private_key", "pwd", "secret", "session_id", "token",
)
#: A secret name, with ``_``, ``-``, a space or nothing between its words, and what follows ``:`` or ``=`` (quoted, bearer or bare).
SECRET = r"(?i)\b((?:[a-z0-9]+[_-])*(?:" + "|".join(n.replace("_", "[_ -]?") for n in sorted(SECRET_NAMES, key=len, reverse=True)) + r"))\b(\\?[\"']?\s*[:=]\s*)(?:\\?\"[^\"]*\"|'[^']*'|bearer\s+[^\s\"',}]+|[^\s\"',}]+)"
BEARER = r"(?i)\b(bearer\s+)[^\s\"',}]+"


def redacted(text: Column) -> Column:
    """Values of secret-like names (``name: value``, ``name=value``, also quoted and in JSON at any depth) and bearer values as asterisks."""
    return F.regexp_replace(F.regexp_replace(text, SECRET, "$1$2***"), BEARER, "$1***")


def is_secret_name(name: Column) -> Column:
    """Whether a field name, in snake or camel case, ends with or is one of the secret names."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"), r"[^A-Za-z0-9]+", "_"))
    return snake.rlike("(^|_)(" + "|".join(SECRET_NAMES) + ")(_|$)")


def safe_path(path: Column) -> Column:
    """Whether a path is relative and stays below its root."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|\x00")
