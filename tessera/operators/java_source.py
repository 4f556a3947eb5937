"""Declarations, calls, names and lambdas out of Java source texts, by tokens and matched brackets.

No parser runs. ``tokens`` takes a text apart with one pattern; running depths over the places of tokens say
which brackets belong together and in which bracket each token stands (``matched``); the tokens that stand
directly in a type's body make the skeletons of its members, in which arguments and bodies are empty brackets,
so that simple patterns tell methods, constructors and fields apart. All windows are over one file, so a
file must fit into a task; files are independent.

What can't be told from the text isn't guessed: a call on an expression other than a name, a ``this``, a
``new`` or a chain of calls has the receiver ``?`` and stays unresolved. Types of more than four generic levels come out as
plain tokens. Unbalanced brackets have no partner; what stands in them has no owner and is left out.

Edge cases: null and empty texts have no tokens; rows with equal paths are one file only if they are one row,
so paths must be unique; strings, characters, comments and text blocks may hold any brackets; an empty table gives
empty results; very long files are held by one task, as windows over a file are.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from .storage import saved, written

_INNER = r"[\w\s.,?\[\]]"
_GENERIC = reduce(lambda inside, _: rf"<(?:{_INNER}|{inside})*+>", range(3), rf"<{_INNER}*+>")
#: One token: white space, comments, text blocks, strings, characters, names, numbers, generic arguments, operators, or any other character.
TOKEN = "|".join([
    r"\s++", r"//[^\n]*+", r"(?s:/\*.*?\*/)", r'(?s:""".*?""")', r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)++'", r"[\p{L}_$][\p{L}\p{N}_$]*+", r"[0-9][\w.]*+",
    rf"(?<=[\w.])(?:(?=<\s*[A-Z?>])|(?<=\.)){_GENERIC}", r"->|::|\.\.\.|\+\+|--|>>>=|<<=|>>=|[-+*/%&|^!=<>]=|&&|\|\|", r"(?s:.)",
])

# Words of the language that are no names.
MODIFIERS = ("abstract", "default", "final", "native", "private", "protected", "public", "sealed", "static", "strictfp", "synchronized", "transient", "volatile")
PRIMITIVES = ("boolean", "byte", "char", "double", "float", "int", "long", "short", "void")
OTHER_WORDS = (
    "assert", "break", "case", "catch", "class", "const", "continue", "do", "else", "enum", "extends", "finally", "for", "goto", "if", "implements", "import",
    "instanceof", "interface", "new", "package", "return", "super", "switch", "this", "throw", "throws", "try", "while", "yield", "true", "false", "null",
)
TYPE_WORDS = ("class", "interface", "enum", "record")
ASSIGNMENTS = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "++", "--")


def tokens(files: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """``(path, j, at, line, token)`` of ``files(path, text)``: the tokens that are no space or comment, numbered from 0; ``at`` counts characters from 0."""
    dealt = _by_path(files.select("path", "text"))  # texts are dealt by path, so that their tokens needn't be
    rows = dealt.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("i", "token")).withColumn("_told", ~F.col("token").rlike(r"^(?:\s|//|/\*)"))
    by = Window.partitionBy("path").orderBy("i")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        "path", "token", "_told", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)).alias("at"),
        (1 + F.coalesce(F.sum(F.length("token") - F.length(F.replace("token", F.lit("\n")))).over(before), F.lit(0))).alias("line"),
        F.coalesce(F.sum(F.col("_told").cast("int")).over(before), F.lit(0)).cast("int").alias("j"),
    )
    return placed.filter("_told").select("path", "j", "at", "line", "token")


def _by_path(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by path over a fixed number of partitions: what is made of them is far more than their bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _at_depth() -> Window:
    return Window.partitionBy("path", "_depth").orderBy("j", "_as")


def _with_depth(rows: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """``rows`` with their ``_depth``; what opens is there once more (``_as`` is 1), at the depth that it opens."""
    delta = F.when(opens, 1).when(closes, -1).otherwise(0)
    rows = rows.withColumn("_after", F.sum(delta).over(Window.partitionBy("path").orderBy("j")))
    rows = rows.withColumn("_depth", F.when(opens, F.col("_after") - 1).otherwise(F.col("_after")))
    both = rows.withColumn("_as", F.explode(F.when(opens, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return both.withColumn("_depth", F.col("_depth") + F.col("_as")).drop("_after")


def enclosing(rows: DataFrame, opens: Column, closes: Column, into: str, carried: str | Column = "j") -> DataFrame:
    """``rows(path, j, ..)`` with ``into``: the ``j`` (or what else is ``carried``) of the innermost row with ``opens`` whose ``closes`` is still to come.

    A row that opens or closes stands itself in what is around it. Depths are running sums, the innermost opening of a depth is the last one.
    """
    carried = F.col(carried) if isinstance(carried, str) else carried
    both = _with_depth(rows, opens, closes)
    last = F.last(F.when(F.col("_as") == 1, carried), ignorenulls=True).over(_at_depth())
    return both.withColumn(into, F.when(F.col("_depth") > 0, last)).filter("_as = 0").drop("_as", "_depth")


def _matched(rows: DataFrame) -> DataFrame:
    """See ``matched``; also with ``block_token``, and still ordered as in ``_at_depth``.

    Between a bracket and its partner nothing stands at their depth, so that they are neighbours there.
    """
    opens, closes = F.col("token").isin("(", "[", "{"), F.col("token").isin(")", "]", "}")
    w, own = _at_depth(), F.when(F.col("_as") == 0, F.col("token"))
    fits = lambda a, b: F.concat(a, b).isin("()", "[]", "{}")
    inner = F.col("_as") == 1
    both = _with_depth(rows, opens, closes).withColumns({
        "_block": F.last(F.when(inner, F.col("j")), ignorenulls=True).over(w), "_block_token": F.last(F.when(inner, F.col("token")), ignorenulls=True).over(w),
        "_next": F.lead(own).over(w), "_next_j": F.lead("j").over(w), "_prev": F.lag(own).over(w), "_prev_j": F.lag("j").over(w),
    })
    inside = F.col("_depth") > 0
    partner = F.when(opens & fits(F.col("token"), F.col("_next")), F.col("_next_j")).when(closes & fits(F.col("_prev"), F.col("token")), F.col("_prev_j"))
    both = both.filter("_as = 0").withColumns({"block": F.when(inside, F.col("_block")), "block_token": F.when(inside, F.col("_block_token")), "partner": partner})
    return both.drop("_block", "_block_token", "_next", "_next_j", "_prev", "_prev_j")


def matched(rows: DataFrame) -> DataFrame:
    """``rows(path, j, token, ..)`` with ``block``, the innermost bracket around, and ``partner``, the other bracket of a pair.

    A closing bracket of another kind than the innermost open one has no partner, nor has that one.
    """
    return _matched(rows).drop("block_token", "_depth", "_as")


class Source:
    """What a tree of Java files declares and does; each attribute is a DataFrame over all files."""

    def __init__(self, files: DataFrame) -> None:
        by = Window.partitionBy("path").orderBy("j")
        rows = tokens(files).withColumns({"prev": F.lag("token").over(by), "next": F.lead("token").over(by), "prev2": F.lag("token", 2).over(by)})
        rows = rows.withColumn("named", F.col("token").rlike(r"^[\p{L}_$]") & ~F.col("token").isin(*OTHER_WORDS, *PRIMITIVES, *MODIFIERS))
        at = _at_depth()  # all that follows is read off this one order: the next row at a depth is a bracket's partner, or the bracket behind a name
        rows = _matched(rows).withColumns({
            "n": F.sum((F.col("token") == ",").cast("int")).over(at), "next_partner": F.when(F.col("next") == "(", F.lead("partner").over(at)), "_close_line": F.lead("line").over(at),
        })
        # a type's body is the first brace behind its name that stands where the name does
        is_type = F.col("prev").isin(*TYPE_WORDS) & F.col("named") & ~(F.coalesce("prev2", F.lit("")) == ".") & ((F.col("prev") != "record") | F.col("next").rlike(r"^[(<]"))
        rows = rows.withColumn("_b", F.when((F.col("token") == "{") & F.col("partner").isNotNull(), F.struct("block", F.col("j").alias("body"), F.col("partner").alias("body_end"), F.col("_close_line").alias("end_line"))))
        rows = rows.withColumn("_b", F.expr("lead(_b) IGNORE NULLS OVER (PARTITION BY path, _depth ORDER BY j, _as)"))
        rows = rows.withColumn("_b", F.when(is_type & F.col("_b.block").eqNullSafe(F.col("block")), F.col("_b")))
        self.rows = written(rows.select("*", "_b.body", "_b.body_end", "_b.end_line").drop("_b", "_depth", "_as", "_close_line", "at"))
        package = files.select("path", F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"))
        self.imports_of = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+([\w.]+)\s*;"), F.lit(1))).alias("fqn"))
        self.types = self._types(package)
        self.members = written(self._members())

    def _in_types(self, rows: DataFrame) -> DataFrame:
        """``rows(path, j, ..)`` with ``type_at``: the ``j`` of the innermost type's body around them."""
        found = self.rows.filter("body IS NOT NULL").select("path", "body", "body_end").distinct()
        mark = lambda c, n: found.select("path", F.col(c).alias("j"), F.lit(n).alias("_mark"))
        both = rows.withColumn("_mark", F.lit(0)).unionByName(mark("body", 1).unionByName(mark("body_end", -1)), allowMissingColumns=True)
        return enclosing(both, F.col("_mark") == 1, F.col("_mark") == -1, "type_at").filter("_mark = 0").drop("_mark")

    def _types(self, package: DataFrame) -> DataFrame:
        """``(path, body, fqn, simple, package, owner, line, end_line)``; a nested type has the names of those around it."""
        at = self._in_types(self.rows.filter("body IS NOT NULL").select("path", "j", "body", F.col("token").alias("simple"), "line", "end_line")).drop("j")
        left = at.join(package, "path")
        full = lambda head: F.concat_ws(".", F.when(head != "", head), "simple")
        done = left.filter("type_at IS NULL").withColumns({"fqn": full(F.col("package")), "owner": F.lit(None).cast("string")})
        out, level = done, done
        left = saved(left.filter("type_at IS NOT NULL"))
        while not left.isEmpty():  # a round for each level of nesting
            level = saved(left.join(level.select("path", F.col("body").alias("type_at"), F.col("fqn").alias("owner")), ["path", "type_at"]).withColumn("fqn", F.concat_ws(".", "owner", "simple")).select(*done.columns))
            if level.isEmpty():
                break
            left = saved(left.join(level.select("path", "body"), ["path", "body"], "left_anti"))
            out = out.unionByName(level)
        return saved(out.select("path", "body", "fqn", "simple", "package", "owner", "line", "end_line"))

    def _members(self) -> DataFrame:
        """``(path, fqn, simple, first, last, line, end_line, params, shape, ..)``: the tokens that stand directly in a type's body, part by part.

        ``shape`` is what is left without annotations and modifiers; brackets are empty in it. ``params`` is the last round bracket before a value.
        """
        own = self.rows.filter("block_token = '{'").select("path", "j", "token", "partner", "line", "block").join(self.types.select("path", F.col("body").alias("block"), "fqn", "simple"), ["path", "block"])
        begun = Window.partitionBy("path", "block").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
        last_at = lambda token: F.coalesce(F.max(F.when(F.col("token") == token, F.col("j"))).over(begun), F.lit(-1))
        own = own.withColumn("_in_value", last_at("=") > last_at(";"))  # a value ends with a semicolon, whatever braces it has
        ends = (F.col("token") == ";") | (F.col("token") == "}") & ~F.col("_in_value")
        own = own.withColumn("part", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(begun), F.lit(0)))
        parts = own.groupBy("path", "block", "fqn", "simple", "part").agg(
            F.array_sort(F.collect_list(F.struct("j", "token", "partner"))).alias("m"), F.min("line").alias("line"), F.max("line").alias("end_line"), F.min("j").alias("first"), F.max("j").alias("last"),
        )
        shape = F.array_join(F.transform("m", lambda x: x["token"]), " ")
        shape = F.regexp_replace(shape, r"@ [\w$]+(?: \. [\w$]+)*+(?: \( \))?+ ?", "")
        shape = F.regexp_replace(shape, r"(?<![\w$])(?:" + "|".join(MODIFIERS) + r")(?![\w$]) ?", "")
        value = F.array_position(F.transform("m", lambda x: x["token"]), F.lit("="))
        head = F.when(value > 0, F.slice("m", F.lit(1), F.greatest(value - 1, F.lit(0)).cast("int"))).otherwise(F.col("m"))
        params = F.element_at(F.filter(head, lambda x: x["token"] == "("), -1)
        params = F.when(F.size(F.filter(head, lambda x: x["token"] == "(")) > 0, params)
        end = F.element_at("m", -1)
        return parts.withColumn("head", head).select("path", "block", "fqn", "simple", "first", "last", "line", "end_line", shape.alias("shape"), params["j"].alias("params"), params["partner"].alias("params_end"), F.when(end["token"] == "}", end["partner"]).alias("body"))

    def methods(self) -> DataFrame:
        """See ``_methods``; written once."""
        return self._methods

    @cached_property
    def _methods(self) -> DataFrame:
        """``(method_id, path, owner, name, arity, parameter_types, returns, kind, line, end_line, body, body_end, params, parameters)``; a constructor returns nothing.

        ``returns`` is the type without generic arguments; ``body`` and ``body_end`` are the places of the braces, null where there are none.
        """
        kind = F.when(F.col("shape").rlike(r"^(?:< [^(]*? > )?[\w$]+ \( \)(?: throws [^{]*)? \{") & (F.regexp_extract("shape", r"([\w$]+) \( \)", 1) == F.col("simple")), "constructor")
        kind = kind.when(F.col("shape").rlike(r"^(?:< [^(=]*? > )?[\w$. ]+(?:<[^(=]*> )?(?:\[ \] )*[\w$]+ \( \)(?: \[ \])*(?: throws [^{;]*)?(?: default [^;]*)? [{;]") & ~F.col("shape").rlike(r"^(?:new|return|record|class|interface|enum) "), "method")
        found = self.members.withColumn("kind", kind).filter("kind IS NOT NULL AND params_end IS NOT NULL")
        name = F.regexp_extract("shape", r"([\w$]+) \( \)", 1)
        returns = F.regexp_replace(F.regexp_replace(F.regexp_extract("shape", r"^(?:< [^(]*? > )?(.*?) ?[\w$]+ \( \)", 1), r"<.*>", ""), " ", "")
        found = found.withColumns({"name": name, "returns": F.when((F.col("kind") == "method") & (returns != "void"), returns)})
        found = found.join(self._parameters(), ["path", "params"], "left")
        types = F.coalesce("parameter_types", F.array().cast("array<string>"))
        signature = F.concat("fqn", F.lit("#"), "name", F.lit("("), F.array_join(types, ","), F.lit(")"))
        return written(found.select(signature.alias("method_id"), "path", F.col("fqn").alias("owner"), "name", F.size(types).alias("arity"), types.alias("parameter_types"), "returns", "kind", "line", "end_line", "body", F.when(F.col("body").isNotNull(), F.col("last")).alias("body_end"), "params", F.coalesce("parameters", F.array().cast("array<string>")).alias("parameters")))

    @cached_property
    def _arguments(self) -> DataFrame:
        """``(path, params, n, text)``: what stands directly in a round bracket, between commas; ``n`` grows with each comma of a bracket."""
        kept = self.rows.filter("block_token = '(' AND token <> ','")
        return written(kept.groupBy("path", F.col("block").alias("params"), "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "token"))), lambda x: x["token"]), " ").alias("text")))

    def _parameters(self) -> DataFrame:
        plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"@ [\w$]+(?: \. [\w$]+)*+(?: \( \))?+ ?", ""), r"(?<![\w$])final ", ""))
        name = F.regexp_extract(plain, r"([\w$]+)(?: \[ \])*$", 1)
        kind = F.regexp_replace(F.regexp_replace(plain, r" ?[\w$]+((?: \[ \])*)$", "$1"), " ", "")
        rows = self._arguments.select("path", "params", F.struct("n", kind.alias("type"), name.alias("name")).alias("p"))
        ordered = rows.groupBy("path", "params").agg(F.array_sort(F.collect_list("p")).alias("p"))
        return ordered.select("path", "params", F.transform("p", lambda x: x["type"]).alias("parameter_types"), F.transform("p", lambda x: x["name"]).alias("parameters"))

    def fields(self) -> DataFrame:
        """``(field_id, path, owner, name, type, line)``; several names behind one type are several fields."""
        is_field = F.col("shape").rlike(r"^[\w$. ]+(?:<[^(=]*> )?(?:\[ \] )*[\w$]+(?: \[ \])* (?:=|;|,)") & ~F.col("shape").rlike(r"^(?:return|package|import|throw|new) ")
        found = self.members.filter(is_field & F.col("shape").endswith(";"))
        kind = F.regexp_extract("shape", r"^([\w$. ]+?(?: <[^(=]*>)?(?: \[ \])*) [\w$]+(?: \[ \])* (?:=|;|,)", 1)
        names = F.regexp_extract_all(F.substr("shape", F.length(kind) + 1), F.lit(r"(?:^|,) ([\w$]+)(?: \[ \])*(?= (?:=|,|;))"), F.lit(1))
        rows = found.select("path", F.col("fqn").alias("owner"), F.explode(names).alias("name"), F.regexp_replace(F.regexp_replace(kind, r" ?<.*>", ""), " ", "").alias("type"), "line")
        return rows.select(F.concat("owner", F.lit("#"), "name").alias("field_id"), "path", "owner", "name", "type", "line")

    @cached_property
    def in_bodies(self) -> DataFrame:
        """All tokens but curly brackets that stand in the body of a callable, at any depth, with its ``method_id`` and ``owner``; of nested ones the innermost."""
        return written(self._in_bodies(self.rows.filter("token NOT IN ('{', '}')")))

    def _in_bodies(self, rows: DataFrame) -> DataFrame:
        """``rows``, without the curly brackets that bodies begin and end with, as in ``in_bodies``."""
        own = self.methods().filter("body IS NOT NULL").withColumn("_own", F.struct(F.col("body").alias("callable_at"), "method_id", "owner"))
        marks = [own.select("path", F.col(c).alias("j"), F.lit(n).alias("_mark"), "_own") for c, n in (("body", 1), ("body_end", -1))]
        both = rows.withColumn("_mark", F.lit(0)).unionByName(marks[0].unionByName(marks[1]), allowMissingColumns=True)
        inside = enclosing(_by_path(both), F.col("_mark") == 1, F.col("_mark") == -1, "_in", "_own").filter("_mark = 0 AND _in IS NOT NULL")
        return inside.select("*", "_in.*").drop("_in", "_own", "_mark")

    def calls(self) -> DataFrame:
        """See ``_calls``; written once."""
        return self._calls

    @cached_property
    def _calls(self) -> DataFrame:
        """``(call_id, path, method_id, owner, receiver, chain, name, arity, line)`` of invocations in bodies; ``chain`` has the calls between receiver and name.

        ``receiver`` is null for a call without one, ``new T`` gives ``T``; ``?`` stands for any other expression. Calls of constructors aren't calls.
        """
        by = Window.partitionBy("path").orderBy("j")
        rows = self._in_bodies(self.rows.filter(F.col("named") | F.col("token").isin(".", "this", "super")))
        starts = F.coalesce(F.lag("j").over(by) != F.col("j") - 1, F.lit(True)) | (F.col("token") != ".") & ~F.coalesce(F.col("prev") == ".", F.lit(False))
        rows = rows.withColumn("_starts", starts).withColumn("run", F.last(F.when(F.col("_starts"), F.col("j")), ignorenulls=True).over(by))
        runs = rows.groupBy("path", "run").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "token"))), lambda x: x["token"]), "").alias("text"), F.min(F.struct("j", "prev"))["prev"].alias("head_prev"),
            F.max(F.struct("j", "token", "named", "prev", "prev2", "next", "next_partner", "method_id", "owner", "line")).alias("_last"),
        )
        arity = self._arguments.groupBy("path", "params").agg(F.count("*").alias("n")).select("path", (F.col("params") - 1).alias("j"), F.col("n"))
        declared = F.col("prev").rlike(r"^[\p{L}_$]") & ~F.col("prev").isin(*OTHER_WORDS) | (F.col("prev") == "]") | F.col("prev").startswith("<") & (F.length("prev") > 1) & (F.col("prev2") != ".")
        found = runs.select("path", "run", "text", "head_prev", "_last.*").withColumnRenamed("next_partner", "closes").filter(F.col("named") & (F.col("next") == "(") & ~F.col("prev").isin("@", "::") & ~declared)
        found = found.join(arity, ["path", "j"], "left")
        found = found.withColumns({"n": F.coalesce("n", F.lit(0)).cast("int"), "made": F.coalesce(F.col("head_prev") == "new", F.lit(False)), "chained": F.col("text").startswith(".")})
        head = F.regexp_replace(F.regexp_replace("text", r"\.?[\w$]+$", ""), r"^\.$", "")
        found = found.withColumn("head", F.when(F.col("made"), F.col("text")).when(F.col("chained"), F.when(F.regexp_count("text", F.lit(r"\.")) > 1, "?")).when(head != "", head))
        found = written(found.select("path", "j", "run", "method_id", "owner", "token", "n", "made", "chained", "head", "line", "closes"))
        # a link leads from a call behind a closing bracket to the call that this bracket ends
        links = found.filter("chained").select("path", "j", (F.col("run") - 1).alias("closes")).join(found.select("path", F.col("j").alias("before"), "closes"), ["path", "closes"]).select("path", "j", "before")
        chains = _chains(found, links)
        steps = F.transform(F.filter("steps", lambda s: ~s["made"]), lambda s: F.struct(s["name"].alias("name"), s["arity"].alias("arity")))
        out = found.filter("NOT made").join(chains, ["path", "j"], "left")
        receiver = F.when(F.col("chained"), F.when(F.col("head").isNotNull() | F.col("root").isNull(), "?").otherwise(F.col("root_head"))).otherwise(F.col("head"))
        chain = F.when(F.col("chained") & (F.coalesce(receiver, F.lit("")) != "?"), F.coalesce(steps, F.array().cast("array<struct<name:string,arity:int>>"))).otherwise(F.array().cast("array<struct<name:string,arity:int>>"))
        return written(out.select(fn.sha_id("call", F.col("path"), F.col("j").cast("string")).alias("call_id"), "path", "method_id", "owner", receiver.alias("receiver"), chain.alias("chain"), F.col("token").alias("name"), F.col("n").alias("arity"), "line"))

    def used_names(self) -> tuple[DataFrame, DataFrame]:
        """``(method_id, owner, name, operator, qualified)`` of names that may be fields, and ``(method_id, name)`` of those declared in the callable.

        The operator is an assignment that follows, or a ``++`` or ``--`` on either side, else ``.``. ``qualified`` ones stand behind ``this.``.
        """
        rows = self.in_bodies
        by = Window.partitionBy("path").orderBy("j")
        rows = rows.withColumns({"prev3": F.lag("token", 3).over(by)})
        after_this = (F.col("prev") == ".") & (F.col("prev2") == "this")
        used = rows.filter(F.col("named") & (F.col("next") != "(") & ((F.col("prev") != ".") | after_this) & ~F.col("prev").isin("@", "::"))
        before = F.when(after_this, F.col("prev3")).otherwise(F.col("prev"))
        operator = F.when(F.col("next").isin(*ASSIGNMENTS), F.col("next")).when(before.isin("++", "--"), before).otherwise(".")
        typed = F.col("prev").rlike(r"^[\p{L}_$]") & ~F.col("prev").isin(*OTHER_WORDS) | F.col("prev").startswith("<") & (F.length("prev") > 1) | (F.col("prev") == "]") & (F.col("prev2") == "[") | (F.col("prev") == "...")
        declared = rows.filter(F.col("named") & (typed & F.col("next").isin("=", ";", ":", ",", ")") | (F.col("next") == "->"))).select("method_id", F.col("token").alias("name"))
        arrows = rows.filter("token = '->' AND prev = ')'").select("path", (F.col("j") - 1).alias("partner"))
        listed = rows.join(arrows.join(self.rows.filter("token = '('").select("path", F.col("j").alias("block"), "partner"), ["path", "partner"]).drop("partner"), ["path", "block"], "left_semi").filter(F.col("named") & F.col("next").isin(",", ")")).select("method_id", F.col("token").alias("name"))
        parameters = self.methods().select("method_id", F.explode("parameters").alias("name"))
        names = used.select("method_id", "owner", F.col("token").alias("name"), operator.alias("operator"), F.coalesce(after_this, F.lit(False)).alias("qualified"))
        return names, declared.unionByName(listed).unionByName(parameters).distinct()

    def lambdas(self) -> DataFrame:
        """``(lambda_id, path, owner, parameters, argument_of, line, end_line)``: ``argument_of`` is the name before the bracket that a lambda stands in.

        A lambda ends with its brace, or where the argument or statement that it is ends.
        """
        ends = Window.partitionBy("path", "block").orderBy("j").rowsBetween(1, Window.unboundedFollowing)
        stop = F.first(F.when(F.col("token").isin(",", ";"), F.col("line")), ignorenulls=True).over(ends)
        rows = self.rows.withColumn("_stop", stop)
        line_at = self.rows.select("path", F.col("j").alias("partner"), F.col("line").alias("partner_line"))
        found = self._in_types(rows.filter("token = '->'").filter(~F.col("prev").isin("default")))
        braces = self.rows.filter("token = '{'").select("path", (F.col("j") - 1).alias("j"), "partner").join(line_at, ["path", "partner"]).select("path", "j", F.col("partner_line").alias("brace_end"))
        around = self.rows.filter(F.col("token").isin("(", "{", "[")).select("path", F.col("j").alias("block"), "partner", F.col("token").alias("around"), F.col("prev").alias("before_block")).join(line_at, ["path", "partner"], "left").drop("partner")
        found = found.join(braces, ["path", "j"], "left").join(around, ["path", "block"], "left")
        listed = self.rows.filter("token = ')' AND next = '->'").select("path", (F.col("j") + 1).alias("j"), F.col("partner").alias("params"), F.col("block").alias("_b")).drop("_b")
        found = found.join(listed, ["path", "j"], "left").join(self._parameters().select("path", "params", "parameters"), ["path", "params"], "left")
        own = self.types.select("path", F.col("body").alias("type_at"), "fqn")
        names = F.when(F.col("prev") != ")", F.array("prev")).otherwise(F.coalesce("parameters", F.array().cast("array<string>")))
        is_call = (F.col("around") == "(") & F.col("before_block").rlike(r"^[\p{L}_$]") & ~F.col("before_block").isin(*OTHER_WORDS)
        end = F.coalesce("brace_end", "_stop", "partner_line", "line")
        found = found.join(own, ["path", "type_at"]).withColumn("around_name", F.when(is_call, F.col("before_block")))
        first = self.rows.select("path", F.col("j").alias("params"), F.col("line").alias("params_line"))
        found = found.join(first, ["path", "params"], "left")
        return found.filter(~F.coalesce(F.col("prev") == "case", F.lit(False))).select(fn.sha_id("lambda", F.col("path"), F.col("j").cast("string")).alias("lambda_id"), "path", F.col("fqn").alias("owner"), names.alias("parameters"), F.col("around_name").alias("argument_of"), F.coalesce("params_line", "line").alias("line"), end.alias("end_line"))

    def imports(self) -> DataFrame:
        """``(owner, simple, fqn)`` for the types of each file."""
        return self.types.select("path", F.col("fqn").alias("owner")).join(self.imports_of, "path").select("owner", F.element_at(F.split("fqn", r"\."), -1).alias("simple"), "fqn")


def _chains(calls: DataFrame, links: DataFrame) -> DataFrame:
    """``(path, j, root, root_head, steps)``: for each linked call the calls before it, from the first on.

    Links double in each round (a call's link becomes that of the call it leads to), so a chain of n calls takes log n rounds.
    """
    step = F.struct(F.col("token").alias("name"), F.col("n").alias("arity"), "made")
    named = calls.select("path", F.col("j").alias("before"), F.array(step).alias("own"))
    reach = saved(links.join(named, ["path", "before"]).select("path", "j", "before", F.col("own").alias("steps")))
    while True:
        on = reach.select("path", F.col("j").alias("before"), F.col("before").alias("_to"), F.col("steps").alias("_more"))
        joined = reach.join(on, ["path", "before"], "left")
        doubled = saved(joined.select("path", "j", F.coalesce("_to", "before").alias("before"), F.concat(F.coalesce("_more", F.array().cast("array<struct<name:string,arity:int,made:boolean>>")), "steps").alias("steps"), F.col("_to").isNotNull().alias("moved")))
        reach = doubled.drop("moved")
        if doubled.filter("moved").isEmpty():
            break
    roots = calls.select("path", F.col("j").alias("before"), F.when(F.col("chained"), F.lit("?")).otherwise(F.col("head")).alias("root_head"))
    return reach.join(roots, ["path", "before"]).select("path", "j", F.col("before").alias("root"), "root_head", "steps")
