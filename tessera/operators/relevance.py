"""Relevance of document fragments to a request, and keyword rank by cover density."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, search_text

# Operations and what names them; prefixes of design documents' file names.
OPERATION_ALIASES = {
    "search": ("検索", "search", "filter", "絞り込"),
    "create": ("新規作成", "create", "insert", "登録"),
    "update": ("編集", "edit", "update", "更新"),
    "delete": ("削除", "delete", "remove"),
    "submit": ("申請する", "提出", "submit"),
    "approve": ("承認する", "approve"),
    "reject": ("差戻す", "却下", "reject", "return"),
}
DOCUMENT_PREFIXES = ("画面設計書", "プログラム設計書", "API詳細設計書", "DB設計書")

#: Keys of the relevance order, the first decides first; all descending.
RELEVANCE = ("subject_contained", "subject_overlap", "operation_matches", "fragment_overlap", "fragment_matches", "subject_chars", "score")


def document_subject(file_name: Column) -> Column:
    """What a design document is about, from its file name: without extension, ordinal and kind; letters and digits only."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    parts = F.filter(F.split(stem, "_"), lambda p: p != "")
    first = lambda p: F.get(p, F.lit(0))
    rest = lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1)))
    parts = F.when(first(parts).rlike(r"^\p{Nd}+$"), rest(parts)).otherwise(parts)
    parts = F.when(first(parts).isin(*DOCUMENT_PREFIXES), rest(parts)).otherwise(parts)
    return F.coalesce(search_text(F.array_join(parts, "")), F.lit(""))


def operation_signals(text: Column) -> Column:
    """Names of the operations that a text mentions, in a fixed order."""
    plain = search_text(text)
    named = [F.when(reduce(lambda a, b: a | b, [F.contains(plain, F.lit(a)) for a in aliases]), F.lit(name)) for name, aliases in OPERATION_ALIASES.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def pairs_or_whole(text: Column) -> Column:
    """Character pairs of a text; of a single character, that one."""
    return F.when(F.length(text) == 1, F.array(text)).otherwise(bigrams(text))


def with_relevance(hits: DataFrame, query: str | Column, file_name: str, headings: str, summary: str, score: str) -> DataFrame:
    """``hits`` with the seven RELEVANCE keys of each fragment. ``headings``: the heading path after the file, an array."""
    asked = F.lit(query) if isinstance(query, str) else query
    q, subject = search_text(asked), document_subject(F.col(file_name))
    fragment = search_text(F.concat(F.array_join(F.coalesce(headings, F.array().cast("array<string>")), ""), F.coalesce(summary, F.lit(""))))
    hits = hits.withColumns({"_q": pairs_or_whole(q), "_s": pairs_or_whole(subject), "_f": pairs_or_whole(fragment)})
    share = lambda a: F.when(F.size(a) > 0, F.size(F.array_intersect(a, "_q")) / F.size(a)).otherwise(0.0)
    keys = {
        "subject_contained": F.when((subject != "") & F.contains(q, subject), 1).otherwise(0), "subject_overlap": share(F.col("_s")),
        "operation_matches": F.size(F.array_intersect(operation_signals(asked), operation_signals(fragment))),
        "fragment_overlap": share(F.col("_f")), "fragment_matches": F.size(F.array_intersect("_f", "_q")), "subject_chars": F.length(subject),
    }
    return hits.withColumns(keys).withColumn("score", F.col(score)).drop("_q", "_s", "_f")


def best_fragments(ranked: DataFrame, document: str, fragment: str, k: int) -> DataFrame:
    """The best fragment of each document by RELEVANCE, ties by id; the k best of them."""
    order = [*[F.desc(c) for c in RELEVANCE], F.col(fragment)]
    best = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy(document).orderBy(*order))).filter("_rn = 1").drop("_rn")
    return best.orderBy(*order).limit(k)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also within a fold."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def cover_density(tokens: Column, groups: Sequence[Sequence[tuple[bool, str]]]) -> Column:
    """Cover density of a text's ``tokens`` for alternatives of terms (wanted or excluded; several words are a phrase).

    A cover is a shortest stretch that holds all wanted terms of an alternative that applies; it adds a tenth, divided
    by one more than the words in it that are no terms. Zero, if there is no cover.
    """
    terms = sorted({t for g in groups for wanted, t in g if wanted})
    if not terms:
        return F.lit(0.0)
    place = {t: i for i, t in enumerate(terms)}
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    applies = [reduce(lambda a, b: a & b, [~F.contains(joined, F.lit(f" {t} ")) for wanted, t in g if not wanted], F.lit(True)) for g in groups]

    def begin(i: Column, term: str) -> Column:
        words = term.split(" ")
        fits = reduce(lambda a, b: a & b, [F.get(tokens, i - (len(words) - 1 - n)) == w for n, w in enumerate(words)])
        return F.when((i >= len(words) - 1) & fits, i - (len(words) - 1)).otherwise(-1)

    ends = sorted({t.split(" ")[-1] for t in terms})
    places = F.transform(F.filter(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda e: e["w"].isin(*ends)), lambda e: e["i"])
    entries = F.transform(places, lambda i: F.struct(i.alias("at"), F.array(*[begin(i, t) for t in terms]).alias("begins")))
    entries = F.filter(entries, lambda e: F.exists(e["begins"], lambda b: b >= 0)) if any(" " in t for t in terms) else entries
    start = F.struct(F.array(*[F.lit(-1)] * len(terms)).alias("last"), F.array(*[F.lit(0)] * len(terms)).alias("nth"), F.lit(0).alias("n"), F.lit(-1).alias("covered"), F.lit(0.0).alias("sum"))

    def step(acc: Column, e: Column, ok: Column) -> Column:
        seen = [F.when(e["begins"][i] >= 0, e["begins"][i]).otherwise(acc["last"][i]) for i in range(len(terms))]
        nth = [F.when(e["begins"][i] >= 0, acc["n"]).otherwise(acc["nth"][i]) for i in range(len(terms))]
        least = lambda cs: F.least(*cs) if len(cs) > 1 else cs[0]
        low = [F.when(ok[i], least([F.struct(seen[place[t]].alias("at"), nth[place[t]].alias("nth")) for wanted, t in g if wanted])) for i, g in enumerate(groups)]

        def with_best(best: Column) -> Column:
            new = F.coalesce(best["at"], F.lit(-1)) > acc["covered"]
            noise = F.greatest(e["at"] - best["at"] - (acc["n"] - best["nth"]), F.lit(0))
            return F.struct(
                F.array(*seen).alias("last"), F.array(*nth).alias("nth"), (acc["n"] + 1).alias("n"),
                F.when(new, best["at"]).otherwise(acc["covered"]).alias("covered"), (acc["sum"] + F.when(new, 0.1 / (1 + noise)).otherwise(0.0)).alias("sum"),
            )

        return let(F.greatest(*low) if len(low) > 1 else low[0], with_best)

    def folded(ok: Column) -> Column:
        """``ok``: which alternatives apply, found once for a text."""
        return F.when(F.exists(ok, lambda x: x), F.aggregate(entries, start, lambda acc, e: step(acc, e, ok), lambda acc: acc["sum"])).otherwise(0.0)

    return F.when(F.size(tokens) > 0, let(F.array(*applies), folded)).otherwise(0.0)
