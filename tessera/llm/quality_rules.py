"""Quality rules: a threshold table compiled into one projection of text measures.

Every measure is a built-in Spark expression over the whole text; no user function runs.
A rule names a measure, the side on which a text fails and the threshold; ``compile_rules``
turns the table into one boolean column. Texts that break the base rule (too short, or
mostly repeated three-word windows) fail before the table is asked.

Edge cases: a null or empty text has no words and fails (``n_words < 50``); ratios of an
empty text are 0; repeated rows are judged alike, each on its own; other columns, whatever
their names, are carried through untouched by ``apply_quality_rules``; an empty table gives
an empty result; very long texts are measured whole, in memory in proportion to their words, in
time to their logarithm as well. Three-word windows of one text are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A text fails the rule if ``measure`` is on the ``fails`` side of ``threshold``."""

    name: str
    measure: str
    fails: str  # "below" or "above"
    threshold: float


#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a all an and are as at be but by for from had has have he her his i in is it its not of on one or she that the their they this to was we were which with you "
    "au aux avec ce dans de des du elle en est et il la le les mais nous on ou par pas pour que qui sa se ses son sur un une vous "
    "als auch auf aus bei das dem den der des die ein eine er es für ich ihr im in ist mit nicht oder sich sie sind und von war wie wir zu zum zur "
    "al con del el ella en es esta este la las lo los no o para pero por que se sin su sus un una y"
).split()

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50

DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("too_long_words", "mean_word_chars", "above", 20.0),
    Rule("too_short_words", "mean_word_chars", "below", 2.0),
    Rule("symbols", "symbols_per_word", "above", 0.2),
    Rule("few_stop_words", "stop_word_ratio", "below", 0.02),
    Rule("repeated_lines", "dup_line_ratio", "above", 0.5),
)

#: Beyond this many comparisons, repeated windows are found by sorting instead of by look-up; both count alike.
LOOKUP_COMPARISONS = 20_000_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
RATIOS = ("mean_word_chars", "symbols_per_word", "stop_word_ratio", "dup_line_ratio")


def _plain_spaces(text: Column) -> Column:
    """``text`` with a space for each other white space, so that a one-character split finds the words."""
    return reduce(lambda c, code: F.replace(c, F.lit(chr(code)), F.lit(" ")), range(9, 14), text)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """Hashes of the three-word windows by their first word's place."""
    at = lambda i: F.get(words, i)
    return F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_places(grams: Column) -> Column:
    """Places of windows that the text has twice or more."""
    ordered = lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))

    def places(twice: Column) -> Column:
        by_look_up = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(twice, F.get(grams, i)))
        placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        by_sorting = _let(placed, lambda s: F.transform(
            F.filter(s, lambda x, i: ((i > 0) & (x["g"] == F.get(s, i - 1)["g"])) | F.coalesce(x["g"] == F.get(s, i + 1)["g"], F.lit(False))),
            lambda x: x["i"],
        ))
        return (
            F.when(F.size(twice) == 0, F.array().cast("array<int>"))
            .when(F.size(twice).cast("long") * F.size(grams) <= LOOKUP_COMPARISONS, by_look_up)
            .otherwise(by_sorting)
        )

    return _let(_let(F.sort_array(grams), ordered), places)


def text_measures(text: Column) -> Column:
    """A struct of the measures that rules may name, in one expression."""
    stop_forms = sorted({form for w in STOP_WORDS for form in (w, w.capitalize())})

    def counted(t: Column, words: Column, lines: Column) -> Column:
        repeated = _let(_windows(words), _repeated_places)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda i: F.array(i, i + 1, i + 2))))).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(words, lambda w: w.isin(*stop_forms))).cast("long").alias("n_stop_words"),
        )

    def ratios(m: Column) -> Column:
        n, n_lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
        parts = {"mean_word_chars": m["word_chars"] / n, "symbols_per_word": m["n_symbols"] / n, "stop_word_ratio": m["n_stop_words"] / n, "dup_line_ratio": m["n_dup_lines"] / n_lines}
        return F.struct(*[m[c].alias(c) for c in COUNTS], *[v.alias(k) for k, v in parts.items()])

    def split(t: Column) -> Column:
        words = F.array_remove(F.split(_plain_spaces(t), " "), "")
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return _let(_let(words, lambda w: _let(lines, lambda ls: counted(t, w, ls))), ratios)

    return _let(F.coalesce(text.cast("string"), F.lit("")), split)


def base_failed(m: Column) -> Column:
    n, repeated = m["n_words"], m["n_repeat_words"]
    return (n < BASE_MIN_WORDS) | (100 * repeated > BASE_MAX_REPEAT_PERCENT * n)


def compile_rules(m: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """The threshold table as one boolean expression of measures: true if the text breaks none of the rules."""
    passes = [(m[r.measure] >= r.threshold) if r.fails == "below" else (m[r.measure] <= r.threshold) for r in rules]
    return reduce(lambda a, b: a & b, passes, F.lit(True))


def judged(text: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """A struct of all measures, ``base_failed`` and ``kept``."""
    return _let(
        text_measures(text),
        lambda m: F.struct(
            *[m[c].alias(c) for c in (*COUNTS, *RATIOS)],
            base_failed(m).alias("base_failed"),
            (~base_failed(m) & compile_rules(m, rules)).alias("kept"),
        ),
    )


def apply_quality_rules(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """The rows that pass, with the columns of ``df`` and no others."""
    return df.filter(judged(F.col(text_col), rules)["kept"])
