"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: the sources, by code point with null last, carry the given weights in turn; the words
to take are shared by weight, no source getting more than ``most_copies`` times its own words,
and what a source can't take is shared anew among the others by weight until none is above.

Taking: of a source whose target is r times its words, every document is taken floor(r) whole
times for certain. The rest, a fraction f of the words, is sampled: a document has the inclusion
probability p = f * g / (the source's mean of g by words), where g is its preference (short texts
are less worth a copy: ``size / (size + 50)``), and the rank u / (1 - u) divided by p / (1 - p)
with u uniform by a hash of its id, text and the seed. Documents are taken in rank order until
their words come to the rest; the sample is fixed in words, and ends at the document whose end
is nearest.

The order is never sorted as a whole: ranks fall into cells, sums of words by cell show in which
cell the rest ends, and only that cell is split on. A hot source costs as many cells as any other.

Edge cases: a null or empty text has size 0 and is taken 0 words; a null source is one source,
last in order; rows equal in id and text rank alike, and where a sample ends among them
any choice gives the same rows; very long texts are counted whole; sources without words have target 0; an empty table gives an empty result; further
columns are not carried and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, checkpointed, fresh

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = 20240607
CELLS = 256
#: Splits of the cell in which a sample ends: CELLS ** LEVELS cells in all.
LEVELS = 3
#: Parts into which the rows of one source are dealt when they meet what is known of sources.
SALTS = 32

_KEY = ["no_source", "source_name"]


def text_hash(id_col: str, text_col: str, seed: int = SEED) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``(id, h, no_source, source_name, size, u, salt)`` of each row: words, and u in (0, 1) by id, text and seed."""
    h = text_hash(id_col, text_col, seed)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"), h.alias("h"), source.isNull().alias(_KEY[0]), F.coalesce(source, F.lit("")).alias(_KEY[1]),
        size.alias("size"), ((F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)).alias("u"),
        F.pmod(h, F.lit(SALTS)).cast("int").alias("salt"),
    )


def _preference() -> Column:
    return F.col("size") / (F.col("size") + 50.0)


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES) -> DataFrame:
    """``sources`` (keys and ``source_size``, one row a source) with each one's ``target`` words.

    Filling up by weight: with sources in order of how many words a unit of weight may bring
    them, those that are full form a head of the order; the rest share what the head leaves.
    """
    place = F.row_number().over(Window.orderBy(*_KEY)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    out = sources.withColumn("weight", weight).withColumn("room", F.col("source_size") * float(most_copies))
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("room") / F.col("weight"), *_KEY)
    before, upto = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, 0)
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    shared = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", left / shared)  # words a unit of weight, were all before this source full and no others
    full = (F.col("room") <= F.col("level") * F.col("weight")).cast("int")
    out = out.withColumn("full", F.min(full).over(upto) == 1)
    level = F.max(F.when(~F.col("full"), F.struct((-F.col("room") / F.col("weight")).alias("place"), "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("room")).otherwise(F.col("weight") * level)
    return out.withColumn("target", target).drop("weight", "room", "level", "full")


def _with_source(rows: DataFrame, sources: DataFrame, how: str = "inner", also: Sequence[str] = ()) -> DataFrame:
    """``rows`` with what is known of their sources; each source's rows meet it in SALTS parts."""
    dealt = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(dealt, [*_KEY, "salt", *also], how)


def _cell(level: int) -> Column:
    """The cell of a rank at a level: its place t in [0, 1) in CELLS ** (level + 1) parts."""
    cells = CELLS ** (level + 1)
    return F.least(F.floor(F.col("t") * float(cells)).cast("long"), F.lit(cells - 1))


def _order_sample(ranked: DataFrame) -> DataFrame:
    """``ranked`` (keys, size, t, rest) with ``drawn``: whether a row's words are in its source's sample.

    Level by level, the words before a cell and within it show the cell in which the rest ends.
    """
    ends = None
    for level in range(LEVELS):
        inside = ranked.withColumn("cell", _cell(level))
        if ends is None:
            inside = inside.withColumn("before", F.lit(0).cast("long"))
        else:
            inside = inside.withColumn("parent", F.floor(F.col("cell") / CELLS).cast("long"))
            inside = _with_source(inside, ends.withColumnRenamed("cell", "parent"), also=["parent"])
        sums = inside.groupBy(*_KEY, "cell").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max("before").alias("before"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy(*_KEY).orderBy("cell")))
        first = F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("m")
        ends = checkpointed(sums.filter(F.col("upto") >= F.col("rest")).groupBy(*_KEY).agg(first).select(*_KEY, "m.cell", "m.before"))
    placed = _with_source(ranked.withColumn("cell", _cell(LEVELS - 1)), ends.withColumnRenamed("cell", "end"), "left")
    at_end = F.coalesce(F.col("cell") == F.col("end"), F.lit(False))
    clear = placed.filter(~at_end).withColumn("drawn", F.coalesce(F.col("cell") < F.col("end"), F.lit(True)))
    running = Window.partitionBy(*_KEY).orderBy("t", "h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(running)
    short, over = F.col("rest") - (upto - F.col("size")), upto - F.col("rest")
    return clear.unionByName(placed.filter(at_end).withColumn("drawn", (over <= 0) | ((short > 0) & (over < short))))


def pareto_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES, seed: int = SEED,
) -> DataFrame:
    """``(id, h, size, source_size, target, copies, taken)``: how often each row of ``docs`` is taken."""
    rows = checkpointed(sized(docs, id_col, text_col, source_col, seed))
    sources = rows.groupBy(*_KEY).agg(F.sum("size").alias("source_size"), (F.sum(F.floor(_preference() * F.col("size") * 1e6)) / 1e6).alias("liked"))  # whole numbers: any order of adding gives one sum
    targets = source_targets(sources, weights, share, most_copies)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    ranked = _with_source(rows, checkpointed(targets))
    chance = F.when(F.col("liked") > 0, F.col("rest") / F.col("liked") * _preference()).otherwise(F.lit(0.0))
    odds = F.least(F.greatest(chance, F.lit(1e-9)), F.lit(1 - 1e-9))
    rank = F.col("u") / (1 - F.col("u")) / (odds / (1 - odds))
    ranked = checkpointed(ranked.withColumn("t", rank / (1 + rank)))
    drawn = _order_sample(ranked).withColumn("copies", F.col("whole") + F.col("drawn").cast("long"))
    return drawn.select("id", "h", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns."""
    mix = pareto_mix(docs, id_col, text_col, source_col, seed=seed)
    named, times = fresh(docs, "__mix_hash"), fresh(docs, "__mix_times")
    none, number = fresh(docs, "__mix_none"), fresh(docs, "__mix_id")
    key = lambda c: [c.isNull().alias(none), F.coalesce(c.cast("string"), F.lit("")).alias(number)]
    taken = mix.filter("copies > 0").groupBy(*key(F.col("id")), F.col("h").alias(named)).agg(F.sum("copies").cast("int").alias(times))
    keyed = docs.select("*", *key(F.col(id_col)), text_hash(id_col, text_col, seed).alias(named))
    one = keyed.join(taken, [none, number, named]).dropDuplicates([none, number, named])
    return one.withColumn(named, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
