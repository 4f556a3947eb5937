"""Collapse of cumulative conversation snapshots, then chat rendering; DataFrame functions only.

A conversation that is logged after each exchange appears as several conversations, each a
prefix of the next. Turns get places, every place a hash of its turns so far (the sum, over the
places up to it, of a hash of place, role and text: a prefix of equal turns has an equal sum).
Prefix hashes that occur inside a longer conversation are those of snapshots; an anti-join drops
the conversations that end there. Of conversations with equal turns the least id stays.

Texts stand in for by two 64-bit hashes until conversations are rendered: then the kept turns
meet the table again, and its texts are shuffled once. Places and sums are made in two steps,
inside blocks of turn numbers and over the blocks of a conversation, and all joins are on
conversation and block, so that one conversation with very many turns is dealt over many tasks.
No pairs of conversations are made: prefix hashes and whole conversations are grouped before
they meet.

Edge cases: null roles and texts count as empty; turns are ordered by number (null first), then
role, then text, so ties have one order (only tied turns are ordered by their texts); repeated
rows are one turn; a null conv_id is a conversation like others, last in order; very long texts
cost their length twice, once hashed and once rendered; turns without a number are one block of
their conversation; an empty table gives an empty result; other columns aren't carried and may
have any name. Sums are of two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BLOCK_TURNS = 64
#: Turns in one rendered row; longer conversations go on in further pieces.
PIECE_TURNS = 64
BEGIN, BETWEEN, END = "<|im_start|>", "\n", "<|im_end|>\n"

_SUMS = ["s1", "s2"]
_TURN = ["conv", "block", "turn", "role", "h1", "h2"]


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "position", "role", f"h{seed + 1}").cast("decimal(20,0)")


def keyed_turns(turns: DataFrame) -> DataFrame:
    """``(conv, block, turn, role, h1, h2, text)`` of each row; a null turn is 0 of a block of its own."""
    plain = turns.select(
        F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id")).alias("conv"),
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))).cast("long").alias("block"),
        F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return plain.select("conv", "block", "turn", "role", *[F.xxhash64(F.lit(i), "text").alias(f"h{i}") for i in (1, 2)], "text")


def _with_ties(slim: DataFrame, keyed: DataFrame) -> DataFrame:
    """``slim`` with ``tie``: the order by text of turns that are alike in number and role."""
    place = _TURN[:4]
    tied = slim.groupBy(*place).agg(F.count("*").alias("n")).filter("n > 1").select(*place)
    if tied.isEmpty():
        return slim.withColumn("tie", F.lit(0))
    texts = keyed.join(tied, place, "left_semi").distinct()
    ordered = texts.withColumn("tie", F.row_number().over(Window.partitionBy(*place).orderBy("text"))).drop("text")
    return slim.join(ordered, _TURN, "left").withColumn("tie", F.coalesce("tie", F.lit(0)))


def placed_turns(turns: DataFrame) -> DataFrame:
    """``(conv, block, turn, role, h1, h2, position, n_turns, s1, s2)``: turns with their places and prefix hashes."""
    keyed = keyed_turns(turns)
    slim = checkpointed(keyed.select(*_TURN).distinct())
    plain = _with_ties(slim, keyed).repartition("conv", "block")
    within = Window.partitionBy("conv", "block")
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = plain.groupBy("conv", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("places_before"), F.sum("n").over(whole).alias("n_turns"))
    placed = plain.withColumn("position", F.row_number().over(within.orderBy("turn", "role", "tie"))).join(blocks, ["conv", "block"])
    placed = placed.withColumn("position", F.col("position") + F.col("places_before"))
    placed = placed.withColumns({s: _hash(i) for i, s in enumerate(_SUMS)})
    sums = placed.groupBy("conv", "block").agg(*[F.sum(s).alias(f"{s}_block") for s in _SUMS])
    sums = sums.select("conv", "block", *[F.coalesce(F.sum(f"{s}_block").over(earlier), F.lit(0)).cast("decimal(38,0)").alias(f"{s}_before") for s in _SUMS])
    upto = within.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(sums, ["conv", "block"]).select(
        *_TURN, "position", "n_turns", *[(F.sum(s).over(upto) + F.col(f"{s}_before")).cast("decimal(38,0)").alias(s) for s in _SUMS]
    )


def maximal_conversations(placed: DataFrame) -> DataFrame:
    """``(conv, n_turns, n_logged)``: conversations that are a prefix of no other, one of each equal group."""
    whole = placed.filter("position = n_turns").groupBy("n_turns", *_SUMS).agg(F.min("conv").alias("conv"), F.count("*").alias("n_logged"))
    inside = placed.filter("position < n_turns").select(F.col("position").alias("n_turns"), *_SUMS).distinct()
    return whole.join(inside, ["n_turns", *_SUMS], "left_anti").select("conv", "n_turns", "n_logged")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit(BETWEEN), text, F.lit(END))


def rendered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, position, n_turns, n_logged, role, rendered)``: the kept conversations' turns as chat text."""
    placed = checkpointed(placed_turns(turns))
    kept = checkpointed(maximal_conversations(placed))
    blocks = placed.select("conv", "block").distinct().join(kept.select("conv", "n_logged"), "conv")
    chosen = placed.join(blocks, ["conv", "block"]).select(*_TURN, "position", "n_turns", "n_logged")
    # The texts are dealt by place; repeated rows of a turn meet there, and one of them stays.
    found = keyed_turns(turns).join(chosen, _TURN).dropDuplicates(_TURN)
    conv_id = F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id")
    return found.select(conv_id, "position", "n_turns", "n_logged", "role", render_turn(F.col("role"), F.col("text")).alias("rendered"))


def rendered_conversations(turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """``(conv_id, piece, n_pieces, n_turns, n_logged, rendered)``: the kept conversations as chat text.

    A conversation of up to ``piece_turns`` turns is one row; a longer one goes on in further
    pieces, so that no conversation, however long, has to fit into one row.
    """
    rows = rendered_turns(turns).withColumn("piece", F.floor((F.col("position") - 1) / piece_turns).cast("long"))
    held = rows.groupBy("conv_id", "piece", "n_turns", "n_logged").agg(F.sort_array(F.collect_list(F.struct("position", "rendered"))).alias("turns"))
    n_pieces = F.ceil(F.col("n_turns") / piece_turns).cast("long").alias("n_pieces")
    return held.select("conv_id", "piece", n_pieces, "n_turns", "n_logged", F.array_join(F.col("turns.rendered"), "").alias("rendered"))
