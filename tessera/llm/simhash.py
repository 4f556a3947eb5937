"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42)
of the text's three-word shingles, repeats included. Two fingerprints that differ in at most
three bits differ in at most three of their eight bytes, so at least five positional bytes
agree. The inverted index posts each distinct fingerprint under its positional bytes; posting
lists of single bytes would be quadratic, so the posted keys are the eight triples of byte
positions within either half (any five shared positions contain one of them). Pairs that share
a posting are tallied over all eight positions (from the two fingerprints, which the posting
carries), those with five or more agreeing bytes are kept and verified by their Hamming distance.
With this bound the tally drops nothing that the distance would keep; it goes first as it is cheap. Postings longer than ``DENSE`` aren't paired: their
fingerprints are posted again under all 56 five-byte keys, whose lists are taken apart in
tasks that return spanning links only. No link is lost.

Edge cases: null and empty texts have fingerprint zero and link like others; shorter texts than
three words hash their whole word sequence; rows with a null ``doc_id`` get a fingerprint and
the component of what they link to (null if that is nothing with an id); repeated rows are
repeated in the result; a fingerprint with more than a thousandth of all rows meets its class by
broadcast, so that copies, however many, are dealt over all tasks; very long texts are hashed
whole, in memory in proportion to their words; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import join_counted
from .common import checkpointed, fresh
from .components import connected_components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: Bytes that agree at least in a pair within MOST_BITS.
LEAST_BYTES = 8 - MOST_BITS
#: Posting lists beyond this length are posted again under longer keys instead of being paired.
DENSE = 24
#: Lists of five-byte keys up to this length are compared pair by pair inside their task.
PAIRWISE = 2048

_HALVES = (range(4), range(4, 8))
TRIPLES = [c for half in _HALVES for c in combinations(half, 3)]
FIVES = list(combinations(range(8), LEAST_BYTES))


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()  # bytes: only A-Z, and the six ASCII spaces
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), dtype=np.uint64)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096].astype(">u8")
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, text_hash)`` of each row; ``fp`` is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(x.as_py()) for x in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], ["id", "fp", "text_hash"])

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ids.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "id long, fp long, text_hash long")


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def _posted(nodes: DataFrame, keys: list[tuple[int, ...]]) -> DataFrame:
    """Each fingerprint under each key: the key's number and the bytes at its positions."""
    postings = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("bytes")) for k, p in enumerate(keys)]
    return nodes.select("fp", F.inline(F.array(*postings)))


def _agreeing_bytes(a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    return reduce(
        lambda s, c: s + c,
        [(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for i in range(8)],
    )


class _Forest:
    """Union-find over places of an array."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def spanning_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked among distinct fingerprints sharing a five-byte key.

    Up to PAIRWISE fingerprints are compared pair by pair; of more, each looks up its neighbours
    within three bits among the 24 free ones, so the work grows with their number.
    """
    fps = np.sort(fps.astype(np.uint64))
    forest, out = _Forest(len(fps)), []
    if len(fps) <= PAIRWISE:
        for i in range(len(fps) - 1):
            x = fps[i] ^ fps[i + 1 :]
            tally = (x[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            close = np.flatnonzero((tally >= LEAST_BYTES) & (np.bitwise_count(x) <= MOST_BITS))
            out += [(i, j) for j in (close + i + 1).tolist() if forest.join(i, j)]
    else:
        free = int(np.bitwise_or.reduce(fps ^ fps[0]))
        bits = [np.uint64(1 << b) for b in range(64) if free >> b & 1]
        for n in range(1, MOST_BITS + 1):
            for some in combinations(bits, n):
                y = fps ^ np.bitwise_or.reduce(np.array(some))
                j = np.minimum(np.searchsorted(fps, y), len(fps) - 1)
                hit = np.flatnonzero((fps[j] == y) & (j > np.arange(len(fps))))
                out += [(i, k) for i, k in zip(hit.tolist(), j[hit].tolist()) if forest.join(i, k)]
    i, j = np.array(out, dtype=np.int64).reshape(-1, 2).T
    return fps[i], fps[j]


def near_links(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``nodes(fp)``, enough of them to connect all that are linked."""
    posted = _posted(nodes, TRIPLES)
    lengths = posted.groupBy("k", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    lists = checkpointed(posted.join(lengths, ["k", "bytes"]))
    short = lists.filter(F.col("n") <= dense)
    a, b = short.select("k", "bytes", F.col("fp").alias("u")), short.select("k", "bytes", F.col("fp").alias("v"))
    u, v = F.col("u"), F.col("v")
    pairs = a.join(b, ["k", "bytes"]).filter(u < v)
    links = pairs.filter((_agreeing_bytes(u, v) >= LEAST_BYTES) & (F.bit_count(u.bitwiseXOR(v)) <= MOST_BITS)).select("u", "v")

    crowded = _posted(lists.filter(F.col("n") > dense).select("fp").distinct(), FIVES)
    shared = crowded.groupBy("k", "bytes").agg(F.count("*").alias("n")).filter("n > 1")

    def local(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x, y = spanning_links(group["fp"].to_numpy().view(np.uint64))
        return pd.DataFrame({"u": x.view(np.int64), "v": y.view(np.int64)})

    lists = crowded.join(shared, ["k", "bytes"]).select("k", "bytes", "fp")
    # Few bytes, much work: a number of its own keeps this exchange from being taken for the join's, and from being coalesced.
    parts = max(24, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    spanning = lists.repartition(parts, "k", "bytes").groupBy("k", "bytes").applyInPandas(local, "u long, v long")
    return links.unionByName(spanning).distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, text_hash, group_fp, component_id)`` of each row: its group's least fingerprint and least id."""
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    sizes = nodes.agg(F.count("*"), F.sum("n")).first()
    groups = connected_components(near_links(nodes.select("fp")))
    named = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("group_fp"))
    named = checkpointed(named)
    least = checkpointed(named.groupBy("group_fp").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")))
    classes = checkpointed(join_counted(named, least, "group_fp", "fps", sizes[0]))
    found = join_counted(prints, classes.select("fp", "group_fp", "component_id", "n"), "fp", "n", sizes[1] or 0)
    return found.select("id", "fp", "text_hash", "group_fp", "component_id")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group: that with the least id, nulls last, then the least text hash.

    Rows that equal it in both are one document, of which one row stays.
    """
    none, number, text = (fresh(docs, f"__sh_{x}") for x in ("none", "id", "text"))
    key = lambda c: F.struct(c.isNull().alias(none), F.coalesce(c, F.lit(0)).alias(number))
    groups = near_duplicate_groups(docs, id_col, text_col)
    first = F.struct(key(F.col("id")).alias("k"), F.col("text_hash").alias(text))
    chosen = groups.groupBy("group_fp").agg(F.min(first).alias("m")).select("m.k.*", f"m.{text}")
    keyed = docs.select("*", F.inline(F.array(key(F.col(id_col).cast("long")))), F.xxhash64(F.col(text_col).cast("string")).alias(text))
    keys = [number, none, text]
    return keyed.join(chosen, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])
