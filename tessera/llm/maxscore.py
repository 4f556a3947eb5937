"""Ranked lexical search: an inverted index in shards, and MaxScore in each of them.

``build_index`` turns documents into shards of about ``SHARD_BYTES`` of text: one row with the sorted
distinct terms of its documents and, for each term, the documents that hold it and how often. No text is
shuffled: a shard is what a task reads one after the other. ``search`` answers items against all shards:

1. the document frequencies of the items' terms, summed over shards, and the number and length of all documents
2. in each shard and for each item, MaxScore: terms are ordered by the highest score that each can give in
   the shard; the longest beginning of that order whose bounds together stay below the item's ``k``-th best
   score so far is non-essential. Documents are taken from the other, essential lists alone; the non-essential
   ones are probed from the highest bound down, for the documents that can still reach that score
3. the best ``k`` of each task, ranked over all tasks in two steps, so that no task gets the rows of all

Pruning never costs a document: one is left out only when its bound is below the ``k``-th best score, so
that equal scores are still told apart by id. The bound rises within a shard and from shard to shard of a task.

Scores are whole numbers: a term's weight is ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, and a document's
score the sum of ``weight * (10**9 tf div (1000 tf + 20 m))`` over the item's terms, with
``m = 50 + 50 n N div L`` for a document of ``n`` terms among ``N`` with ``L`` in all.

Items are held in blocks of ``BLOCK_TERMS`` terms (or one item), each a pass over the index, so that the
driver and the tasks hold a block of any query set at a time.

Edge cases: null and empty texts have no terms and aren't found; items without terms, or whose terms no
document has, give no rows; rows with equal item ids are one item with the terms of all of them; rows with
equal document ids, and equal rows, are documents of their own; among equal scores a null id comes last; very
long texts are shards of their own, in memory whole; empty tables give an empty result; other columns aren't carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import best_of_each, checkpointed
from .tokens import packed_counts, unpacked_counts

#: UTF-8 bytes of the texts in a shard, about.
SHARD_BYTES = 8_000_000
#: Terms of the items that are searched in one pass over the index.
BLOCK_TERMS = 200_000

#: Bytes that part terms: ASCII but letters and digits. Upper-case letters become lower case.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = np.iinfo(np.int64).max

INDEX = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, starts binary, docs binary, tfs binary"


class Shard(NamedTuple):
    """An inverted index; ``starts`` has where each term's postings begin, and one entry more."""

    ids: pa.Array
    lengths: np.ndarray
    terms: dict[bytes, int]
    starts: np.ndarray
    docs: np.ndarray
    tfs: np.ndarray


def index_row(ids: pa.Array, texts: pa.Array) -> dict:
    """The index of some texts, as a row of ``INDEX``."""
    words: list[bytes] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        own = (text or b"").translate(_TERMS).split()
        lengths[i] = len(own)
        words += own
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    order = np.array(sorted(range(len(coded.dictionary)), key=coded.dictionary.to_pylist().__getitem__), dtype=np.int64)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    held = np.flatnonzero(lengths)  # documents with a term, renumbered
    doc = np.repeat(np.arange(len(held)), lengths[held])
    key, tfs = np.unique(rank[coded.indices.to_numpy(zero_copy_only=False)] * max(1, len(held)) + doc, return_counts=True)
    term, docs = key // max(1, len(held)), key % max(1, len(held))
    starts = np.searchsorted(term, np.arange(len(order) + 1))
    within = np.diff(docs, prepend=0)
    within[starts[:-1]] = docs[starts[:-1]]  # steps from one document of a term to its next
    own_ids = ids.take(pa.array(held))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as out:
        out.write_batch(pa.record_batch([own_ids.cast(pa.int64())], ["id"]))
    return {
        "n_docs": len(held), "n_terms": int(lengths.sum()), "ids": sink.getvalue().to_pybytes(), "lengths": packed_counts(lengths[held]),
        "terms": zstandard.compress(b" ".join(coded.dictionary.take(pa.array(order)).to_pylist()), 1), "starts": packed_counts(np.diff(starts)),
        "docs": packed_counts(within), "tfs": packed_counts(tfs),
    }


def read_shard(row: dict) -> Shard:
    terms = zstandard.decompress(row["terms"]).split()
    sizes, steps = unpacked_counts(row["starts"]), unpacked_counts(row["docs"])
    starts = np.append(0, np.cumsum(sizes))
    run = np.cumsum(steps)
    docs = run - np.repeat(run[starts[:-1]] - steps[starts[:-1]], sizes) if len(sizes) else steps
    ids = pa.ipc.open_stream(row["ids"]).read_all().column(0).combine_chunks()
    return Shard(ids, unpacked_counts(row["lengths"]), {t: i for i, t in enumerate(terms)}, starts, docs, unpacked_counts(row["tfs"]))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of about SHARD_BYTES, in the order in which they come."""
    ids, texts, size = [], [], 0
    for batch in batches:
        own = batch.column(1).cast(pa.large_string())
        ends = np.cumsum(pc.fill_null(pc.binary_length(own), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(own):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SHARD_BYTES - size, side="right")))
            ids.append(batch.column(0).slice(at, to - at))
            texts.append(own.slice(at, to - at))
            size, at = size + int(ends[to - 1]) - before, to
            if size >= SHARD_BYTES or at < len(own):
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of ``docs``, written to the shared folder: they are read twice for each block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _shares(batches):
            row = index_row(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k.startswith("n_") else pa.binary()) for k, v in row.items()], list(row))

    return checkpointed(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, INDEX))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _PARTING), ""))


def item_blocks(items: DataFrame, item_id: str, text_col: str, most_terms: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their distinct terms, in blocks of at most ``most_terms`` terms (or of one item), read one partition at a time."""
    terms = items.select(F.col(item_id).cast("long").alias("item"), F.explode(_terms(F.col(text_col).cast("string"))).alias("term"))
    block, held = [], 0
    for item, own in terms.groupBy("item").agg(F.sort_array(F.collect_set("term"))).toLocalIterator():
        if block and held + len(own) > most_terms:
            yield block
            block, held = [], 0
        block.append((item, [t.encode() for t in own]))
        held += len(own)
    if block:
        yield block


def weights(n_docs: int, frequencies: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequencies], dtype=np.int64)


def _damping(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``m`` of each document."""
    if len(lengths) and int(lengths.max()) * 50 * n_docs >= 1 << 63:  # beyond 64 bits
        return np.array([50 + 50 * int(n) * n_docs // n_terms for n in lengths], dtype=np.int64)
    return 50 + 50 * lengths * n_docs // max(1, n_terms)


class Postings(NamedTuple):
    """A term's documents in a shard with what it adds to their scores; ``bound`` is the most it adds, ``kth`` the ``k``-th most."""

    docs: np.ndarray
    impacts: np.ndarray
    bound: int
    kth: int


def postings_of(shard: Shard, wanted: list[bytes], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> dict[int, Postings]:
    """By the number of each wanted term that the shard has."""
    damping, out = _damping(shard.lengths, n_docs, n_terms), {}
    for number, term in enumerate(wanted):
        at = shard.terms.get(term)
        if at is not None:
            part = slice(shard.starts[at], shard.starts[at + 1])
            docs, tfs = shard.docs[part], shard.tfs[part]
            impacts = weight[number] * (1_000_000_000 * tfs // (1000 * tfs + 20 * damping[docs]))
            out[number] = Postings(docs, impacts, int(impacts.max()), int(np.partition(impacts, -k)[-k]) if len(impacts) >= k else 0)
    return out


def max_score(lists: list[Postings], least: int, k: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that can be among the best ``k`` of all, with their scores.

    ``least`` is the ``k``-th best score so far. ``scores`` has a zero for each document, and has again after.
    """
    lists = sorted(lists, key=lambda p: p.bound)
    least = max([least, 1, *(p.kth for p in lists)])
    below = np.cumsum([p.bound for p in lists])  # what a document can get from the lists up to each
    first = int(np.searchsorted(below, least, side="left"))  # the first essential list
    if first == len(lists):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for p in lists[first:]:
        scores[p.docs] += p.impacts
    docs = np.flatnonzero(scores)
    found = scores[docs]
    for p in lists[first:]:
        scores[p.docs] = 0
    for i in range(first - 1, -2, -1):
        if len(found) > k:  # sums so far are scores at least
            least = max(least, int(np.partition(found, -k)[-k]))
        can = found + (below[i] if i >= 0 else 0) >= least
        docs, found = docs[can], found[can]
        if i < 0 or not len(docs):
            break
        p = lists[i]
        at = np.minimum(np.searchsorted(p.docs, docs), len(p.docs) - 1)
        found = found + np.where(p.docs[at] == docs, p.impacts[at], 0)
    return docs, found


class _Best:
    """The best ``k`` documents of an item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 0
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.nulls, nulls)
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]
        self.least = int(self.scores[-1]) if len(order) == self.k else 0


def _frequencies(index: DataFrame, wanted: list[bytes]) -> np.ndarray:
    """Documents that hold each wanted term; a row for each task and term comes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for blob, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, sizes = {t: i for i, t in enumerate(zstandard.decompress(blob).split())}, unpacked_counts(sizes)
                at = [(n, own[t]) for n, t in enumerate(wanted) if t in own]
                if at:
                    numbers, places = np.array(at).T
                    count[numbers] += sizes[places]
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held])], ["term", "df"])

    out = np.zeros(len(wanted), dtype=np.int64)
    for term, df in index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def _search_block(index: DataFrame, block: list[tuple[int | None, list[bytes]]], totals: tuple[int, int], k: int) -> DataFrame:
    """``(item, id, score)``: the best ``k`` of each task for each item of the block."""
    wanted = sorted({t for _, terms in block for t in terms})
    number = {t: i for i, t in enumerate(wanted)}
    asked = [(item, [number[t] for t in terms]) for item, terms in block]
    weight = weights(totals[0], _frequencies(index, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in asked]
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                shard = read_shard(row)
                held = postings_of(shard, wanted, weight, *totals, k)
                ids, nulls = shard.ids.fill_null(_LAST).to_numpy(zero_copy_only=False), shard.ids.is_null().to_numpy(zero_copy_only=False)
                scores = np.zeros(len(ids), dtype=np.int64)
                for own, (_, terms) in zip(best, asked):
                    docs, found = max_score([held[t] for t in terms if t in held], own.least, k, scores)
                    if len(docs):
                        own.add(found, ids[docs], nulls[docs])
        for own, (item, _) in zip(best, asked):
            if len(own.ids):
                columns = [pa.array([item] * len(own.ids), pa.int64()), pa.array(own.ids, mask=own.nulls), pa.array(own.scores)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "id", "score"])

    return index.mapInArrow(run, "item long, id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text_col: str = "text", most_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item, rank, id, score)``: the ``k`` documents with the highest scores above 0 for each item."""
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    found = index.sparkSession.createDataFrame([], "item long, id long, score long")
    for n, block in enumerate(item_blocks(items, item_id, text_col, most_terms)):
        part = _search_block(index, block, tuple(totals), k)
        found = part if not n else checkpointed(found).unionByName(checkpointed(part))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    return best_of_each(found, "item", order, k).select("item", F.col("rank").cast("int").alias("rank"), "id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``search`` of the index of ``docs``."""
    return search(build_index(docs, id_col, text_col), items, k)
