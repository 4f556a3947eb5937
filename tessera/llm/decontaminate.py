"""Benchmark decontamination by q-gram lemma filtering with banded verification.

Texts and items are normalised alike, byte for byte: A-Z to lower case, ASCII punctuation and
white space to a space, runs of spaces to one. An item of m bytes with an edit budget of k lies
in a text only if the two share m - q + 1 - k * q q-grams on neighbouring diagonals. Shared
q-grams are counted in overlapping diagonal bands twice as wide as the budget; bands that meet
the bound are verified by an alignment confined to their diagonals: a row has two budgets of
cells, whatever the text's length. The budget of an item is ``error_rate`` of its length, lessened
where the lemma would ask for no shared q-gram at all. Each band gives its cheapest place (of
equally cheap ones, that which ends first); places of one item that start within a budget of
each other are one, the cheapest, then the first. Other places may overlap and are all given.

The items are a stated query set. They are read in blocks of bounded bytes; each block's index
travels with the tasks of one pass over the documents. Where there are several blocks, the
rows of a pass are written to the checkpoint folder before the next block is read, so that the
driver and the tasks hold one block at a time, however large the benchmark.

Edge cases: null and empty texts match nothing; null items, and items of fewer than q bytes
after normalising, can't identify a passage and match nothing; repeated documents and items are
matched each on their own; a null id of a document or item is given as null; whole texts are
searched, whatever their length, in slices of bounded bytes or one text; an empty table of
either kind gives no matches; other columns are carried by ``clean_documents`` and ignored else.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

Q = 12
ERROR_RATE = 0.06
#: Normalised bytes of benchmark items that one pass over the documents looks for.
BLOCK_BYTES = 4_000_000
#: Bytes of text that are looked through at once.
SLICE_BYTES = 4_000_000

_PLAIN = np.array(
    [c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)],
    dtype=np.uint8,
)
_FILTER_BITS = 22


class Match(NamedTuple):
    item_id: int
    start: int  # bytes of the text, as it is
    end: int
    edits: int


def normalise(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes of texts that begin at ``starts`` of ``raw``, and where each byte stood."""
    plain = _PLAIN[raw]
    space = plain == 32
    before = np.empty_like(space)
    before[1:] = space[:-1]
    before[starts[starts < len(raw)]] = True  # no space begins a text
    place = np.flatnonzero(~(space & before))
    return plain[place], place


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place of ``text`` on."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    text = np.ascontiguousarray(text)
    low = np.ndarray(n, dtype="<u8", buffer=text, strides=(1,))
    high = np.ndarray(n, dtype="<u4", buffer=text[8:], strides=(1,)).astype(np.uint64)
    return low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F) ^ (low >> np.uint64(29))


class Alignment(NamedTuple):
    edits: int
    start: int
    end: int
    cells: int


def banded_edits(item: np.ndarray, text: np.ndarray, low: int, diagonals: int, budget: int, begin: int = 0, end: int | None = None) -> Alignment | None:
    """The fewest edits (at most ``budget``) that turn ``item`` into a part of ``text``; None if it takes more.

    The part may begin and end anywhere between ``begin`` and ``end``, but its alignment stays on the ``diagonals``
    from ``low`` on (place in the text less place in the item). A row of the table has one cell for each of them, and
    no others are made. Of equally cheap parts the one that ends first is taken.
    """
    last, far, c = len(text) if end is None else end, budget + 1, np.arange(diagonals)
    places = low + c  # of the text, before the first byte of the item
    cost = np.where((places >= begin) & (places <= last), 0, far)
    start = places.copy()
    padded = np.full(len(item) + diagonals, -1, dtype=np.int16)
    first, upto = max(low, begin), min(low + len(padded), last)
    if first < upto:
        padded[first - low : upto - low] = text[first:upto]
    for i, byte in enumerate(item.tolist()):
        change = cost + (padded[i : i + diagonals] != byte)
        change[padded[i : i + diagonals] < 0] = far
        drop = np.append(cost[1:] + 1, far)
        new = np.minimum(change, drop)
        origin = np.where(change <= drop, start, np.append(start[1:], 0))
        run = np.minimum.accumulate((new - c) * (diagonals + 1) + c)  # insertions, with the cell that they come from
        start = origin[run % (diagonals + 1)]
        cost = np.minimum(run // (diagonals + 1) + c, far)
        at = places + i + 1
        cost[(at < begin) | (at > last)] = far
        if cost.min() > budget:
            return None
    best = int(cost.argmin())
    return Alignment(int(cost[best]), int(start[best]), int(places[best]) + len(item), len(item) * diagonals)


class ItemIndex:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]], error_rate: float = ERROR_RATE) -> None:
        self.ids, self.texts, self.budgets, self.bounds = [], [], [], []
        hashes, owners, places = [], [], []
        for item_id, text in items:
            raw = np.frombuffer(text, dtype=np.uint8)
            plain, _ = normalise(raw, np.zeros(1, dtype=np.int64))
            if len(plain) and plain[-1] == 32:
                plain = plain[:-1]
            if len(plain) < Q:
                continue
            budget = min(int(len(plain) * error_rate), (len(plain) - Q) // Q)
            own = _gram_hashes(plain)
            hashes.append(own)
            owners.append(np.full(len(own), len(self.ids)))
            places.append(np.arange(len(own)))
            self.ids.append(item_id)
            self.texts.append(plain)
            self.budgets.append(budget)
            self.bounds.append(len(plain) - Q + 1 - budget * Q)
        flat = np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owners = np.concatenate([*owners, np.zeros(0, dtype=np.int64)]).astype(np.int64)[order]
        self.places = np.concatenate([*places, np.zeros(0, dtype=np.int64)]).astype(np.int64)[order]
        self.widths = np.array(self.budgets, dtype=np.int64) + 1
        self.bounds = np.array(self.bounds, dtype=np.int64)
        self.seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.seen[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def _hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``text`` and entries of the index with the same q-gram."""
        hashes = _gram_hashes(text)
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _FILTER_BITS)])
        first = np.searchsorted(self.hashes, hashes[at], side="left")
        count = np.searchsorted(self.hashes, hashes[at], side="right") - first
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        entry = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(at, count), entry

    def matches(self, raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, Match]]:
        """Number of the text and match, for each item found in texts that begin at ``starts`` of ``raw``."""
        text, place = normalise(raw, starts)
        at, entry = self._hits(text)
        if not len(at):
            return
        begins = np.searchsorted(place, starts)  # of the texts, in normalised bytes
        doc = np.searchsorted(begins, at, side="right") - 1
        ends = np.append(begins[1:], len(text))
        inside = at + Q <= ends[doc]
        at, entry, doc = at[inside], entry[inside], doc[inside]
        owner = self.owners[entry]
        band = (at - self.places[entry]) // self.widths[owner]
        lowest = band.min() - 1 if len(band) else 0
        keys = np.concatenate([band, band - 1]) - lowest
        both_docs, both_owners = np.tile(doc, 2), np.tile(owner, 2)
        order = np.lexsort((keys, both_owners, both_docs))
        k, o, d = keys[order], both_owners[order], both_docs[order]
        edge = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(edge, len(k)))
        held: tuple[int, int, int, Alignment] | None = None  # text, item, band, and its cheapest place so far
        for e in edge[count >= self.bounds[o[edge]]].tolist():
            d_, o_, b_ = int(d[e]), int(o[e]), int(k[e] + lowest)
            item, width = self.texts[o_], int(self.widths[o_])
            low, begin, end = b_ * width, int(begins[d_]), int(ends[d_])
            left = max(low, begin)
            exact = text[left : max(left, min(low + 2 * width - 1 + len(item), end))].tobytes().find(item.tobytes())
            found = Alignment(0, left + exact, left + exact + len(item), 0) if exact >= 0 else banded_edits(item, text, low, 2 * width, self.budgets[o_], begin, end)
            if found is None:
                continue
            if held is not None and held[:2] == (d_, o_) and found.start - held[3].start < width:
                if found.edits < held[3].edits:
                    held = (d_, o_, b_, found)
                continue
            if held is not None:
                yield held[0], self._match(held, place, starts)
            held = (d_, o_, b_, found)
        if held is not None:
            yield held[0], self._match(held, place, starts)

    def _match(self, held: tuple[int, int, int, Alignment], place: np.ndarray, starts: np.ndarray) -> Match:
        doc, owner, _, found = held
        begin, end = int(place[found.start]), int(place[found.end - 1]) + 1
        return Match(self.ids[owner], begin - int(starts[doc]), end - int(starts[doc]), found.edits)


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The bytes of ``texts`` in pieces of whole texts: number of the first text, bytes, starts."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at:to] - offsets[at]
        at = to


def item_blocks(items: DataFrame, item_id: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The query set in blocks of at most ``block_bytes`` (or of one item), read one partition at a time."""
    block, held = [], 0
    wanted = items.select(F.col(item_id).cast("long"), F.col(text_col).cast("binary")).filter(F.col(text_col).isNotNull())
    for number, text in wanted.toLocalIterator():
        if block and held + len(text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((number, bytes(text)))
        held += len(text)
    if block:
        yield block


def find_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, item_id, start, end, edits)``: each place where an item lies in a text within its budget."""
    schema = "id long, item_id long, start long, end long, edits int"
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for number, block in enumerate(item_blocks(items, block_bytes=block_bytes)):
        index = ItemIndex(block, error_rate)

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (batch.column(0)[at + d].as_py(), *match)
                    for at, raw, starts in _slices(batch.column(1))
                    for d, match in index.matches(raw, starts)
                ]
                if rows:
                    columns = list(zip(*rows))
                    types = [pa.int64()] * 4 + [pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "item_id", "start", "end", "edits"])

        part = wanted.mapInArrow(run, schema)
        found = part if not number else checkpointed(found).unionByName(checkpointed(part))
    return found


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item lies, with all their columns. Nothing is shuffled."""
    place = docs.columns.index(text_col)
    for number, block in enumerate(item_blocks(items, block_bytes=block_bytes)):
        index = ItemIndex(block, error_rate)
        docs = checkpointed(docs) if number else docs

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for at, raw, starts in _slices(batch.column(place)):
                    for d, _ in index.matches(raw, starts):
                        clean[at + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
