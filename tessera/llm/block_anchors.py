"""Exact substring removal by fixed-block anchors.

Words of a document are removed where a run of ``WINDOW`` (13) words also starts in a document
with a smaller id. Of each document the non-overlapping blocks of ``BLOCK`` (7) words are the
index; every rolling window of seven words of every document probes it. Each run of 13 words
holds a whole block, so two documents that share a run share an anchor: the block in one, the
probe in the other. Anchors are extended by six words to either side, the runs inside are
looked up by a 64-bit hash for their first document, and neighbouring runs that have an earlier
one join to maximal exact repeats.

The work is linear: hashes are dealt to buckets, packed as sorted arrays (see ``routing``), and
answered by a bit each; no pair of documents is ever listed, however many share a passage.

1. chunk: the distinct probes of a chunk, which of them are blocks, which stand in two documents
2. bucket: a probe is an anchor if a document has it as a block and another one has it at all
3. chunk: anchors extended to candidate runs; each distinct run with its first document here
4. bucket: the first document of each run over all chunks
5. chunk: runs with an earlier document joined to repeats, and removed

Texts are shuffled once, by chunk; the plan reuses that exchange for steps 1, 3 and 5.

Words are told apart, and runs of them are, by 64-bit hashes, and never compared: at n different
runs, chance makes about n * n / 2**65 pairs of them alike (none at a billion, one in a million
runs at 10**13).

Edge cases: null and empty texts have no words; texts under 13 words lose nothing; a row with
a null id has no earlier and is no earlier than any other: it loses nothing and takes nothing;
rows with equal ids are one document as to order, so a run within it, however often, is kept
once for each; rows equal in id and text are all in one chunk; very long texts are chunks of their
own, in memory whole; a run in all chunks (a notice) sends its bucket a row from each, and chunks
grow with the input before they grow in number (see ``common``); an empty table gives an empty
result; other columns aren't carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_count, chunk_of, text_bytes
from .routing import SENT, Numbers, Routing, read_answers, routed, routing_for, sent_rows, table_of
from .tokens import Words, rolling

WINDOW = 13
BLOCK = 7
#: Leading bits of a probe's hash that are sent.
PROBE_BITS = 48
#: UTF-8 bytes of the texts in a chunk, about.
CHUNK_BYTES = 4_000_000
#: UTF-8 bytes of all texts for each bucket, about.
BUCKET_BYTES = 12_000_000

_NONE = np.iinfo(np.int64).min  # the id that stands for null


class _Chunk:
    """What a chunk's texts say to the buckets."""

    def __init__(self, ids: pa.Array, texts: pa.Array) -> None:
        order = np.argsort(ids.fill_null(_NONE).to_numpy(zero_copy_only=False), kind="stable")  # answers name hashes by place
        ids = ids.take(pa.array(order))
        self.ids = ids
        self.plain_ids = ids.fill_null(_NONE).to_numpy(zero_copy_only=False)
        self.texts = texts.take(pa.array(order)).cast(pa.large_binary()).to_pylist()
        self.words = Words(self.texts)
        self.doc = self.words.doc_of()
        self.hashed = self.words.hashes()[self.words.codes] if len(self.words.codes) else np.zeros(0, dtype=np.uint64)

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which ``width`` words of one document with an id begin, and their hashes."""
        hashes = rolling(self.hashed, width)
        if not len(hashes):
            return np.zeros(0, dtype=np.int64), hashes
        whole = (self.doc[: len(hashes)] == self.doc[width - 1 :]) & (self.plain_ids[self.doc[: len(hashes)]] != _NONE)
        at = np.flatnonzero(whole)
        return at, hashes[at]

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions, the distinct probe hashes, for each position its distinct hash, and the probes' flags.

        Anchors only preselect, so that PROBE_BITS of a hash do. Flags: 1, some document has it as a block; 2, two documents of the chunk have it.
        """
        at, hashes = self.runs(BLOCK)
        hashes &= np.uint64((1 << 64) - (1 << (64 - PROBE_BITS)))
        distinct, which = np.unique(hashes, return_inverse=True)
        flags = np.zeros(len(distinct), dtype=np.uint8)
        flags[which[(at - self.words.starts[self.doc[at]]) % BLOCK == 0]] |= 1
        ids = self.plain_ids[self.doc[at]]
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        high = np.full(len(distinct), _NONE)
        np.minimum.at(low, which, ids)
        np.maximum.at(high, which, ids)
        flags[low < high] |= 2
        return at, distinct, which, flags

    def candidates(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the runs around anchors, the distinct run hashes, each position's, and first ids."""
        at, distinct, which, _ = self.probes()
        near = np.zeros(len(self.doc) + 1, dtype=np.int64)
        hit = at[anchors[which]]
        np.add.at(near, np.maximum(hit - (WINDOW - BLOCK), 0), 1)
        np.add.at(near, hit + 1, -1)
        wanted = np.cumsum(near)[:-1] > 0
        runs, hashes = self.runs(WINDOW)
        chosen = wanted[runs]
        runs, hashes = runs[chosen], hashes[chosen]
        distinct, which = np.unique(hashes, return_inverse=True)
        first = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(first, which, self.plain_ids[self.doc[runs]])
        return runs, distinct, which, first


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks() if table.num_rows else pa.array([], table.schema.field(name).type)


def _flags(numbers: Numbers, edge: np.ndarray) -> Numbers:
    """Flags together; what comes from two senders stands in two documents."""
    (flags,) = numbers
    return [np.bitwise_or.reduceat(flags, edge) | np.where(np.diff(np.append(edge, len(flags))) > 1, 2, 0)] if len(flags) else numbers


def _first(numbers: Numbers, edge: np.ndarray) -> Numbers:
    (first,) = numbers
    return [np.minimum.reduceat(first, edge)] if len(first) else numbers


def dealt_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Routing]:
    """``(chunk, id, text)`` of each row, and the buckets for the table."""
    total = text_bytes(docs, text_col)
    chunks = max(16, chunk_count(total, CHUNK_BYTES))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.select(chunk_of(chunks, "id", "text").alias("chunk"), "id", "text"), routing_for(total, BUCKET_BYTES)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept_text)`` of each row."""
    dealt, routing = dealt_documents(docs, id_col, text_col)
    by_chunk = dealt.groupBy("chunk")

    def chunk_from(table: pa.Table) -> tuple[int, _Chunk]:
        return table.column("chunk")[0].as_py(), _Chunk(_column(table, "id"), _column(table, "text"))

    def send_probes(table: pa.Table) -> pa.Table:
        number, chunk = chunk_from(table)
        _, distinct, _, flags = chunk.probes()
        return sent_rows(number, distinct, [flags.astype(np.int64)], routing.parts)

    def send_runs(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return sent_rows(0, np.zeros(0, dtype=np.uint64), [np.zeros(0, dtype=np.int64)], routing.parts)
        number, chunk = chunk_from(texts)
        _, distinct, _, first = chunk.candidates(read_answers(answers, chunk.probes()[1], routing.parts) > 0)
        return sent_rows(number, distinct, [first], routing.parts)

    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def cut(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        """Which of a chunk's words stay. ``answers`` hold those to probes and to runs."""
        if not texts.num_rows:
            return table_of([], out)
        _, chunk = chunk_from(texts)
        anchors = read_answers(answers.filter(pc.equal(answers.column("step"), 1)), chunk.probes()[1], routing.parts) > 0
        runs, distinct, which, first = chunk.candidates(anchors)
        elsewhere = read_answers(answers.filter(pc.equal(answers.column("step"), 2)), distinct, routing.parts) > 0
        earlier = elsewhere[which] | (first[which] < chunk.plain_ids[chunk.doc[runs]])
        cover = np.zeros(len(chunk.doc) + 1, dtype=np.int64)
        np.add.at(cover, runs[earlier], 1)
        np.add.at(cover, np.minimum(runs[earlier] + WINDOW, len(chunk.doc)), -1)
        kept = np.cumsum(cover)[:-1] == 0
        rows = []
        for i, (start, n) in enumerate(zip(chunk.words.starts.tolist(), chunk.words.counts.tolist())):
            own = kept[start : start + n]
            words = (chunk.texts[i] or b"").split()
            left = words if own.all() else [w for w, k in zip(words, own.tolist()) if k]
            rows.append((chunk.ids[i].as_py(), n, n - len(left), b" ".join(left)))
        return table_of([(i, n, r, t.decode()) for i, n, r, t in rows], out)

    anchors = routed(by_chunk.applyInArrow(send_probes, SENT), routing, _flags, lambda whole, own: whole[0] == 3)
    firsts = routed(by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(send_runs, SENT), routing, _first, lambda whole, own: whole[0] < own[0])
    answers = anchors.withColumn("step", F.lit(1)).unionByName(firsts.withColumn("step", F.lit(2)))
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(cut, "id long, n_words long, n_removed long, kept_text string")

