"""Sorted hashes of many chunks brought together by hash, and an answer for each hash sent.

A chunk of documents sends its distinct hashes with some whole numbers each; numbers of equal hashes are
merged over all chunks, and each chunk gets an answer for every hash that it sent, in the order in which it
sent them. Hashes are dealt to buckets of a fixed size, whose number grows with the input.

While there are ``DIRECT`` buckets at most, a chunk sends a row to each. Beyond that rows would become as
many as hashes, so they go in two steps: a chunk sends a row to each of ``parts`` (the square root of the
buckets), where the rows of ``BLOCK`` chunks are merged and dealt to the buckets of that part; answers go
back the same way. Rows a chunk and rows a merged block stay near a thousand for any input.

``merge`` takes numbers sorted by hash and the places where hashes begin, and gives one number for each
hash; it must not matter in which order, and in how many steps, it is applied. ``answer`` takes the merged
numbers and a chunk's own, both for the hashes that the chunk sent.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_count

#: Buckets to which chunks send their rows themselves.
DIRECT = 8192
#: Chunks whose rows are merged before they are dealt to more buckets than that.
BLOCK = 64

Numbers = list[np.ndarray]
Merge = Callable[[Numbers, np.ndarray], Numbers]
Answer = Callable[[Numbers, Numbers], np.ndarray]

SENT = "part int, chunk int, hashes binary, numbers binary"
ANSWERS = "chunk int, part int, answers binary"
_SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("numbers", pa.binary())])
_ANSWERS = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("answers", pa.binary())])
_MERGED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary()), ("numbers", pa.binary())])
_WHOLE = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("bucket", pa.int32()), ("numbers", pa.binary())])


class Routing(NamedTuple):
    buckets: int
    parts: int


def routing_for(total_bytes: int, bucket_bytes: int, least: int = 16) -> Routing:
    """Buckets of about ``bucket_bytes`` of text, and the parts to which chunks send."""
    buckets = max(least, chunk_count(total_bytes, bucket_bytes))
    if buckets <= DIRECT:
        return Routing(buckets, buckets)
    parts = int(np.ceil(np.sqrt(buckets)))
    return Routing(parts * -(-buckets // parts), parts)


def packed_integers(values: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, from the first to the last that isn't zero for all; two bytes tell which."""
    plain = np.ascontiguousarray(values).view(np.uint64)
    every = int(np.bitwise_or.reduce(plain)) if len(plain) else 0
    last = (every.bit_length() + 7) // 8
    first = ((every & -every).bit_length() - 1) // 8 if every else 0
    return bytes([first, last]) + plain.view(np.uint8).reshape(-1, 8)[:, first:last].T.tobytes()


def unpacked_integers(blob: bytes, n: int) -> np.ndarray:
    planes, (first, last) = np.zeros((n, 8), dtype=np.uint8), blob[:2]
    planes[:, first:last] = np.frombuffer(blob, dtype=np.uint8, count=n * (last - first), offset=2).reshape(last - first, n).T
    return planes.view(np.uint64).reshape(n)


def packed_sorted(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the first and the steps between them."""
    return len(hashes).to_bytes(8, "little") + hashes[:1].tobytes() + packed_integers(np.diff(hashes))


def unpacked_sorted(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.cumsum(np.concatenate([np.frombuffer(blob, dtype=np.uint64, count=1, offset=8), unpacked_integers(blob[16:], n - 1)]), dtype=np.uint64)


def _packed(numbers: Numbers) -> bytes:
    return b"".join(packed_integers(v) for v in numbers)


def _unpacked(blob: bytes, n: int) -> Numbers:
    out, at = [], 0
    while at < len(blob):
        out.append(unpacked_integers(blob[at:], n).view(np.int64))
        at += 2 + n * (blob[at + 1] - blob[at])
    return out


def _packed_answers(answers: np.ndarray) -> bytes:
    return b"b" + np.packbits(answers).tobytes() if answers.dtype == bool else b"n" + packed_integers(answers)


def _unpacked_answers(blob: bytes, n: int) -> np.ndarray:
    if blob[:1] == b"b":
        return np.unpackbits(np.frombuffer(blob, dtype=np.uint8, offset=1), count=n).astype(np.int64)
    return unpacked_integers(blob[1:], n).view(np.int64)


def _edges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted hashes, and one entry more."""
    return np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def sent_rows(chunk: int, hashes: np.ndarray, numbers: Numbers, parts: int) -> pa.Table:
    """What a chunk sends: a row for each part, from its sorted distinct hashes."""
    edges, rows = _edges(hashes, parts), []
    for part in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[part], edges[part + 1])
        rows.append((part, chunk, packed_sorted(hashes[own]), _packed([v[own] for v in numbers])))
    return table_of(rows, _SENT)


def read_answers(answers: pa.Table, hashes: np.ndarray, parts: int) -> np.ndarray:
    """An answer for each of the sorted distinct hashes of a chunk."""
    out, edges = np.zeros(len(hashes), dtype=np.int64), _edges(hashes, parts)
    for part, blob in zip(answers.column("part").to_pylist(), answers.column("answers").to_pylist()):
        out[edges[part] : edges[part + 1]] = _unpacked_answers(blob, int(edges[part + 1] - edges[part]))
    return out


class _Sources:
    """The rows of several senders, their hashes merged."""

    def __init__(self, table: pa.Table, merge: Merge) -> None:
        own = [unpacked_sorted(b) for b in table.column("hashes").to_pylist()]
        self.ends = np.cumsum([len(h) for h in own])
        self.numbers = [np.concatenate(c) for c in zip(*(_unpacked(b, len(h)) for b, h in zip(table.column("numbers").to_pylist(), own)))]
        every = np.concatenate(own)
        self.order = np.argsort(every, kind="stable")
        every = every[self.order]
        edge = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        self.hashes, self.sizes = every[edge], np.diff(np.append(edge, len(every)))
        self.merged = merge([v[self.order] for v in self.numbers], edge)

    def back(self, merged: Numbers) -> Numbers:
        """Numbers of merged hashes for each hash that came in."""
        out = [np.empty(len(self.order), dtype=np.int64) for _ in merged]
        for to, v in zip(out, merged):
            to[self.order] = np.repeat(v, self.sizes)
        return out

    def of_each(self, numbers: Numbers) -> list[Numbers]:
        return [[v[a:b] for v in numbers] for a, b in zip(np.append(0, self.ends[:-1]), self.ends)]


def routed(sent: DataFrame, routing: Routing, merge: Merge, answer: Answer) -> DataFrame:
    """``ANSWERS`` to the rows of ``SENT``, which are read twice where they go in two steps."""

    def answered(sources: _Sources, whole: Numbers, chunks: list[int], part: int) -> pa.Table:
        both = zip(chunks, sources.of_each(whole), sources.of_each(sources.numbers))
        return table_of([(c, part, _packed_answers(answer(w, own))) for c, w, own in both], _ANSWERS)

    if routing.parts == routing.buckets:

        def resolve(table: pa.Table) -> pa.Table:
            sources = _Sources(table, merge)
            return answered(sources, sources.back(sources.merged), table.column("chunk").to_pylist(), table.column("part")[0].as_py())

        return sent.groupBy("part").applyInArrow(resolve, ANSWERS)

    within = routing.buckets // routing.parts

    def merge_block(table: pa.Table) -> pa.Table:
        sources, block, part = _Sources(table, merge), table.column("block")[0].as_py(), table.column("part")[0].as_py()
        edges = _edges(sources.hashes, routing.buckets)[part * within : (part + 1) * within + 1]
        rows = []
        for i in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[i], edges[i + 1])
            rows.append((part * within + i, block, part, packed_sorted(sources.hashes[own]), _packed([v[own] for v in sources.merged])))
        return table_of(rows, _MERGED)

    def merge_all(table: pa.Table) -> pa.Table:
        sources = _Sources(table, merge)
        columns = (table.column(c).to_pylist() for c in ("block", "part", "bucket"))
        return table_of([(*k, _packed(w)) for *k, w in zip(*columns, sources.of_each(sources.back(sources.merged)))], _WHOLE)

    def give_back(table: pa.Table, wholes: pa.Table) -> pa.Table:
        sources, part = _Sources(table, merge), table.column("part")[0].as_py()
        edges = _edges(sources.hashes, routing.buckets)
        blobs = sorted(zip(wholes.column("bucket").to_pylist(), wholes.column("numbers").to_pylist()))
        pieces = [_unpacked(blob, int(edges[b + 1] - edges[b])) for b, blob in blobs]
        return answered(sources, sources.back([np.concatenate(c) for c in zip(*pieces)]), table.column("chunk").to_pylist(), part)

    blocked = sent.withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int"))
    by_block = blocked.groupBy("block", "part")
    whole = (
        by_block.applyInArrow(merge_block, "bucket int, block int, part int, hashes binary, numbers binary")
        .groupBy("bucket").applyInArrow(merge_all, "block int, part int, bucket int, numbers binary")
    )
    return by_block.cogroup(whole.groupBy("block", "part")).applyInArrow(give_back, ANSWERS)
