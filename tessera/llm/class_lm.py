"""Brown class-based bigram language model with exact corpus counts.

Every word belongs to a unit: training words that come LEAST_COUNT times or are among the FREQUENT
most frequent are units of their own, all rarer words (unseen ones too) share one of ENDINGS units
by a hash of their last two letters, and the end of a text is one. Exchange clustering moves units between classes
while that raises the likelihood of the class bigrams; unit bigrams are counted over all training
texts. It begins with the classes of the FREQUENT words and the endings alone, then goes over all
units in rounds until they settle (see ``settle``). A text's probability is the product,
over its words and its end, of P(class | class before) and P(word | class): transitions are
interpolated with the class unigrams, emissions are (c + 0.1) / (N + 0.1 (V + 1)) within the
class, from the exact count of every distinct word; each class keeps one unseen word.

Word counts never stand whole in one place. A chunk of texts packs the hashes of its distinct
words for each bucket; a bucket's task sums the counts of its words over all chunks and answers
each chunk with its words' counts (see ``tokens``). Unit bigrams stay packed in buckets, by the
word before and by the word after; a round makes each unit's counts of (class before, class after)
from them and proposes its best class. The driver holds one hash and one class of each unit that is
clustered, the CLASSES x CLASSES table and the proposals of a round.

Edge cases: a null or empty text has one token, its end; a null id has the bucket of an empty
string; repeated rows count as often as they are there, and rows equal in id and text are one
chunk's; very long texts are chunks of their own, in memory whole; equally frequent words are
ordered by their hash, and of equally good classes the first is taken; without training texts all counts are
0 and every transition is alike; an empty table gives an empty result; other columns aren't
carried. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunk_count, chunk_of, text_bytes
from .tokens import Words, bucket_edges, stirred

FREQUENT = 512
ENDINGS = 256
#: Words that come this often in training are clustered, however many there are.
LEAST_COUNT = 20
#: Units of the first clustering: frequent words, the end, endings. Further words are the units after them.
UNITS = FREQUENT + 1 + ENDINGS
END_UNIT = FREQUENT
CLASSES = 64
#: Least gain of a move, in nats of the likelihood of all training texts.
LEAST_GAIN = 1e-3
#: Units that are exchanged one by one in a round.
BATCH = 4096
#: Of more units that gain, the share that moves at once in a round.
AT_ONCE = 0.75
#: Clustering ends with a round that raises the likelihood by less than this, in nats a training token; 0 goes on until no word gains by a move.
SETTLED = 1e-3
#: Tables of class bigrams are summed in so many bands of rows, those of a band in so many parts first.
BANDS, PARTS = 8, 64
#: Weight, in tokens, of the class unigrams in a transition.
BACKOFF = 20.0
ADD = 0.1
CHUNK_BYTES = 4_000_000
BUCKET_BYTES = 12_000_000

_STRIP = b".,;:!?\"'()[]*#$%&|<>"


def in_training(id_col: str, folds: int = 10) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != 0


def endings(words: Words) -> np.ndarray:
    """The ending (0 to ENDINGS - 1) of each distinct word: a hash of its last two code points, without punctuation."""
    tails = [t[-2:] if t.isascii() else t.decode(errors="ignore")[-2:].encode() for t in ((w.rstrip(_STRIP) or w)[-8:] for w in words.distinct)]
    codes = np.fromiter((int.from_bytes(t, "little") for t in tails), dtype=np.uint64, count=len(tails))
    return (stirred(codes + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.uint8)


class _Units:
    """Frequent words by hash; the unit of any word."""

    def __init__(self, hashes: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.units = hashes[order], np.where(order < FREQUENT, order, order + 1 + ENDINGS).astype(np.int64)

    def of(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        units = ends.astype(np.int64) + END_UNIT + 1
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            units[known] = self.units[at[known]]
        return units


def _flow(words: Words, units: np.ndarray) -> np.ndarray:
    """Units of all texts in turn, each text with its end; the texts are thought to follow an end."""
    total = len(words.codes) + len(words.counts)
    out = np.full(total, END_UNIT, dtype=np.int64)
    is_word = np.ones(total, dtype=bool)
    is_word[np.cumsum(words.counts + 1) - 1] = False
    out[is_word] = units[words.codes]
    return out


def _pieces(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[list[bytes | None]]:
    piece, held = [], 0
    for text in texts.cast(pa.large_binary()):
        piece.append(text.as_py())
        held += len(piece[-1] or b"")
        if held >= most:
            yield piece
            piece, held = [], 0
    if piece:
        yield piece


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_classes(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each unit after exchange clustering of ``bigrams[unit, next unit]``.

    The end keeps class 0 to itself. Units are moved one by one, the frequent first, each to the
    class with the greatest likelihood, until a sweep moves none or gains less than SETTLED a token.
    """
    counts = bigrams.astype(np.float64)
    n = len(counts)
    order = np.argsort(-(counts.sum(0) + counts.sum(1)), kind="stable")
    order = order[order != END_UNIT]
    cls = np.zeros(n, dtype=np.int64)
    cls[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), cls] = 1
    grid = member.T @ counts @ member
    f = _f
    reached, moved, least = -np.inf, 1, SETTLED * float(counts.sum())
    while moved and (now := likelihood(grid)) > reached + least:  # gains leave out what a move does to the sums of other classes
        reached, moved = now, 0
        for u in order.tolist():
            own = counts[u, u]
            right = np.bincount(cls, weights=counts[u], minlength=classes)
            left = np.bincount(cls, weights=counts[:, u], minlength=classes)
            if not right.any() and not left.any():
                continue
            a = cls[u]
            right[a] -= own
            left[a] -= own
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] -= own
            grid = np.maximum(grid, 0)
            row, column = f(grid + right), f(grid + left[:, None])
            base = f(grid)
            diagonal = np.diag(grid)
            gain = row.sum(1) - np.diag(row) - (base.sum(1) - np.diag(base))
            gain += column.sum(0) - np.diag(column) - (base.sum(0) - np.diag(base))
            gain += f(diagonal + right + left + own) - f(diagonal)
            out, into = grid.sum(1), grid.sum(0)
            gain -= f(out + right.sum() + own) - f(out) + f(into + left.sum() + own) - f(into)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-9:
                best = int(a)
            grid[best] += right
            grid[:, best] += left
            grid[best, best] += own
            cls[u] = best
            moved += best != a
    return cls


def _packed(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(x.tobytes(), asbytes=True)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.Codec("zstd").decompress(blob[8:], decompressed_size=n, asbytes=True), dtype=kind)


def pair_table(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """``(bucket, right, codes, counts)``: packed unit bigrams of the training ``docs(text)``; a text follows an end.

    Codes are sorted steps of ``unit << 32 | other``: where ``right``, the other comes after the unit, else before.
    A bucket has all bigrams of its units.
    """
    sent = "bucket int, right boolean, codes binary, counts binary"
    kind = pa.schema([("bucket", pa.int32()), ("right", pa.bool_()), ("codes", pa.binary()), ("counts", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Units(frequent)
        for batch in batches:
            for piece in _pieces(batch.column("text")):
                words = Words(piece, lower=True)
                flow = _flow(words, known.of(words.hashes(), endings(words))).astype(np.uint64)
                pairs, n = np.unique(np.r_[np.uint64(END_UNIT), flow[:-1]] << np.uint64(32) | flow, return_counts=True)
                n = n.astype(np.uint32)
                rows = []
                for right in (True, False):
                    if not right:
                        pairs = pairs << np.uint64(32) | pairs >> np.uint64(32)
                    bucket = stirred((pairs >> np.uint64(32)) + np.uint64(1)) % np.uint64(buckets)
                    order = np.lexsort((pairs, bucket))
                    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
                    for b in np.flatnonzero(np.diff(edges)).tolist():
                        own = order[edges[b] : edges[b + 1]]
                        rows.append((b, right, _packed(np.diff(pairs[own], prepend=np.uint64(0))), _packed(n[own])))
                yield from _rows(rows, kind).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        rows = []
        for right in (True, False):
            some = table.filter(pc.equal(table.column("right"), right))
            codes = np.concatenate([np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in some.column("codes").to_pylist()])
            counts = np.concatenate([_unpacked(x, np.uint32) for x in some.column("counts").to_pylist()]).astype(np.int64)
            order = np.argsort(codes, kind="stable")
            codes = codes[order]
            edge = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            rows.append((table.column("bucket")[0].as_py(), right, _packed(np.diff(codes[edge], prepend=np.uint64(0))), _packed(np.add.reduceat(counts[order], edge))))
        return _rows(rows, kind)

    return docs.select("text").mapInArrow(cut, sent).groupBy("bucket").applyInArrow(merge, sent)


def _bigrams(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units, the others, and counts."""
    both = np.cumsum(_unpacked(codes, np.uint64), dtype=np.uint64)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64), _unpacked(counts, np.int64)


def class_bigrams(pairs: DataFrame, cls: np.ndarray, classes: int) -> np.ndarray:
    """``[class, next class]`` over all of ``pairs``; tables of tasks are summed band by band in tasks, so that one comes to the driver."""
    edges = np.linspace(0, classes, min(BANDS, classes) + 1).astype(np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            for codes, counts in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist()):
                u, v, n = _bigrams(codes, counts)
                grid += np.bincount(cls[u] * classes + cls[v], weights=n, minlength=classes * classes).astype(np.int64)
        bands = [grid[i * classes : j * classes].tobytes() for i, j in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(bands)), pa.int32()), pa.array(bands, pa.binary())], ["band", "grid"])

    def total(table: pa.Table) -> pa.Table:
        grid = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("grid"))
        return pa.table({"band": table.column("band").slice(0, 1).cast(pa.int32()), "grid": pa.array([grid.tobytes()], pa.binary())})

    each = pairs.filter("right").select("codes", "counts").mapInArrow(add, "band int, grid binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    some = each.groupBy("band", "part").applyInArrow(total, "band int, grid binary")
    grid = np.zeros((classes, classes), dtype=np.int64)
    for r in some.groupBy("band").applyInArrow(total, "band int, grid binary").collect():
        grid[edges[r["band"]] : edges[r["band"] + 1]] = np.frombuffer(r["grid"], dtype=np.int64).reshape(-1, classes)
    return grid


def move_gains(grid: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """``[unit, class]``: what the likelihood gains when units that are taken out of their classes join each class.

    ``right`` and ``left`` are each unit's counts by class after and before it, without ``own``, those of itself.
    """
    k, classes = right.shape
    grid, at = grid.astype(np.float64), np.arange(k)
    gains = np.zeros((k, classes))
    for table, some, other in ((grid, right, left), (grid.T, left, right)):
        i, c = np.nonzero(some)
        r, rows = some[i, c], np.arange(len(i))
        base = table.T[c]  # the class joined, with class c
        before = _f(table.T)[c]  # of what few cells change, anew below
        home = np.flatnonzero(c == cls[i])
        base[home] = np.maximum(base[home] - other[i[home]], 0)
        before[home] = _f(base[home])
        base[rows, cls[i]] = np.maximum(table[cls[i], c] - r, 0)
        before[rows, cls[i]] = _f(base[rows, cls[i]])
        gain = _f(base + r[:, None]) - before
        gain[np.arange(len(i)), c] = 0
        if len(i):
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            gains[i[starts]] += np.add.reduceat(gain, starts, axis=0)
    diagonal = np.tile(np.diag(grid), (k, 1))
    diagonal[at, cls] -= right[at, cls] + left[at, cls] + own
    diagonal = np.maximum(diagonal, 0)
    gains += _f(diagonal + right + left + own[:, None]) - _f(diagonal)
    for sums, some in ((grid.sum(1), right), (grid.sum(0), left)):
        tokens = some.sum(1) + own
        held = np.tile(sums, (k, 1))
        held[at, cls] -= tokens
        gains -= _f(held + tokens[:, None]) - _f(held)
    return gains


def proposals(pairs: DataFrame, cls: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units that gain by a move out of their class, and the best class of each. No unit joins the end's class."""
    classes, end = len(grid), int(cls[END_UNIT])

    def best(table: pa.Table) -> pa.Table:
        counts, own, units = {}, None, None
        for side, codes, numbers in zip(*(table.column(c).to_pylist() for c in ("right", "codes", "counts"))):
            u, v, n = _bigrams(codes, numbers)
            edge = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            units = u[edge]
            place = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(u))))
            counts[side] = np.bincount(place * classes + cls[v], weights=n, minlength=len(edge) * classes).reshape(-1, classes)
            own = np.bincount(place[u == v], weights=n[u == v], minlength=len(edge))
        moved, into = [], []
        for i in range(0, len(units), 1024):
            some = slice(i, i + 1024)
            home, at = cls[units[some]], np.arange(len(units[some]))
            right, left = counts[True][some], counts[False][some]
            right[at, home] -= own[some]
            left[at, home] -= own[some]
            gains = move_gains(grid, right, left, own[some], home)
            gains[:, end] = -np.inf
            to = gains.argmax(1)
            good = (gains[at, to] > gains[at, home] + LEAST_GAIN) & (units[some] != END_UNIT)
            moved.append(units[some][good])
            into.append(to[good])
        return pa.table({"units": pa.array([np.concatenate(moved).astype(np.int64).tobytes()], pa.binary()), "classes": pa.array([np.concatenate(into).astype(np.int64).tobytes()], pa.binary())})

    # A bucket's two rows were made by one task and stand side by side: no shuffle brings them together.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if held is None:
                    held = row
                else:
                    yield from best(pa.Table.from_batches([held, row])).to_batches()
                    held = None

    rows = pairs.select("right", "codes", "counts").mapInArrow(run, "units binary, classes binary").collect()
    units, into = (np.concatenate([np.zeros(0, dtype=np.int64), *(np.frombuffer(r[c], dtype=np.int64) for r in rows)]) for c in ("units", "classes"))
    order = np.argsort(units)
    return units[order], into[order]


def likelihood(grid: np.ndarray) -> float:
    """Of the class bigrams, but for what no move changes."""
    return float(_f(grid.astype(np.float64)).sum() - _f(grid.sum(0).astype(np.float64)).sum() - _f(grid.sum(1).astype(np.float64)).sum())


def _among(pairs: DataFrame, cls: np.ndarray, classes: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of BATCH sorted units at most: counts by class after and before each, and ``(i, j, count)`` of bigrams within them."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, codes, numbers in zip(*(batch.column(c).to_pylist() for c in ("right", "codes", "counts"))):
                u, v, n = _bigrams(codes, numbers)
                i = np.minimum(np.searchsorted(units, u), len(units) - 1)
                own = units[i] == u
                i, v, n = i[own], v[own], n[own]
                held, place = np.unique(i, return_inverse=True)
                counts = np.bincount(place * classes + cls[v], weights=n, minlength=len(held) * classes).astype(np.int64)
                j = np.minimum(np.searchsorted(units, v), len(units) - 1)
                both = units[j] == v if side else np.zeros(len(v), dtype=bool)
                blobs = [[held.astype(np.int64).tobytes()], [counts.tobytes()], [np.stack([i[both], j[both], n[both]]).astype(np.int64).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array([side]), *(pa.array(x, pa.binary()) for x in blobs)], ["right", "held", "counts", "within"])

    tables = {True: np.zeros((len(units), classes)), False: np.zeros((len(units), classes))}
    within = [np.zeros((3, 0), dtype=np.int64)]
    for r in pairs.select("right", "codes", "counts").mapInArrow(pick, "right boolean, held binary, counts binary, within binary").collect():
        tables[r["right"]][np.frombuffer(r["held"], dtype=np.int64)] = np.frombuffer(r["counts"], dtype=np.int64).reshape(-1, classes)
        within.append(np.frombuffer(r["within"], dtype=np.int64).reshape(3, -1))
    return tables[True], tables[False], np.concatenate(within, axis=1)


def _exchanged(pairs: DataFrame, cls: np.ndarray, grid: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the sorted ``units`` exchanged in turn, once, all others staying: exact, so the likelihood rises with each move."""
    cls, grid, classes, end = cls.copy(), grid.astype(np.float64), len(grid), int(cls[END_UNIT])
    right, left, (first, second, n) = _among(pairs, cls, classes, units)
    after, before = ([[] for _ in units] for _ in range(2))
    for i, j, count in zip(first.tolist(), second.tolist(), n.tolist()):
        after[i].append((j, count))
        before[j].append((i, count))
    for i, u in enumerate(units.tolist()):
        a, own = int(cls[u]), float(sum(c for j, c in after[i] if j == i))
        r, b = right[i].copy(), left[i].copy()
        r[a] -= own
        b[a] -= own
        gains = move_gains(grid, r[None], b[None], np.array([own]), np.array([a]))[0]
        gains[end] = -np.inf
        to = int(gains.argmax())
        if gains[to] <= gains[a] + LEAST_GAIN:
            continue
        for c, sign in ((a, -1), (to, 1)):
            grid[c] += sign * r
            grid[:, c] += sign * b
            grid[c, c] += sign * own
        for j, count in after[i]:
            left[j, a] -= count
            left[j, to] += count
        for j, count in before[i]:
            right[j, a] -= count
            right[j, to] += count
        cls[u] = to
    return cls, grid.round().astype(np.int64)


def settle(pairs: DataFrame, cls: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units and their class bigrams, after rounds of moves until they settle.

    A round asks all units. Of more than BATCH units that gain, the share AT_ONCE moves at once; where that lowers the
    likelihood they go back, and BATCH of them are exchanged one by one instead, as are units that are fewer. The end
    comes, at any number of units, when no unit gains by a move or the moves of a round together raise the likelihood
    by less than SETTLED a token.
    """
    grid, number = class_bigrams(pairs, cls, classes), 0
    least = SETTLED * float(grid.sum())
    units, into = proposals(pairs, cls, grid)
    while len(units):
        number += 1
        drawn = np.argsort(stirred(units.astype(np.uint64) + np.uint64(number << 40)), kind="stable")
        reached, rises = likelihood(grid), False
        if len(units) > BATCH:
            tried, moving = cls.copy(), drawn[: int(len(units) * AT_ONCE)]
            tried[units[moving]] = into[moving]
            after = class_bigrams(pairs, tried, classes)
            rises = likelihood(after) > reached
        cls, grid = (tried, after) if rises else _exchanged(pairs, cls, grid, np.sort(units[drawn[:BATCH]]))
        if likelihood(grid) - reached < least:
            break
        units, into = proposals(pairs, cls, grid)
    return cls, grid


def _folded(bigrams: np.ndarray, cls: np.ndarray) -> np.ndarray:
    member = np.zeros((len(cls), CLASSES))
    member[np.arange(len(cls)), cls] = 1
    return member.T @ bigrams @ member


class Model:
    """Class transitions, and what an emission needs to know of each class."""

    def __init__(self, frequent: np.ndarray, bigrams: np.ndarray, distinct: np.ndarray, classes: np.ndarray | None = None) -> None:
        """``distinct``: training words in each unit; ``bigrams``: of units, or of ``classes``, where they are given."""
        self.frequent = frequent
        self.classes = exchange_classes(bigrams) if classes is None else classes
        grid = bigrams if classes is not None else _folded(bigrams, self.classes)
        into = grid.sum(0)
        unigram = (into + ADD) / (into.sum() + ADD * CLASSES)
        self.transition = np.log10((grid + BACKOFF * unigram) / (grid.sum(1, keepdims=True) + BACKOFF))
        self.tokens = into
        self.room = ADD * (np.bincount(self.classes, weights=distinct, minlength=CLASSES) + 1)
        self.docs = float(into[self.classes[END_UNIT]])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def count_words(dealt: DataFrame, buckets: int) -> DataFrame:
    """``(kind, chunk, bucket, a, b)``: answers to chunks (a: counts) and, of each bucket, what it holds.

    kind 0: a chunk's words' training counts, in the order in which the chunk sent them;
    kind 1: the bucket's words that come LEAST_COUNT times or are its FREQUENT most frequent (a), and their counts and then endings (b);
    kind 2: the bucket's tokens (a) and its distinct training words by ending (b).
    """
    sent = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("ends", pa.binary()), ("counts", pa.binary())])
    told = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def send(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        words = Words(table.column("text").combine_chunks().cast(pa.large_binary()).to_pylist(), lower=True)
        trains = np.repeat(table.column("trains").to_numpy(), words.counts)
        counts = np.bincount(words.codes[trains], minlength=len(words.distinct)).astype(np.uint32)
        hashes, ends = words.hashes(), endings(words)
        order = np.argsort(hashes, kind="stable")
        hashes, ends, counts = hashes[order], ends[order], counts[order]
        edges = bucket_edges(hashes, buckets)
        parts = [(b, slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges)).tolist()]
        return _rows([(b, number, hashes[p].tobytes(), ends[p].tobytes(), counts[p].tobytes()) for b, p in parts], sent)

    def merge(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        ends = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in table.column("ends").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        flat = np.concatenate(blobs)
        order = np.argsort(flat, kind="stable")
        merged = flat[order]
        edge = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
        total = np.add.reduceat(counts[order], edge)
        each = np.empty(len(merged), dtype=np.int64)
        each[order] = np.repeat(total, np.diff(np.append(edge, len(merged))))
        kind = np.uint32 if total.max() < 1 << 32 else np.uint64
        upto = np.cumsum([len(x) for x in blobs])
        bucket = table.column("bucket")[0].as_py()
        rows = [(0, c, bucket, each[e - len(x) : e].astype(kind).tobytes(), b"") for c, x, e in zip(table.column("chunk").to_pylist(), blobs, upto)]
        top = np.lexsort((merged[edge], -total))
        top = top[: max(FREQUENT, int((total >= LEAST_COUNT).sum()))]
        top = top[total[top] > 0]
        rows.append((1, None, bucket, merged[edge][top].tobytes(), total[top].tobytes() + ends[order][edge][top].tobytes()))
        held = np.bincount(ends[order][edge][total > 0], minlength=ENDINGS).astype(np.int64)
        rows.append((2, None, bucket, np.array([total.sum()]).tobytes(), held.tobytes()))
        return _rows(rows, told)

    probes = dealt.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, hashes binary, ends binary, counts binary")
    return probes.groupBy("bucket").applyInArrow(merge, "kind int, chunk int, bucket int, a binary, b binary")


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and endings of the training words that are units of their own, the most frequent first."""
    hashes, counts, ends = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint8)]
    for r in counted.filter("kind = 1").select("a", "b").collect():
        hashes.append(np.frombuffer(r["a"], dtype=np.uint64))
        counts.append(np.frombuffer(r["b"], dtype=np.int64, count=len(hashes[-1])))
        ends.append(np.frombuffer(r["b"], dtype=np.uint8, offset=8 * len(hashes[-1])))
    h, n, e = np.concatenate(hashes), np.concatenate(counts), np.concatenate(ends)
    order = np.lexsort((h.view(np.int64), -n))[: max(FREQUENT, int((n >= LEAST_COUNT).sum()))]
    return h[order], e[order].astype(np.int64)


def _held(counted: DataFrame) -> tuple[int, np.ndarray]:
    """Training words, and distinct ones by ending, over all buckets."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        tokens = sum(int(np.frombuffer(a, dtype=np.int64)[0]) for a in table.column("a").to_pylist())
        held = sum(np.frombuffer(b, dtype=np.int64) for b in table.column("b").to_pylist())
        return pa.table({"tokens": [tokens], "held": [held.tolist()]})

    some = counted.filter("kind = 2").select(F.pmod("bucket", F.lit(64)).alias("part"), "a", "b")
    rows = some.groupBy("part").applyInArrow(add, "tokens long, held array<long>").collect()
    return sum(r["tokens"] for r in rows), np.sum([r["held"] for r in rows], axis=0, dtype=np.int64).reshape(-1) if rows else np.zeros(ENDINGS, dtype=np.int64)


def first_bigrams(pairs: DataFrame, ends: np.ndarray) -> np.ndarray:
    """``[unit, next unit]`` of the first UNITS units, where all other words are in the units of their endings; ``ends``: of frequent words."""
    fold = np.r_[np.arange(UNITS), END_UNIT + 1 + ends[FREQUENT:]]
    return class_bigrams(pairs, fold, UNITS)


def cluster(docs: DataFrame, frequent: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit and the class bigrams of the training ``docs(text)``."""
    pairs = checkpointed(pair_table(docs, frequent, buckets))
    first = exchange_classes(first_bigrams(pairs, ends))
    return settle(pairs, np.r_[first, first[END_UNIT + 1 + ends[FREQUENT:]]])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` of each row."""
    total = text_bytes(docs, text_col)
    chunks, buckets = max(16, chunk_count(total, CHUNK_BYTES)), max(16, chunk_count(total, BUCKET_BYTES))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), in_training(id_col).alias("trains"), F.col(text_col).cast("string").alias("text"))
    dealt = slim.select(chunk_of(chunks, "id", "text").alias("chunk"), "id", "trains", "text")
    counted = checkpointed(count_words(dealt, buckets))
    frequent, frequent_ends = _frequent(counted)
    n_words, by_ending = _held(counted)
    classes, bigrams = cluster(slim.filter("trains"), frequent, frequent_ends, buckets)
    distinct = np.ones(len(classes), dtype=np.int64)
    distinct[len(frequent) : END_UNIT] = 0
    distinct[END_UNIT + 1 : UNITS] = by_ending
    np.subtract.at(distinct, END_UNIT + 1 + frequent_ends, 1)
    model = Model(frequent, bigrams, distinct, classes)
    n_docs = int(model.docs)
    train_tokens = n_words + n_docs
    n_distinct = int(by_ending.sum()) + (n_docs > 0)
    base_room = train_tokens + ADD * (n_distinct + 1)
    out = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _rows([], out)
        words = Words(texts.column("text").combine_chunks().cast(pa.large_binary()).to_pylist(), lower=True)
        hashes = words.hashes()
        order = np.argsort(hashes, kind="stable")
        edges = bucket_edges(hashes[order], buckets)
        counts = np.zeros(len(hashes), dtype=np.int64)
        for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("a").to_pylist()):
            n = int(edges[b + 1] - edges[b])
            counts[order[edges[b] : edges[b + 1]]] = np.frombuffer(blob, dtype=np.uint32 if len(blob) == 4 * n else np.uint64)
        units = _Units(model.frequent).of(hashes, endings(words))
        flow = _flow(words, units)
        is_end = flow == END_UNIT
        seen = np.full(len(flow), n_docs, dtype=np.int64)
        seen[~is_end] = counts[words.codes]
        kind = model.classes[flow]
        before = np.r_[model.classes[END_UNIT], kind[:-1]]
        each = model.transition[before, kind] + np.log10((seen + ADD) / (model.tokens[kind] + model.room[kind]))
        base = np.log10((seen + ADD) / base_room)
        at = np.cumsum(words.counts + 1) - (words.counts + 1)
        sums = [np.add.reduceat(x, at) for x in ((seen > 0).astype(np.int64), base, each)]
        columns = [texts.column("id"), pc.invert(texts.column("trains")), pa.array(words.counts + 1), *map(pa.array, sums)]
        return pa.Table.from_arrays(columns, schema=out)

    answers = counted.filter("kind = 0").select("chunk", "bucket", "a")
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
