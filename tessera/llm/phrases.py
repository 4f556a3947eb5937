"""Phrases that words form more often than chance: suffix automata count, one global sum decides.

Each chunk of documents builds the generalised suffix automaton of its pieces of text, cut at ``most_words``
words: its strings, for each the count of places where it ends, its suffix link (the string without its
first word), the string without its last word, and its state (the strings that end at the same places).
Counts of shards are summed by hash, and every chunk learns the global count of each of its strings that
reaches ``least_count``. As a chunk that has a phrase has all parts of it, the links then lead from a
phrase to the counts of its parts without a join:

1. chunk: automaton; a hash and a count for each of its strings
2. bucket: counts summed by hash (see ``routing``); the chunk with the least number speaks for a string
3. chunk: the chunk that speaks for a candidate scores its cuts by links, and marks, from each longer
   candidate down the links of suffixes and beginnings, what that one subsumes
4. candidates without a mark are ranked for each language, in parts first

No row is made for a string that isn't a candidate, and nothing is pruned before its count is known.

A phrase of ``a`` occurrences cut into parts with ``l`` and ``r`` occurrences scores ``10**6 a a / (l r)``,
rounded down; of its cuts the one with the lowest score counts, among equals the first. A candidate is
subsumed by a longer one that holds it if that one has ``SUBSUMED_PERCENT`` of its occurrences or more.

Strings are told apart by 64-bit hashes of their language and words: at n different strings, chance makes
about n * n / 2**65 pairs of them alike. Scores are exact; where they pass 64 bits, by Python's integers.

Edge cases: null and empty texts have no words; a null language is ``und``, and one with documents with
that name; repeated rows and rows with equal ids count each on its own, but lie in one chunk; very long
texts are chunks of their own, in memory whole; an empty table gives an empty result; other columns aren't carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_of_each, checkpointed, chunk_count, chunk_of, text_bytes
from .routing import SENT, Numbers, read_answers, routed, routing_for, sent_rows
from .tokens import stirred

#: Words of a phrase at most, and its occurrences at least.
MOST_WORDS = 3
LEAST_COUNT = 10
SUBSUMED_PERCENT = 50
#: Phrases for each language.
MOST_PHRASES = 2000
#: UTF-8 bytes of the texts in a chunk, and of all texts for each bucket, about.
CHUNK_BYTES = 4_000_000
BUCKET_BYTES = 8_000_000

_STOP = b"."
#: Lower case, one stop for all characters that part pieces, a space for a tab.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


class Automaton:
    """The suffix automaton of several pieces, cut at ``depth`` words; its strings in order of their lengths.

    ``codes`` are the words (from 0 on, all occur), ``place`` each word's place in its piece. ``count`` is the
    number of places where a string ends: a place counts for the longest string that ends there, and counts
    go up the suffix links. Strings with the count of a longer one that they end are of its ``state``, which
    is numbered by its longest string.
    """

    def __init__(self, codes: np.ndarray, place: np.ndarray, depth: int) -> None:
        n_words = int(codes.max()) + 1 if len(codes) else 0
        self.levels = [0, n_words]  # where the strings of each length begin
        links, prefixes, lasts = [np.full(n_words, -1)], [np.full(n_words, -1)], [np.arange(n_words)]
        here, longest = codes, codes.copy()
        for d in range(2, depth + 1):
            ends = np.flatnonzero(place >= d - 1)
            keys, first, which = np.unique(here[ends] * n_words + codes[ends - d + 1], return_index=True, return_inverse=True)
            links.append(here[ends[first]])
            prefixes.append(here[ends[first] - 1])
            lasts.append(codes[ends[first]])
            here = np.full(len(codes), -1)
            here[ends] = self.levels[-1] + which
            longest[ends] = here[ends]
            self.levels.append(self.levels[-1] + len(keys))
        self.link, self.prefix, self.last = (np.concatenate(x).astype(np.int64) for x in (links, prefixes, lasts))
        self.count = np.bincount(longest, minlength=self.levels[-1]).astype(np.int64)
        self.state = np.arange(self.levels[-1])
        for own in map(self.level, range(depth, 1, -1)):
            np.add.at(self.count, self.link[own], self.count[own])
        for own in map(self.level, range(depth, 1, -1)):
            same = self.count[own] == self.count[self.link[own]]
            self.state[self.link[own][same]] = self.state[own][same]

    def level(self, length: int) -> slice:
        return slice(self.levels[length - 1], self.levels[length])

    def words(self, strings: np.ndarray, length: int) -> list[np.ndarray]:
        """The words of strings of one length, first words first."""
        out = []
        for _ in range(length):
            out.append(self.last[strings])
            strings = self.prefix[strings]
        return out[::-1]


class _Chunk:
    """The automaton of a chunk's texts, words of each language apart."""

    def __init__(self, table: pa.Table, most_words: int) -> None:
        words: list[bytes] = []
        sizes = []
        for text in table.column("text").to_pylist():
            own = (text or b"").translate(_PLAIN).replace(_STOP, b" . ").split()
            own.append(_STOP)
            words += own
            sizes.append(len(own))
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        self.distinct = coded.dictionary
        langs = table.column("lang").combine_chunks().dictionary_encode()
        self.langs = langs.dictionary
        stop = pc.index(coded.dictionary, pa.scalar(_STOP, pa.large_binary())).as_py()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kept = np.flatnonzero(codes != stop)
        since = np.maximum.accumulate(np.where(codes == stop, np.arange(len(codes)), -1)) if len(codes) else codes
        place = (np.arange(len(codes)) - since)[kept] - 1
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)[kept]
        both, codes = np.unique(lang * max(1, len(self.distinct)) + codes[kept], return_inverse=True)
        self.word, self.lang = both % max(1, len(self.distinct)), both // max(1, len(self.distinct))  # of each code
        self.n_words = np.bincount(lang, minlength=len(self.langs))
        self.automaton = Automaton(codes, place, most_words)
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.distinct.to_pylist()), dtype=np.uint64, count=len(self.distinct))
        seeds = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in self.langs.to_pylist()), dtype=np.uint64, count=len(self.langs))
        a = self.automaton
        hashes = np.empty(a.levels[-1], dtype=np.uint64)
        hashes[a.level(1)] = stirred(hashed[self.word] ^ seeds[self.lang])
        for length in range(2, most_words + 1):
            own = a.level(length)
            hashes[own] = stirred(hashes[a.prefix[own]] * np.uint64(0x9E3779B97F4A7C15) + hashed[self.word[a.last[own]]])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def texts(self, strings: np.ndarray, length: int) -> pa.Array:
        words = [self.distinct.take(pa.array(self.word[w])) for w in self.automaton.words(strings, length)]
        return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())


def _exact_score(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``10**6 a a / (l r)`` rounded down, of counts of any size."""
    small = (a < 3_000_000) & (left < 3_000_000_000) & (right < 3_000_000_000)
    out = 1_000_000 * np.where(small, a * a, 0) // np.where(small, left * right, 1)
    for i in np.flatnonzero(~small).tolist():
        out[i] = 1_000_000 * int(a[i]) ** 2 // (int(left[i]) * int(right[i]))
    return out


_FOUND = pa.schema([
    ("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64()),
    ("subsumed", pa.bool_()),
])
FOUND = "lang string, phrase string, a long, l long, r long, score long, subsumed boolean"


def _sum(numbers: Numbers, edge: np.ndarray) -> Numbers:
    """Counts summed, the least chunk."""
    count, chunk = numbers
    return [np.add.reduceat(count, edge), np.minimum.reduceat(chunk, edge)] if len(count) else numbers


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``FOUND``: each candidate once with ``subsumed`` false, and a row with it true for each longer candidate that subsumes one.

    Rows with a null phrase have in ``a`` the number of a chunk's words in that language.
    """
    total = text_bytes(docs, text_col)
    chunks, routing = max(16, chunk_count(total, CHUNK_BYTES)), routing_for(total, BUCKET_BYTES)
    slim = docs.select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    by_chunk = slim.select(chunk_of(chunks, "id", "text").alias("chunk"), "lang", "text").groupBy("chunk")

    def send(table: pa.Table) -> pa.Table:
        own, number = _Chunk(table, most_words), table.column("chunk")[0].as_py()
        return sent_rows(number, own.hashes, [own.automaton.count[own.order], np.full(len(own.order), number)], routing.parts)

    def answer(whole: Numbers, own: Numbers) -> np.ndarray:
        """Twice the count of all chunks, and one more if this chunk speaks; 0 below ``least_count``."""
        return np.where(whole[0] >= least_count, 2 * whole[0] + (whole[1] == own[1]), 0)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Chunk(table, most_words)
        auto, told = own.automaton, np.zeros(len(own.order), dtype=np.int64)
        told[own.order] = read_answers(answers, own.hashes, routing.parts)
        count, speaks = told >> 1, told & 1 > 0
        subsumed = np.zeros(len(count), dtype=bool)
        out = [pa.table([own.langs.cast(pa.string()), pa.nulls(len(own.langs), pa.string()), pa.array(own.n_words), *[pa.nulls(len(own.langs), pa.int64())] * 3, pa.nulls(len(own.langs), pa.bool_())], schema=_FOUND)]
        for length in range(most_words, 1, -1):
            strings = np.flatnonzero(speaks[auto.level(length)]) + auto.levels[length - 1]
            _mark(auto, strings, length, count, subsumed)
            a = count[strings]
            best, left, right = np.full(len(a), np.iinfo(np.int64).max), np.zeros_like(a), np.zeros_like(a)
            for k in range(1, length):
                head, tail = strings, strings
                for _ in range(length - k):
                    head = auto.prefix[head]
                for _ in range(k):
                    tail = auto.link[tail]
                value = _exact_score(a, count[head], count[tail])
                lower = value < best
                best, left, right = np.where(lower, value, best), np.where(lower, count[head], left), np.where(lower, count[tail], right)
            gone = np.flatnonzero(subsumed[auto.level(length)]) + auto.levels[length - 1]
            nothing = pa.nulls(len(gone), pa.int64())
            for which, numbers, flag in ((strings, [pa.array(v) for v in (a, left, right, best)], False), (gone, [nothing] * 4, True)):
                langs = own.langs.take(pa.array(own.lang[auto.last[which]]))
                out.append(pa.table([langs.cast(pa.string()), own.texts(which, length), *numbers, pa.array(np.full(len(which), flag))], schema=_FOUND))
        return pa.concat_tables(out)

    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        return score(table, answers) if table.num_rows else _FOUND.empty_table()

    answers = routed(by_chunk.applyInArrow(send, SENT), routing, _sum, answer)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(scored, FOUND)


def _mark(auto: Automaton, strings: np.ndarray, length: int, count: np.ndarray, subsumed: np.ndarray) -> None:
    """Set ``subsumed`` of every shorter candidate in one of ``strings`` that has enough of its occurrences."""
    inner = [strings]
    for _ in range(length - 2):  # strings of length - 1, and so on down to two words
        inner = [auto.link[inner[0]], *(auto.prefix[x] for x in inner)]
        for x in inner:
            subsumed[x[100 * count[strings] >= SUBSUMED_PERCENT * count[x]]] = True


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least_count: int = LEAST_COUNT, most: int = MOST_PHRASES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: for each language its first ``most`` phrases, ``n`` of all its words."""
    found = checkpointed(candidates(docs, id_col, text_col, lang_col, most_words, least_count))
    words = found.filter("phrase IS NULL").groupBy("lang").agg(F.sum("a").alias("n"))
    numbers = [F.max(c).alias(c) for c in ("a", "l", "r", "score")]
    whole = found.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(*numbers, F.max("subsumed").alias("subsumed"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = best_of_each(whole.filter(~F.col("subsumed")).drop("subsumed"), "lang", order, most)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
