import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import phrases as p
from tessera.llm import routing


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, most_words=3, least=10, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {w: c for w, c in counts.items() if len(w) > 1 and c >= least}
        inside = lambda s, w: any(w[i : i + len(s)] == s for i in range(len(w) - len(s) + 1))
        left = []
        for w, a in found.items():
            if any(len(v) > len(w) and inside(w, v) and 100 * b >= 50 * a for v, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w)))
            left.append((-score, -a, " ".join(w).encode(), a, counts[w[:k]], counts[w[k:]]))
        out += [(lang, i, x[2].decode(), *x[3:], n[lang], -x[0]) for i, x in enumerate(sorted(left)[:most], 1)]
    return sorted(out)


def corpus(seed, size=700):
    rng = random.Random(seed)
    words = ["the", "of", "River", "é", "stone", "New", "York", "a\x00b", "city"] + [f"w{i}" for i in range(40)]
    fixed = ["new york city", "of the river", "w1 w2 w3 w4", "é é é é"] + [" ".join(rng.choices(words, k=rng.choice([2, 2, 3, 4]))) for _ in range(50)]
    rows = []
    for i in range(size):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randrange(30))]
        rows.append((rng.randrange(200), "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"]) for x in parts), rng.choice(["en", "en", "fr", None, "und"])))
    return rows + rows[:20] + [(1, None, "en"), (2, "", "xx"), (3, " .,\t", None), (None, "new york city", "en")]


@pytest.mark.parametrize("seed", range(4))
def test_automaton_has_the_classes_of_end_places(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(4 + 3 * seed) for _ in range(rng.randrange(12))] for _ in range(20)]
    ends = defaultdict(set)
    for t, text in enumerate(texts):
        for i in range(len(text)):
            for k in range(1, 5):
                if k <= i + 1:
                    ends[tuple(text[i + 1 - k : i + 1])].add((t, i))
    letters = sorted({c for text in texts for c in text})
    codes = np.array([letters.index(c) for text in texts for c in text])
    auto = p.Automaton(codes, np.array([i for text in texts for i in range(len(text))]), 4)
    named = {}
    for length in range(1, 5):
        own = np.arange(auto.levels[length - 1], auto.levels[length])
        for node, word in zip(own.tolist(), zip(*(w.tolist() for w in auto.words(own, length)))):
            named[tuple(letters[c] for c in word)] = node
    assert set(named) == set(ends) and auto.levels[-1] == len(named)
    for string, node in named.items():
        assert auto.count[node] == len(ends[string])
        if len(string) > 1:
            assert auto.link[node] == named[string[1:]] and auto.prefix[node] == named[string[:-1]]
        longest = max((s for s in ends if ends[s] == ends[string]), key=len)
        assert auto.state[node] == named[longest]


@pytest.mark.parametrize("direct, block", [(8192, 64), (4, 3)])
def test_agrees_with_brute_force(spark, monkeypatch, direct, block):
    """The second case sends hashes in two steps."""
    monkeypatch.setattr(p, "CHUNK_BYTES", 1500)
    monkeypatch.setattr(p, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(routing, "DIRECT", direct)
    monkeypatch.setattr(routing, "BLOCK", block)
    rows = corpus(5)
    frame = spark.createDataFrame([(i, t, g, 0, "x") for i, t, g in rows], "doc_id long, text string, lang string, a long, chunk string")
    want = brute(rows)
    assert len(want) > 60 and {r[0] for r in want} == {"en", "fr", "und"}
    assert sorted(tuple(r) for r in p.collocations(frame).collect()) == want
    if direct == 4:  # other bounds
        got = p.collocations(frame, most_words=4, least_count=4, most=30)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 4, 30)


def test_scores_beyond_64_bits_are_exact():
    a, left, right = [5, 10**12, 3_000_000, 10**13], [7, 10**12 + 1, 3_000_001, 10**13], [11, 3 * 10**12, 2**40, 10**13 + 7]
    got = p._exact_score(np.array(a), np.array(left), np.array(right)).tolist()
    assert got == [1000000 * x * x // (y * z) for x, y, z in zip(a, left, right)]


def test_one_key_in_all_rows_long_texts_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "same words here", "en")] * 3000 + [(2, "long text " * 200_000, "en")], "doc_id long, text string, lang string")
    got = {r["phrase"]: (r["a"], r["n"]) for r in p.collocations(frame).collect()}
    assert got == {"same words here": (3000, 409_000), "long text long": (199_999, 409_000), "text long text": (199_999, 409_000)}
    assert p.collocations(frame.limit(0)).count() == 0


def test_rows_of_a_chunk_do_not_grow_with_the_input():
    small, large, largest = (routing.routing_for(size, 8_000_000) for size in (10**9, 3 * 10**11, 10**14))
    assert small.parts == small.buckets == 125
    assert large.parts < 400 and large.buckets % large.parts == 0 and large.buckets >= 3 * 10**11 / 8_000_000
    assert largest.parts <= 1300 and largest.buckets / largest.parts <= 1300
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**64, 100_000, dtype=np.uint64))
    assert routing.sent_rows(0, hashes, [np.ones(len(hashes), dtype=np.int64)], largest.parts).num_rows == largest.parts


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1000):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        if n:
            assert (routing.unpacked_sorted(routing.packed_sorted(hashes)) == hashes).all()
        for numbers in (rng.integers(0, 300, n), rng.integers(-5, 5, n), np.zeros(n, dtype=np.int64)):
            assert (routing.unpacked_integers(routing.packed_integers(numbers), n).view(np.int64) == numbers).all()
