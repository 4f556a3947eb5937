import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tessera.llm import maxscore as m

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t for t in TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked, out = defaultdict(set), []
    for item, text in items:
        asked[item] |= set(terms(text))
    for item, own in asked.items():
        rows = []
        for i, c in counts:
            n = sum(c.values())
            score = 0
            for t in own & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms)))
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(3000)]
    make = lambda n: "".join(rng.choice([w, w.upper(), w + "é"]) + rng.choice([" ", ", ", "\n", "-"]) for w in rng.choices(words, k=n))
    docs = [(rng.randrange(400), make(rng.randrange(60))) for _ in range(500)]
    docs += [(None, docs[3][1]), (None, docs[3][1]), (7, None), (8, ""), (9, " .,\x00\x7f"), (10, "É é 漢字 a1b2")] + docs[:40]  # repeated rows and ties
    items = [(i, make(rng.randrange(1, 25))) for i in range(30)] + [(40, None), (41, "zzz"), (42, "!!"), (1, "w1 w2 é"), (None, "w3"), (43, "漢字 É")]
    return docs, items


@pytest.mark.parametrize("shard_bytes, most_terms, k", [(8_000_000, 200_000, 50), (600, 40, 5), (1, 1, 1)])
def test_agrees_with_brute_force(spark, monkeypatch, shard_bytes, most_terms, k):
    monkeypatch.setattr(m, "SHARD_BYTES", shard_bytes)
    docs, items = corpus(k)
    items = items[::9] if most_terms == 1 else items  # a pass for each
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, item string")
    index = m.build_index(frame)
    got = [tuple(r) for r in m.search(index, spark.createDataFrame(items, "item_id long, text string"), k, most_terms=most_terms).collect()]
    assert sorted(got, key=str) == brute(docs, items, k)


def test_index_round_trip():
    texts = ["b a b", None, "", "C c é", "a"]
    shard = m.read_shard(m.index_row(pa.array([5, 6, 7, None, 5]), pa.array(texts)))
    lists = {t.decode(): list(zip(shard.docs[shard.starts[i] : shard.starts[i + 1]].tolist(), shard.tfs[shard.starts[i] : shard.starts[i + 1]].tolist())) for t, i in shard.terms.items()}
    assert lists == {"a": [(0, 1), (2, 1)], "b": [(0, 2)], "c": [(1, 2)], "é": [(1, 1)]}
    assert shard.ids.to_pylist() == [5, None, 5] and shard.lengths.tolist() == [3, 3, 1]
    empty = m.read_shard(m.index_row(pa.array([1], pa.int64()), pa.array([None], pa.string())))
    assert empty.terms == {} and len(empty.ids) == 0


def test_non_essential_lists_are_probed_for_few_documents():
    """A frequent term of little weight brings no candidates once the bound is above it."""
    texts = ["the rare" if i % 100 == 0 else "the common thing" for i in range(2000)]
    shard = m.read_shard(m.index_row(pa.array(range(2000)), pa.array(texts)))
    held = m.postings_of(shard, [b"the", b"rare"], m.weights(2000, [2000, 20]), 2000, int(shard.lengths.sum()), 10)
    scores = pytest.importorskip("numpy").zeros(2000, dtype="int64")
    docs, _ = m.max_score(list(held.values()), 0, 10, scores)
    assert docs.tolist() == list(range(0, 2000, 100)) and not scores.any()


def test_arithmetic_beyond_64_bits():
    lengths = pytest.importorskip("numpy").array([10**9, 7])
    assert m._damping(lengths, 10**11, 10**14).tolist() == [50 + 50 * n * 10**11 // 10**14 for n in (10**9, 7)]


def test_long_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "river " * 400_000 + "stone"), (2, "stone")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "stone")], "item_id long, text string")
    assert [r["id"] for r in m.search_documents(docs, items).orderBy("rank").collect()] == [2, 1]
    assert m.search_documents(docs.limit(0), items).count() == 0
    assert m.search_documents(docs, items.limit(0)).count() == 0
