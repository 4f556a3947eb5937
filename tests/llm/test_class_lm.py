import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import class_lm as lm


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(n=160, seed=2):
    rng = random.Random(seed)
    tongues = [[f"{stem}{end}" for stem in "bcdfgkl" for end in ends] for ends in (("ing", "ed", "er"), ("eau", "aux", "ou"), ("ung", "sch", "ei"))]
    rows = [(1000, None), (1001, ""), (1002, "One"), (None, "no id")]
    for i in range(n):
        tongue = rng.choice(tongues)
        words = [rng.choice(tongue) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(5, 60))]
        words += [f"rare{rng.randrange(10**6)}"] * (i % 3 == 0)
        rows.append((i, " ".join(w.capitalize() if rng.random() < 0.1 else w for w in words)))
    return rows + rows[10:13]


def test_counts_and_base_score_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 2000)
    rows = corpus()
    frame = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, kind int")
    out = [r.asDict() for r in lm.score_documents(frame).collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*lowered(t), None])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in rows:
        tokens = [*lowered(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        want[d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)] += 1
    got = Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == want
    known = [r for r in out if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in known) > sum(r["base_score"] for r in known)


def test_model_score_agrees_with_brute_force(spark, monkeypatch):
    """Classes are taken as they were found; all else of the score is counted anew, word by word."""
    kept = {}
    cluster = lm.cluster
    monkeypatch.setattr(lm, "cluster", lambda docs, frequent, ends, buckets: kept.setdefault("out", ((frequent, ends), cluster(docs, frequent, ends, buckets)))[1])
    rows = [*corpus(60, 5), (2000, "bing " * 3000 + "end")]
    out = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    (frequent, _), (classes, _) = kept["out"]

    def class_of(word):
        words = lm.Words([word.encode()])
        return int(classes[lm._Units(frequent).of(words.hashes(), lm.endings(words))[0]])

    end = int(classes[lm.END_UNIT])
    counts, moves, members = Counter(), Counter(), {}
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0:
            continue
        before = end
        for w in [*lowered(t), None]:
            kind = end if w is None else class_of(w)
            counts[w] += 1
            moves[before, kind] += 1
            members.setdefault(kind, set()).add(w)
            before = kind
    into, out_of = Counter(), Counter()
    for (a, b), n in moves.items():
        into[b] += n
        out_of[a] += n
    total = sum(into.values())
    want = Counter()
    for d, t in rows:
        score, before = 0.0, end
        for w in [*lowered(t), None]:
            kind = end if w is None else class_of(w)
            unigram = (into[kind] + lm.ADD) / (total + lm.ADD * lm.CLASSES)
            score += math.log10((moves[before, kind] + lm.BACKOFF * unigram) / (out_of[before] + lm.BACKOFF))
            score += math.log10((counts[w] + lm.ADD) / (into[kind] + lm.ADD * (len(members.get(kind, ())) + 1)))
            before = kind
        want[d, round(score, 5)] += 1
    assert Counter((r["id"], round(r["score"], 5)) for r in out) == want


def test_endings_are_letters():
    words = lm.Words(["école, chaussée fée rosé é".encode()])
    ends = dict(zip([w.decode() for w in words.distinct], lm.endings(words).tolist()))
    assert ends["chaussée"] == ends["fée"] != ends["rosé"] and ends["rosé"] != ends["é"]


def test_probabilities_sum_to_one(spark):
    """With what any word may get of its class, each class's emissions and each row's transitions sum to 1."""
    rng = np.random.default_rng(1)
    bigrams = rng.integers(0, 5, (lm.UNITS, lm.UNITS))
    distinct = rng.integers(1, 4, lm.UNITS)
    model = lm.Model(np.arange(lm.FREQUENT, dtype=np.uint64), bigrams, distinct)
    assert np.allclose((10**model.transition).sum(1), 1)
    member = np.array([distinct[model.classes == c].sum() for c in range(lm.CLASSES)])
    assert np.allclose((model.tokens + lm.ADD * member + lm.ADD) / (model.tokens + model.room), 1)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(4)
    planted = np.arange(40) % 2
    bigrams = np.zeros((lm.UNITS, lm.UNITS), dtype=np.int64)
    bigrams[:40, :40] = rng.poisson(np.where(planted[:, None] == planted[None, :], 30, 1))
    classes = lm.exchange_classes(bigrams, classes=3)
    assert {len(set(classes[:40][planted == p])) for p in (0, 1)} == {1}
    assert classes[0] != classes[1]


def test_words_beyond_the_frequent_ones_are_clustered_by_their_contexts(spark, monkeypatch):
    monkeypatch.setattr(lm, "SETTLED", 0.0)
    rng = random.Random(3)
    kinds = [[f"{k}{i}es" for i in range(500)] for k in "ab"]  # one ending, 1,000 words of like frequency
    rows = []
    for n in range(600):
        rows.append((n, " ".join(f"x{rng.randrange(9)} {rng.choice(kinds[0])} y{rng.randrange(9)} {rng.choice(kinds[1])}" for _ in range(40))))
    frame = spark.createDataFrame(rows, "id long, text string")
    named = [w.encode() for kind in kinds for w in kind] + [f"{c}{i}".encode() for c in "xy" for i in range(9)]
    hashes = lm.Words([b" ".join(named)]).hashes()
    ends = lm.endings(lm.Words([b" ".join(named)])).astype(np.int64)
    classes, grid = lm.cluster(frame, hashes, ends, 4)
    of = classes[lm._Units(hashes).of(hashes, ends)]
    assert not set(of[:500]) & set(of[500:1000])
    assert grid.sum() == 600 * 161
    pairs = lm.checkpointed(lm.pair_table(frame, hashes, 4))
    assert (lm.class_bigrams(pairs, classes, lm.CLASSES) == grid).all()
    assert len(lm.proposals(pairs, classes, grid)[0]) == 0  # no word gains by a move


def test_move_gains_agree_with_the_likelihood_of_each_move():
    rng = np.random.default_rng(5)
    counts, cls = rng.integers(0, 4, (12, 12)), np.arange(12) % 4
    table = lambda c: np.array([[counts[np.ix_(c == a, c == b)].sum() for b in range(4)] for a in range(4)])
    for u in range(12):
        own, a = np.array([float(counts[u, u])]), cls[u : u + 1]
        right, left = (np.bincount(cls, weights=x, minlength=4)[None] for x in (counts[u], counts[:, u]))
        right[0, a] -= own
        left[0, a] -= own
        gains = lm.move_gains(table(cls), right, left, own, a)[0]
        for b in range(4):
            moved = np.where(np.arange(12) == u, b, cls)
            assert np.isclose(gains[b] - gains[a[0]], lm.likelihood(table(moved)) - lm.likelihood(table(cls)))


def test_empty_table(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_thousands_of_equal_rows_are_scored_alike(spark):
    rows = [(5, "one two three one two")] * 3000 + [(i, "one two four") for i in range(6, 20)]
    out = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("id = 5").groupBy("n_tokens", "n_known", "score", "base_score").count().collect()
    assert [(r["n_tokens"], r["n_known"], r["count"]) for r in out] == [(6, 6, 3000)]
