import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np

from tessera.llm import toxic_spans as ts


def enumerated(log_odds, moves):
    """Chances of tag 1 at each token, and the log of the partition sum, over all tags."""
    total, ones = 0.0, np.zeros(len(log_odds))
    for tags in product((0, 1), repeat=len(log_odds)):
        before, score = 0, 0.0
        for e, t in zip(log_odds, tags):
            score += e * t + moves[before, t]
            before = t
        total += np.exp(score)
        ones += np.exp(score) * np.array(tags)
    return ones / total, np.log(total)


def test_marginals_agree_with_enumeration(monkeypatch):
    rng = np.random.default_rng(7)
    moves = np.array([[0.0, -1.3], [0.0, 0.8]])
    for run in (3, 4, 256):  # texts begin and end within runs, and go over several
        monkeypatch.setattr(ts, "RUN", run)
        texts = [rng.normal(scale=3, size=n) for n in (1, 9, 2, 7, 10, 1)]
        first = np.concatenate([np.arange(len(t)) == 0 for t in texts])
        found = ts.forward_backward(np.concatenate(texts), first, moves)
        want = [enumerated(t, moves) for t in texts]
        assert np.allclose(found.toxic, np.concatenate([ones for ones, _ in want]))
        at = np.cumsum([0, *[len(t) for t in texts]])
        assert np.allclose([found.log_z[a:b].sum() for a, b in zip(at, at[1:])], [z for _, z in want])
        assert np.allclose(found.moves.sum(0), found.toxic)


def test_long_quiet_texts_keep_small_chances():
    found = ts.forward_backward(np.full(50_000, -20.0), np.arange(50_000) == 0, np.array([[0.0, 0.0], [0.0, 2.0]]))
    assert np.isclose(found.log_z.sum(), 50_000 * np.exp(-20.0), rtol=1e-4)


def test_gradient_agrees_with_differences(monkeypatch, spark):
    rng = random.Random(4)
    words = "Alpha beta, gamma. delta Eps zeta! eta".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    groups = {ts._text_key(t): i for i, t in enumerate(texts)}
    names = ts.frequent_features(spark.createDataFrame([(t,) for t in texts], "text string"), groups, 2)
    counts = Counter(f for t in set(texts) for f in ts.document_features(t))
    assert names == sorted(f for f, n in counts.items() if n >= 2)
    field = ts.Field({f: i for i, f in enumerate(names)})
    tokens = ts.Tokens([t.encode() for t in texts], field.look_up)
    toxic, shares = np.arange(12) % 2, np.linspace(0.5, 1, 12)
    seen = []
    monkeypatch.setattr(ts, "climbed", lambda loss, w, steps: seen.append((loss, w)) or w)
    field.fit(tokens, toxic, shares)
    loss, w = seen[0]
    w = w + np.random.default_rng(2).normal(scale=0.5, size=len(w))
    w[-2] = 0.0
    _, g = loss(w)
    for i in [*range(0, len(w) - 4, 17), len(w) - 4, len(w) - 3, len(w) - 1]:
        step = np.zeros(len(w))
        step[i] = 1e-5
        assert np.isclose(g[i], (loss(w + step)[0] - loss(w - step)[0]) / 2e-5, atol=1e-5)


def test_scores_agree_with_enumeration(spark):
    """Of the fitted field: each document's score and marginals, from its weights by name, over all tags."""
    rng = random.Random(11)
    plain = "the cat sat on a mat and saw dogs".split()
    rows = [(i, " ".join([*(rng.choice(plain) for _ in range(4)), *(["vile"] if i % 3 == 0 else []), rng.choice(plain)])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    field = ts.fit(docs, labels)
    n, w = field.n, dict(zip(sorted(field.features, key=field.features.get), field.weights))
    moves = np.array([[0.0, field.weights[-3]], [field.weights[-2], field.weights[-1]]])
    scored = {r["id"]: r for r in ts.score_documents(docs, labels).collect()}
    for i, text in rows[:20]:
        odds, words = [], text.split()
        for k, token in enumerate(words):
            e = field.weights[-4] + sum(w.get(f, 0) for f in ts.features_of(token))
            e += w.get(f"<{ts.form_of(words[k - 1])}", 0) if k else 0
            e += w.get(f">{ts.form_of(words[k + 1])}", 0) if k + 1 < len(words) else 0
            odds.append(e + field.weights[n + (ts.shape_of(words[k - 1]) if k else ts.START) * ts.SHAPES + ts.shape_of(token)])
        ones, log_z = enumerated(odds, moves)
        assert np.isclose(scored[i]["score"], 1 - np.exp(-log_z))
        spans = [(s["start"], s["end"]) for s in scored[i]["spans"]]
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        assert spans == [at[k] for k in np.flatnonzero(ones >= 0.5)]
    assert all((scored[i]["score"] >= 0.7) == (i % 3 == 0) and scored[i]["score"] > 0 for i, _ in rows)


def test_spans_and_scores(spark):
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in "bdfgklm" for b in ("an", "er", "ish", "ol")]
    bad = ["Zorgle", "quibbed"]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(10, 40))]
        toxic = i % 4 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    copies = [(i, "a tale told again and again by mundane clerks", "x") for i in range(900, 960)]
    docs += copies + [(2000, None, "x"), (2001, "", "x"), (2002, "ähm Zorgle quibbed ok", "x"), (None, "Zorgle", "x"), (2002, "bad", "x")]
    labels += [(i, 1) for i, *_ in copies] + [(None, 1), (5, None), (9999, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = ts.score_documents(frame, marks).collect()
    assert len(out) == len(docs)
    by_id = {r["id"]: r for r in out if r["id"] is not None and r["id"] != 2002}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by_id[i]["held_out"] == (i in held) for i in range(900))
    assert all(by_id[i]["predicted"] == (i % 4 == 0) for i in range(900))
    assert by_id[2000]["score"] == by_id[2001]["score"] == 0.0
    assert all(not by_id[i]["predicted"] for i, *_ in copies)  # copies of one text aren't evidence against its words
    spans = next(r["spans"] for r in out if r["id"] == 2002 and r["spans"])
    assert [(s["start"], s["end"]) for s in spans] == [(4, 18)]


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in ts.score_documents(docs, none).collect()] == [0.0]
    assert ts.score_documents(docs.limit(0), none).count() == 0


def test_a_fixed_phrase_is_evidence_and_copies_are_not(spark):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "er", "ish", "ol", "um")]
    docs = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 50))]
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = "i will zorgle you".split()
        else:
            words[:0] = "i will see you".split()
        docs.append((i, " ".join(words)))
    tale = [rng.choice(plain) for _ in range(60)] + "a mundane tale told by weary clerks".split()
    docs += [(i, " ".join([*tale, rng.choice(plain)])) for i in range(900, 1000)]
    labels = [(i, int(i >= 900 or i % 4 == 0)) for i, _ in docs]
    out = ts.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r["predicted"] == (r["id"] % 4 == 0) for r in out if r["id"] < 900)
    assert not any(r["predicted"] for r in out if r["id"] >= 900)  # near copies of one text
