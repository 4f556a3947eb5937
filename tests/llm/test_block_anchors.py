import random
from collections import Counter

import pytest

from tessera.llm import block_anchors as ba
from tessera.llm import routing


def brute(rows):
    """Kept words of each row, in order of the rows."""
    words = [(text or "").split() for _, text in rows]
    first = {}
    for (doc_id, _), own in zip(rows, words):
        for i in range(len(own) - 12):
            if doc_id is not None:
                run = tuple(own[i : i + 13])
                first[run] = min(first.get(run, doc_id), doc_id)
    out = []
    for (doc_id, _), own in zip(rows, words):
        gone = set()
        for i in range(len(own) - 12):
            if doc_id is not None and first[tuple(own[i : i + 13])] < doc_id:
                gone.update(range(i, i + 13))
        out.append((doc_id, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return out


@pytest.mark.parametrize("direct, block", [(8192, 64), (4, 3)])
def test_repeats_agree_with_brute_force(spark, monkeypatch, direct, block):
    """The second case sends hashes in two steps."""
    monkeypatch.setattr(routing, "DIRECT", direct)
    monkeypatch.setattr(routing, "BLOCK", block)
    monkeypatch.setattr(ba, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(ba, "BUCKET_BYTES", 4000)
    rng = random.Random(11)
    passages = [[rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(8, 60))] for _ in range(12)]
    rows = [(900, None), (901, ""), (902, " \t\n"), (None, " ".join(passages[0])), (None, " ".join(passages[0]))]
    for n in range(120):
        own = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(50))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(own) + 1), rng.choice(passages)
            cut = rng.randrange(len(p))
            own[at:at] = p[cut:] if rng.random() < 0.5 else p[: cut + 1]
        rows.append((rng.randrange(-50, 120), rng.choice([" ", "\n", "  "]).join(own)))
    rows += rows[20:24] + [(5, "é " * 40), (6, "é " * 40), (500, " ".join(["x"] * 30)), (500, " ".join(["x"] * 30))]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, chunk int")
    got = [tuple(r) for r in ba.remove_repeats(frame).collect()]
    want = brute(rows)
    assert sum(r[2] for r in want) > 500
    assert Counter(got) == Counter(want)


def test_empty_table(spark):
    assert ba.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_and_thousands_of_equal_rows(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    long = f"{'word ' * 300_000}{passage}"
    frame = spark.createDataFrame([(1, passage)] * 3000 + [(2, long), (3, long)], "doc_id long, text string")
    got = Counter((r["id"], r["n_words"], r["n_removed"]) for r in ba.remove_repeats(frame).collect())
    assert got == {(1, 40, 0): 3000, (2, 300_040, 40): 1, (3, 300_040, 300_040): 1}
