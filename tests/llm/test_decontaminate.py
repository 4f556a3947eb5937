import random

import numpy as np

from tessera.llm import decontaminate as dc


def brute_edits(item: bytes, text: bytes) -> int:
    """Fewest edits that turn ``item`` into some part of ``text``."""
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain(text: bytes) -> bytes:
    raw = np.frombuffer(text, dtype=np.uint8)
    return dc.normalise(raw, np.zeros(1, dtype=np.int64))[0].tobytes()


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "tion", "ander", "inge", "thesh", "er", "onle"]) for _ in range(n))


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.4:
            chars[i] = rng.choice("abcxyz")
        elif kind < 0.7:
            del chars[i]
        else:
            chars.insert(i, rng.choice("abcxyz"))
    return "".join(chars)


def test_banded_edits_agree_with_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        item, text = sentence(rng, 6).encode(), sentence(rng, 12).encode()
        if rng.random() < 0.5:
            text = (sentence(rng, 3) + edited(rng, item.decode(), rng.randrange(6)) + sentence(rng, 3)).encode()
        want = brute_edits(item, text)
        a, b = (np.frombuffer(x, dtype=np.uint8) for x in (item, text))
        got = dc.banded_edits(a, b, -len(a), len(a) + len(b) + 1, 8)
        assert (got is None) == (want > 8)
        if got:
            assert got[0] == want
            assert brute_edits(item, text[got[1] : got[2]]) == want


def band_edits(item: bytes, text: bytes, low: int, diagonals: int) -> int:
    """The same, of alignments that stay on the diagonals from ``low`` on."""
    far = 10**6
    row = {j: 0 if 0 <= j <= len(text) else far for j in range(low, low + diagonals)}
    for i, c in enumerate(item, 1):
        new = {}
        for j in range(low + i, low + i + diagonals):
            ways = [row.get(j, far) + 1, new.get(j - 1, far) + 1]
            if 1 <= j <= len(text):
                ways.append(row.get(j - 1, far) + (text[j - 1] != c))
            new[j] = min(ways) if 0 <= j <= len(text) else far
        row = new
    return min(row.values())


def test_only_cells_of_the_band_are_made():
    rng = random.Random(8)
    for _ in range(80):
        item = sentence(rng, 6).encode()
        text = (sentence(rng, 3) + edited(rng, item.decode(), rng.randrange(6)) + sentence(rng, 3)).encode()
        low, diagonals = rng.randrange(-9, 25), rng.randrange(1, 14)
        want = band_edits(item, text, low, diagonals)
        got = dc.banded_edits(*(np.frombuffer(x, dtype=np.uint8) for x in (item, text)), low, diagonals, 8)
        assert (got is None) == (want > 8)
        if got:
            assert got.edits == want and got.cells == len(item) * diagonals
            assert low <= got.start < low + diagonals and brute_edits(item, text[got.start : got.end]) <= want


def test_overlapping_places_are_all_given():
    item = b"la grande maison bleue du port et la grande maison bleue"
    index = dc.ItemIndex([(7, item)])
    text = b"x " + item + b" du port et la grande maison bleue fin"
    places = [(m.start, m.end) for _, m in index.matches(np.frombuffer(text, dtype=np.uint8), np.zeros(1, dtype=np.int64))]
    second = text.find(item, 3)
    assert places == [(2, 2 + len(item)), (second, second + len(item))] and second < 2 + len(item)


def test_null_ids_and_long_texts(spark):
    item = "la grande maison bleue du port de la ville"
    docs = [(None, f"x {item} y"), (1, "mot " * 150_000 + item + " mot" * 1000), (2, "mot " * 1000)]
    bench = spark.createDataFrame([(None, item)], "item_id long, text string")
    found = dc.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted(((r["id"], r["item_id"], r["start"]) for r in found), key=str) == [(1, None, 600_000), (None, None, 2)]


def test_matches_are_those_within_the_budget(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, 40)) for i in range(6)] + [(6, "short"), (7, None), (8, "")]
    docs = [(0, None, "x"), (1, "", "x"), (2, "the", "x")]
    for n in range(3, 40):
        text = sentence(rng, rng.randrange(60))
        if n % 2:
            i = rng.randrange(6)
            text += "\n" + edited(rng, items[i][1].upper(), rng.randrange(30)) + "; " + sentence(rng, 20)
        docs.append((n, text, "x"))
    docs.append(docs[5])
    frame = spark.createDataFrame(docs, "doc_id long, text string, start string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for doc_id, text, _ in docs:
        for item_id, item in items[:6]:
            m = len(plain(item.encode()))
            budget = min(int(m * dc.ERROR_RATE), (m - dc.Q) // dc.Q)
            if text and brute_edits(plain(item.encode()), plain(text.encode())) <= budget:
                want.add((doc_id, item_id))
    got = {(r["id"], r["item_id"]) for r in dc.find_matches(frame, bench).collect()}
    assert len(want) > 5 and got == want
    assert {(r["id"], r["item_id"]) for r in dc.find_matches(frame, bench, block_bytes=300).collect()} == want
    left = dc.clean_documents(frame, bench, block_bytes=300)
    assert left.columns == frame.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, *_ in docs if d not in {w for w, _ in want})


def test_spans_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Été!  La   Grande, maison bleue du   port — ici.")], "doc_id long, text string")
    bench = spark.createDataFrame([(4, "la grande maison bleue, du port")], "item_id long, text string")
    row = dc.find_matches(docs, bench).first()
    raw = docs.first()["text"].encode()
    assert raw[row["start"] : row["end"]].decode() == "La   Grande, maison bleue du   port"
    assert dc.find_matches(docs.limit(0), bench).count() == 0
    assert dc.find_matches(docs, bench.limit(0)).count() == 0
    assert dc.clean_documents(docs, bench.limit(0)).count() == 1
