import random
from collections import Counter

from tessera.llm import snapshots


def test_collapse_agrees_with_brute_force(spark):
    rng = random.Random(4)
    logs = {}
    for c in range(40):
        turns = [("user" if k % 2 == 0 else "assistant", rng.choice(["hi", "more", "so?"])) for k in range(rng.randrange(1, 7))]
        logs[c] = turns
        for cut in range(1, len(turns)):
            if rng.random() < 0.4:
                logs[100 + 10 * c + cut] = turns[:cut]
    logs[7] = [("user", str(k)) for k in range(400)]  # longer than several blocks
    logs[8] = logs[7][:200]
    rows = [(c, 3 * k - 5, r, t, "x") for c, turns in logs.items() for k, (r, t) in enumerate(turns)]
    rows += [(900, None, None, None, "x"), (900, 1, "user", "a", "x"), (None, 0, "user", "only here", "x")]
    rows += [(901, 5, "user", t, "x") for t in ("b", "a", "long " * 50_000, "c")]  # ties, and a very long text
    rows += rng.sample(rows, 30)
    rng.shuffle(rows)
    logs[900] = [("", ""), ("user", "a")]
    logs[901] = [("user", t) for t in sorted(("b", "a", "long " * 50_000, "c"))]
    logs[None] = [("user", "only here")]
    whole = Counter(tuple(t) for t in logs.values())
    inside = {tuple(t[:k]) for t in logs.values() for k in range(1, len(t))}
    want = set()
    for turns in whole:
        if turns not in inside:
            owner = min((c for c, t in logs.items() if tuple(t) == turns), key=lambda c: (c is None, c))
            chat = [f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns]
            want |= {(owner, k // 64, -(-len(turns) // 64), len(turns), whole[turns], "".join(chat[k : k + 64])) for k in range(0, len(turns), 64)}
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")
    got = [(r["conv_id"], r["piece"], r["n_pieces"], r["n_turns"], r["n_logged"], r["rendered"]) for r in snapshots.rendered_conversations(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_table(spark):
    assert snapshots.rendered_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
