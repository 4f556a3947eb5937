import random

from tessera.operators import revisions


def brute(rows):
    history, state = {}, {}
    for case in {r[0] for r in rows}:
        version, stack = 0, []
        for _, _, op, kind, base, field, value in sorted((r for r in rows if r[0] == case), key=lambda r: r[1:3]):
            target, status = None, "undo" if kind == "undo" else "applied"
            if base != version:
                status = "conflict"
            elif kind == "undo":
                if stack:
                    target = stack.pop()[0]
                else:
                    status = "nothing_to_undo"
            else:
                stack.append((op, field, value))
            version += status in ("applied", "undo")
            history[case, op] = (status, version, target)
        for op, field, value in stack:
            state[case, field] = (value, op, version)
    return history, state


def test_folds_agree_with_a_plain_walk(spark):
    rng, rows, versions = random.Random(8), [], {}
    for op in range(600):
        case = rng.randrange(7)
        right = versions.setdefault(case, 0)
        kind = "undo" if rng.random() < 0.35 else "edit"
        base = right if rng.random() < 0.8 else rng.randrange(5)
        rows.append((case, op // 2, op, kind, base, rng.choice(["a", "b", None]), rng.choice([None, f"v{op}"])))
        versions[case] = brute([r for r in rows if r[0] == case])[0][case, op][1]
    history, state = brute(rows)
    shuffled = rng.sample(rows, len(rows)) + [(None, 1, 900, "edit", 0, "a", "x"), (1, None, 901, "edit", 0, "a", "x")]
    frame = spark.createDataFrame(shuffled, "case_id long, seq long, op_id long, kind string, base_version long, field string, value string")
    assert {(r["case_id"], r["op_id"]): (r["status"], r["version"], r["undoes"]) for r in revisions.revision_history(frame).collect()} == history
    assert {(r["case_id"], r["field"]): (r["value"], r["op_id"], r["version"]) for r in revisions.revision_state(frame).collect()} == state
    assert {h[0] for h in history.values()} == {"applied", "undo", "conflict", "nothing_to_undo"}
    assert revisions.revision_state(frame.limit(0)).count() == 0
