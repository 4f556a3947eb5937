import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    places = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places), failed)


def texts():
    rng = random.Random(8)
    out = [None, "", " \t\n", "one", "two words", "three more words", "a b c a b c", "x " * 300, "line\nline\n\nline", " nbsp x é|#", "the cat " * 26]
    for _ in range(60):
        words = [rng.choice(["the", "of", "a", "stone", "river", "##", "|"]) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(200))]
        out.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\t"]) for w in words))
    return out


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures_agree_with_brute_force_on_both_ways(spark, monkeypatch):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id int, text string")
    want = {i: brute(t) for i, t in enumerate(texts())}
    for limit in (q.LOOKUP_COMPARISONS, 0):  # by look-up, then by sorting
        monkeypatch.setattr(q, "LOOKUP_COMPARISONS", limit)
        rows = frame.select("id", q.judged(F.col("text")).alias("m")).select("id", "m.*").collect()
        assert {r["id"]: tuple(r[c] for c in COLUMNS) for r in rows} == want


def test_rules_decide_and_columns_stay(spark):
    clean = " ".join(f"word{i} of the river{i}" for i in range(40))
    rows = [(1, clean, 7, "x"), (2, clean.replace(" of the ", " ## $$ "), 7, "x"), (3, None, 7, "x"), (1, clean, 7, "x"), (4, " ".join(f"zq{i}" for i in range(80)), 7, "x")]
    frame = spark.createDataFrame(rows, "doc_id int, text string, n_words int, m string")
    kept = q.apply_quality_rules(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1]
    assert q.apply_quality_rules(frame.limit(0)).count() == 0


def test_no_python_and_one_projection(spark):
    plan = spark.createDataFrame([(1, "x")], "id int, text string").select(q.judged(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_very_long_texts_and_thousands_of_equal_rows(spark):
    long = " ".join(f"w{i} of the" for i in range(150_000))
    frame = spark.createDataFrame([(1, long)] + [(2, "the same short row")] * 3000, "id int, text string")
    rows = frame.select("id", q.judged(F.col("text")).alias("m")).groupBy("id", "m.n_words", "m.n_repeat_words", "m.kept").count().collect()
    assert {tuple(r) for r in rows} == {(1, 450_000, 0, True, 1), (2, 4, 0, False, 3000)}
