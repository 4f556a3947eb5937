import random
from collections import Counter

import corpus_pipeline as cp
from tessera.llm import decontaminate, quality_rules, sharding, simhash


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["the", "on", "er", "ti", "sha", "mo"]) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(rng.choice([*(f"{word()}{rng.randrange(60)}" for _ in range(6)), "the", "of"]) for _ in range(n))
    items = [(i, text(35)) for i in range(3)]
    docs = [(i, text(rng.randrange(60, 140)), "en", f"s{i % 4}", 0) for i in range(60)]
    docs += [(100 + i, docs[i][1], "en", "s1", 0) for i in range(10)]  # copies
    docs += [(200 + i, f"{text(40)} {items[i % 3][1]} {text(20)}", "en", "s2", 0) for i in range(6)]  # leaks
    docs += [(300, "short", "en", "s0", 0), (301, None, None, None, None), (302, "## " * 100, "en", "s0", 0)]
    rng.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in cp.STAGES[:3]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in frame.collect()})
    assert kept[0] == {d[0] for d in docs} - {300, 301, 302}
    assert kept[1] == kept[0] - set(range(100, 110))
    assert kept[2] == kept[1] - set(range(200, 206))
    mixed = cp.STAGES[3][1](spark, frame, str(tmp_path))
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= kept[2] and max(copies.values()) <= 2
    out = cp.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out) == copies
    assert {r["shard"] for r in out} == set(range(sharding.SHARDS))
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    assert quality_rules and simhash and decontaminate


def test_null_ids_long_texts_and_empty_tables(spark, tmp_path):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(400)] + ["the", "of", "and"] * 30
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(None, text(80), "en", None), (None, text(90), "en", "a"), (1, text(60_000), "en", "a"), (2, text(70), "en", None), (2, None, "en", "a")]
    for name, rows in (("full", docs), ("empty", [])):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(0, text(30)), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    full = cp.run(spark, str(tmp_path / "full")).collect()
    assert {r["doc_id"] for r in full} == {None, 1, 2} and len({r["size"] for r in full}) == 4
    assert cp.run(spark, str(tmp_path / "empty")).count() == 0
