"""Small languages get thresholds of their own, however large the others are."""

import random

from lodestone.llm import quality_model


def test_small_language(spark, monkeypatch):
    """Of 90 trusted documents of a language beside 3,000 of another, all count: with the sample's share alone it had too few."""
    # the default is bound when the module is read
    monkeypatch.setattr(quality_model, "SAMPLE", 400)
    monkeypatch.setattr(quality_model.training_ids, "__defaults__", (400,))
    rng = random.Random(1)
    say = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))
    rows = [(i, say("abcdefgh"), "large") for i in range(3000)] + [(3000 + i, say("qrstuvwxyz"), "small") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    found = quality_model.judge_documents(docs, labels).groupBy("lang").agg({"limit": "max", "kept": "count"}).collect()
    assert len({r["max(limit)"] for r in found}) == 2
    ids = {r["doc_id"] for r in quality_model.training_ids(docs.select("doc_id", "lang"), 400).collect()}
    small = sum(i >= 3000 for i in ids)
    assert len(ids) == 400 and 50 <= small <= 90
