"""Decontamination by a join: windows that share their rarest word, frequent keys, and copies of one text."""

import random

from rasterloom.llm import common, decontam


def found(df, bench, **kw):
    return sorted((r.doc_id, r.n_words, list(r.hit), list(r["items"])) for r in decontam.contamination(df, bench, **kw).collect())


def test_frequent_keys_and_copies_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(12)}"
    items = [" ".join([*[word() for _ in range(k % 11)], "rare", *[word() for _ in range(10 - k % 11)]]) for k in range(60)] + ["rare", "short one", "rare w1"]
    texts = [" ".join([word() for _ in range(rng.randrange(3, 30))] + [rng.choice(items)] + [word() for _ in range(5)]) for _ in range(80)]
    texts += ["rare " * 300, "rare", "", None, "w1 rare"] + [texts[0]] * 40
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = found(docs, bench)
    assert found(docs, bench, most=0) == want and sum(bool(r[2]) for r in want) > 80
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert found(docs, bench, most=0) == want
    kept = {r.doc_id for r in decontam.decontaminate(docs, bench, most=0).collect()}
    assert kept == {i for i, _, hit, _ in want if not hit}
