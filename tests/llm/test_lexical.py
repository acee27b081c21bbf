"""Ranked lexical search against brute force, ties, and awkward inputs."""

import math
import random
from collections import Counter

import numpy as np

from rasterloom.llm import lexical

DOCS, ITEMS = "doc_id long, text string, item_id string, score string", "item_id long, text string, rank string"


def brute(docs, items, top=20):
    terms = [(i, lexical.terms_of(t)) for i, t, *_ in docs]
    n_docs, n_terms = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text, *_ in items:
        asked, rows = Counter(lexical.terms_of(text)), []
        for i, t in terms:
            tf, m = Counter(t), 75 + 25 * len(t) * n_docs // max(1, n_terms)
            score = sum(k * weight[x] * (1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * m)) for x, k in asked.items() if tf[x])
            if score:
                rows.append((-score, i is None, i if i is not None else 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=str)


def test_equals_brute_force_with_ties_and_awkward_rows(spark):
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 40))), "x", "y") for i in range(500)]
    docs += [(1000 + i, "same tied text ÄÖ w1", "x", "y") for i in range(45)] + [(7, "same tied text ÄÖ w1", "x", "y")] * 3
    docs += [(2000, None, "x", "y"), (2001, "", "x", "y"), (2002, " .!\x7f", "x", "y"), (None, "w3 w4 unique", None, None), (2003, "w5 " * 50_000 + "END", "x", "y")]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12))), "r") for i in range(25)]
    items += [(50, "TIED tied w1", "r"), (50, "TIED tied w1", "r"), (None, "end unique", "r"), (51, None, "r"), (52, "", "r"), (53, "nowhere", "r"), (54, "ÄÖ", "r")]
    frame, asked = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    for block in (lexical.BLOCK_BYTES, 100):  # one block of items, and several
        assert sorted(map(tuple, lexical.rank_documents(frame, asked, block_bytes=block).collect()), key=str) == want
    none = spark.createDataFrame([], DOCS)
    assert lexical.rank_documents(none, asked).count() == 0
    assert lexical.rank_documents(frame, spark.createDataFrame([], ITEMS)).columns == ["item_id", "rank", "doc_id", "score"]


def test_small_ranges_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(f"t{rng.randrange(30)}" for _ in range(rng.randrange(1, 20))), "x", "y") for i in range(300)]
    items = [(i, " ".join(f"t{rng.randrange(30)}" for _ in range(5)), "r") for i in range(10)]
    monkeypatch.setattr(lexical, "RANGE_CELLS", 1)
    found = lexical.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_tree_opens_few_leaves_and_equal_bounds():
    rng = np.random.default_rng(3)
    n, n_terms = 20_000, 50
    sizes = rng.integers(1, 10, n)
    terms = np.concatenate([rng.choice(n_terms, s, replace=False) for s in sizes])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    impact = rng.integers(1, 1000, len(terms))
    impact[starts[777] : starts[778]] = 900_000  # one document stands out
    tree = lexical.RangeTree(list(range(n)), starts, terms, impact, n_terms)
    asked = np.unique(terms[starts[777] : starts[778]])
    dense = np.zeros(n_terms, dtype=np.int64)
    dense[asked] = 2
    best = []
    assert tree.search(asked, dense[asked], dense, best, 1) == 1 and best[0][2] == 777
    flat = lexical.RangeTree(list(range(100, 0, -1)), np.arange(101), np.zeros(100, dtype=np.int64), np.full(100, 5), 1)
    best = []
    flat.search(np.array([0]), np.array([3]), np.array([3]), best, 2)
    assert best == [(-15, False, 1), (-15, False, 2)]
