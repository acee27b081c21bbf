"""Groups stay whole in shards, and what has to be cut is cut as an exhaustive search would."""

from collections import Counter
from functools import cache

import pytest

from rasterloom.llm import sharding


def least_cut(groups, loose, shards):
    """Fewest cut links over every way to deal the groups to shards of equal size, by exhaustive search."""
    total = sum(groups) + loose
    quota = tuple(total // shards + (s < total % shards) for s in range(shards))

    def ways(n, free):
        if not free:
            if n == 0:
                yield ()
            return
        for k in range(min(n, free[0]) + 1):
            for rest in ways(n - k, free[1:]):
                yield (k, *rest)

    @cache
    def best(i, free):
        if i == len(groups):
            return 0
        m = groups[i]
        return min(m * (m - 1) // 2 - sum(k * (k - 1) // 2 for k in way) + best(i + 1, tuple(f - k for f, k in zip(free, way))) for way in ways(m, free))

    return best(0, quota)


@pytest.mark.parametrize("groups, loose, shards", [((4, 3, 2), 3, 3), ((6, 2), 1, 3), ((5, 4, 3), 0, 3), ((2,), 0, 4)])
def test_cut_is_the_least(spark, groups, loose, shards):
    texts = [f"group {g}" for g, m in enumerate(groups) for _ in range(m)] + [f"text {i}" for i in range(loose)]
    placed = sharding.shards_with_keys(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards).cache()
    rows = placed.collect()
    held = Counter(r.shard for r in rows)
    assert max(held.values()) - min(held[s] for s in range(shards)) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in sorted(held) for i in range(held[s])]
    found = sharding.cut_links(placed).first()
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], Counter())[r.shard] += 1
    cut = sum(sum(c.values()) * (sum(c.values()) - 1) // 2 - sum(k * (k - 1) // 2 for k in c.values()) for c in where.values())
    assert found.n_cut == cut == least_cut(groups, loose, shards)
    assert found.n_groups == sum(m > 1 for m in groups) and found.n_links == sum(m * (m - 1) // 2 for m in groups)


def test_without_room_few_groups_are_cut(spark):
    texts = [f"group {g}" for g, m in enumerate((3, 3, 2)) for _ in range(m)]
    found = sharding.cut_links(sharding.shards_with_keys(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2)).first()
    assert found.n_split == 1 and found.n_cut <= 2  # the least is 1; finding it always is bin packing


def test_groups_stay_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = sharding.cut_links(sharding.shards_with_keys(docs.union(docs).union(docs.where("doc_id % 2 = 0")).union(docs.selectExpr("doc_id", "concat(text, ' alone ', doc_id)")), 16)).first()
    assert found.n_groups > 80 and found.n_split == 0 and found.n_cut == 0
    # With groups of three alone, quotas that three does not divide force cuts; each one fills a shard.
    found = sharding.cut_links(sharding.shards_with_keys(docs.union(docs).union(docs), 16)).first()
    assert found.n_groups > 80 and found.n_split < 16


@pytest.mark.parametrize("sizes, free", [([5, 3], [4, 4]), ([2, 2, 2], [3, 3]), ([7], [1, 2, 4])])
def test_fit_uses_no_more_than_is_free(sizes, free):
    left = list(free)
    for size, parts in zip(sizes, sharding.fit(sizes, left)):
        assert sum(n for _, n in parts) == size
    assert min(left) >= 0 and sum(left) == sum(free) - sum(sizes)


def test_no_linked_rows(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else f"t{i}") for i in range(7)], "doc_id long, text string")
    assert tuple(sharding.cut_links(sharding.shards_with_keys(docs, 3)).first()) == (0, 0, 0, 0)
