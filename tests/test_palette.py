"""Palette estimation against a plain computation over one image at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import palette

SCHEMA = "image_id long, x int, y int, width int, height int, r int, g int, b int"


def pixels(spark, pictures):
    rows = [(i, x, y, p.shape[1], p.shape[0], *map(int, p[y, x])) for i, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, SCHEMA).repartition(4, "x")


def sampled(p):
    """Flat interior pixels in raster order, or all where there are none."""
    h, w, _ = p.shape
    flat = [p[y, x] for y in range(1, h - 1) for x in range(1, w - 1) if max(np.abs(p[y, x] - q).max() for q in (p[y, x - 1], p[y, x + 1], p[y - 1, x], p[y + 1, x])) < palette.GRADIENT]
    return np.array(flat if flat else p.reshape(-1, 3), dtype=float)


def gaps(points, centers):
    d = points[:, None, :] - np.asarray(centers)[None, :, :]
    return d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2


def seeded(points, k):
    draw = palette.mulberry32(palette.SEED)
    centers = [points[int(draw() * len(points))]]
    while len(centers) < k:
        sums, at = np.cumsum(gaps(points, centers).min(axis=1)), draw()
        centers.append(points[min(int(np.searchsorted(sums, at * sums[-1])), len(points) - 1)])
    return np.array(centers)


def moved(points, centers, rounds):
    centers = centers.copy()
    for _ in range(rounds):
        near = gaps(points, centers).argmin(axis=1)
        for k in set(near.tolist()):
            centers[k] = points[near == k].mean(axis=0)
    return centers, np.bincount(near, minlength=len(centers))


def test_generator_gives_the_public_values():
    draw = palette.mulberry32(12345)
    assert [draw() for _ in range(4)] == [0.9797282677609473, 0.3067522644996643, 0.484205421525985, 0.817934412509203]
    draw = palette.mulberry32(0)
    assert [draw() for _ in range(3)] == [0.26642920868471265, 0.0003297457005828619, 0.2232720274478197]


@pytest.fixture(scope="module")
def pictures():
    """Noise without flat pixels, blots with many, and a smooth ramp."""
    r = np.random.default_rng(7)
    noise = r.integers(0, 256, (14, 17, 3))
    blots = np.repeat(np.repeat(r.integers(0, 256, (3, 4, 3)), 6, axis=0), 6, axis=1) + r.integers(0, 4, (18, 24, 3))
    ramp = np.stack(np.broadcast_arrays(np.arange(20)[None, :] * 9, np.arange(15)[:, None] * 11, np.full((15, 20), 90)), axis=2)
    return {0: noise, 1: np.minimum(blots, 255), 2: ramp}


def test_seeds_equal_a_walk(spark, pictures):
    sample = palette.stride_sample(palette.flat_interior(pixels(spark, pictures)))
    draw, state = palette.mulberry32(palette.SEED), None
    for _ in range(3):
        state = palette.add_seed(sample, state, draw())
    for row in state.collect():
        assert [(c.r, c.g, c.b) for c in row.colors] == [tuple(c) for c in seeded(sampled(pictures[row.image_id]), 3)]


@pytest.mark.parametrize("rounds", [1, 7])
def test_moves_equal_plain_means(spark, pictures, rounds):
    sample = palette.stride_sample(palette.flat_interior(pixels(spark, pictures)))
    starts = {i: seeded(sampled(p), 4) for i, p in pictures.items()}
    rows = [(i, [(k, *map(float, c), 0, 0.0) for k, c in enumerate(s)]) for i, s in starts.items()]
    state = spark.createDataFrame(rows, "image_id long, colors array<struct<color_idx: int, r: double, g: double, b: double, n: long, sse: double>>")
    found = palette.lloyd(sample.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n")), state, rounds).collect()
    assert len(found) == len(pictures)
    for row in found:
        centers, held = moved(sampled(pictures[row.image_id]), starts[row.image_id], rounds)
        np.testing.assert_allclose([(c.r, c.g, c.b) for c in row.colors], centers, rtol=0, atol=1e-9)
        assert [c.n for c in row.colors] == held.tolist()


def test_whole_palettes_equal_a_walk(spark, pictures):
    found = {}
    for r in palette.estimate_palette(pixels(spark, pictures), 3).orderBy("image_id", "color_idx").collect():
        found.setdefault(r.image_id, []).append((r.r, r.g, r.b))
    for i, p in pictures.items():
        points = sampled(p)
        centers, held = moved(points, seeded(points, 3), 20)
        assert held.min() > 0 and (gaps(centers, centers) + 1e9 * np.eye(3)).min() >= palette.DEAD**2  # nothing to repair
        centers = centers[np.argsort(centers @ (3, 6, 1), kind="stable")]
        assert found[i] == [tuple(np.floor(c + 0.5).astype(int)) for c in centers]


def test_near_pixels_are_listed_with_their_places(spark):
    """Pixels of equal colour stay apart; the query gives each with its place, as its SQL does."""
    rng = np.random.default_rng(4)
    p = rng.choice([100, 128, 150, 250], size=(20, 30))[..., None].repeat(3, axis=2)
    grey = F.array(palette.center(F.lit(0), *[F.lit(128)] * 3))
    out = palette.near_pixels(pixels(spark, {0: p, 1: p}), spark.range(1).select(F.col("id").alias("image_id"), grey.alias("added")), 60, 100)
    near = [(y, x) for y in range(20) for x in range(30) if p[y, x, 0] < 200]
    want = near[:: -(-len(near) // 100)]
    assert sorted((r.y, r.x) for r in out.collect()) == want and 50 < len(want) <= 100
    from rasterloom import queries

    got = queries.queries()["pixels_near"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["image_id", "y", "x", "r", "g", "b"]
    assert got.select("image_id", "y", "x").distinct().count() == got.count()
