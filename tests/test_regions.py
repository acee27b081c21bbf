"""Components by tiles and despeckling by rounds against walks over the same pixels, and plans that know their sizes."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import boundary, palette, segment
from rasterloom.operators.graph import cut, size_estimate
from rasterloom.plans.vectorize import Options, Vectorizer
from rasterloom.sources import raster
from tests.test_loops import image


def flooded(cells):
    h, w = cells.shape
    label = np.full((h, w), -1)
    for y in range(h):
        for x in range(w):
            todo = [(y, x)] if label[y, x] < 0 else []
            while todo:
                a, b = todo.pop()
                if 0 <= a < h and 0 <= b < w and label[a, b] < 0 and cells[a, b] == cells[y, x]:
                    label[a, b] = y * w + x
                    todo += [(a, b + 1), (a + 1, b), (a, b - 1), (a - 1, b)]
    return label


def walked(label, least):
    """Up to 8 passes over the small regions in the order in which their borders are first met."""
    label = label.copy()
    h, w = label.shape
    for _ in range(8):
        size, borders = Counter(label.ravel().tolist()), {}
        for y in range(h):
            for x in range(w):
                for p, q in ((y, x + 1), (y + 1, x)):
                    if p < h and q < w and label[p, q] != label[y, x]:
                        for a, b in ((label[y, x], label[p, q]), (label[p, q], label[y, x])):
                            if size[a] < least:
                                near = borders.setdefault(int(a), {})
                                near[int(b)] = near.get(int(b), 0) + 1
        if not borders:
            break
        into = {}

        def root(i):
            while i in into:  # noqa: B023
                i = into[i]  # noqa: B023
            return i

        for small, near in borders.items():
            s, o = root(small), root(max(near, key=near.get))
            if s != o and size[s] < least:
                into[s] = o
                size[o] += size[s]
        label = np.vectorize(lambda i: root(int(i)))(label)
    return label


def found(df, shape):
    out = np.zeros(shape, dtype=int)
    for r in df.collect():
        out[r.y, r.x] = r.region
    return out


def snake(n):
    cells = np.zeros((n, n), dtype=int)
    cells[1::4, : n - 1] = cells[3::4, 1:] = 1
    return cells


@pytest.mark.parametrize("cells", [np.random.default_rng(5).integers(0, 2, (37, 41)), snake(40)], ids=["noise", "snake"])
def test_components_by_tiles(spark, cells):
    px, pal = image(spark, cells)
    assert (found(segment.regions(palette.nearest_palette(px, pal), tile=8), cells.shape) == flooded(cells)).all()


def test_tile_labels_of_missing_cells():
    assert segment.tile_labels(np.array([[-1, 3], [-1, 3], [3, 3]])).tolist() == [[0, 1], [2, 1], [1, 1]]


@pytest.mark.parametrize("seed,colours,least", [(1, 3, 6), (2, 2, 9)])
def test_despeckle_equals_the_walk(spark, seed, colours, least):
    cells = np.random.default_rng(seed).integers(0, colours, (24, 31))
    px, pal = image(spark, cells)
    parts = cut(segment.regions(palette.nearest_palette(px, pal)))
    after = cut(segment.despeckle(parts, least))
    assert (found(after, cells.shape) == walked(flooded(cells), least)).all()
    assert after.groupBy("region").agg(F.count_distinct("color_idx").alias("k")).where("k > 1").count() == 0
    assert after.where(F.col("y") * F.col("width") + F.col("x") == F.col("region")).join(parts.select("y", "x", F.col("color_idx").alias("was")), ["y", "x"]).where("was <> color_idx").count() == 0


def test_sizes_are_known_after_tracing(spark):
    cells = np.random.default_rng(4).integers(0, 2, (24, 24))
    px, pal = image(spark, cells)
    parts = cut(segment.regions(palette.nearest_palette(px, pal)))
    edges = cut(boundary.boundary_edges(parts))
    traced = cut(boundary.trace(edges))
    assert size_estimate(traced) < 100 * 60 * edges.count()


def test_image_of_256_by_256(spark):
    """A ring inside a square, and specks that go."""
    inside = lambda x, y: raster.inside_ring(x, y, 128, 128, 70, 12) | raster.inside_square(x, y, 128, 128, 20, 0.3) | ((F.floor(x) == 9) & (F.floor(y) == 200))
    px = cut(raster.render_shape(spark, 256, 256, inside, (10, 10, 10), (250, 250, 250), ss=4))
    row = Vectorizer(px).run(Options(color_count=2, merge_paths=False)).first()
    assert row.path_count == 4 and row.svg.count("M") == 7 and row.point_count < 200
