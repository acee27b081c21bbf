"""Whole documents: curves of shared boundaries, junctions, counts of loops, and the same bytes from any layout of the input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rasterloom.plans.vectorize import Options, Vectorizer
from rasterloom.sources import raster

RED, BLUE, PAPER, INK = (200, 30, 30), (30, 30, 200), (245, 245, 245), (20, 20, 20)


def painted(px, where, rgb):
    return px.select(*[F.when(where, F.lit(v)).otherwise(F.col(c)).cast(px.schema[c].dataType).alias(c) if (v := dict(zip("rgb", rgb)).get(c)) is not None else F.col(c) for c in px.columns])


@pytest.fixture(scope="module")
def drawings(spark):
    """0: a disc of two colours; 1: two rectangles side by side; 2: a ring."""
    disc = raster.render_shape(spark, 64, 64, lambda x, y: raster.inside_circle(x, y, 32, 32, 20), RED, PAPER, image_id=0)
    inside = (F.col("x") + 0.5 - 32) ** 2 + (F.col("y") + 0.5 - 32) ** 2 <= 400
    disc = painted(disc, inside & (F.col("x") >= 32), BLUE)
    box = lambda x, y: (x >= 12) & (x < 36) & (y >= 10) & (y < 34)
    boxes = raster.render_shape(spark, 72, 48, box, RED, PAPER, image_id=1)
    boxes = painted(boxes, F.col("x").between(36, 59) & F.col("y").between(10, 33), BLUE)
    ring = raster.render_shape(spark, 64, 64, lambda x, y: raster.inside_ring(x, y, 32, 32, 18, 8), INK, PAPER, image_id=2)
    return disc.unionByName(boxes).unionByName(ring).cache()


@pytest.fixture(scope="module")
def documents(drawings):
    run = Vectorizer(drawings).run(Options(color_count="auto", smoothness=1, merge_paths=False, optimize=False))
    return {r.image_id: r for r in run.collect()}


def loops(svg):
    """A list of cubics (eight numbers) for each loop of a plain document."""
    out = []
    for d in re.findall(r' d="([^"]*)"', svg):
        for loop in d.split("M")[1:]:
            n = [float(v) for v in re.findall(r"-?\d+(?:\.\d+)?", loop)]
            ends = [n[:2], *[n[i + 4 : i + 6] for i in range(2, len(n), 6)]]
            out.append([(*ends[k], *n[i : i + 6]) for k, i in enumerate(range(2, len(n), 6))])
    return out


def either_way(c):
    return min(c, (*c[6:], *c[4:6], *c[2:4], *c[:2]))


@pytest.mark.parametrize("image, width, height", [(0, 64, 64), (1, 72, 48), (2, 64, 64)])
def test_neighbours_share_their_cubics(documents, image, width, height):
    cubics = [c for loop in loops(documents[image].svg) for c in loop]
    uses = Counter(map(either_way, cubics))
    within = [c for c in cubics if all(0 < c[i] < width and 0 < c[i + 1] < height for i in (0, 6))]
    assert within and max(uses.values()) <= 2
    assert all(uses[either_way(c)] == 2 for c in within)
    assert documents[image].point_count == sum(3 * len(loop) + 1 for loop in loops(documents[image].svg))


@pytest.mark.parametrize("image", [0, 1, 2])
def test_loops_close(documents, image):
    found = loops(documents[image].svg)
    assert found
    for loop in found:
        assert loop[0][:2] == loop[-1][6:]


def test_arcs_end_where_three_colours_meet(documents):
    assert documents[1].path_count == 3
    ends = {c[6:] for loop in loops(documents[1].svg) for c in loop}
    assert {(36.0, 10.0), (36.0, 34.0)} <= ends


def test_ring_has_five_loops(drawings, documents):
    assert len(loops(documents[2].svg)) == 5 and documents[2].path_count == 3
    merged = Vectorizer(drawings.where("image_id = 2")).run(Options(color_count=2)).first()
    assert merged.path_count == 2 and merged.svg.count("M") == 5


def test_bytes_do_not_depend_on_the_layout(drawings):
    px = drawings.where("image_id = 0")
    o = Options(color_count=3, gap_closing=2, black_point=15, transparent_bg=True)
    a = Vectorizer(px.coalesce(1)).run(o).first()
    b = Vectorizer(px.repartition(5, "x").sortWithinPartitions(F.desc("y"))).run(o).first()
    assert a.svg == b.svg and a.point_count == b.point_count
