"""Rules of documents and of closing gaps, on small hand-made inputs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import boundary, jobs, palette, pre, segment, svg
from rasterloom.operators.graph import cut
from tests.test_loops import image

RED, PAPER = (200, 30, 30), (245, 245, 245)


@pytest.fixture(scope="module")
def drawing(spark):
    """A paper, a square on it, a smaller one of its colour, and a pocket of the paper's colour."""
    rows = [(0, 0, 400.0, 0, "M0 0h20v20h-20z"), (0, 1, 100.0, 45, "M5 5h10v10h-10z"), (0, 1, 50.0, 300, "M1 15h5v5h-5z"), (0, 0, 5.0, 130, "M10 6h1v1h-1z")]
    paths = cut(spark.createDataFrame(rows, "image_id long, color_idx int, area double, first_pixel long, d string"))
    colours = spark.createDataFrame([(0, 0, *PAPER), (0, 1, *RED)], "image_id long, color_idx int, r int, g int, b int")
    return paths, colours, spark.createDataFrame([(0, 20, 20), (1, 7, 3)], "image_id long, width int, height int")


def document(drawing, image_id=0, **flags):
    return next(r for r in svg.assemble(*drawing, **flags).collect() if r.image_id == image_id)


def test_larger_areas_come_first(drawing):
    doc = document(drawing, merge=False)
    assert doc.path_count == 4 and 'viewBox="0 0 20 20"' in doc.svg and doc.svg.count('fill-rule="evenodd"') == 4
    assert re.findall('fill="(#[0-9a-f]+)"', doc.svg) == ["#f5f5f5", "#c81e1e", "#c81e1e", "#f5f5f5"]
    assert document(drawing, merge=False).svg == doc.svg
    empty = document(drawing, 1)
    assert empty.path_count == 0 and empty.svg == '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 7 3">\n  \n</svg>\n'


def test_merged_paths_keep_their_parts(drawing):
    doc = document(drawing)
    red = next(line for line in doc.svg.split("\n") if "#c81e1e" in line)
    assert doc.path_count == 2 and 'd="M5 5h10v10h-10zM1 15h5v5h-5z"' in red


def test_a_transparent_background_takes_all_of_its_colour(drawing):
    for merge, left in ((False, 2), (True, 1)):
        doc = document(drawing, merge=merge, transparent=True)
        assert doc.path_count == left and "#f5f5f5" not in doc.svg
    stacked = document(drawing, transparent=True, stacked=True)  # which stacking does not look at
    assert stacked.path_count == 4 and "fill-rule" not in stacked.svg
    assert [d[:3] for d in re.findall(' d="([^"]*)"', stacked.svg)] == ["M0 ", "M5 ", "M10", "M1 "]


def test_overrides_change_fills_alone(drawing):
    base = document(drawing, merge=False).svg
    one = document(drawing, merge=False, overrides=[None, "#123456"]).svg
    assert one.count("#123456") == 2 and "#c81e1e" not in one and one.count("#f5f5f5") == 2
    assert re.findall(' d="([^"]*)"', one) == re.findall(' d="([^"]*)"', base)
    for none in ([], [None], [None, None, "#000000"]):
        assert document(drawing, merge=False, overrides=none).svg == base


def test_overrides_follow_their_colours(spark):
    schema = "image_id long, color_idx int, r int, g int, b int, override string"
    old = spark.createDataFrame([(0, 0, 10, 10, 10, "#a"), (0, 1, 200, 200, 200, None), (1, 0, 10, 10, 10, "#b"), (1, 1, 90, 90, 90, "#c"), (1, 2, 200, 200, 200, None)], schema)
    new = spark.createDataFrame([(0, 0, 150, 150, 150, None), (0, 1, 250, 250, 250, None), (1, 0, 88, 90, 91, None), (1, 1, 205, 200, 200, None)], schema).drop("override")
    found = {(r.image_id, r.color_idx): r.override for r in jobs.carry_overrides(old, new).collect()}
    # As many colours: by index, however far the colour moved. Fewer: the near colour, and what has none is dropped.
    assert found == {(0, 0): "#a", (0, 1): None, (1, 0): "#c", (1, 1): None}


def strokes(gap, dash, residue, every=1):
    """Dashes in row 20, ``residue`` between them, above a solid bar."""
    cells = np.full((40, 60), 245)
    cells[28:34, 4:56] = 30
    for x in range(4, 56):
        cells[20, x] = 30 if (x - 4) % (dash + gap) < dash else residue
    return cells


def ink_regions(spark, cells, radius):
    h, w = cells.shape
    px = spark.createDataFrame([(0, w, h, y, x, *[int(cells[y, x])] * 3) for y in range(h) for x in range(w)], "image_id long, width int, height int, y int, x int, r int, g int, b int")
    pal = spark.createDataFrame([(0, 0, 30, 30, 30), (0, 1, 245, 245, 245)], "image_id long, color_idx int, r int, g int, b int")
    parts = segment.regions(cut(segment.close_gaps(cut(palette.nearest_palette(px, pal)), pal, radius)))
    return segment.region_sizes(parts).where("color_idx = 0").count()


def test_gaps_close_by_reach_and_by_colour(spark):
    broken = strokes(3, 5, 145)
    assert ink_regions(spark, broken, 0) > 2 and ink_regions(spark, broken, 2) == 2
    assert ink_regions(spark, strokes(3, 5, 160), 2) > 2  # 160 is further from ink than 1.3 times its way to paper
    wide = strokes(7, 8, 145)
    assert ink_regions(spark, wide, 3) > 2 and ink_regions(spark, wide, 4) == 2
    clean = np.full((40, 60), 245)
    clean[10, 4:56] = clean[14, 4:56] = 30
    assert ink_regions(spark, clean, 2) == 2  # paper between two strokes stays


def test_loops_come_by_first_pixel_and_junctions_where_three_regions_meet(spark):
    cells = np.zeros((12, 16), dtype=int)
    cells[:6, 8:], cells[6:, :] = 1, 3
    px, pal = image(spark, cells)
    edges = cut(boundary.boundary_edges(cut(segment.regions(palette.nearest_palette(px, pal)))))
    inner = boundary.junctions(edges).where("x > 0 AND x < 16 AND y > 0 AND y < 12").collect()
    assert [(r.x, r.y, r.n) for r in inner] == [(8, 6, 3)]
    assert boundary.junctions(edges).count() == 4  # and where borders end on the frame


def test_blur_keeps_the_mean_and_spreads(spark):
    cells = np.random.default_rng(1).integers(0, 256, (32, 32))
    px = cut(spark.createDataFrame([(0, 32, 32, y, x, *[int(cells[y, x])] * 3) for y in range(32) for x in range(32)], "image_id long, width int, height int, y int, x int, r int, g int, b int"))
    stats = lambda df: df.agg(F.avg("r").alias("m"), F.var_pop("r").alias("v")).first()
    was, soft, softer = stats(px), stats(pre.blur(px, 0.8)), stats(pre.blur(px, 2))
    assert abs(soft.m - was.m) < 3 and softer.v < soft.v < was.v and softer.v < 0.3 * was.v
    wide = {(r.y, r.x): r.r for r in pre.box_pass(px, 40, "x").collect()}  # reaches beyond both ends
    line = np.concatenate([np.repeat(cells[5, 0], 40), cells[5], np.repeat(cells[5, -1], 40)]).astype(float)
    assert all(abs(wide[5, x] - line[x : x + 81].mean()) < 1e-3 for x in range(32))


@pytest.mark.parametrize("radius,height,width", [(3, 20, 17), (16, 50, 90), (40, 7, 200), (40, 90, 30)])
def test_extremes_of_any_reach(spark, radius, height, width):
    cells = np.random.default_rng(radius).integers(0, 1000, (height, width))
    df = spark.createDataFrame([(0, y, x, int(cells[y, x])) for y in range(height) for x in range(width)], "image_id long, y int, x int, m long")
    for f, op in ((segment.dilate, np.max), (segment.erode, np.min)):
        got = np.zeros_like(cells)
        for r in f(df, radius).collect():
            got[r.y, r.x] = r.m
        rows = np.stack([op(cells[:, max(0, x - radius) : x + radius + 1], axis=1) for x in range(width)], axis=1)
        assert (got == np.stack([op(rows[max(0, y - radius) : y + radius + 1], axis=0) for y in range(height)])).all()
