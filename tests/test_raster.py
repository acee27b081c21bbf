"""Analytic geometry as ground truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import boundary, corners, fit, palette, pre, segment
from rasterloom.plans.vectorize import Options, Vectorizer
from rasterloom.sources import raster


def shape(spark, w, h, inside, fg=(200, 30, 30), bg=(245, 245, 245), image_id=0):
    return raster.render_shape(spark, w, h, inside, fg, bg, image_id=image_id)


@pytest.fixture(scope="module")
def circle(spark):
    return shape(spark, 96, 96, lambda x, y: raster.inside_circle(x, y, 48, 48, 30)).cache()


def poly(spark, points):
    return spark.createDataFrame([([tuple(map(float, p)) for p in points],)], "points array<struct<x: double, y: double>>")


def test_circle_end_to_end_and_reuse(spark, circle):
    v = Vectorizer(circle)
    a = v.run(Options(color_count=2)).first()
    assert a.path_count == 2 and a.point_count < 80
    kept = dict(v.cache)
    b = v.run(Options(color_count=2, optimize=False)).first()
    assert v.cache == kept and "C" in b.svg and len(b.svg) > len(a.svg)
    assert v.run(Options(color_count=2)).first().svg == a.svg
    assert v.run(Options(color_count=2, transparent_bg=True)).first().path_count == 1
    assert v.run(Options(color_count=2, stacked_shapes=True)).first().svg.count("M") == 2


def test_thin_ring_palette(spark):
    px = shape(spark, 128, 128, lambda x, y: raster.inside_ring(x, y, 64, 64, 40, 0.75), (0, 0, 0), (255, 255, 255))
    found = sorted((r.r, r.g, r.b) for r in palette.estimate_palette(px, 2).collect())
    assert max(found[0]) < 60 and min(found[1]) > 245


def test_refined_points_lie_on_the_circle(spark):
    px = shape(spark, 64, 64, lambda x, y: raster.inside_circle(x, y, 32, 32, 20.3)).cache()
    pal = spark.createDataFrame([(0, 0, 200, 30, 30), (0, 1, 245, 245, 245)], "image_id long, color_idx int, r int, g int, b int")
    parts = segment.regions(palette.nearest_palette(px, pal)).cache()
    edges = boundary.boundary_edges(parts).cache()
    inner = edges.where("nbr >= 0").select("image_id", "edge_id").distinct()
    far = boundary.refined_edges(edges, parts, pal).join(inner, ["image_id", "edge_id"]).select(F.max(F.abs(F.hypot(F.col("mx") - 32, F.col("my") - 32) - 20.3))).first()[0]
    assert far < 0.1
    assert all(r.area == r.n for r in boundary.lattice_area(edges).join(parts.groupBy("region").agg(F.count("*").alias("n")), "region").collect())
    walks = boundary.traversals(boundary.trace(edges), boundary.refined_edges(edges, parts, pal))
    uses = boundary.shared_arcs(walks, segment.region_sizes(parts))[1].groupBy("arc_id").agg(F.count("*").alias("n"), F.sum(F.col("reversed").cast("int")).alias("r")).collect()
    assert all(u.n <= 2 and u.r == u.n - 1 for u in uses)


def test_corners(spark):
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    assert poly(spark, np.c_[50 + 30 * np.cos(t), 50 + 30 * np.sin(t)]).select(corners.closed_corners(F.col("points"))).first()[0] == []
    side = [(i, 0) for i in range(25)] + [(25, i) for i in range(25)] + [(25 - i, 25) for i in range(25)] + [(0, 25 - i) for i in range(25)]
    assert poly(spark, side).select(corners.closed_corners(F.col("points"))).first()[0] == [0, 25, 50, 75]
    bend = [(i, 0) for i in range(21)] + [(20, i) for i in range(1, 21)]
    assert poly(spark, bend).select(corners.open_corners(F.col("points"))).first()[0] == [20]


def test_fit_circle_and_reversal(spark):
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    chain = fit.fit_arc(np.c_[50 + 30 * np.cos(t), 50 + 30 * np.sin(t)], [], True, 0.5)
    assert len(chain) <= 8
    u = np.linspace(0, 1, 50)
    pts = np.vstack([fit._weights(u) @ b for b in chain])
    assert np.abs(np.hypot(*(pts - 50).T) - 30).max() < 0.5
    assert all((a[3] == b[0]).all() for a, b in zip(chain, chain[1:] + chain[:1]))
    row = spark.createDataFrame([([dict(zip(fit.CUBIC, map(float, b.ravel()))) for b in chain],)], "c array<struct<" + ",".join(f"{c}: double" for c in fit.CUBIC) + ">>")
    twice = row.select("c", fit.reverse_cubics(fit.reverse_cubics(F.col("c"))).alias("d")).first()
    assert twice.c == twice.d


def test_tone(spark, circle):
    assert pre.preprocess(circle) is circle
    flat = shape(spark, 6, 6, lambda x, y: x < 0, (0, 0, 0), (125, 125, 125))
    assert {r.r for r in pre.levels(flat, 50, 200).collect()} == {128}
    ramp = raster.grid(spark, 128, 128).select(F.lit(0).cast("long").alias("image_id"), F.lit(128).alias("width"), F.lit(128).alias("height"), "y", "x", *[F.floor(108 + 69 * (F.col("x") + F.col("y")) / 254).cast("int").alias(c) for c in "rgb"])
    even = pre.preprocess(ramp, flatten_strength=1.0)
    ends = {(r.x, r.y): r.r for r in even.where("(x = 0 and y = 0) or (x = 127 and y = 127)").collect()}
    assert abs(ends[0, 0] - ends[127, 127]) < 8
    assert pre.box_widths(0.3)[-1] == 3


def test_despeckle_absorbs_a_pixel(spark):
    px = shape(spark, 20, 20, lambda x, y: (F.floor(x) == 5) & (F.floor(y) == 5), (0, 0, 0), (255, 255, 255))
    pal = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 1, 255, 255, 255)], "image_id long, color_idx int, r int, g int, b int")
    parts = segment.regions(palette.nearest_palette(px, pal)).cache()
    assert segment.region_sizes(parts).count() == 2
    left = segment.region_sizes(segment.despeckle(parts, 4)).collect()
    assert [r["size"] for r in left] == [400]


def test_fit_as_a_table_function(spark):
    t = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    bend = [(float(i), 0.0) for i in range(21)] + [(20.0, float(i)) for i in range(1, 21)]
    rows = [(0, 1, True, [], [(float(50 + 30 * np.cos(a)), float(50 + 30 * np.sin(a))) for a in t]), (0, 2, False, [20], bend), (0, 3, False, [], [(1.0, 1.0)]), (0, 4, False, None, None)]
    df = spark.createDataFrame(rows, "image_id long, arc_id long, closed boolean, corners array<int>, points array<struct<x: double, y: double>>")
    df.createOrReplaceTempView("polylines")
    fit.register_fit(spark)
    got = spark.sql("SELECT arc_id, q.* FROM polylines, LATERAL fit_curve(points, corners, closed, 0.5) q").collect()
    found = {a: [tuple(r)[2:] for r in sorted((r for r in got if r.arc_id == a), key=lambda r: r.seq)] for a in {r.arc_id for r in got}}
    want = {r.arc_id: [tuple(c) for c in r.cubics] for r in fit.fit_arcs(df.where("points IS NOT NULL"), 0.5).collect() if r.cubics}
    assert found == want and set(want) == {1, 2}
