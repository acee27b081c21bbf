"""Loops, arcs and shapes against a walk over the same edges, on seeded noise and pinched shapes."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import boundary, palette, segment, svg
from rasterloom.operators.graph import cut
from rasterloom.plans.vectorize import Options, Vectorizer
from rasterloom.sources import raster

COLORS = ((200, 30, 30), (245, 245, 245), (20, 30, 160), (60, 180, 90))


def image(spark, cells, image_id=0):
    """Pixels of a grid of colour numbers, and the palette."""
    h, w = cells.shape
    rows = [(image_id, w, h, y, x, *COLORS[int(cells[y, x])]) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "image_id long, width int, height int, y int, x int, r int, g int, b int")
    pal = spark.createDataFrame([(image_id, i, *c) for i, c in enumerate(COLORS)], "image_id long, color_idx int, r int, g int, b int")
    return px, pal


def walked(edges):
    """Loops of directed edges (x0, y0, x1, y1), each walked from its topmost edge."""
    order = sorted(edges, key=lambda e: (e[1] != e[3], min(e[1], e[3]), min(e[0], e[2])))
    out = defaultdict(list)
    for e in order:
        out[e[:2]].append(e)
    used, loops = set(), []
    for first in order:
        if first in used:
            continue
        loop, e = [], first
        while e not in used:
            used.add(e)
            loop.append(e)
            dx, dy = e[2] - e[0], e[3] - e[1]
            e = max(out[e[2:]], key=lambda n: dx * (n[3] - n[1]) - dy * (n[2] - n[0]))
        loops.append(loop)
    return loops


def traced(spark, cells):
    px, pal = image(spark, cells)
    parts = cut(segment.regions(palette.nearest_palette(px, pal)))
    edges = cut(boundary.boundary_edges(parts))
    return px, pal, parts, edges, cut(boundary.trace(edges))


@pytest.mark.parametrize("seed", [1, 99])
def test_loops_of_noise(spark, seed):
    cells = np.random.default_rng(seed).integers(0, 2 + seed % 2, (13, 17))
    px, pal, parts, edges, loops = traced(spark, cells)
    by = defaultdict(list)
    for r in edges.collect():
        by[r.region].append((r.x0, r.y0, r.x1, r.y1))
    found = defaultdict(lambda: defaultdict(dict))
    for r in loops.collect():
        found[r.region][r.loop][r.seq] = (r.x0, r.y0, r.x1, r.y1)
    for region, es in by.items():
        want = walked(es)
        got = [[steps[k] for k in range(len(steps))] for _, steps in sorted(found[region].items())]
        assert got == want
    sizes = {r.region: r.n for r in parts.groupBy("region").agg(F.count("*").alias("n")).collect()}
    area = {g: sum(a[0] * a[3] - a[2] * a[1] for loop in walked(es) for a in loop) / 2 for g, es in by.items()}
    assert area == sizes
    walks = boundary.traversals(loops, boundary.refined_edges(edges, parts, pal))
    arcs, refs = boundary.shared_arcs(walks, segment.region_sizes(parts))
    uses = refs.groupBy("arc_id").agg(F.count("*").alias("n"), F.sum(F.col("reversed").cast("int")).alias("r")).collect()
    assert all(u.n <= 2 and u.r == u.n - 1 for u in uses) and arcs.count() == len(uses)
    points = arcs.select("arc_id", F.posexplode("points").alias("i", "p")).select("arc_id", "i", "p.x", "p.y").collect()
    chains = defaultdict(list)
    for r in points:
        chains[r.arc_id].append((r.i, r.x, r.y))
    assert all(a[1:] != b[1:] for c in chains.values() for a, b in zip(sorted(c), sorted(c)[1:]))


def test_walk_goes_through_a_pinch(spark):
    letters = ("BAAA", "BABA", "BBAA", "BBBB")
    cells = np.array([[0 if c == "A" else 1 for c in line] for line in letters])
    loops = traced(spark, cells)[-1].groupBy("region", "loop").agg(F.count("*").alias("n")).collect()
    # The two B areas touch at a corner only, and the A area passes through that corner in one loop of 16 edges.
    assert sorted(r.n for r in loops) == [4, 16, 16]


def test_stacked_shape_keeps_the_largest_loop(spark):
    yy, xx = np.mgrid[0:24, 0:24]
    ring = ((abs(xx - 12) < 9) & (abs(yy - 12) < 9) & ~((abs(xx - 12) < 5) & (abs(yy - 12) < 5))).astype(int)
    _, _, parts, edges, loops = traced(spark, ring)
    px, pal = image(spark, ring)
    walks = boundary.traversals(loops, boundary.refined_edges(edges, parts, pal))
    arcs, refs = boundary.shared_arcs(walks, segment.region_sizes(parts))
    areas = boundary.loop_areas(arcs, refs)
    best = {r.region: r.area for r in boundary.region_areas(areas).collect()}
    assert best == {r.region: r.a for r in areas.groupBy("region").agg(F.max("area").alias("a")).collect()} and len(best) == 3
    v = Vectorizer(cut(px))
    stacked = v.run(Options(color_count=2, despeckle_size=1, stacked_shapes=True))
    doc = cut(stacked).first().svg
    assert doc.count("M") == 3 and "fill-rule" not in doc
    flat = v.run(Options(color_count=2, despeckle_size=1, merge_paths=False, color_overrides=("#123456",))).first().svg
    assert flat.count("M") == 5 and "fill-rule" in flat and 1 <= flat.count("#123456") <= 2
    sizes = v.report(spark.createDataFrame([(0, doc)], "image_id long, svg string")).first()
    assert sizes.bytes == len(doc.encode()) and sizes.total_ms > 0
    colours, tones = v.side_outputs(Options(color_count=2, despeckle_size=1))
    assert colours.count() == 2 and tones.count() == 24 * 24


def test_size_goes_into_the_first_tag(spark):
    row = spark.createDataFrame([('<svg xmlns="x" viewBox="0 0 3 2"></svg>', 3, 2)], "s string, w int, h int")
    assert row.select(svg.with_size(F.col("s"), F.col("w"), F.col("h"))).first()[0] == '<svg width="3" height="2" xmlns="x" viewBox="0 0 3 2"></svg>'


def png(cells) -> bytes:
    """An RGBA file of rows of (r, g, b, a)."""
    h, w = len(cells), len(cells[0])
    data = b"".join(b"\0" + bytes(v for p in line for v in p) for line in cells)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(data)) + part(b"IEND", b"")


def test_decode_sink_and_stream(spark, tmp_path):
    from rasterloom.streaming.images import vectorize_stream

    (tmp_path / "in").mkdir()
    red, clear = (200, 30, 30, 255), (10, 20, 30, 0)
    for k in range(2):
        (tmp_path / "in" / f"{k}.png").write_bytes(png([[red if 2 <= x < 8 and 2 <= y < 8 + k else clear for x in range(12)] for y in range(12)]))
    (tmp_path / "in" / "broken.png").write_bytes(b"no image")
    px = raster.decode_images(spark, str(tmp_path / "in"))
    assert px.count() == 288 and px.where("r = 200 AND g = 30 AND b = 30").count() == 36 + 42 and px.where("r = 255 AND g = 255 AND b = 255").count() == 288 - 78
    prints = raster.fingerprint(px).collect()
    assert len({r.print for r in prints}) == 2 and raster.fingerprint(px.limit(0)).count() == 0
    query = vectorize_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"), Options(color_count=2, despeckle_size=1))
    assert query.awaitTermination(240)
    text = ["\n".join(open(f).read() for f in sorted(d.glob("*.txt"))) for d in (tmp_path / "out").glob("batch=*/image_id=*")]
    assert len(text) == 2 and all(t.startswith("<svg") and t.count("<path") == 2 for t in text)


def test_palette_of_two_images_at_once(spark):
    cells = np.zeros((20, 20), dtype=int)
    cells[5:15, 5:15] = 1
    one, _ = image(spark, cells, 0)
    two, _ = image(spark, np.where(cells == 1, 2, 3), 1)
    found = defaultdict(set)
    for r in palette.estimate_palette(one.unionByName(two)).collect():
        found[r.image_id].add((r.r, r.g, r.b))
    assert found == {0: {COLORS[0], COLORS[1]}, 1: {COLORS[2], COLORS[3]}}
