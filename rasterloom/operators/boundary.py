"""Region boundaries: directed lattice edges, sub-pixel points, loops and shared arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .graph import cut, cut_counting
from .palette import palette_array


def boundary_edges(px: DataFrame) -> DataFrame:
    """Directed unit edges between regions, and against the outside, each once for either region.

    Edges keep their region on the right, seen with y downwards. (ax, ay) is the pixel above or
    left of the edge, (bx, by) the other; ``nbr`` is the region across, -1 outside. Undirected
    edges have ids 2 V (horizontal) and 2 V + 1 (vertical), V = y (width + 1) + x.
    """
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    base = px.select("image_id", "width", "height", "y", "x", "region", *[F.coalesce(f("region").over(w), F.lit(-1)).alias(n) for n, f, w in (("up", F.lag, col), ("down", F.lead, col), ("left", F.lag, row), ("right", F.lead, row))])
    x, y, v = F.col("x"), F.col("y"), lambda x, y: (y.cast("long") * (F.col("width") + 1) + x) * 2

    def edge(nbr, x0, y0, x1, y1, eid, ax, ay, bx, by):
        names = ("x0", "y0", "x1", "y1", "ax", "ay", "bx", "by")
        cols = [c.cast("int").alias(n) for n, c in zip(names, (x0, y0, x1, y1, ax, ay, bx, by))]
        return F.struct(F.col(nbr).cast("long").alias("nbr"), eid.alias("edge_id"), *cols)

    sides = F.array(
        edge("up", x, y, x + 1, y, v(x, y), x, y - 1, x, y), edge("right", x + 1, y, x + 1, y + 1, v(x + 1, y) + 1, x, y, x + 1, y),
        edge("down", x + 1, y + 1, x, y + 1, v(x, y + 1), x, y, x, y + 1), edge("left", x, y + 1, x, y, v(x, y) + 1, x - 1, y, x, y))
    return base.select("image_id", "width", "height", "region", F.explode(sides).alias("e")).where("e.nbr <> region").select("image_id", "width", "height", "region", "e.*")


def coverage(pixel: Column, ci: Column, cj: Column) -> Column:
    """Share of colour ci in a pixel taken as a mix of ci and cj."""
    axis, off = [ci[c] - cj[c] for c in "rgb"], [pixel[c] - cj[c] for c in "rgb"]
    len2 = axis[0] * axis[0] + axis[1] * axis[1] + axis[2] * axis[2]
    dot = off[0] * axis[0] + off[1] * axis[1] + off[2] * axis[2]
    return F.when(len2 == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.when(len2 == 0, 1).otherwise(len2))))


def refined_edges(edges: DataFrame, px: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, edge_id, mx, my): one point for each undirected edge, at the sub-pixel place of the border."""
    once = edges.groupBy("image_id", "edge_id").agg(*[F.first(c).alias(c) for c in ("width", "height", "ax", "ay", "bx", "by")])
    pixel = px.join(palette_array(palette), "image_id").select("image_id", "x", "y", F.struct("r", "g", "b", F.element_at("colors", F.col("color_idx") + 1).alias("k")).alias("p"))
    side = lambda s: pixel.select("image_id", F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"), F.col("p").alias(s))
    both = once.join(side("a"), ["image_id", "ax", "ay"], "left").join(side("b"), ["image_id", "bx", "by"], "left")
    a, b = F.col("a"), F.col("b")
    t = F.greatest(F.lit(-0.5), F.least(F.lit(1.5), coverage(a, a["k"], b["k"]) + coverage(b, a["k"], b["k"]) - 0.5))
    shift = F.when(a.isNull() | b.isNull(), 0.0).otherwise(t - 0.5)
    at = lambda p: (F.col(f"a{p}") + F.col(f"b{p}") + 1) / 2 + (F.col(f"b{p}") - F.col(f"a{p}")) * shift
    return both.select("image_id", "edge_id", at("x").alias("mx"), at("y").alias("my"))


def junctions(edges: DataFrame) -> DataFrame:
    """(image_id, x, y, n): lattice vertices where three or more boundary edges meet."""
    once = edges.groupBy("image_id", "edge_id").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])
    # The least and greatest corner of an undirected edge are its ends whichever way it was walked.
    ends = once.select("image_id", F.explode(F.array(F.struct(F.least("x0", "x1").alias("x"), F.least("y0", "y1").alias("y")), F.struct(F.greatest("x0", "x1").alias("x"), F.greatest("y0", "y1").alias("y")))).alias("v"))
    return ends.groupBy("image_id", "v.x", "v.y").agg(F.count("*").alias("n")).where("n >= 3")


def lattice_area(edges: DataFrame) -> DataFrame:
    """(image_id, region, area): signed area inside a region's loops, which is its number of pixels."""
    return edges.groupBy("image_id", "region").agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area"))


def successors(edges: DataFrame) -> DataFrame:
    """Add ``next``: the edge id at which a region's walk goes on.

    Where two edges of a region leave a vertex the walk takes the one that turns clockwise.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    out = edges.select("image_id", "region", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("edge_id").alias("to"), dx.alias("ox"), dy.alias("oy"))
    turn = dx * F.col("oy") - dy * F.col("ox")
    return edges.join(out, ["image_id", "region", "x1", "y1"]).groupBy("image_id", "region", "edge_id").agg(F.max_by("to", turn).alias("next"))


def trace(edges: DataFrame) -> DataFrame:
    """Add ``loop`` and ``seq`` to a region's edges: closed walks, each from its topmost edge, whose id names the loop.

    Every edge looks ahead for the first edge of its loop, twice as far in each round; rounds end
    when no edge finds an earlier one. Edges are joined by their own key, so a region with very
    many edges is spread like any other.
    """
    edges = cut(edges.select("image_id", "region", "edge_id", "nbr", "x0", "y0", "x1", "y1"))
    # Horizontal edges, which have even ids, come before vertical ones.
    order = F.struct((F.col("edge_id") % 2).alias("k"), F.col("edge_id").alias("e"))
    ahead = cut(successors(edges).select("image_id", "region", "edge_id", "next", order.alias("least"), F.lit(0).cast("long").alias("dist")))
    reach = 1
    while True:
        far = ahead.select("image_id", "region", F.col("edge_id").alias("next"), F.col("next").alias("far"), F.col("least").alias("far_least"), F.col("dist").alias("far_dist"))
        better = F.col("far_least") < F.col("least")
        ahead, changed = cut_counting(ahead.join(far, ["image_id", "region", "next"]).select(
            "image_id", "region", "edge_id", F.col("far").alias("next"), F.when(better, F.col("far_least")).otherwise(F.col("least")).alias("least"),
            F.when(better, F.col("far_dist") + reach).otherwise(F.col("dist")).alias("dist"), better.alias("better")), "better")
        reach *= 2
        if changed == 0:
            break
    named = ahead.select("image_id", "region", "edge_id", F.col("least.e").alias("loop"), "dist")
    sizes = named.groupBy("image_id", "region", "loop").agg(F.count("*").alias("m"))
    placed = edges.join(named, ["image_id", "region", "edge_id"]).join(sizes, ["image_id", "region", "loop"])
    return placed.select("image_id", "region", "edge_id", "nbr", "x0", "y0", "x1", "y1", "loop", F.pmod(F.col("m") - F.col("dist"), F.col("m")).cast("int").alias("seq"))


def traversals(traced: DataFrame, points: DataFrame) -> DataFrame:
    """Arcs as regions walk them: loops cut where the neighbour changes.

    (image_id, region, loop, part, arc_id, closed, points): parts start at the loop's first
    change; an arc's id is its least edge id; open arcs begin and end at lattice vertices.
    """
    loop = W.partitionBy("image_id", "region", "loop")
    walk = loop.orderBy("seq")
    e = traced.join(points, ["image_id", "edge_id"])
    whole = walk.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.lag("nbr").over(walk), F.last("nbr").over(whole))
    e = e.withColumn("change", (F.col("nbr") != before).cast("int")).withColumn("m", F.count("*").over(loop))
    start = F.min(F.when(F.col("change") == 1, F.col("seq"))).over(loop)
    e = e.withColumn("start", start).withColumn("place", F.pmod(F.col("seq") - F.coalesce("start", F.lit(0)), F.col("m").cast("int")))
    e = e.withColumn("part", F.sum("change").over(loop.orderBy("place")))
    step = F.struct("place", F.col("mx").cast("double").alias("x"), F.col("my").cast("double").alias("y"), "x0", "y0", "x1", "y1")
    arcs = e.groupBy("image_id", "region", "loop", "part").agg(F.min("edge_id").alias("arc_id"), F.max(F.col("start").isNull()).alias("closed"), F.sort_array(F.collect_list(step)).alias("s"))
    mids = F.transform("s", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    end = lambda v, k: F.array(F.struct(v[f"x{k}"].cast("double").alias("x"), v[f"y{k}"].cast("double").alias("y")))
    pts = F.when(F.col("closed"), mids).otherwise(F.concat(end(F.get("s", F.lit(0)), 0), mids, end(F.element_at("s", -1), 1)))
    return arcs.select("image_id", "region", "loop", "part", "arc_id", "closed", pts.alias("points"))


def shared_arcs(walks: DataFrame, first_pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs, refs): each arc once, as the region of the smaller first pixel walks it, and who uses it which way."""
    ordered = walks.join(first_pixels.select("image_id", "region", "first_pixel"), ["image_id", "region"])
    one = ordered.groupBy("image_id", "arc_id").agg(F.min(F.struct("first_pixel", "loop", "part", "closed", "points")).alias("a"))
    arcs = one.select("image_id", "arc_id", "a.closed", "a.points")
    refs = ordered.join(one.select("image_id", "arc_id", F.col("a.first_pixel").alias("owner")), ["image_id", "arc_id"])
    return arcs, refs.select("image_id", "region", "first_pixel", "loop", "part", "arc_id", (F.col("first_pixel") != F.col("owner")).alias("reversed"))


def polygon_area(points: Column) -> Column:
    """Shoelace area of a closed polyline of (x, y) structs."""
    n = F.size(points)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(points, i + 1)["x"] * F.element_at(points, (i + 1) % n + 1)["y"] - F.element_at(points, (i + 1) % n + 1)["x"] * F.element_at(points, i + 1)["y"])
    return F.when(n == 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2)


def loop_areas(arcs: DataFrame, refs: DataFrame) -> DataFrame:
    """(image_id, region, loop, area): the absolute area of each refined loop."""
    walked = refs.join(arcs, ["image_id", "arc_id"])
    way = F.when(F.col("reversed"), F.reverse("points")).otherwise(F.col("points"))
    way = F.when(F.col("closed"), way).otherwise(F.slice(way, F.lit(2), F.size(way) - 1))
    loops = walked.select("image_id", "region", "loop", "part", way.alias("w")).groupBy("image_id", "region", "loop").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "w"))), lambda v: v["w"])).alias("p"))
    return loops.select("image_id", "region", "loop", F.abs(polygon_area(F.col("p"))).alias("area"))


def region_areas(areas: DataFrame) -> DataFrame:
    """(image_id, region, area, outer): the largest area of a region's loops and the first loop that has it; holes are not subtracted."""
    return areas.groupBy("image_id", "region").agg(F.max("area").alias("area"), F.max_by("loop", F.struct("area", -F.col("loop"))).alias("outer"))
