"""Segmentation: morphology, components, despeckling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType

from rasterloom.functions.workers import reach_workers

from .graph import components, cut, cut_counting
from .palette import distance2, ordinal, palette_array

# Gap guard ratio, passes of despeckling, largest closing radius.
GUARD, PASSES, MAX_RADIUS = 1.3, 8, 9
#: A merge that has not run and may.
OPEN = "NOT done AND s <> o AND ns < least"
#: Pixels up to which an extreme is a window's frame.
FRAME = 32
#: Side of the square tiles that components are first found in.
TILE = 256


def line_extreme(mask: DataFrame, radius: int, op, along: str) -> DataFrame:
    """``m`` as the extreme over ``radius`` pixels to either side in a line; outside pixels are ignored.

    Beyond FRAME pixels a window's frame would cost its width at every pixel. The line is then cut
    into blocks of the width: every frame is the end of one block and the beginning of the next,
    whose extremes run along the blocks, so the work does not grow with the radius.
    """
    other, size = ("y" if along == "x" else "x"), 2 * radius + 1
    line = W.partitionBy("image_id", other).orderBy(along)
    if size <= FRAME:
        return mask.withColumn("m", op("m").over(line.rowsBetween(-radius, radius)))
    block = W.partitionBy("image_id", other, "block")
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    placed = mask.withColumn("place", F.row_number().over(line) - 1).withColumn("block", F.floor(F.col("place") / size))
    runs = placed.withColumn("head", op("m").over(upto(block.orderBy(along)))).withColumn("tail", op("m").over(upto(block.orderBy(F.col(along).desc()))))
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # The frame's last pixel, or the line's where it is shorter; its first one, none where the line begins in it.
    at = runs.withColumn("end", F.coalesce(F.lead("head", radius).over(line), F.last("head").over(whole))).withColumn("end_block", F.coalesce(F.lead("block", radius).over(line), F.last("block").over(whole)))
    at = at.withColumn("begin", F.lag("tail", radius).over(line)).withColumn("begin_block", F.lag("block", radius).over(line))
    both = F.greatest("begin", "end") if op is F.max else F.least("begin", "end")
    # A frame that the line cuts off lies in one block: with the line's first pixel at its beginning, or with its last at its end.
    value = F.when(F.col("begin").isNull(), F.col("end")).when(F.col("begin_block") == F.col("end_block"), F.when(F.col("place") + radius < F.col("last"), F.col("end")).otherwise(F.col("begin"))).otherwise(both)
    return at.withColumn("last", F.last("place").over(whole)).withColumn("m", value).select(*mask.columns)


def dilate(mask: DataFrame, radius: int, op=F.max) -> DataFrame:
    """Chebyshev dilation of column ``m`` along rows and then columns."""
    return line_extreme(line_extreme(mask, radius, op, "x"), radius, op, "y")


def erode(mask: DataFrame, radius: int) -> DataFrame:
    return dilate(mask, radius, F.min)


def close_mask(mask: DataFrame, radius: int) -> DataFrame:
    return erode(dilate(mask, radius), radius)


def color_order(labelled: DataFrame) -> DataFrame:
    """(image_id, color_idx, n, place, last): colours by frequency and index; the most frequent is the background."""
    by = W.partitionBy("image_id")
    freq = labelled.groupBy("image_id", "color_idx").agg(F.count("*").alias("n"))
    return freq.withColumn("place", F.row_number().over(by.orderBy("n", "color_idx")) - 1).withColumn("last", F.col("place") == F.count("*").over(by) - 1)


def close_gaps(labelled: DataFrame, palette: DataFrame, gap: float) -> DataFrame:
    """Close gaps of each colour, rarest first; a pixel changes once at most and only if the colour is near enough."""
    radius = min(MAX_RADIUS, max(0, int(gap + 0.5)))
    if radius == 0:
        return labelled
    order = color_order(labelled)
    images = order.where("NOT last").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("place", "color_idx"))).alias("turns"))
    px = labelled.join(images, "image_id", "left").join(palette_array(palette), "image_id").withColumn("flipped", F.lit(False))
    color = lambda k: F.element_at("colors", k + 1)
    for turn in range(15):
        px = px.withColumn("c", F.get(F.col("turns.color_idx"), F.lit(turn))).withColumn("m", F.coalesce((F.col("color_idx") == F.col("c")).cast("int"), F.lit(0)))
        px = close_mask(px, radius)
        near = F.sqrt(distance2("r", "g", "b", color(F.col("c")))) <= GUARD * F.sqrt(distance2("r", "g", "b", color(F.col("color_idx"))))
        flip = F.coalesce((F.col("m") == 1) & (F.col("color_idx") != F.col("c")) & ~F.col("flipped") & near, F.lit(False))
        px = px.withColumn("flip", flip).withColumn("color_idx", F.when(F.col("flip"), F.col("c")).otherwise(F.col("color_idx"))).withColumn("flipped", F.col("flipped") | F.col("flip"))
        if turn % 3 == 2:
            px = cut(px)
        if turn + 1 >= 2 and turn % 3 == 2 and px.where(F.size("turns") > turn + 1).limit(1).count() == 0:
            break
    return px.select(*labelled.columns)


def row_runs(labelled: DataFrame) -> DataFrame:
    """(image_id, y, run, x0, x1, color_idx): maximal runs of one colour in a row; run is the first pixel's place."""
    line = W.partitionBy("image_id", "y").orderBy("x")
    change = F.coalesce((F.lag("color_idx").over(line) != F.col("color_idx")).cast("int"), F.lit(1))
    runs = labelled.select("image_id", "width", "y", "x", "color_idx", change.alias("change")).withColumn("k", F.sum("change").over(line))
    out = runs.groupBy("image_id", "width", "y", "k").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("color_idx").alias("color_idx"))
    return out.select("image_id", "y", (F.col("y").cast("long") * F.col("width") + F.col("x0")).alias("run"), "x0", "x1", "color_idx")


def run_adjacency(runs: DataFrame) -> DataFrame:
    """(image_id, a, b): overlapping runs of one colour in neighbouring rows."""
    below = runs.select("image_id", (F.col("y") - 1).alias("y"), F.col("run").alias("b"), F.col("x0").alias("l"), F.col("x1").alias("h"), "color_idx")
    joined = runs.join(below, ["image_id", "y", "color_idx"]).where((F.col("x0") <= F.col("h")) & (F.col("l") <= F.col("x1")))
    return joined.select("image_id", F.col("run").alias("a"), "b")


def tile_labels(colors: np.ndarray) -> np.ndarray:
    """The place of the first cell of each cell's 4-connected component of one colour; -1 is no colour.

    Roots take the least root across their edges and then their roots' roots, until nothing changes.
    """
    h, w = colors.shape
    at = np.arange(h * w).reshape(h, w)
    right = (colors[:, 1:] == colors[:, :-1]) & (colors[:, 1:] >= 0)
    down = (colors[1:] == colors[:-1]) & (colors[1:] >= 0)
    a, b = np.concatenate((at[:, :-1][right], at[:-1][down])), np.concatenate((at[:, 1:][right], at[1:][down]))
    root = at.ravel().copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root.reshape(h, w)
        root = new


def tile_parts(labelled: DataFrame, tile: int) -> DataFrame:
    """Add ``part``, the place of the first pixel of a pixel's component inside its tile."""
    schema = labelled.select("*", F.lit(0).cast("long").alias("part")).schema
    arrow = to_arrow_schema(schema)
    names = labelled.columns

    def label(table: pa.Table) -> pa.Table:
        y, x, width, color = (table[c].to_numpy().astype(np.int64) for c in ("y", "x", "width", "color_idx"))
        y0, x0 = y // tile * tile, x // tile * tile
        cells = np.full((int((y - y0).max()) + 1, int((x - x0).max()) + 1), -1)
        cells[y - y0, x - x0] = color
        root = tile_labels(cells)[y - y0, x - x0]
        part = (root // cells.shape[1] + y0) * width + root % cells.shape[1] + x0
        return pa.Table.from_arrays([*(table[c].cast(arrow.field(c).type) for c in names), pa.array(part)], schema=arrow)

    reach_workers(labelled.sparkSession)
    place = [F.col("image_id"), F.floor(F.col("y") / tile), F.floor(F.col("x") / tile)]
    return labelled.groupBy(*place).applyInArrow(label, schema)


def border_pairs(parts: DataFrame, tile: int) -> DataFrame:
    """(image_id, a, b): parts of one colour that touch across a border of two tiles."""
    out = None
    for p in ("x", "y"):
        before = parts.where((F.col(p) + 1) % tile == 0).select("image_id", *[(F.col(c) + 1 if c == p else F.col(c)).alias(c) for c in ("y", "x")], "color_idx", F.col("part").alias("a"))
        after = parts.where(F.col(p) % tile == 0).select("image_id", "y", "x", "color_idx", F.col("part").alias("b"))
        pairs = before.join(after, ["image_id", "y", "x", "color_idx"]).select("image_id", "a", "b")
        out = pairs if out is None else out.union(pairs)
    return out.distinct()


def regions(labelled: DataFrame, tile: int = TILE) -> DataFrame:
    """Add ``region``, the first pixel's place of the 4-connected component of equal colour.

    Components are found inside tiles, each in one task; only parts that touch a border of
    tiles are joined with each other, so no task or join key holds more than a tile's pixels.
    """
    parts = cut(tile_parts(labelled, tile))
    pairs, met = cut_counting(border_pairs(parts, tile), F.lit(True))
    if met == 0:  # images of one tile
        return parts.withColumnRenamed("part", "region")
    ends = pairs.select("image_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = components(pairs, ends).select("image_id", F.col("node").alias("part"), "comp")
    return parts.join(roots, ["image_id", "part"], "left").select(*labelled.columns, F.coalesce("comp", "part").cast(LongType()).alias("region"))


def region_sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id", "region").agg(F.count("*").alias("size"), F.min("color_idx").alias("color_idx"), F.min(ordinal()).alias("first_pixel"))


def with_least(rows: DataFrame, least: int | DataFrame) -> DataFrame:
    """Add ``least``, one number for all images or from rows (image_id, least)."""
    return rows.join(least.select("image_id", "least"), "image_id") if isinstance(least, DataFrame) else rows.withColumn("least", F.lit(least))


def border_counts(px: DataFrame, least: int | DataFrame) -> DataFrame:
    """(image_id, small, other, n, first): shared edges of regions under ``least`` pixels, and where the first was met."""
    sizes = with_least(region_sizes(px).select("image_id", "region", "size"), least)
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    near = px.select("image_id", ordinal().alias("p"), F.col("region").alias("a"), F.array(F.struct(F.lead("region").over(row).alias("b"), F.lit(0).alias("k")), F.struct(F.lead("region").over(col).alias("b"), F.lit(1).alias("k"))).alias("near"))
    edges = near.select("image_id", "p", "a", F.explode("near").alias("e")).where("e.b <> a")
    sides = F.array(F.struct(F.col("a").alias("small"), F.col("e.b").alias("other"), F.lit(0).alias("s")), F.struct(F.col("e.b").alias("small"), F.col("a").alias("other"), F.lit(1).alias("s")))
    flat = edges.select("image_id", "p", F.col("e.k").alias("k"), F.explode(sides).alias("v")).select("image_id", "v.small", "v.other", (F.col("p") * 4 + F.col("k") * 2 + F.col("v.s")).alias("at"))
    counted = flat.groupBy("image_id", "small", "other").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return counted.join(sizes.withColumnRenamed("region", "small"), ["image_id", "small"]).where("size < least").drop("size", "least")


def despeckle_targets(borders: DataFrame) -> DataFrame:
    """(image_id, small, other, first): the neighbour with the longest border, the first met of equal ones."""
    return borders.groupBy("image_id", "small").agg(F.max_by("other", F.struct("n", -F.col("first"))).alias("other"), F.min("first").alias("first"))


def ordered_merges(targets: DataFrame, sizes: DataFrame, least: int | DataFrame) -> DataFrame:
    """(image_id, region, root) after each ``small`` region, in order of ``first``, went into its ``other``.

    A merge looks at what earlier ones left: both regions count as what they have become, and one
    that has grown to ``least`` pixels stays. Regions of ``least`` pixels or more never move, so
    merges meet only in small ones. In each round those merges run that are the earliest of all
    that touch their small regions; the others then see the grown regions. Rounds are joins.
    """
    size = lambda c, n: sizes.select("image_id", F.col("region").alias(c), F.col("size").alias(n))
    state = targets.join(size("small", "ns"), ["image_id", "small"]).join(size("other", "no"), ["image_id", "other"])
    state, waiting = cut_counting(with_least(state.select("image_id", "first", F.col("small").alias("s"), F.col("other").alias("o"), "ns", "no", F.lit(False).alias("done")), least), OPEN)
    while waiting:
        live = state.where(OPEN)
        touched = live.select("image_id", "first", F.explode(F.when(F.col("no") < F.col("least"), F.array("s", "o")).otherwise(F.array("s"))).alias("r")).groupBy("image_id", "r").agg(F.min("first").alias("m"))
        turn = lambda c: touched.select("image_id", F.col("r").alias(c), F.col("m").alias(f"m{c}"))  # noqa: B023, E731
        ready = live.join(turn("s"), ["image_id", "s"]).join(turn("o"), ["image_id", "o"], "left")
        runs = cut(ready.where("first = ms AND (no >= least OR first = mo)").select("image_id", "first", "s", "o", "ns", "no", "least"))
        gain = runs.groupBy("image_id", F.col("o").alias("r")).agg(F.sum("ns").alias("gain"))
        moved = runs.select("image_id", F.col("s").alias("r"), F.col("o").alias("to"), F.col("no").alias("nt"))
        # What a region has become, and its size, for either side of the merges that wait.
        rest = state.join(runs.select("image_id", "first"), ["image_id", "first"], "left_anti").where("done OR (s <> o AND ns < least)")
        for c, n in (("s", "ns"), ("o", "no")):
            rest = rest.join(moved.withColumnRenamed("r", c), ["image_id", c], "left")
            hit = F.col("to").isNotNull() if c == "o" else F.col("to").isNotNull() & ~F.col("done")
            rest = rest.withColumn(c, F.when(hit, F.col("to")).otherwise(F.col(c))).withColumn(n, F.when(hit, F.col("nt")).otherwise(F.col(n))).drop("to", "nt")
            rest = rest.join(gain.withColumnRenamed("r", c), ["image_id", c], "left").withColumn(n, F.col(n) + F.coalesce("gain", F.lit(0))).drop("gain")
        state, waiting = cut_counting(rest.unionByName(runs.withColumn("done", F.lit(True))), OPEN)
    return state.where("done").select("image_id", F.col("s").alias("region"), F.col("o").alias("root"))


def despeckle(px: DataFrame, least: int | DataFrame) -> DataFrame:
    """Merge regions under ``least`` pixels into their longest neighbour, up to 8 passes; see ``ordered_merges``."""
    if not isinstance(least, DataFrame) and least <= 1:
        return px
    for _ in range(PASSES):
        targets, small = cut_counting(despeckle_targets(border_counts(px, least)), F.lit(True))
        if small == 0:
            break
        moves = ordered_merges(targets, region_sizes(px).select("image_id", "region", "size"), least)
        px = cut(px.join(moves, ["image_id", "region"], "left").withColumn("region", F.coalesce("root", "region")).drop("root"))
    # A region's colour is its root's, whatever its absorbed pixels had.
    roots = px.where(ordinal() == F.col("region")).select("image_id", "region", F.col("color_idx").alias("root_color"))
    return px.join(roots, ["image_id", "region"]).withColumn("color_idx", F.col("root_color")).drop("root_color")
