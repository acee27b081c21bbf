"""The whole plan: pixels in, one SVG for each image out."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rasterloom.operators import boundary, corners, fit, palette as pal, pre, segment, svg
from rasterloom.operators.graph import cut


@dataclass(frozen=True)
class Options:
    """Options and their defaults."""

    color_count: int | str = "auto"
    smoothness: float = 0.5
    despeckle_size: int = 8
    gap_closing: float = 0
    black_point: float = 0
    white_point: float = 255
    flatten: float = 0
    blur_radius: float = 0
    saturation: float = 1
    optimize: bool = True
    stacked_shapes: bool = False
    merge_paths: bool = True
    transparent_bg: bool = False
    color_overrides: tuple | None = None

    def key(self, stage: str) -> tuple:
        """The options that the results of a stage and of those before it depend on."""
        tone = (self.flatten, self.blur_radius, self.saturation, self.black_point, self.white_point)
        steps = {"pre": (), "palette": (self.color_count,), "segment": (self.color_count, self.despeckle_size, self.gap_closing)}
        return (stage, tone, *steps[stage])


class Vectorizer:
    """Runs the stages over one pixel relation and keeps each stage's result for option changes after it."""

    def __init__(self, pixels: DataFrame, palette_pixels: DataFrame | None = None):
        self.pixels, self.palette_pixels, self.cache, self.timings = pixels, palette_pixels, {}, {}

    def _stage(self, key: tuple, make):
        if key not in self.cache:
            began = time.time()
            self.cache[key] = make()
            self.timings[key[0]] = (time.time() - began) * 1000
        return self.cache[key]

    def side_outputs(self, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
        """The palette and the pixels after tone changes that ``run`` uses for these options."""
        px = self._stage(o.key("pre"), lambda: cut(self._tone(self.pixels, o)))
        source = px if self.palette_pixels is None else self._tone(self.palette_pixels, o)
        return self._stage(o.key("palette"), lambda: cut(pal.estimate_palette(source, o.color_count))), px

    def report(self, results: DataFrame) -> DataFrame:
        """(image_id, bytes, kb, total_ms): size of each document in UTF-8, and the milliseconds of all stages of the last runs."""
        size = F.octet_length("svg").cast("long")
        return results.select("image_id", size.alias("bytes"), (size / 1024).alias("kb"), F.lit(float(sum(self.timings.values()))).alias("total_ms"))

    def _tone(self, px: DataFrame, o: Options) -> DataFrame:
        return pre.preprocess(px, o.flatten, o.blur_radius, o.saturation, o.black_point, o.white_point)

    def run(self, o: Options = Options()) -> DataFrame:
        """(image_id, svg, path_count, point_count)."""
        palette, px = self.side_outputs(o)

        def segmented():
            labelled = segment.close_gaps(cut(pal.nearest_palette(px, palette)), palette, o.gap_closing)
            parts = cut(segment.despeckle(cut(segment.regions(labelled)), o.despeckle_size))
            firsts = cut(segment.region_sizes(parts))
            edges = cut(boundary.boundary_edges(parts))
            walks = cut(boundary.traversals(boundary.trace(edges), boundary.refined_edges(edges, parts, palette)))
            arcs, refs = boundary.shared_arcs(walks, firsts)
            arcs, refs = cut(arcs), cut(refs)
            return firsts, arcs, refs, cut(boundary.region_areas(boundary.loop_areas(arcs, refs)))

        firsts, arcs, refs, areas = self._stage(o.key("segment"), segmented)
        turned = arcs.withColumn("corners", F.when(F.col("closed"), corners.closed_corners(F.col("points"))).otherwise(corners.open_corners(F.col("points"))))
        began = time.time()
        cubics = cut(fit.fit_arcs(turned, 0.25 + 1.75 * o.smoothness))
        self.timings["fit"] = (time.time() - began) * 1000
        used = refs.join(cubics, ["image_id", "arc_id"])
        way = F.when(F.col("reversed"), fit.reverse_cubics(F.col("cubics"))).otherwise(F.col("cubics"))
        loops = used.select("image_id", "region", "loop", "part", way.alias("w")).groupBy("image_id", "region", "loop").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "w"))), lambda v: v["w"])).alias("chain"))
        loops = loops.where(F.size("chain") > 0)
        write = svg.path_compact if o.optimize else svg.path_plain
        texts = loops.select("image_id", "region", "loop", (3 * F.size("chain") + 1).alias("points"), write(F.col("chain")).alias("d"))
        paths = texts.groupBy("image_id", "region").agg(F.sum("points").alias("points"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("loop", "d"))), lambda v: v["d"]), "").alias("d"))
        if o.stacked_shapes:  # each shape is solid: only its largest loop stays
            outer = areas.select("image_id", "region", F.col("outer").alias("loop"))
            paths = texts.join(outer, ["image_id", "region", "loop"]).select("image_id", "region", "points", "d")
        paths = cut(paths.join(firsts.select("image_id", "region", "color_idx", "first_pixel"), ["image_id", "region"]).join(areas.drop("outer"), ["image_id", "region"]))
        images = self.pixels.groupBy("image_id").agg(F.first("width").alias("width"), F.first("height").alias("height"))
        out = svg.assemble(paths, palette, images, o.stacked_shapes, o.merge_paths, o.transparent_bg, list(o.color_overrides or ()))
        points = paths.groupBy("image_id").agg(F.sum("points").alias("point_count"))
        return out.join(points, "image_id", "left").withColumn("point_count", F.coalesce("point_count", F.lit(0)))


def vectorize(pixels: DataFrame, options: Options = Options(), palette_pixels: DataFrame | None = None) -> DataFrame:
    return Vectorizer(pixels, palette_pixels).run(options)
