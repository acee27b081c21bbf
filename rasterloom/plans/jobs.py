"""Many jobs in one plan: options are columns, and jobs share what their options have in common."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.operators import boundary, corners, fit, palette as pal, pre, segment, svg
from rasterloom.operators.graph import cut
from rasterloom.plans.store import StageStore
from rasterloom.plans.vectorize import Options
from rasterloom.sources.raster import fingerprint

TONE = ("flatten", "blur_radius", "saturation", "black_point", "white_point")
#: Options that each stage looks at beside those of the stages before it.
OWN = {"pre": TONE, "palette": ("color_count",), "segment": ("despeckle_size", "gap_closing"), "fit": ("smoothness",)}
SCHEMA = """job_id long, image_id long, color_count int, smoothness double, despeckle_size int, gap_closing double, black_point double, white_point double, flatten double,
 blur_radius double, saturation double, optimize boolean, stacked_shapes boolean, merge_paths boolean, transparent_bg boolean, color_overrides array<string>"""


def job_rows(spark: SparkSession, jobs: list[tuple[int, int, Options]]) -> DataFrame:
    """Jobs (job_id, image_id, options) as rows with a column for each option; a colour count of null is 'auto'."""
    names = [f.split()[0] for f in SCHEMA.split(",")]
    rows = []
    for job, image, o in jobs:
        v = asdict(o) | {"job_id": job, "image_id": image, "color_count": None if o.color_count == "auto" else int(o.color_count), "color_overrides": list(o.color_overrides or ())}
        kinds = {"despeckle_size": int} | {c: float for c in ("smoothness", "gap_closing", *TONE)}
        rows.append(tuple(kinds[c](v[c]) if c in kinds else v[c] for c in names))
    return spark.createDataFrame(rows, SCHEMA)


def units(jobs: DataFrame, prints: DataFrame) -> DataFrame:
    """``jobs`` with the key of the unit that each stage computes for them: the image's content and the options so far."""
    keyed, sofar = jobs.join(prints.select("image_id", "print"), "image_id"), ["print"]
    for stage, own in OWN.items():
        sofar += own
        keyed = keyed.withColumn(f"{stage}_unit", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("auto")) for c in sofar]))
    return keyed


def rekey(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` under the keys that ``links`` (old, image_id) gives to theirs; several keys may share rows."""
    return rows.withColumnRenamed("image_id", "old").join(links.select("old", "image_id"), "old").drop("old")


def vectorize_jobs(pixels: DataFrame, jobs: DataFrame, store: StageStore | None = None) -> DataFrame:
    """(job_id, svg, path_count, point_count) of jobs with ``SCHEMA``'s columns.

    All jobs go through each stage together. A stage computes a unit once for all jobs whose
    images have the same content and whose options up to that stage agree, and not at all if
    ``store`` has it from an earlier run. Jobs whose image has no pixels give no row.
    """
    store = store or StageStore(pixels.sparkSession)
    prints = cut(fingerprint(pixels))
    work = cut(units(jobs, prints))
    one = lambda stage, *also: work.groupBy(F.col(f"{stage}_unit").alias("image_id")).agg(*[F.min(c).alias(c) for c in also])

    def tone(missing):
        first = prints.groupBy("print").agg(F.min("image_id").alias("old"))  # one image of each content
        links = missing.join(first, "print")
        return {"pixels": pre.preprocess_each(rekey(pixels, links), missing)}

    px = store.results("pre", one("pre", "print", *TONE), tone)["pixels"]

    def colours(missing):
        return {"palette": pal.estimate_palette(cut(rekey(px, missing.withColumnRenamed("pre_unit", "old"))), missing.select("image_id", F.col("color_count").alias("k")))}

    palettes = store.results("palette", one("palette", "pre_unit", "color_count"), colours)["palette"]

    def shapes(missing):
        mine, palette = (cut(rekey(df, missing.withColumnRenamed(c, "old"))) for df, c in ((px, "pre_unit"), (palettes, "palette_unit")))
        labelled = cut(pal.nearest_palette(mine, palette))
        radius = F.least(F.lit(segment.MAX_RADIUS), F.greatest(F.lit(0), F.floor(F.col("gap_closing") + 0.5)))
        gaps = missing.select("image_id", radius.cast("int").alias("radius"))
        closed = None
        for r in sorted(x.radius for x in gaps.select("radius").distinct().collect()):  # 0 to 9
            part = segment.close_gaps(labelled.join(gaps.where(F.col("radius") == r), "image_id", "left_semi"), palette, r)
            closed = part if closed is None else closed.unionByName(part)
        parts = cut(segment.despeckle(cut(segment.regions(closed)), missing.select("image_id", F.col("despeckle_size").alias("least"))))
        firsts, edges = cut(segment.region_sizes(parts)), cut(boundary.boundary_edges(parts))
        walks = cut(boundary.traversals(boundary.trace(edges), boundary.refined_edges(edges, parts, palette)))
        arcs, refs = (cut(df) for df in boundary.shared_arcs(walks, firsts))
        areas = boundary.region_areas(boundary.loop_areas(arcs, refs))
        turned = F.when(F.col("closed"), corners.closed_corners(F.col("points"))).otherwise(corners.open_corners(F.col("points")))
        return {"firsts": firsts, "refs": refs, "areas": areas, "arcs": arcs.withColumn("corners", turned)}

    shape = store.results("segment", one("segment", "pre_unit", "palette_unit", "despeckle_size", "gap_closing"), shapes)

    def curves(missing):
        links = missing.withColumnRenamed("segment_unit", "old")
        arcs = rekey(shape["arcs"], links).join(missing.select("image_id", "smoothness"), "image_id")
        return {"cubics": fit.fit_arcs(arcs, 0.25 + 1.75 * F.col("smoothness"))}

    cubics = store.results("fit", one("fit", "segment_unit", "smoothness"), curves)["cubics"]
    links = lambda stage: work.select(F.col(f"{stage}_unit").alias("old"), F.col("job_id").alias("image_id"))
    way = F.when(F.col("reversed"), fit.reverse_cubics(F.col("cubics"))).otherwise(F.col("cubics"))
    used = rekey(shape["refs"], links("segment")).join(rekey(cubics, links("fit")), ["image_id", "arc_id"])
    chains = used.select("image_id", "region", "loop", "part", way.alias("w")).groupBy("image_id", "region", "loop").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "w"))), lambda v: v["w"])).alias("chain"))
    flags = work.select(F.col("job_id").alias("image_id"), "optimize", "stacked_shapes")
    areas = rekey(shape["areas"], links("segment"))
    # A stacked shape is solid: only its largest loop stays.
    kept = chains.where(F.size("chain") > 0).join(flags, "image_id").join(areas, ["image_id", "region"]).where(~F.col("stacked_shapes") | (F.col("loop") == F.col("outer")))
    text = F.when(F.col("optimize"), svg.path_compact(F.col("chain"))).otherwise(svg.path_plain(F.col("chain")))
    loops = kept.select("image_id", "region", "loop", "area", (3 * F.size("chain") + 1).alias("points"), text.alias("d"))
    paths = loops.groupBy("image_id", "region").agg(F.first("area").alias("area"), F.sum("points").alias("points"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("loop", "d"))), lambda v: v["d"]), "").alias("d"))
    paths = cut(paths.join(rekey(shape["firsts"], links("segment")).select("image_id", "region", "color_idx", "first_pixel"), ["image_id", "region"]))
    sizes = prints.select(F.col("image_id").alias("source"), "width", "height")
    images = work.select(F.col("job_id").alias("image_id"), F.col("image_id").alias("source"), F.col("stacked_shapes").alias("stacked"), F.col("merge_paths").alias("merge"), F.col("transparent_bg").alias("transparent"), F.col("color_overrides").alias("overrides"))
    out = svg.assemble_flagged(paths, rekey(palettes, links("palette")), images.join(sizes, "source"))
    points = paths.groupBy("image_id").agg(F.sum("points").alias("point_count"))
    return out.join(points, "image_id", "left").select(F.col("image_id").alias("job_id"), "svg", "path_count", F.coalesce("point_count", F.lit(0)).alias("point_count"))
