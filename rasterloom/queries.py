"""One query for each raster operator, and DuckDB SQL for the same rows.

Queries return integers or text where engines could differ in the last bit of a double.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from rasterloom.functions.numeric import centi, fmt_centi, half_up, hex_color
from rasterloom.operators import boundary, corners, fit, jobs, palette as pal, pre, segment, svg
from rasterloom.operators.graph import cut, shared_folder
from rasterloom.plans import jobs as job_plans
from rasterloom.plans.vectorize import Options, vectorize
from rasterloom.sources import raster
from rasterloom.streaming import jobs as job_events

#: Palette of the fixed-palette queries, darkest first.
COLORS = ((20, 30, 40), (200, 40, 60), (60, 180, 90), (128, 128, 128), (250, 240, 230))


def fixed_palette(spark: SparkSession, images: int) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(COLORS)]
    one = spark.createDataFrame(rows, "color_idx int, r int, g int, b int")
    return spark.range(images).select(F.col("id").alias("image_id")).crossJoin(F.broadcast(one))


def _centers(spark: SparkSession, images: int) -> DataFrame:
    """The fixed palette as centres of each image."""
    c = lambda p, n: p[n].cast("double")
    colors = F.transform("colors", lambda p: pal.center(p["color_idx"], *[c(p, n) for n in "rgb"]))
    return pal.palette_array(fixed_palette(spark, images)).select("image_id", colors.alias("colors"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pal.nearest_palette(raster.raster_lineitem(spark, sf_dir), fixed_palette(spark, 3))


def _labels(df: DataFrame) -> DataFrame:
    return df.select("image_id", "y", "x", F.col("color_idx").cast("int").alias("color_idx"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.regions(cut(labelled(spark, sf_dir)))


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("image_id", "y", "x", (F.col("color_idx") == 3).cast("int").alias("m"))


def _polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polyline for each customer nation: points ordered by customer, coordinates from its balance."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    point = F.struct(F.col("c_custkey").alias("k"), F.floor(F.pmod(F.col("c_custkey") * 37, F.lit(101))).cast("double").alias("x"), F.floor(F.pmod(F.col("c_custkey") * 53, F.lit(89))).cast("double").alias("y"))
    return c.groupBy(F.col("c_nationkey").alias("arc")).agg(F.sort_array(F.collect_list(point)).alias("points"))


def _corner_rows(df: DataFrame, found) -> DataFrame:
    return df.select("arc", F.explode(found(F.col("points"))).alias("corner")).select(F.col("arc").cast("long").alias("arc"), F.col("corner").cast("long").alias("corner"))


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    px = cut(_regions(spark, sf_dir))
    return px, boundary.boundary_edges(px)


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of parts: one square for each supplier, nation as image, key mod 4 as colour."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    side = F.col("s_suppkey") % 17 + 1
    return s.select(F.col("s_nationkey").cast("long").alias("image_id"), (F.col("s_suppkey") % 4).cast("int").alias("color_idx"), (side * side).cast("double").alias("area"), F.col("s_suppkey").cast("long").alias("first_pixel"), F.concat(F.lit("M"), side.cast("string"), F.lit(" 0z")).alias("d"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").cast("long").alias("k"), (F.pmod(F.col("p_partkey") * 7919, F.lit(40001)) - 20000).cast("long").alias("c"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("long").alias("session"), F.col("event_id").cast("long").alias("job_id"), F.floor(F.col("event_id") / 40).cast("string").alias("image_fp"),
                    F.floor(F.col("value") / 40).cast("long").alias("black_point"), F.col("event_type").alias("color_count"), F.floor(F.col("value") / 25).cast("long").alias("despeckle_size"))


#: Milliseconds that a change of the events' sessions waits for the next one.
CHANGE_WAIT = 6 * 3_600_000


def _changes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as changes of options, a session for each user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events
    return e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").cast("long").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("user_id") / 7 + F.dayofmonth("ts") / 9).cast("string").alias("image_fp"),
                    F.floor(F.col("value") / 60).cast("long").alias("black_point"), F.col("event_type").alias("color_count"), F.floor(F.col("value") / 25).cast("long").alias("despeckle_size"))


def _job_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each event, on the image of a vector, with a few options that vary."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = [f.split()[0] for f in job_plans.SCHEMA.split(",")]
    varied = {"job_id": F.col("event_id"), "image_id": F.col("event_id") % 300, "color_count": F.col("user_id") % 3 + 2, "despeckle_size": F.floor(F.col("value") / 30), "smoothness": F.col("user_id") % 2 / 2, "black_point": F.col("user_id") % 5}
    kinds = dict(f.split(" ", 1) for f in (x.strip() for x in job_plans.SCHEMA.split(",")))
    return e.select(*[varied.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names])


def _old_palette(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    image, idx = F.floor(F.col("p_partkey") / 8).cast("long"), (F.col("p_partkey") % 8).cast("int")
    k = F.col("p_partkey")
    base = p.select(image.alias("image_id"), idx.alias("color_idx"), (k * 41 % 256).cast("int").alias("r"), (k * 67 % 256).cast("int").alias("g"), (k * 29 % 256).cast("int").alias("b"), k.alias("k"))
    old = base.select("image_id", "color_idx", "r", "g", "b", F.when(F.col("k") % 3 != 0, F.concat(F.lit("#"), F.col("k").cast("string"))).alias("override"))
    new = base.select("image_id", (7 - F.col("color_idx")).alias("color_idx"), *[F.least(F.lit(255), F.col(c) + F.col("k") % 15).cast("int").alias(c) for c in "rgb"])
    return old, new


def q_nearest_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: colours, components and region sizes of the order raster, summed by colour."""
    sizes = segment.region_sizes(_regions(spark, sf_dir))
    return sizes.groupBy("image_id", F.col("color_idx").cast("int").alias("color_idx")).agg(F.count("*").alias("n_regions"), F.sum("size").alias("n_pixels"), F.max("size").alias("largest"))


def _vector_rows(df: DataFrame) -> DataFrame:
    return df.select("image_id", "svg", "path_count", F.col("point_count").cast("long").alias("point_count"))


def queries() -> dict:
    L, Q = raster.raster_lineitem, {}

    def add(f):
        Q[f.__name__] = f
        return f

    Q["raster_lineitem"], Q["raster_embeddings"], Q["raster_events"] = raster.raster_lineitem, raster.raster_embeddings, raster.raster_events
    Q["region_summary"] = q_nearest_regions

    @add
    def render_circle(s, d):
        """A 16 x 16 raster for each supplier: by its key a circle, a ring or a turned square."""
        k, of = F.col("s_suppkey"), lambda v, name: v.cast("double").alias(name)
        shapes = s.read.parquet(f"{d}/supplier.parquet").select(
            k.cast("long").alias("image_id"), F.lit(16).alias("width"), F.lit(16).alias("height"), (k % 3).alias("kind"), of(6 + k % 5, "cx"), of(7 + k % 3, "cy"), of(3 + k % 4, "radius"))
        kind, *at = (F.col(c) for c in ("kind", "cx", "cy", "radius"))

        def inside(x, y):
            return F.when(kind == 0, raster.inside_circle(x, y, *at)).when(kind == 1, raster.inside_ring(x, y, *at, 1.25)).otherwise(raster.inside_square(x, y, *at, 0.5))

        return raster.render_shapes(shapes, inside, (200, 30, 30), (245, 245, 245)).select("image_id", "y", "x", "r", "g", "b")

    @add
    def scaled_dims(s, d):
        p = s.read.parquet(f"{d}/part.parquet")
        w, h, u = F.col("p_partkey") * 37 % 6000 + 1, F.col("p_partkey") * 91 % 5000 + 1, F.col("p_partkey") % 3 + 1
        tw, th = raster.scaled_dims(w, h, u)
        return p.select(F.col("p_partkey").cast("long").alias("k"), tw.alias("w"), th.alias("h"))

    @add
    def levels(s, d):
        return pre.levels(L(s, d), 40, 200)

    @add
    def saturation(s, d):
        return pre.with_channels(pre.saturation(L(s, d), 0.5), lambda c: half_up(F.col(c) * 100).cast("long"))

    @add
    def box_blur(s, d):
        return pre.with_channels(pre.box_pass(pre.box_pass(L(s, d), 1, "x"), 1, "y"), lambda c: half_up(F.col(c).cast("double") * 100).cast("long"))

    @add
    def luma_hist_cells(s, d):
        return pre.luma_histogram(L(s, d))

    @add
    def cell_modes(s, d):
        return pre.cell_modes(pre.luma_histogram(L(s, d)))

    @add
    def dilate(s, d):
        return segment.dilate(_mask(s, d), 2)

    @add
    def erode(s, d):
        return segment.erode(_mask(s, d), 1)

    @add
    def close_mask(s, d):
        return segment.close_mask(_mask(s, d), 2)

    @add
    def flat_interior(s, d):
        return pal.flat_interior(pre.levels(raster.raster_embeddings(s, d), 0, 2000)).select("image_id", "y", "x", "r", "g", "b")

    @add
    def stride_sample(s, d):
        return pal.stride_sample(L(s, d), 500).select("image_id", "y", "x", F.col("i").cast("long").alias("i"))

    @add
    def color_histogram(s, d):
        return pal.color_histogram(raster.raster_embeddings(s, d))

    @add
    def nearest_palette(s, d):
        return _labels(labelled(s, d))

    @add
    def color_freq_order(s, d):
        return segment.color_order(labelled(s, d)).select("image_id", F.col("color_idx").cast("int").alias("color_idx"), "n", F.col("place").cast("long").alias("place"), "last")

    @add
    def kmeans_one_step(s, d):
        out = pal.lloyd(pal.color_histogram(L(s, d)), _centers(s, 3), 1).select("image_id", F.explode("colors").alias("c"))
        return out.select("image_id", "c.color_idx", F.col("c.n").alias("n"), *[centi(F.col(f"c.{c}")).alias(c) for c in "rgb"], F.col("c.sse").cast("long").alias("sse"))

    @add
    def farthest_pixel(s, d):
        found = pal.farthest_color(pal.first_places(L(s, d)), _centers(s, 3).withColumnRenamed("colors", "live"))
        return found.select("image_id", (-F.col("far.i")).alias("p"), F.col("far.d").cast("long").alias("d"))

    @add
    def pixels_near(s, d):
        grey = F.array(pal.center(F.lit(0), F.lit(128), F.lit(128), F.lit(128)))
        added = s.range(3).select(F.col("id").alias("image_id"), grey.alias("added"))
        return pal.near_pixels(L(s, d), added, 60, 100).select("image_id", "y", "x", "r", "g", "b")

    @add
    def blend_test(s, d):
        new = _old_palette(s, d)[1]
        own = F.struct(*[F.col(c).cast("double").alias(c) for c in "rgb"])
        rows = new.join(pal.palette_array(new), "image_id")
        others = F.filter("colors", lambda c: c["color_idx"] != F.col("color_idx"))
        return rows.select("image_id", "color_idx", "r", "g", "b", pal.is_blend(own, others, 20).alias("blend"))

    @add
    def row_runs(s, d):
        return segment.row_runs(labelled(s, d)).withColumn("color_idx", F.col("color_idx").cast("int"))

    @add
    def run_adjacency(s, d):
        return segment.run_adjacency(segment.row_runs(labelled(s, d)))

    @add
    def components(s, d):
        return _regions(s, d).select("image_id", "y", "x", "region")

    @add
    def region_sizes(s, d):
        return segment.region_sizes(_regions(s, d)).withColumn("color_idx", F.col("color_idx").cast("int"))

    @add
    def border_counts(s, d):
        return segment.border_counts(_regions(s, d), 6)

    @add
    def despeckle_targets(s, d):
        return segment.despeckle_targets(segment.border_counts(_regions(s, d), 6))

    @add
    def boundary_edges(s, d):
        return _edges(s, d)[1].select("image_id", "region", "nbr", "edge_id", "x0", "y0", "x1", "y1")

    @add
    def refined_edges(s, d):
        px, e = _edges(s, d)
        return boundary.refined_edges(e, px, fixed_palette(s, 3)).select("image_id", "edge_id", centi(F.col("mx")).alias("mx"), centi(F.col("my")).alias("my"))

    @add
    def junctions(s, d):
        return boundary.junctions(_edges(s, d)[1])

    @add
    def lattice_area(s, d):
        return boundary.lattice_area(_edges(s, d)[1]).select("image_id", "region", F.col("area").cast("long").alias("area"))

    @add
    def first_pixel_order(s, d):
        sizes = segment.region_sizes(_regions(s, d))
        return sizes.select("image_id", "region", F.row_number().over(W.partitionBy("image_id").orderBy("first_pixel")).cast("long").alias("place"))

    @add
    def closed_corners(s, d):
        return _corner_rows(_polylines(s, d), corners.closed_corners)

    @add
    def open_corners(s, d):
        return _corner_rows(_polylines(s, d), corners.open_corners)

    @add
    def hex_fill(s, d):
        return _old_palette(s, d)[1].select("image_id", "color_idx", hex_color(F.col("r"), F.col("g"), F.col("b")).alias("fill"))

    @add
    def fmt_centi_text(s, d):
        return _numbers(s, d).select("k", fmt_centi(F.col("c")).alias("t"))

    @add
    def path_compact(s, d):
        c = lambda k: ((F.col("k") * k % 4001 - 2000) / 100).cast("double")
        one = F.struct(*[c(k).alias(n) for n, k in zip(fit.CUBIC, (3, 5, 7, 11, 13, 17, 19, 23))])
        return _numbers(s, d).select("k", svg.path_compact(F.array(one)).alias("d"))

    @add
    def merge_by_color(s, d):
        return svg.merge_by_color(_squares(s, d)).select("image_id", "color_idx", F.col("area").cast("long").alias("area"), "d")

    @add
    def background_pick(s, d):
        return svg.background(_squares(s, d))

    @add
    def palette_remap(s, d):
        return jobs.palette_remap(*_old_palette(s, d))

    @add
    def override_policy(s, d):
        old, new = _old_palette(s, d)
        return jobs.carry_overrides(old, new.where("image_id % 2 = 0 OR color_idx <> 3"))

    @add
    def compute_fit(s, d):
        v = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"), *[(F.col("p_partkey") * m % 997 + 3).cast("double").alias(n) for n, m in (("iw", 31), ("ih", 57), ("cw", 83), ("ch", 19))])
        return jobs.compute_fit(v).select("k", *[centi(F.col(c)).alias(c) for c in ("zoom", "pan_x", "pan_y")])

    @add
    def first_dirty_stage(s, d):
        return jobs.first_dirty_stage(_jobs(s, d)).select("session", "job_id", "stage")

    @add
    def job_superseded(s, d):
        return jobs.job_superseded(_jobs(s, d)).select("session", "job_id", "superseded")

    @add
    def job_debounce(s, d):
        return jobs.debounced(_changes(s, d), CHANGE_WAIT)

    @add
    def job_stream(s, d):
        """The same rule over the events as a stream, all that is there now; decided are changes whose time is over."""
        # A stream's source is a folder or a pattern; this one matches the table alone.
        source = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
        out = f"{shared_folder(s)}/jobs-{uuid.uuid4().hex}"
        with job_events.state_store(s):
            rows = job_events.job_stream(_changes(s, d, source), CHANGE_WAIT)
            rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
        return s.read.schema(rows.schema).parquet(f"{out}/rows")

    @add
    def kmeans_palette(s, d):
        return pal.estimate_palette(raster.raster_events(s, d), 4)

    @add
    def despeckle(s, d):
        return segment.region_sizes(segment.despeckle(_regions(s, d), 6)).withColumn("color_idx", F.col("color_idx").cast("int"))

    @add
    def gap_close(s, d):
        return _labels(segment.close_gaps(labelled(s, d), fixed_palette(s, 3), 1))

    @add
    def upscale_bilinear(s, d):
        return raster.resample(raster.raster_events(s, d), 2)

    @add
    def fingerprint(s, d):
        return raster.fingerprint(raster.raster_embeddings(s, d))

    @add
    def channel_stats(s, d):
        found = raster.channel_stats(raster.raster_embeddings(s, d))
        return found.select("image_id", "n", *[half_up(F.col(f"{name}_{c}") * 1000).cast("long").alias(f"{name}_{c}") for c in "rgb" for name in ("mean", "var")])

    @add
    def loops(s, d):
        traced = boundary.trace(_edges(s, d)[1])
        area = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2
        return traced.groupBy("image_id", "region", "loop").agg(F.count("*").alias("n"), area.cast("long").alias("area"))

    @add
    def svg_size(s, d):
        p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"))
        doc = F.concat(F.lit('<svg viewBox="0 0 '), F.col("k").cast("string"), F.lit(' 9">'), F.lit("</svg>"))
        return p.select("k", svg.with_size(doc, F.col("k"), F.lit(9)).alias("svg"))

    @add
    def flatten(s, d):
        return pre.with_channels(pre.flatten(L(s, d), 1.0), lambda c: half_up(F.col(c).cast("double") * 100).cast("long"))

    @add
    def arcs(s, d):
        px, e = _edges(s, d)
        walks = cut(boundary.traversals(boundary.trace(e), boundary.refined_edges(e, px, fixed_palette(s, 3))))
        return boundary.shared_arcs(walks, segment.region_sizes(px))[1]

    @add
    def stage_units(s, d):
        """For each job the first one whose image's content and options so far agree with its own, stage by stage."""
        keyed = job_plans.units(_job_options(s, d), raster.fingerprint(raster.raster_embeddings(s, d)))
        firsts = [F.min("job_id").over(W.partitionBy(f"{stage}_unit")).alias(stage) for stage in job_plans.OWN]
        return keyed.select("job_id", *firsts)

    @add
    def vectorize_many(s, d):
        """Three jobs with options of their own over one raster."""
        sets = [Options(color_count=4, despeckle_size=2), Options(color_count=4, despeckle_size=2, smoothness=1, optimize=False), Options(color_count=4, despeckle_size=5, stacked_shapes=True)]
        return job_plans.vectorize_jobs(raster.raster_events(s, d), job_plans.job_rows(s, [(k, 0, o) for k, o in enumerate(sets)]))

    @add
    def vectorize_svg(s, d):
        return _vector_rows(vectorize(raster.raster_events(s, d), Options(color_count=4, despeckle_size=2)))

    return Q


GREY = 3
_PAL = "(VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(COLORS)) + ") k(color_idx, kr, kg, kb)"
RL = """rl AS (SELECT i AS image_id, 48 AS width, 48 AS height, y, x, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(b, 255) AS b
  FROM (SELECT i, y, x FROM range(3) a(i), range(48) b(y), range(48) c(x)) LEFT JOIN
  (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS i, l_orderkey % 48 AS y, l_partkey % 48 AS x, CAST(sum(l_quantity) AS BIGINT) % 256 AS r,
   CAST(sum(l_linenumber) * 9 AS BIGINT) % 256 AS g, least(255, 12 * count(*)) AS b FROM lineitem GROUP BY 1, 2, 3) USING (i, y, x))"""
LAB = RL + f""", d AS (SELECT rl.*, color_idx, (r-kr)*(r-kr)+(g-kg)*(g-kg)+(b-kb)*(b-kb) AS dist FROM rl, {_PAL}),
lab AS (SELECT image_id, y, x, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, arg_min(color_idx, (dist, color_idx)) AS color_idx FROM d GROUP BY image_id, y, x)"""
RUNS = LAB + """, ch AS (SELECT *, coalesce(CAST(lag(color_idx) OVER w <> color_idx AS INT), 1) AS c FROM lab WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
ks AS (SELECT *, sum(c) OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM ch),
runs AS (SELECT image_id, y, CAST(y * 48 + min(x) AS BIGINT) AS run, min(x) AS x0, max(x) AS x1, min(color_idx) AS color_idx FROM ks GROUP BY image_id, y, k)"""
COMP = RUNS.replace("rl AS (", "RECURSIVE rl AS (", 1) + """, adj AS (SELECT a.image_id, a.run AS a, b.run AS b FROM runs a JOIN runs b ON a.image_id = b.image_id AND b.y = a.y + 1 AND a.color_idx = b.color_idx AND a.x0 <= b.x1 AND b.x0 <= a.x1),
both_ways AS (SELECT * FROM adj UNION ALL SELECT image_id, b, a FROM adj),
comp(image_id, run, comp) USING KEY (image_id, run) AS (SELECT image_id, run, run FROM runs
  UNION SELECT e.image_id, e.b, min(c.comp) FROM comp c JOIN both_ways e ON c.image_id = e.image_id AND c.run = e.a JOIN recurring.comp o ON o.image_id = e.image_id AND o.run = e.b WHERE c.comp < o.comp GROUP BY e.image_id, e.b),
reg AS (SELECT l.image_id, l.y, l.x, l.r, l.g, l.b, l.color_idx, c.comp AS region FROM lab l JOIN runs r ON r.image_id = l.image_id AND r.y = l.y AND l.x BETWEEN r.x0 AND r.x1 JOIN comp c ON c.image_id = r.image_id AND c.run = r.run)"""
EDGES = COMP + """, nb AS (SELECT *, coalesce(lag(region) OVER v, -1) AS up, coalesce(lead(region) OVER v, -1) AS down, coalesce(lag(region) OVER h, -1) AS lft, coalesce(lead(region) OVER h, -1) AS rgt
  FROM reg WINDOW v AS (PARTITION BY image_id, x ORDER BY y), h AS (PARTITION BY image_id, y ORDER BY x)),
e AS (SELECT image_id, region, up AS nbr, (y * 49 + x) * 2 AS edge_id, x AS x0, y AS y0, x + 1 AS x1, y AS y1, x AS ax, y - 1 AS ay, x AS qx, y AS qy FROM nb WHERE up <> region
  UNION ALL SELECT image_id, region, rgt, (y * 49 + x + 1) * 2 + 1, x + 1, y, x + 1, y + 1, x, y, x + 1, y FROM nb WHERE rgt <> region
  UNION ALL SELECT image_id, region, down, ((y + 1) * 49 + x) * 2, x + 1, y + 1, x, y + 1, x, y, x, y + 1 FROM nb WHERE down <> region
  UNION ALL SELECT image_id, region, lft, (y * 49 + x) * 2 + 1, x, y + 1, x, y, x - 1, y, x, y FROM nb WHERE lft <> region)"""
LUMA = "(0.2126::DOUBLE * rl.r + 0.7152::DOUBLE * rl.g + 0.0722::DOUBLE * rl.b)"
HIST = RL + f""", c0 AS (SELECT image_id, least(5, y * 6 // 48) AS cell_y, least(5, x * 6 // 48) AS cell_x, CAST(floor(greatest(0, least(255, {LUMA})) + 0.5) AS INT) AS bin FROM rl),
h AS (SELECT image_id, 6 AS g, cell_y, cell_x, bin, count(*) AS n FROM c0 GROUP BY image_id, cell_y, cell_x, bin)"""
U8 = "CAST(round_even(greatest(0.0, least(255.0, {})), 0) AS INT)"
MASK = LAB + f", m AS (SELECT image_id, y, x, CAST(color_idx = {GREY} AS INT) AS m FROM lab)"
DIL = """, {o}h AS (SELECT image_id, y, x, {f}(m) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS m FROM {i}),
{o} AS (SELECT image_id, y, x, {f}(m) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS m FROM {o}h)"""
OLD = """p0 AS (SELECT p_partkey // 8 AS image_id, p_partkey % 8 AS i, p_partkey * 41 % 256 AS r, p_partkey * 67 % 256 AS g, p_partkey * 29 % 256 AS b, p_partkey AS k FROM part),
old AS (SELECT image_id, i, r, g, b, CASE WHEN k % 3 <> 0 THEN '#' || k END AS override FROM p0),
new AS (SELECT image_id, CAST(7 - i AS INT) AS color_idx, CAST(least(255, r + k % 15) AS INT) AS r, CAST(least(255, g + k % 15) AS INT) AS g, CAST(least(255, b + k % 15) AS INT) AS b FROM p0)"""
LINES = """c AS (SELECT c_nationkey AS arc, c_custkey AS k, CAST(c_custkey * 37 % 101 AS DOUBLE) AS x, CAST(c_custkey * 53 % 89 AS DOUBLE) AS y FROM customer),
p AS (SELECT arc, row_number() OVER (PARTITION BY arc ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY arc) AS n, x, y FROM c)"""
SQUARES = "s AS (SELECT CAST(s_nationkey AS BIGINT) AS image_id, CAST(s_suppkey % 4 AS INT) AS color_idx, (s_suppkey % 17 + 1) * (s_suppkey % 17 + 1) AS area, s_suppkey AS fp, 'M' || (s_suppkey % 17 + 1) || ' 0z' AS d FROM supplier)"
JOBS = "j AS (SELECT user_id AS session, event_id AS job_id, CAST(event_id // 40 AS VARCHAR) AS image_fp, floor(value / 40) AS bp, event_type AS cc, floor(value / 25) AS ds FROM events)"


def _fmt(v: str) -> str:
    part = f"abs({v}) % 100"
    return f"""CASE WHEN {v} = 0 THEN '0' ELSE (CASE WHEN {v} < 0 THEN '-' ELSE '' END) || (CASE WHEN {part} = 0 THEN CAST(abs({v}) // 100 AS VARCHAR) ELSE (CASE WHEN abs({v}) < 100 THEN '' ELSE CAST(abs({v}) // 100 AS VARCHAR) END) || '.' ||
 (CASE WHEN {part} % 10 = 0 THEN CAST({part} // 10 AS VARCHAR) ELSE lpad(CAST({part} AS VARCHAR), 2, '0') END) END) END"""


def oracle_sql() -> dict[str, str]:
    px = "image_id, width, height, y, x, "
    q: dict[str, str] = {}
    q["raster_lineitem"] = f"WITH {RL} SELECT {px} r, g, b FROM rl"
    q["raster_embeddings"] = "WITH e AS (SELECT vec_id AS image_id, p, greatest(0, least(255, floor((CAST(embedding[p + 1] AS DOUBLE) + 0.6) * 200))) AS v FROM embeddings, range(64) t(p)) SELECT image_id, 8 AS width, 8 AS height, p // 8 AS y, p % 8 AS x, CAST(v AS INT) AS r, CAST(v AS INT) AS g, CAST(v AS INT) AS b FROM e"
    q["raster_events"] = """WITH c AS (SELECT hour(ts) AS y, day(ts) - 1 AS x, least(255, 20 * count(*) FILTER (event_type = 'view')) AS r, least(255, 20 * count(*) FILTER (event_type = 'click')) AS g, least(255, 20 * count(*) FILTER (event_type = 'purchase')) AS b FROM events GROUP BY 1, 2)
SELECT 0 AS image_id, 30 AS width, 24 AS height, y, x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM (SELECT y, x FROM range(24) a(y), range(30) b(x)) LEFT JOIN c USING (y, x)"""
    q["region_summary"] = f"WITH {COMP}, z AS (SELECT image_id, region, any_value(color_idx) AS color_idx, count(*) AS size FROM reg GROUP BY 1, 2) SELECT image_id, color_idx, count(*) AS n_regions, CAST(sum(size) AS BIGINT) AS n_pixels, max(size) AS largest FROM z GROUP BY 1, 2"
    c, n = float(np.cos(-0.5)), float(np.sin(-0.5))
    px0, py0 = "(x + (sx + 0.5::DOUBLE) / 8 - cx)", "(y + (sy + 0.5::DOUBLE) / 8 - cy)"
    q["render_circle"] = f"""WITH k AS (SELECT s_suppkey AS k, 6 + s_suppkey % 5 AS cx, 7 + s_suppkey % 3 AS cy, 3 + s_suppkey % 4 AS r FROM supplier),
a AS (SELECT k, y, x, sum(CAST(CASE k % 3 WHEN 0 THEN {px0} * {px0} + {py0} * {py0} <= r * r WHEN 1 THEN abs(sqrt({px0} * {px0} + {py0} * {py0}) - r) <= 1.25
  ELSE abs({px0} * {c!r}::DOUBLE - {py0} * {n!r}::DOUBLE) <= r AND abs({px0} * {n!r}::DOUBLE + {py0} * {c!r}::DOUBLE) <= r END AS INT)) / 64.0::DOUBLE AS a FROM k, range(16) p(y), range(16) q(x), range(8) u(sx), range(8) v(sy) GROUP BY 1, 2, 3)
SELECT k AS image_id, y, x, {U8.format('200 * a + 245 * (1 - a)')} AS r, {U8.format('30 * a + 245 * (1 - a)')} AS g, {U8.format('30 * a + 245 * (1 - a)')} AS b FROM a"""
    q["scaled_dims"] = """WITH p AS (SELECT p_partkey AS k, p_partkey * 37 % 6000 + 1 AS w, p_partkey * 91 % 5000 + 1 AS h, p_partkey % 3 + 1 AS u FROM part), s AS (SELECT *, least(1.0::DOUBLE, 4096.0::DOUBLE / greatest(w * u, h * u)) AS z FROM p)
SELECT k, CAST(greatest(1, floor(w * u * z + 0.5)) AS INT) AS w, CAST(greatest(1, floor(h * u * z + 0.5)) AS INT) AS h FROM s"""
    q["levels"] = f"WITH {RL} SELECT {px} " + ", ".join(U8.format(f"({c} - 40) * 255.0::DOUBLE / 160") + f" AS {c}" for c in "rgb") + " FROM rl"
    q["saturation"] = f"WITH {RL} SELECT {px} " + ", ".join(f"CAST(floor(({LUMA} + ({c} - {LUMA}) * 0.5::DOUBLE) * 100 + 0.5) AS BIGINT) AS {c}" for c in "rgb") + " FROM rl"
    mean = "CAST((sum(CAST({c} AS DOUBLE)) OVER {w} + greatest(0, 1 - {p}) * first_value(CAST({c} AS DOUBLE)) OVER {v} + greatest(0, {p} + 1 - 47) * last_value(CAST({c} AS DOUBLE)) OVER {v}) / 3 AS FLOAT) AS {c}"

    def box(src: str, p: str, other: str) -> str:
        cols = ", ".join(mean.format(c=c, p=p, w="w", v="v") for c in "rgb")
        part = f"PARTITION BY image_id, {other} ORDER BY {p} ROWS BETWEEN"
        return f"SELECT {px} {cols} FROM {src} WINDOW w AS ({part} 1 PRECEDING AND 1 FOLLOWING), v AS ({part} UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"

    q["box_blur"] = f"WITH {RL}, hb AS ({box('rl', 'x', 'y')}), vb AS ({box('hb', 'y', 'x')}) SELECT {px} " + ", ".join(f"CAST(floor(CAST({c} AS DOUBLE) * 100 + 0.5) AS BIGINT) AS {c}" for c in "rgb") + " FROM vb"
    q["luma_hist_cells"] = f"WITH {HIST} SELECT * FROM h"
    q["cell_modes"] = f"WITH {HIST}, s AS (SELECT image_id, g, cell_y, cell_x, b AS bin, sum(n) AS s FROM h, unnest(generate_series(greatest(0, bin - 2), least(255, bin + 2))) t(b) GROUP BY ALL) SELECT image_id, g, cell_y, cell_x, arg_max(bin, (s, -bin)) AS mode FROM s GROUP BY ALL"
    q["dilate"] = f"WITH {MASK}{DIL.format(o='o', f='max', r=2, i='m')} SELECT image_id, y, x, m FROM o"
    q["erode"] = f"WITH {MASK}{DIL.format(o='o', f='min', r=1, i='m')} SELECT image_id, y, x, m FROM o"
    q["close_mask"] = f"WITH {MASK}{DIL.format(o='o', f='max', r=2, i='m')}{DIL.format(o='c', f='min', r=2, i='o')} SELECT image_id, y, x, m FROM c"
    q["flat_interior"] = f"""WITH e AS ({q['raster_embeddings'][q['raster_embeddings'].index('WITH e'):].replace('WITH e AS', 'WITH e0 AS').replace('FROM e', 'FROM e0').replace('FROM e0mbeddings', 'FROM embeddings')}),
v AS (SELECT image_id, y, x, {U8.format('r * 255.0::DOUBLE / 2000')} AS r FROM e),
g AS (SELECT *, greatest(abs(r - lag(r) OVER h), abs(r - lead(r) OVER h), abs(r - lag(r) OVER u), abs(r - lead(r) OVER u)) AS grad FROM v WINDOW h AS (PARTITION BY image_id, y ORDER BY x), u AS (PARTITION BY image_id, x ORDER BY y)),
f AS (SELECT *, x >= 1 AND y >= 1 AND x < 7 AND y < 7 AND grad < 24 AS flat FROM g), s AS (SELECT image_id, max(CAST(flat AS INT)) AS any_flat FROM f GROUP BY 1)
SELECT image_id, y, x, r, r AS g, r AS b FROM f JOIN s USING (image_id) WHERE flat OR any_flat = 0"""
    q["stride_sample"] = f"WITH {RL}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS o, count(*) OVER (PARTITION BY image_id) // 500 AS k FROM rl) SELECT image_id, y, x, o // k AS i FROM o WHERE o % k = 0"
    q["color_histogram"] = "WITH z AS (" + q["raster_embeddings"] + ") SELECT image_id, r, g, b, count(*) AS n FROM z GROUP BY ALL"
    q["nearest_palette"] = f"WITH {LAB} SELECT image_id, y, x, color_idx FROM lab"
    q["color_freq_order"] = f"WITH {LAB}, f AS (SELECT image_id, color_idx, count(*) AS n FROM lab GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n, color_idx) - 1 AS place, count(*) OVER (PARTITION BY image_id) AS k FROM f) SELECT image_id, color_idx, n, place, place = k - 1 AS last FROM o"
    q["kmeans_one_step"] = f"""WITH {LAB}, s AS (SELECT image_id, l.color_idx, count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb, sum((r-kr)*(r-kr)+(g-kg)*(g-kg)+(b-kb)*(b-kb)) AS sse FROM lab l JOIN {_PAL} ON k.color_idx = l.color_idx GROUP BY 1, 2)
SELECT i AS image_id, k.color_idx, CAST(coalesce(n, 0) AS BIGINT) AS n, {', '.join(f"CAST(floor(coalesce(CAST(s{c} AS DOUBLE) / n, k{c}) * 100 + 0.5) AS BIGINT) AS {c}" for c in 'rgb')}, CAST(coalesce(sse, 0) AS BIGINT) AS sse FROM range(3) t(i) CROSS JOIN {_PAL} LEFT JOIN s ON s.image_id = i AND s.color_idx = k.color_idx"""
    q["farthest_pixel"] = f"WITH {LAB}, m AS (SELECT image_id, y * 48 + x AS p, min(dist) AS d FROM d GROUP BY image_id, y, x) SELECT image_id, arg_max(p, (d, -p)) AS p, max(d) AS d FROM m GROUP BY 1"
    q["pixels_near"] = f"WITH {RL}, z AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS o, count(*) OVER (PARTITION BY image_id) AS n FROM rl WHERE (r-128)*(r-128)+(g-128)*(g-128)+(b-128)*(b-128) <= 3600) SELECT image_id, y, x, r, g, b FROM z WHERE o % greatest(1, CAST(ceil(n / 100.0) AS BIGINT)) = 0"
    q["blend_test"] = f"""WITH {OLD}, t AS (SELECT c.image_id, c.color_idx, least(1.0, greatest(0.0, ((c.r-p.r)*(q.r-p.r)+(c.g-p.g)*(q.g-p.g)+(c.b-p.b)*(q.b-p.b))::DOUBLE / ((q.r-p.r)*(q.r-p.r)+(q.g-p.g)*(q.g-p.g)+(q.b-p.b)*(q.b-p.b)))) AS t,
 c.r-p.r AS dx, c.g-p.g AS dy, c.b-p.b AS dz, q.r-p.r AS ax, q.g-p.g AS ay, q.b-p.b AS az FROM new c JOIN new p ON p.image_id = c.image_id AND p.color_idx <> c.color_idx JOIN new q ON q.image_id = c.image_id AND q.color_idx <> c.color_idx AND p.color_idx < q.color_idx),
h AS (SELECT image_id, color_idx, max(CAST((dx-t*ax)*(dx-t*ax)+(dy-t*ay)*(dy-t*ay)+(dz-t*az)*(dz-t*az) < 400 AS INT)) AS hit FROM t GROUP BY 1, 2) SELECT n.*, coalesce(hit, 0) = 1 AS blend FROM new n LEFT JOIN h USING (image_id, color_idx)"""
    q["row_runs"] = f"WITH {RUNS} SELECT * FROM runs"
    q["run_adjacency"] = f"WITH {RUNS} SELECT a.image_id, a.run AS a, b.run AS b FROM runs a JOIN runs b ON a.image_id = b.image_id AND b.y = a.y + 1 AND a.color_idx = b.color_idx AND a.x0 <= b.x1 AND b.x0 <= a.x1"
    q["components"] = f"WITH {COMP} SELECT image_id, y, x, region FROM reg"
    q["region_sizes"] = f"WITH {COMP} SELECT image_id, region, count(*) AS size, min(color_idx) AS color_idx, min(y * 48 + x) AS first_pixel FROM reg GROUP BY 1, 2"
    borders = COMP + """, sz AS (SELECT image_id, region, count(*) AS size FROM reg GROUP BY 1, 2),
pr AS (SELECT image_id, y * 48 + x AS p, region AS a, lead(region) OVER (PARTITION BY image_id, y ORDER BY x) AS b, 0 AS k FROM reg UNION ALL SELECT image_id, y * 48 + x, region, lead(region) OVER (PARTITION BY image_id, x ORDER BY y), 1 FROM reg),
bo AS (SELECT image_id, a AS small, b AS other, p * 4 + k * 2 AS f FROM pr WHERE a <> b UNION ALL SELECT image_id, b, a, p * 4 + k * 2 + 1 FROM pr WHERE a <> b),
bc AS (SELECT bo.image_id, small, other, count(*) AS n, min(f) AS first FROM bo JOIN sz ON sz.image_id = bo.image_id AND sz.region = small WHERE size < 6 GROUP BY 1, 2, 3)"""
    q["border_counts"] = f"WITH {borders} SELECT * FROM bc"
    q["despeckle_targets"] = f"WITH {borders} SELECT image_id, small, arg_max(other, (n, -first)) AS other, min(first) AS first FROM bc GROUP BY 1, 2"
    q["boundary_edges"] = f"WITH {EDGES} SELECT image_id, region, nbr, edge_id, x0, y0, x1, y1 FROM e"
    cov = lambda v: f"CASE WHEN l2 = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, (({v}.r-kb.kr)*(ka.kr-kb.kr)+({v}.g-kb.kg)*(ka.kg-kb.kg)+({v}.b-kb.kb)*(ka.kb-kb.kb))::DOUBLE / l2)) END"
    q["refined_edges"] = f"""WITH {EDGES}, pk AS (SELECT * FROM {_PAL}), o AS (SELECT DISTINCT image_id, edge_id, ax, ay, qx, qy FROM e),
j AS (SELECT o.*, a.r AS r1, (ka.kr-kb.kr)*(ka.kr-kb.kr)+(ka.kg-kb.kg)*(ka.kg-kb.kg)+(ka.kb-kb.kb)*(ka.kb-kb.kb) AS l2, {cov('a').replace('l2', '((ka.kr-kb.kr)*(ka.kr-kb.kr)+(ka.kg-kb.kg)*(ka.kg-kb.kg)+(ka.kb-kb.kb)*(ka.kb-kb.kb))')} AS fa, {cov('b').replace('l2', '((ka.kr-kb.kr)*(ka.kr-kb.kr)+(ka.kg-kb.kg)*(ka.kg-kb.kg)+(ka.kb-kb.kb)*(ka.kb-kb.kb))')} AS fb, a.r IS NULL OR b.r IS NULL AS frame
 FROM o LEFT JOIN reg a ON a.image_id = o.image_id AND a.x = ax AND a.y = ay LEFT JOIN reg b ON b.image_id = o.image_id AND b.x = qx AND b.y = qy LEFT JOIN pk ka ON ka.color_idx = a.color_idx LEFT JOIN pk kb ON kb.color_idx = b.color_idx),
t AS (SELECT *, CASE WHEN frame THEN 0.0 ELSE greatest(-0.5, least(1.5, fa + fb - 0.5)) - 0.5 END AS s FROM j)
SELECT image_id, edge_id, CAST(floor(((ax + qx + 1) / 2.0 + (qx - ax) * s) * 100 + 0.5) AS BIGINT) AS mx, CAST(floor(((ay + qy + 1) / 2.0 + (qy - ay) * s) * 100 + 0.5) AS BIGINT) AS my FROM t"""
    q["junctions"] = f"WITH {EDGES}, u AS (SELECT DISTINCT image_id, edge_id, least(x0, x1) AS xa, least(y0, y1) AS ya, greatest(x0, x1) AS xb, greatest(y0, y1) AS yb FROM e), v AS (SELECT image_id, xa AS x, ya AS y FROM u UNION ALL SELECT image_id, xb, yb FROM u) SELECT image_id, x, y, count(*) AS n FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 3"
    q["lattice_area"] = f"WITH {COMP} SELECT image_id, region, count(*) AS area FROM reg GROUP BY 1, 2"
    q["first_pixel_order"] = f"WITH {COMP}, z AS (SELECT image_id, region, min(y * 48 + x) AS f FROM reg GROUP BY 1, 2) SELECT image_id, region, row_number() OVER (PARTITION BY image_id ORDER BY f) AS place FROM z"
    turn = "abs(atan2((q.x-p.x)*(r.y-q.y)-(q.y-p.y)*(r.x-q.x), (q.x-p.x)*(r.x-q.x)+(q.y-p.y)*(r.y-q.y)))"
    q["closed_corners"] = f"""WITH {LINES}, st AS (SELECT q.arc, q.i, q.n, {turn} AS t FROM p q, (VALUES (2), (4), (8)) v(s), p AS p, p AS r WHERE q.n >= 8 AND p.arc = q.arc AND r.arc = q.arc AND p.i = (q.i - least(s, (q.n - 1) // 2) + q.n) % q.n AND r.i = (q.i + least(s, (q.n - 1) // 2)) % q.n),
dv AS (SELECT arc, i, any_value(n) AS n, min(t) AS v FROM st GROUP BY arc, i)
SELECT arc, i AS corner FROM dv a WHERE v >= {corners.LEAST!r} AND NOT EXISTS (SELECT 1 FROM dv b, range(-8, 9) t(k) WHERE b.arc = a.arc AND k <> 0 AND b.i = (a.i + k + 8 * a.n) % a.n AND (b.v > a.v OR (b.v = a.v AND b.i < a.i)))"""
    q["open_corners"] = f"""WITH {LINES}, st AS (SELECT q.arc, q.i, q.n, {turn} AS t FROM p q, (VALUES (2), (4), (8)) v(s), p AS p, p AS r WHERE q.n >= 5 AND q.i BETWEEN 1 AND q.n - 2 AND least(s, q.i, q.n - 1 - q.i) >= 2 AND p.arc = q.arc AND r.arc = q.arc AND p.i = q.i - least(s, q.i, q.n - 1 - q.i) AND r.i = q.i + least(s, q.i, q.n - 1 - q.i)),
dv AS (SELECT arc, i, min(t) AS v FROM st GROUP BY arc, i)
SELECT arc, i AS corner FROM dv a WHERE v >= {corners.LEAST!r} AND NOT EXISTS (SELECT 1 FROM dv b WHERE b.arc = a.arc AND b.i <> a.i AND b.i BETWEEN a.i - 8 AND a.i + 8 AND (b.v > a.v OR (b.v = a.v AND b.i < a.i)))"""
    q["hex_fill"] = f"WITH {OLD} SELECT image_id, color_idx, printf('#%02x%02x%02x', r, g, b) AS fill FROM new"
    q["fmt_centi_text"] = f"WITH n AS (SELECT p_partkey AS k, p_partkey * 7919 % 40001 - 20000 AS c FROM part) SELECT k, {_fmt('c')} AS t FROM n"
    v = lambda k: f"(k * {k} % 4001 - 2000)"
    steps = [f"({v(a)} - {v(b)})" for a, b in ((7, 3), (11, 5), (13, 3), (17, 5), (19, 3), (23, 5))]
    join = lambda parts: "replace(" + " || ' ' || ".join(f"({_fmt(x)})" for x in parts) + ", ' -', '-')"
    q["path_compact"] = f"WITH n AS (SELECT p_partkey AS k FROM part) SELECT k, 'M' || {join([v(3), v(5)])} || 'c' || {join(steps)} || 'z' AS d FROM n"
    q["merge_by_color"] = f"WITH {SQUARES} SELECT image_id, color_idx, CAST(sum(area) AS BIGINT) AS area, string_agg(d, '' ORDER BY fp) AS d FROM s GROUP BY 1, 2"
    q["background_pick"] = f"WITH {SQUARES} SELECT image_id, arg_max(color_idx, (area, -fp)) AS color_idx FROM s GROUP BY 1"
    q["palette_remap"] = f"""WITH {OLD}, m AS (SELECT o.image_id, o.i, o.override, n.color_idx AS j, (o.r-n.r)*(o.r-n.r)+(o.g-n.g)*(o.g-n.g)+(o.b-n.b)*(o.b-n.b) AS d FROM old o JOIN new n USING (image_id) WHERE o.override IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY image_id, i ORDER BY d, j) AS rn FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY image_id, j ORDER BY d, i) AS rk FROM a WHERE rn = 1 AND d <= 400)
SELECT n.image_id, n.color_idx, b.override FROM new n LEFT JOIN b ON b.image_id = n.image_id AND b.j = n.color_idx AND b.rk = 1"""
    remap = q["palette_remap"].replace("FROM new n LEFT JOIN", "FROM fewer n LEFT JOIN").replace("JOIN new n USING", "JOIN fewer n USING").replace(", m AS (", ", fewer AS (SELECT * FROM new WHERE image_id % 2 = 0 OR color_idx <> 3), m AS (", 1)
    head, tail = remap.rsplit("\nSELECT ", 1)
    q["override_policy"] = f"""{head}, r AS (SELECT {tail}), z AS (SELECT image_id, (SELECT count(*) FROM old o WHERE o.image_id = n.image_id) = count(*) AS same FROM fewer n GROUP BY image_id)
SELECT r.image_id, r.color_idx, CASE WHEN same THEN o.override ELSE r.override END AS override FROM r JOIN z USING (image_id) LEFT JOIN old o ON o.image_id = r.image_id AND o.i = r.color_idx"""
    q["fingerprint"] = "WITH z AS (" + q["raster_embeddings"] + """), w AS (SELECT image_id, width, height, y, sha256(string_agg(printf('%X', r * 65536 + g * 256 + b), ',' ORDER BY x)) AS h FROM z GROUP BY image_id, width, height, y)
SELECT image_id, width, height, sha256(width || ':' || height || ':' || string_agg(h, ',' ORDER BY y)) AS print FROM w GROUP BY image_id, width, height"""
    sums = {"mean": "sum({c})::DOUBLE / count(*)", "var": "(count(*) * sum({c} * {c}) - sum({c}) * sum({c}))::DOUBLE / (count(*) * count(*))"}
    q["channel_stats"] = "WITH z AS (" + q["raster_embeddings"] + ") SELECT image_id, count(*) AS n, " + ", ".join(f"CAST(floor({f.format(c=c)} * 1000 + 0.5) AS BIGINT) AS {n}_{c}" for c in "rgb" for n, f in sums.items()) + " FROM z GROUP BY 1"
    q["svg_size"] = """SELECT p_partkey AS k, '<svg width="' || p_partkey || '" height="9" viewBox="0 0 ' || p_partkey || ' 9"></svg>' AS svg FROM part"""
    # A loop's edges reach each other by steps to the next edge, which turns clockwise where two leave a vertex.
    q["loops"] = f"""WITH {EDGES}, st AS (SELECT a.image_id, a.region, a.edge_id, arg_max(b.edge_id, (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0)) AS nxt FROM e a JOIN e b ON b.image_id = a.image_id AND b.region = a.region AND b.x0 = a.x1 AND b.y0 = a.y1 GROUP BY 1, 2, 3),
lp(image_id, region, edge_id, least) USING KEY (image_id, region, edge_id) AS (SELECT image_id, region, edge_id, (edge_id % 2) * 1000000 + edge_id FROM e
  UNION SELECT s.image_id, s.region, s.nxt, min(l.least) FROM lp l JOIN st s ON s.image_id = l.image_id AND s.region = l.region AND s.edge_id = l.edge_id JOIN recurring.lp o ON o.image_id = s.image_id AND o.region = s.region AND o.edge_id = s.nxt WHERE l.least < o.least GROUP BY 1, 2, 3)
SELECT l.image_id, l.region, CAST(l.least % 1000000 AS BIGINT) AS loop, count(*) AS n, CAST(sum(e.x0 * e.y1 - e.x1 * e.y0) / 2 AS BIGINT) AS area FROM lp l JOIN e ON e.image_id = l.image_id AND e.region = l.region AND e.edge_id = l.edge_id GROUP BY 1, 2, 3"""
    weights = lambda c: " + ".join(f"{c}{i}{j}.{c} * {'ax' if i else '(1 - ax)'} * {'ay' if j else '(1 - ay)'}" for i in (0, 1) for j in (0, 1))
    q["upscale_bilinear"] = "WITH z AS (" + q["raster_events"] + """), t AS (SELECT ty, tx, (tx + 0.5::DOUBLE) * 30 / 60 - 0.5 AS fx, (ty + 0.5::DOUBLE) * 24 / 48 - 0.5 AS fy FROM range(48) a(ty), range(60) b(tx)),
u AS (SELECT *, floor(fx) AS x0, floor(fy) AS y0, fx - floor(fx) AS ax, fy - floor(fy) AS ay FROM t) SELECT 0 AS image_id, 60 AS width, 48 AS height, ty AS y, tx AS x, """ + ", ".join(U8.format("round(" + weights(c).replace(f"{c}0", "p0").replace(f"{c}1", "p1") + ", 9)") + f" AS {c}" for c in "rgb") + " FROM u " + " ".join(
        f"JOIN z p{i}{j} ON p{i}{j}.x = greatest(0, least(29, x0 + {i})) AND p{i}{j}.y = greatest(0, least(23, y0 + {j}))" for i in (0, 1) for j in (0, 1))
    gap = LAB + """, fo AS (SELECT image_id, color_idx, count(*) AS n FROM lab GROUP BY 1, 2), od AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n, color_idx) - 1 AS place, count(*) OVER (PARTITION BY image_id) AS k FROM fo), s0 AS (SELECT *, false AS flipped FROM lab)"""
    for t in range(len(COLORS) - 1):
        near = lambda k: f"sqrt((s.r-{k}.kr)*(s.r-{k}.kr)+(s.g-{k}.kg)*(s.g-{k}.kg)+(s.b-{k}.kb)*(s.b-{k}.kb))"
        gap += f""", i{t} AS (SELECT s.image_id, y, x, CAST(coalesce(s.color_idx = o.color_idx, false) AS INT) AS m FROM s{t} s LEFT JOIN od o ON o.image_id = s.image_id AND o.place = {t} AND o.place < o.k - 1)""" + DIL.format(o=f"d{t}", f="max", r=1, i=f"i{t}") + DIL.format(o=f"e{t}", f="min", r=1, i=f"d{t}") + f""",
f{t} AS (SELECT s.*, o.color_idx AS c, coalesce(m.m = 1 AND s.color_idx <> o.color_idx AND NOT s.flipped AND {near('kc')} <= 1.3::DOUBLE * {near('ko')}, false) AS flip FROM s{t} s JOIN e{t} m USING (image_id, y, x) LEFT JOIN od o ON o.image_id = s.image_id AND o.place = {t} AND o.place < o.k - 1 LEFT JOIN {_PAL.replace(') k(', ') kc(')} ON kc.color_idx = o.color_idx JOIN {_PAL.replace(') k(', ') ko(')} ON ko.color_idx = s.color_idx),
s{t + 1} AS (SELECT image_id, y, x, r, g, b, CASE WHEN flip THEN c ELSE color_idx END AS color_idx, flipped OR flip AS flipped FROM f{t})"""
    q["gap_close"] = f"WITH {gap} SELECT image_id, y, x, CAST(color_idx AS INT) AS color_idx FROM s{len(COLORS) - 1}"
    surface = lambda u, v, c="c": f"({c}[1] + {c}[2] * {u} + {c}[3] * {v} + {c}[4] * ({u}) * ({u}) + {c}[5] * ({u}) * ({v}) + {c}[6] * ({v}) * ({v}))"
    fit_sql = f"""WITH {HIST}, s AS (SELECT image_id, g, cell_y, cell_x, b AS bin, sum(n) AS s FROM h, unnest(generate_series(greatest(0, bin - 2), least(255, bin + 2))) t(b) GROUP BY ALL),
md AS (SELECT image_id, g, cell_y, cell_x, arg_max(bin, (s, -bin)) AS m FROM s GROUP BY ALL),
w0 AS (SELECT image_id, (cell_x + 0.5::DOUBLE) / g - 0.5 AS u, (cell_y + 0.5::DOUBLE) / g - 0.5 AS v, CAST(m AS DOUBLE) AS m, list_sort(list(CAST(m AS DOUBLE)) OVER (PARTITION BY image_id))[count(*) OVER (PARTITION BY image_id) // 2 + 1] AS centre FROM md)"""
    for p, window in enumerate(pre.WINDOWS):
        base = ", ".join(f"sum(f[r] * f[{k}])" for k in range(1, 7))
        fit_sql += f""", a{p} AS (SELECT image_id, [1.0::DOUBLE, u, v, u * u, u * v, v * v] AS f, m FROM w{p} WHERE abs(m - centre) <= {window}),
x{p}_0 AS (SELECT image_id, r, 0 AS var, [{base}, sum(f[r] * m)] AS c FROM a{p}, range(1, 7) t(r) GROUP BY image_id, r HAVING count(*) >= 18)"""
        for k in range(1, 7):
            fit_sql += f""", p{p}_{k} AS (SELECT image_id, arg_max(r, (abs(c[{k}]), -r)) AS pr, arg_max(c, (abs(c[{k}]), -r)) AS pc FROM x{p}_{k - 1} WHERE var = 0 GROUP BY image_id),
x{p}_{k} AS (SELECT image_id, r, CASE WHEN r = pr THEN {k} ELSE var END AS var, CASE WHEN r = pr THEN list_transform(pc, lambda x: x / pc[{k}]) ELSE list_transform(c, lambda x, i: x - pc[i] * (c[{k}] / pc[{k}])) END AS c FROM x{p}_{k - 1} JOIN p{p}_{k} USING (image_id) WHERE abs(pc[{k}]) >= 1e-9)"""
        fit_sql += f""", k{p} AS (SELECT image_id, list(c[7] ORDER BY var) AS c FROM x{p}_6 GROUP BY image_id),
w{p + 1} AS (SELECT w{p}.image_id, u, v, m, {surface("u", "v")} AS centre FROM w{p} JOIN k{p} USING (image_id))"""
    last = len(pre.WINDOWS) - 1
    probe = f"list_sort(list_transform(range(81), lambda i: {surface('((i % 9) / 8.0::DOUBLE - 0.5)', '((i // 9) / 8.0::DOUBLE - 0.5)')}))[41]"
    fit_sql += f""", lit AS (SELECT image_id, c, {probe} AS mid FROM k{last}),
ga AS (SELECT rl.*, mid, {surface("((x + 0.5::DOUBLE) / 48 - 0.5)", "((y + 0.5::DOUBLE) / 48 - 0.5)")} AS l FROM rl LEFT JOIN lit USING (image_id)),
gn AS (SELECT *, CASE WHEN mid IS NULL OR mid <= 1 THEN 1.0::DOUBLE WHEN mid + (l - mid) * 1.0 <= 1 THEN 4.0::DOUBLE ELSE least(4.0::DOUBLE, greatest(0.25::DOUBLE, mid / (mid + (l - mid) * 1.0))) END AS gain FROM ga)"""
    q["flatten"] = f"{fit_sql} SELECT {px} " + ", ".join(f"CAST(floor(CAST(CAST({c} * gain AS FLOAT) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS {c}" for c in "rgb") + " FROM gn"
    # Loops from their topmost edge, step by step; parts begin where the region across changes.
    q["arcs"] = f"""WITH {EDGES}, st AS (SELECT a.image_id, a.region, a.edge_id, any_value(a.nbr) AS nbr, arg_max(b.edge_id, (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0)) AS nxt FROM e a JOIN e b ON b.image_id = a.image_id AND b.region = a.region AND b.x0 = a.x1 AND b.y0 = a.y1 GROUP BY 1, 2, 3),
lp(image_id, region, edge_id, least) USING KEY (image_id, region, edge_id) AS (SELECT image_id, region, edge_id, (edge_id % 2) * 1000000 + edge_id FROM e
  UNION SELECT s.image_id, s.region, s.nxt, min(l.least) FROM lp l JOIN st s ON s.image_id = l.image_id AND s.region = l.region AND s.edge_id = l.edge_id JOIN recurring.lp o ON o.image_id = s.image_id AND o.region = s.region AND o.edge_id = s.nxt WHERE l.least < o.least GROUP BY 1, 2, 3),
tops AS (SELECT DISTINCT image_id, region, least % 1000000 AS loop FROM lp),
wk AS (SELECT image_id, region, loop, loop AS edge_id, 0 AS seq FROM tops UNION ALL SELECT w.image_id, w.region, w.loop, s.nxt, w.seq + 1 FROM wk w JOIN st s USING (image_id, region, edge_id) WHERE s.nxt <> w.loop),
wn AS (SELECT wk.*, s.nbr, count(*) OVER l AS m, lag(s.nbr) OVER (PARTITION BY image_id, region, loop ORDER BY seq) AS bf, last_value(s.nbr) OVER (PARTITION BY image_id, region, loop ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ls FROM wk JOIN st s USING (image_id, region, edge_id) WINDOW l AS (PARTITION BY image_id, region, loop)),
wc AS (SELECT *, CAST(nbr <> coalesce(bf, ls) AS INT) AS ch FROM wn),
wp AS (SELECT *, (seq - coalesce(min(seq) FILTER (ch = 1) OVER (PARTITION BY image_id, region, loop), 0) + m) % m AS place FROM wc),
wa AS (SELECT image_id, region, loop, edge_id, CAST(sum(ch) OVER (PARTITION BY image_id, region, loop ORDER BY place) AS BIGINT) AS part FROM wp),
pt AS (SELECT image_id, region, loop, part, min(edge_id) AS arc_id FROM wa GROUP BY 1, 2, 3, 4),
fp AS (SELECT image_id, region, min(y * 48 + x) AS first_pixel FROM reg GROUP BY 1, 2),
ow AS (SELECT image_id, arc_id, min(first_pixel) AS owner FROM pt JOIN fp USING (image_id, region) GROUP BY 1, 2)
SELECT image_id, region, CAST(first_pixel AS BIGINT) AS first_pixel, CAST(loop AS BIGINT) AS loop, part, CAST(arc_id AS BIGINT) AS arc_id, first_pixel <> owner AS reversed FROM pt JOIN fp USING (image_id, region) JOIN ow USING (image_id, arc_id)"""
    # Despeckling: in each pass the small regions merge one after the other; lists hold what each region has become and its size.
    speck = COMP + ", g0 AS (SELECT image_id, y, x, region FROM reg)"
    for p in range(segment.PASSES):
        speck += f""", z{p} AS (SELECT image_id, region, count(*) AS size, row_number() OVER (PARTITION BY image_id ORDER BY region) AS no FROM g{p} GROUP BY 1, 2),
q{p} AS (SELECT image_id, y * 48 + x AS p, region AS a, lead(region) OVER (PARTITION BY image_id, y ORDER BY x) AS b, 0 AS k FROM g{p} UNION ALL SELECT image_id, y * 48 + x, region, lead(region) OVER (PARTITION BY image_id, x ORDER BY y), 1 FROM g{p}),
b{p} AS (SELECT image_id, a AS small, b AS other, p * 4 + k * 2 AS f FROM q{p} WHERE a <> b UNION ALL SELECT image_id, b, a, p * 4 + k * 2 + 1 FROM q{p} WHERE a <> b),
n{p} AS (SELECT b.image_id, small, other, count(*) AS n, min(f) AS f FROM b{p} b JOIN z{p} z ON z.image_id = b.image_id AND z.region = small WHERE z.size < 6 GROUP BY 1, 2, 3),
t{p} AS (SELECT image_id, small, arg_max(other, (n, -f)) AS other, min(f) AS f FROM n{p} GROUP BY 1, 2),
o{p} AS (SELECT t.image_id, a.no AS s, b.no AS o, row_number() OVER (PARTITION BY t.image_id ORDER BY t.f) AS i FROM t{p} t JOIN z{p} a ON a.image_id = t.image_id AND a.region = small JOIN z{p} b ON b.image_id = t.image_id AND b.region = other),
m{p}(image_id, i, root, size) AS (SELECT image_id, 0::BIGINT, list(no ORDER BY no), list(size ORDER BY no) FROM z{p} GROUP BY 1
  UNION ALL SELECT image_id, i, CASE WHEN go THEN list_transform(root, lambda v: CASE WHEN v = s THEN o ELSE v END) ELSE root END, CASE WHEN go THEN list_transform(size, lambda v, j: CASE WHEN j = o THEN v + size[s] ELSE v END) ELSE size END
  FROM (SELECT m.image_id, x.i, root, size, root[x.s] AS s, root[x.o] AS o, root[x.s] <> root[x.o] AND size[root[x.s]] < 6 AS go FROM m{p} m JOIN o{p} x ON x.image_id = m.image_id AND x.i = m.i + 1)),
l{p} AS (SELECT image_id, arg_max(root, i) AS root FROM m{p} GROUP BY 1),
g{p + 1} AS (SELECT g.image_id, g.y, g.x, r.region FROM g{p} g JOIN z{p} z USING (image_id, region) JOIN l{p} l USING (image_id) JOIN z{p} r ON r.image_id = g.image_id AND r.no = l.root[z.no])"""
    q["despeckle"] = f"WITH {speck} SELECT g.image_id, g.region, count(*) AS size, CAST(any_value(r.color_idx) AS INT) AS color_idx, CAST(min(g.y * 48 + g.x) AS BIGINT) AS first_pixel FROM g{segment.PASSES} g JOIN reg r ON r.image_id = g.image_id AND r.y * 48 + r.x = g.region GROUP BY 1, 2"
    q["compute_fit"] = """WITH v AS (SELECT p_partkey AS k, (p_partkey * 31 % 997 + 3)::DOUBLE AS iw, (p_partkey * 57 % 997 + 3)::DOUBLE AS ih, (p_partkey * 83 % 997 + 3)::DOUBLE AS cw, (p_partkey * 19 % 997 + 3)::DOUBLE AS ch FROM part), z AS (SELECT *, least(1.0::DOUBLE, cw / iw, ch / ih) AS zoom FROM v)
SELECT k, CAST(floor(zoom * 100 + 0.5) AS BIGINT) AS zoom, CAST(floor((cw - iw * zoom) / 2 * 100 + 0.5) AS BIGINT) AS pan_x, CAST(floor((ch - ih * zoom) / 2 * 100 + 0.5) AS BIGINT) AS pan_y FROM z"""
    q["first_dirty_stage"] = f"WITH {JOBS} SELECT session, job_id, CASE WHEN lag(job_id) OVER w IS NULL OR image_fp IS DISTINCT FROM lag(image_fp) OVER w OR bp IS DISTINCT FROM lag(bp) OVER w THEN 'pre' WHEN cc IS DISTINCT FROM lag(cc) OVER w THEN 'palette' WHEN ds IS DISTINCT FROM lag(ds) OVER w THEN 'segment' ELSE 'fit' END AS stage FROM j WINDOW w AS (PARTITION BY session ORDER BY job_id)"
    q["stage_units"] = "WITH z AS (" + q["raster_embeddings"] + """), f AS (SELECT image_id, string_agg(r * 65536 + g * 256 + b, ',' ORDER BY y, x) AS print FROM z GROUP BY 1),
j AS (SELECT event_id AS job_id, print, user_id % 5 AS bp, user_id % 3 AS cc, floor(value / 30) AS ds, user_id % 2 AS sm FROM events JOIN f ON image_id = event_id % 300)
SELECT job_id, min(job_id) OVER (PARTITION BY print, bp) AS pre, min(job_id) OVER (PARTITION BY print, bp, cc) AS palette, min(job_id) OVER (PARTITION BY print, bp, cc, ds) AS segment, min(job_id) OVER (PARTITION BY print, bp, cc, ds, sm) AS fit FROM j"""
    q["job_debounce"] = f"""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS job_id, epoch_us(ts) // 1000 AS ms, floor(user_id / 7.0::DOUBLE + day(ts) / 9.0::DOUBLE) AS fp, floor(value / 60) AS bp, event_type AS cc, floor(value / 25) AS ds FROM events),
r AS (SELECT *, coalesce(lead(ms) OVER w - ms >= {CHANGE_WAIT}, true) AS ran FROM c WINDOW w AS (PARTITION BY session ORDER BY ms, job_id)),
s AS (SELECT session, job_id, CASE WHEN lag(job_id) OVER w IS NULL OR fp <> lag(fp) OVER w OR bp <> lag(bp) OVER w THEN 'pre' WHEN cc <> lag(cc) OVER w THEN 'palette' WHEN ds <> lag(ds) OVER w THEN 'segment' ELSE 'fit' END AS stage FROM r WHERE ran WINDOW w AS (PARTITION BY session ORDER BY ms, job_id))
SELECT r.session, r.job_id, ms + {CHANGE_WAIT} AS run_ms, ran, stage FROM r LEFT JOIN s USING (session, job_id)"""
    q["job_stream"] = q["job_debounce"] + f" WHERE ms + {CHANGE_WAIT} <= (SELECT max(ms) FROM c)"
    q["job_superseded"] = f"WITH {JOBS} SELECT session, job_id, lead(job_id) OVER (PARTITION BY session ORDER BY job_id) IS NOT NULL AS superseded FROM j"
    return q
