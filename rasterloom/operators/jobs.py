"""Job logs: which stage a change makes dirty, superseded jobs, and colours carried to a new palette."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# Options that each stage depends on first, in order, and the distance at which colours are the same.
STAGE_OPTIONS = (("pre", ("black_point", "white_point", "blur_radius", "saturation", "flatten")), ("palette", ("color_count",)), ("segment", ("despeckle_size", "gap_closing")))
SAME_COLOR = 20


def first_dirty_stage(jobs: DataFrame) -> DataFrame:
    """Add ``stage`` to (session, job_id, image_fp, options...): the first stage to run again after the job before."""
    w = W.partitionBy("session").orderBy("job_id")
    changed = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(w))
    stage = F.when(F.lag("job_id").over(w).isNull() | changed("image_fp"), "pre")
    for name, options in STAGE_OPTIONS:
        known = [c for c in options if c in jobs.columns]
        if known:
            hit = changed(known[0])
            for c in known[1:]:
                hit = hit | changed(c)
            stage = stage.when(hit, name)
    return jobs.withColumn("stage", stage.otherwise("fit"))


def debounced(changes: DataFrame, wait: int) -> DataFrame:
    """(session, job_id, run_ms, ran, stage) of changes (session, job_id, ts, image_fp, options...).

    A change runs ``wait`` milliseconds after it came unless the session's next one, by time and
    job_id, comes before that; the stage of one that runs is the first that differs from the run
    before.
    """
    w = W.partitionBy("session").orderBy("ms", "job_id")
    placed = changes.withColumn("ms", F.unix_millis("ts"))
    next_ms = F.lead("ms").over(w)
    placed = placed.withColumn("ran", next_ms.isNull() | (next_ms - F.col("ms") >= wait))
    # Jobs are compared in the order in which they run.
    ranked = placed.where("ran").withColumn("job", F.col("job_id")).withColumn("job_id", F.row_number().over(w))
    stages = first_dirty_stage(ranked).select("session", F.col("job").alias("job_id"), "stage")
    return placed.join(stages, ["session", "job_id"], "left").select("session", "job_id", (F.col("ms") + wait).alias("run_ms"), "ran", "stage")


def job_superseded(jobs: DataFrame) -> DataFrame:
    """Add ``superseded``: a later job of the session exists."""
    return jobs.withColumn("superseded", F.lead("job_id").over(W.partitionBy("session").orderBy("job_id")).isNotNull())


def palette_remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(image_id, color_idx, override) of the new palette: each override moves to the nearest new colour within 20.

    ``old`` has image_id, color_idx, r, g, b, override. Equally near colours: the lower index;
    several overrides on one colour: the nearest, then the lower old index.
    """
    o, n = old.where("override IS NOT NULL").alias("o"), new.alias("n")
    d = sum((F.col(f"o.{c}") - F.col(f"n.{c}")) * (F.col(f"o.{c}") - F.col(f"n.{c}")) for c in "rgb")
    pairs = o.join(n, F.col("o.image_id") == F.col("n.image_id")).select("o.image_id", F.col("o.color_idx").alias("i"), "override", F.col("n.color_idx").alias("j"), d.alias("d"))
    best = pairs.groupBy("image_id", "i", "override").agg(F.min(F.struct("d", "j")).alias("m")).where(F.col("m.d") <= SAME_COLOR**2)
    won = best.groupBy("image_id", F.col("m.j").alias("color_idx")).agg(F.min_by("override", F.struct("m.d", "i")).alias("override"))
    return new.select("image_id", "color_idx").join(won, ["image_id", "color_idx"], "left")


def carry_overrides(old: DataFrame, new: DataFrame) -> DataFrame:
    """(image_id, color_idx, override) of each image's new palette.

    Where a palette keeps its number of colours, overrides stay at their index: colours may move
    but stay in order. Where the number changes they go to near colours, as ``palette_remap`` says.
    """
    sizes = old.groupBy("image_id").agg(F.count("*").alias("was")).join(new.groupBy("image_id").agg(F.count("*").alias("now")), "image_id")
    same = sizes.where("was = now").select("image_id")
    kept = new.join(same, "image_id", "left_semi").select("image_id", "color_idx").join(old.select("image_id", "color_idx", "override"), ["image_id", "color_idx"], "left")
    changed = new.join(same, "image_id", "left_anti")
    return kept.unionByName(palette_remap(old.join(same, "image_id", "left_anti"), changed))


def compute_fit(views: DataFrame) -> DataFrame:
    """Add zoom, pan_x and pan_y that show an image (iw, ih) whole and centred in a container (cw, ch), never enlarged."""
    zoom = F.least(F.lit(1.0), F.col("cw") / F.col("iw"), F.col("ch") / F.col("ih"))
    return views.withColumn("zoom", zoom).withColumn("pan_x", (F.col("cw") - F.col("iw") * F.col("zoom")) / 2).withColumn("pan_y", (F.col("ch") - F.col("ih") * F.col("zoom")) / 2)
