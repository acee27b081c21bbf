"""Paths and documents as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.functions.numeric import centi, fmt_centi, fmt_plain, hex_color, join_numbers


def path_plain(loop: Column) -> Column:
    """Absolute path of a loop of cubics, two decimals."""
    f = lambda v: fmt_plain(centi(v))
    body = F.transform(loop, lambda c: F.concat(F.lit("C"), F.array_join(F.array(*[f(c[n]) for n in ("c1x", "c1y", "c2x", "c2y", "x1", "y1")]), " ")))
    first = F.get(loop, F.lit(0))
    return F.when(F.size(loop) == 0, "").otherwise(F.concat(F.lit("M"), f(first["x0"]), F.lit(" "), f(first["y0"]), F.array_join(body, ""), F.lit("Z")))


def path_compact(loop: Column) -> Column:
    """Relative path in hundredths of rounded coordinates, with as few characters as possible."""
    first = F.get(loop, F.lit(0))

    def part(c, i):
        # Deltas count from the rounded end of the cubic before.
        prev = F.get(loop, i - 1)
        ox = F.when(i == 0, centi(c["x0"])).otherwise(centi(prev["x1"]))
        oy = F.when(i == 0, centi(c["y0"])).otherwise(centi(prev["y1"]))
        nums = [fmt_centi(centi(c[n]) - (ox if n.endswith("x") or n == "x1" else oy)) for n in ("c1x", "c1y", "c2x", "c2y", "x1", "y1")]
        return F.concat(F.lit("c"), join_numbers(F.array(*nums)))

    start = join_numbers(F.array(fmt_centi(centi(first["x0"])), fmt_centi(centi(first["y0"]))))
    return F.when(F.size(loop) == 0, "").otherwise(F.concat(F.lit("M"), start, F.array_join(F.transform(loop, part), ""), F.lit("z")))


def merge_by_color(paths: DataFrame) -> DataFrame:
    """One path for each colour: areas add up, loops follow in the order of their regions."""
    return paths.groupBy("image_id", "color_idx").agg(
        F.sum("area").alias("area"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_pixel", "d"))), lambda p: p["d"]), "").alias("d"), F.min("first_pixel").alias("first_pixel"))


def background(paths: DataFrame) -> DataFrame:
    """(image_id, color_idx): colour of the largest path, the first of equal ones."""
    return paths.groupBy("image_id").agg(F.max_by("color_idx", F.struct("area", -F.col("first_pixel"))).alias("color_idx"))


def fill(overrides: Column) -> Column:
    """A colour's override where one is given for its index, else its own value."""
    return F.coalesce(F.get(overrides, F.col("color_idx")), hex_color(F.col("r"), F.col("g"), F.col("b")))


def assemble_flagged(paths: DataFrame, palette: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, svg, path_count) of paths (image_id, color_idx, area, first_pixel, d).

    ``images`` has image_id, width, height, and each image's own flags: stacked, merge,
    transparent and overrides, an array of colours or null by index. Largest first, equal areas by
    first pixel; stacked shapes in order of their first pixel, and neither merged nor dropped.
    """
    flags = ["stacked", "merge", "transparent"]
    # A path that is not merged is a group of its own.
    own = F.when(F.col("merge") & ~F.col("stacked"), F.lit(-1).cast("long")).otherwise(F.col("first_pixel"))
    one = paths.join(images.select("image_id", *flags), "image_id").withColumn("own", own).groupBy("image_id", *flags, "own", "color_idx")
    items = one.agg(F.sum("area").alias("area"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_pixel", "d"))), lambda p: p["d"]), "").alias("d"), F.min("first_pixel").alias("first_pixel"))
    items = items.join(background(items).withColumnRenamed("color_idx", "bg"), "image_id")
    items = items.where(F.col("stacked") | ~F.col("transparent") | (F.col("color_idx") != F.col("bg")))
    fills = palette.join(images.select("image_id", "overrides"), "image_id").select("image_id", "color_idx", fill(F.col("overrides")).alias("fill"))
    rule = F.when(F.col("stacked"), "").otherwise(' fill-rule="evenodd"')
    text = F.concat(F.lit('<path fill="'), F.col("fill"), F.lit('"'), rule, F.lit(' d="'), F.col("d"), F.lit('"/>'))
    key = F.struct(F.when(F.col("stacked"), 0.0).otherwise(-F.col("area")).alias("k"), "first_pixel", text.alias("t"))
    body = items.join(fills, ["image_id", "color_idx"]).groupBy("image_id").agg(F.sort_array(F.collect_list(key)).alias("p"))
    out = images.join(body, "image_id", "left")
    lines = F.coalesce(F.array_join(F.transform("p", lambda v: v["t"]), "\n  "), F.lit(""))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit('">\n  '))
    return out.select("image_id", F.concat(head, lines, F.lit("\n</svg>\n")).alias("svg"), F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("path_count"))


def assemble(paths: DataFrame, palette: DataFrame, images: DataFrame, stacked: bool = False, merge: bool = True, transparent: bool = False, overrides: list | None = None) -> DataFrame:
    """``assemble_flagged`` with the same flags for all images."""
    given = F.array(*[F.lit(o).cast("string") for o in overrides or []]).cast("array<string>")
    flags = images.select("image_id", "width", "height", F.lit(stacked).alias("stacked"), F.lit(merge).alias("merge"), F.lit(transparent).alias("transparent"), given.alias("overrides"))
    return assemble_flagged(paths, palette, flags)


def with_size(svg: Column, width: Column, height: Column) -> Column:
    """The document with its size in pixels as attributes of its first tag."""
    size = F.concat(F.lit('<svg width="'), width.cast("string"), F.lit('" height="'), height.cast("string"), F.lit('" '))
    return F.concat(size, F.substring(svg, F.lit(len("<svg ") + 1), F.length(svg)))
