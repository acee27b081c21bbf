"""Tone operators: flatten, blur, saturation, levels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rasterloom.functions.numeric import half_up, u8

# Luma weights; grid, basis size, acceptance windows and least pivot of the illumination fit.
LUMA = (0.2126, 0.7152, 0.0722)
GRID, BASIS, WINDOWS, PIVOT = 32, 6, (40, 30, 25, 25), 1e-9


def luma(r="r", g="g", b="b") -> Column:
    return LUMA[0] * F.col(r) + LUMA[1] * F.col(g) + LUMA[2] * F.col(b)


def with_channels(px: DataFrame, f, *kept: str) -> DataFrame:
    return px.select("image_id", "width", "height", "y", "x", *kept, *[f(c).alias(c) for c in "rgb"])


def saturation(px: DataFrame, s: float) -> DataFrame:
    """Move channels away from (s > 1) or towards (s < 1) the pixel's luma; not rounded."""
    return with_channels(px, lambda c: luma() + (F.col(c) - luma()) * s)


def levels(px: DataFrame, black: float | Column, white: float | Column) -> DataFrame:
    """Stretch black..white to 0..255 and store as bytes; a white point not above black counts as black + 1."""
    span = F.greatest(F.lit(white) if not isinstance(white, Column) else white, F.lit(1) + black) - black
    return with_channels(px, lambda c: u8((F.col(c) - black) * 255.0 / span))


def box_widths(sigma: float, n: int = 3) -> list[int]:
    """Odd widths whose composed boxes have the variance of a Gaussian; one real pass at least."""
    ideal = math.sqrt(12 * sigma * sigma / n + 1)
    low = max(1, math.floor(ideal) - (math.floor(ideal) % 2 == 0))
    m = min(n, max(0, math.floor((12 * sigma * sigma - n * low * low - 4 * n * low - 3 * n) / (-4 * low - 4) + 0.5)))
    widths = [low] * m + [low + 2] * (n - m)
    if low == 1 and m == n:
        widths[-1] = 3
    return widths


def box_pass(px: DataFrame, radius: int, along: str) -> DataFrame:
    """Sliding mean of width 2 radius + 1 with replicated edges, stored as 32-bit floats.

    A mean is the difference of two running sums, so the work does not grow with the radius; sums
    of bytes or 32-bit floats of a line are exact in doubles.
    """
    other, size = ("y", "width") if along == "x" else ("x", "height")
    line = W.partitionBy("image_id", other).orderBy(along)
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    run = px.select("image_id", "width", "height", "y", "x", *[e for c in "rgb" for e in (F.col(c).cast("double").alias(c), F.sum(F.col(c).cast("double")).over(line.rowsBetween(W.unboundedPreceding, 0)).alias(f"s{c}"))])
    before = F.greatest(F.lit(0), radius - F.col(along))
    after = F.greatest(F.lit(0), F.col(along) + radius - (F.col(size) - 1))

    def mean(c):
        upto, short = F.coalesce(F.lead(f"s{c}", radius).over(line), F.last(f"s{c}").over(whole)), F.coalesce(F.lag(f"s{c}", radius + 1).over(line), F.lit(0.0))
        return ((upto - short + before * F.first(c).over(whole) + after * F.last(c).over(whole)) / (2 * radius + 1)).cast("float")

    return with_channels(run, mean)


def blur(px: DataFrame, sigma: float) -> DataFrame:
    for width in box_widths(sigma):
        if width > 1:
            px = box_pass(box_pass(px, width // 2, "x"), width // 2, "y")
    return px


def luma_histogram(px: DataFrame) -> DataFrame:
    """(image_id, g, cell_y, cell_x, bin, n): luma bins of the cells of a g x g grid; none for images too small."""
    g = F.greatest(F.lit(4), F.least(F.lit(GRID), F.floor(F.least("width", "height") / 8))).cast("int")
    cell = lambda p, size: F.least(F.col("g") - 1, F.floor(F.col(p) * F.col("g") / F.col(size))).cast("int")
    tone = half_up(F.greatest(F.lit(0.0), F.least(F.lit(255.0), luma()))).cast("int")
    px = px.select("image_id", "width", "height", "y", "x", tone.alias("bin"), g.alias("g")).where(F.col("g") * F.col("g") >= 3 * BASIS)
    return px.groupBy("image_id", "g", cell("y", "height").alias("cell_y"), cell("x", "width").alias("cell_x"), "bin").agg(F.count("*").alias("n"))


def cell_modes(hist: DataFrame) -> DataFrame:
    """(image_id, g, cell_y, cell_x, mode): centre of the fullest run of five bins, the lowest of equal ones."""
    spread = hist.select("image_id", "g", "cell_y", "cell_x", "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("bin") - 2), F.least(F.lit(255), F.col("bin") + 2))).alias("bin"))
    sums = spread.groupBy("image_id", "g", "cell_y", "cell_x", "bin").agg(F.sum("n").alias("s"))
    return sums.groupBy("image_id", "g", "cell_y", "cell_x").agg(F.max_by("bin", F.struct("s", -F.col("bin"))).alias("mode"))


def basis(u, v) -> list:
    return [u * 0 + 1.0, u, v, u * u, u * v, v * v]


def solve(sums: Column, n: int = BASIS) -> Column:
    """Unknowns of n linear equations, given as n * n coefficients by rows and then n right sides; null where a pivot is under 1e-9.

    Each step takes the row with the largest coefficient of the step's unknown, the first of
    equal ones, and clears that unknown from all other rows.
    """
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.slice(sums, i * n + 1, n), F.array(F.get(sums, n * n + i))))

    def clear(state, k):
        rows = state["rows"]
        best = -F.array_max(F.transform(F.sequence(k, F.lit(n - 1)), lambda i: F.struct(F.abs(F.get(F.get(rows, i), k)).alias("size"), (-i).alias("i"))))["i"]
        pivot = F.get(rows, best)

        def row(r, i):
            mine = F.when(i == best, F.get(rows, k)).otherwise(r)
            cleared = F.zip_with(mine, pivot, lambda a, p: a - p * (F.get(mine, k) / F.get(pivot, k)))
            return F.when(i == k, F.transform(pivot, lambda p: p / F.get(pivot, k))).otherwise(cleared)

        ok = state["ok"] & (F.abs(F.get(pivot, k)) >= PIVOT)
        return F.struct(F.when(ok, F.transform(rows, row)).otherwise(rows).alias("rows"), ok.alias("ok"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.struct(rows.alias("rows"), F.lit(True).alias("ok")), clear)
    return F.when(done["ok"], F.transform(done["rows"], lambda r: F.get(r, n)))


def illumination(px: DataFrame) -> DataFrame:
    """(image_id, coef, mid): bi-quadratic surface through the modes near their median; only images that have one.

    A pass sums the normal equations over the accepted cells of each image; the small solve runs
    once for each image and pass.
    """
    cells = cell_modes(luma_histogram(px)).select("image_id", ((F.col("cell_x") + 0.5) / F.col("g") - 0.5).alias("u"), ((F.col("cell_y") + 0.5) / F.col("g") - 0.5).alias("v"), F.col("mode").cast("double").alias("m"))
    by = W.partitionBy("image_id")
    cells = cells.withColumn("centre", F.sort_array(F.collect_list("m").over(by))[F.floor(F.count("*").over(by) / 2).cast("int")])
    f = basis(F.col("u"), F.col("v"))
    terms = [f[i] * f[k] for i in range(BASIS) for k in range(BASIS)] + [f[i] * F.col("m") for i in range(BASIS)]

    for window in WINDOWS:
        sums = cells.where(F.abs(F.col("m") - F.col("centre")) <= window).groupBy("image_id").agg(F.count("*").alias("used"), F.array(*[F.sum(t) for t in terms]).alias("sums"))
        coef = sums.where(F.col("used") >= 3 * BASIS).select("image_id", solve(F.col("sums")).alias("coef")).where("coef IS NOT NULL")
        cells = cells.drop("coef").join(coef, "image_id").withColumn("centre", surface(F.col("u"), F.col("v")))
    found = cells.groupBy("image_id").agg(F.first("coef").alias("coef"))
    steps = [i / 8 - 0.5 for i in range(9)]
    probes = F.array(*[surface(F.lit(u), F.lit(v)) for v in steps for u in steps])
    return found.withColumn("mid", F.sort_array(probes)[40])


def surface(u: Column, v: Column) -> Column:
    out = F.lit(0.0)
    for k, f in enumerate(basis(u, v)):
        out = out + F.col("coef")[k] * f
    return out


def flatten(px: DataFrame, strength: float | Column) -> DataFrame:
    """Divide out the illumination surface; gains lie in 1/4..4 and images without a surface stay."""
    lit = px.join(illumination(px), "image_id", "left")
    level = surface((F.col("x") + 0.5) / F.col("width") - 0.5, (F.col("y") + 0.5) / F.col("height") - 0.5)
    eff = F.col("mid") + (level - F.col("mid")) * strength
    gain = F.when(F.col("mid").isNull() | (F.col("mid") <= 1), 1.0).when(eff <= 1, 4.0).otherwise(F.least(F.lit(4.0), F.greatest(F.lit(0.25), F.col("mid") / eff)))
    return with_channels(lit.withColumn("gain", gain), lambda c: (F.col(c) * F.col("gain")).cast("float"))


def preprocess(px: DataFrame, flatten_strength: float = 0.0, blur_radius: float = 0.0, saturate: float = 1.0, black: float = 0.0, white: float = 255.0) -> DataFrame:
    """Flatten, blur, saturation and levels, in this order; identity options return ``px`` itself."""
    if (flatten_strength, blur_radius, saturate, black, white) == (0, 0, 1, 0, 255):
        return px
    if flatten_strength > 0:
        px = flatten(px, flatten_strength)
    if blur_radius > 0:
        px = blur(px, blur_radius)
    return levels(saturation(px, saturate), black, white)


def preprocess_each(px: DataFrame, options: DataFrame) -> DataFrame:
    """``preprocess`` with each image's own options: rows (image_id, flatten, blur_radius, saturation, black_point, white_point).

    Options are columns of the pixels; an image that a step does not touch passes by it. Blurs
    run once for each list of box widths that some image asks for, of which there are a few tens
    in the options' domain of 0 to 10.
    """
    names = ["flatten", "blur_radius", "saturation", "black_point", "white_point"]
    fixed = ["image_id", "width", "height", "y", "x", "r", "g", "b"]
    set_ = options.select("image_id", *[F.col(c).cast("double").alias(c) for c in names])
    asked = set_.select("flatten", "blur_radius").distinct().collect()
    if any(r.flatten > 0 for r in asked):
        strong = set_.where("flatten > 0").select("image_id", F.col("flatten").alias("strength"))
        flat = flatten(px.join(strong, "image_id"), F.col("strength"))
        px = flat.unionByName(px.select(*fixed).join(strong, "image_id", "left_anti"))
    widths: dict[tuple, set] = {}
    for r in asked:
        if r.blur_radius > 0:
            widths.setdefault(tuple(box_widths(r.blur_radius)), set()).add(r.blur_radius)
    if widths:
        parts = [px.join(set_.where("blur_radius <= 0").select("image_id"), "image_id", "left_semi").select(*fixed)]
        for radii in widths.values():
            parts.append(blur(px.join(set_.where(F.col("blur_radius").isin(*radii)).select("image_id"), "image_id", "left_semi"), min(radii)))
        px = parts[0]
        for p in parts[1:]:
            px = px.unionByName(p)
    px = px.join(set_.select("image_id", F.col("saturation").alias("s"), "black_point", "white_point"), "image_id")
    toned = with_channels(px, lambda c: luma() + (F.col(c) - luma()) * F.col("s"), "black_point", "white_point")
    return levels(toned, F.col("black_point"), F.col("white_point"))
