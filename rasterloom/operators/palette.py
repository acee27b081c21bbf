"""Palette estimation: samples, clustering steps and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rasterloom.functions.numeric import u8

from .graph import cut, cut_counting

# Fixed values of the estimator: gradient bound, sample cap, near radius and cap, blend and dead distances, RMS goal, seed.
GRADIENT, CAP, NEAR, NEAR_CAP, BLEND, DEAD, RMS, SEED = 24, 50_000, 24, 20_000, 8, 4, 8, 12345


def ordinal() -> Column:
    return F.col("y").cast("long") * F.col("width") + F.col("x")


def flat_interior(px: DataFrame) -> DataFrame:
    """Interior pixels whose channels differ by less than 24 from all four neighbours; all pixels of images without any."""
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    gap = lambda c, w: F.greatest(F.abs(F.col(c) - F.lag(c).over(w)), F.abs(F.col(c) - F.lead(c).over(w)))
    edge = (F.col("x") >= 1) & (F.col("y") >= 1) & (F.col("x") < F.col("width") - 1) & (F.col("y") < F.col("height") - 1)
    graded = px.select("*", F.greatest(*[gap(c, w) for c in "rgb" for w in (row, col)]).alias("grad")).withColumn("flat", edge & (F.col("grad") < GRADIENT))
    some = graded.groupBy("image_id").agg(F.max(F.col("flat").cast("int")).alias("some"))
    return graded.join(some, "image_id").where(F.col("flat") | (F.col("some") == 0)).select(*px.columns)


def stride_sample(px: DataFrame, cap: int = CAP) -> DataFrame:
    """Every k-th pixel in raster order, k = max(1, n div cap); adds the pixel's place ``i`` in the sample.

    Places are prefix sums of row counts plus the rank in a row, so no window spans an image.
    """
    rows = px.groupBy("image_id", "y").agg(F.count("*").alias("c"))
    counts = W.partitionBy("image_id").orderBy("y")
    rows = rows.select("image_id", "y", (F.sum("c").over(counts) - F.col("c")).alias("start"), F.sum("c").over(W.partitionBy("image_id")).alias("n"))
    inside = F.row_number().over(W.partitionBy("image_id", "y").orderBy("x")) - 1
    step = F.greatest(F.lit(1), F.floor(F.col("n") / cap))
    placed = px.join(rows, ["image_id", "y"]).withColumn("o", F.col("start") + inside).withColumn("step", step)
    return placed.where(F.col("o") % F.col("step") == 0).select(*px.columns, F.floor(F.col("o") / F.col("step")).alias("i"))


def color_histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))


def distance2(r, g, b, p: Column) -> Column:
    return (F.col(r) - p["r"]) * (F.col(r) - p["r"]) + (F.col(g) - p["g"]) * (F.col(g) - p["g"]) + (F.col(b) - p["b"]) * (F.col(b) - p["b"])


def palette_array(palette: DataFrame) -> DataFrame:
    """(image_id, colors): colours of an image in order, 16 at most."""
    return palette.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("color_idx", "r", "g", "b"))).alias("colors"))


def nearest_palette(px: DataFrame, palette: DataFrame) -> DataFrame:
    """Add ``color_idx``, the nearest colour of the image's palette; the lowest index of equally near ones.

    Distinct colours are matched once and joined back to their pixels.
    """
    colors = color_histogram(px).drop("n").join(palette_array(palette), "image_id")
    best = F.array_min(F.transform("colors", lambda p: F.struct(distance2("r", "g", "b", p).alias("d"), p["color_idx"].alias("k"))))
    matched = colors.select("image_id", "r", "g", "b", best["k"].alias("color_idx"))
    return px.join(matched, ["image_id", "r", "g", "b"]).select(*px.columns, "color_idx")


def mulberry32(seed: int):
    """The public generator of that name: numbers in [0, 1) from a 32-bit counter. Its constants are fixed values."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        t = (t ^ (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF) & 0xFFFFFFFF
        return (t ^ t >> 14) / 4294967296

    return draw


def _gap2(p: Column, q: Column) -> Column:
    return (p["r"] - q["r"]) * (p["r"] - q["r"]) + (p["g"] - q["g"]) * (p["g"] - q["g"]) + (p["b"] - q["b"]) * (p["b"] - q["b"])


def center(k, r, g, b, n=None, sse=None) -> Column:
    kinds = {"color_idx": (k, "int"), "r": (r, "double"), "g": (g, "double"), "b": (b, "double"), "n": (n if n is not None else F.lit(0), "long"), "sse": (sse if sse is not None else F.lit(0), "double")}
    return F.struct(*[v.cast(kind).alias(name) for name, (v, kind) in kinds.items()])


def add_seed(sample: DataFrame, state: DataFrame | None, u: float) -> DataFrame:
    """(image_id, colors) with one more centre: a place in the sample drawn by squared distance from the others.

    ``u`` in [0, 1) is drawn for all images alike. The window spans an image's sample, which has
    fewer than twice CAP pixels.
    """
    line = W.partitionBy("image_id").orderBy("i")
    if state is None:
        placed = sample.withColumn("at", F.floor(u * F.count("*").over(W.partitionBy("image_id"))))
        return placed.where("i = at").select("image_id", F.array(center(F.lit(0), F.col("r"), F.col("g"), F.col("b"))).alias("colors"))
    d2 = F.array_min(F.transform("colors", lambda p: distance2("r", "g", "b", p)))
    run = sample.join(state, "image_id").withColumn("d2", d2).withColumn("sum", F.sum("d2").over(line)).withColumn("all", F.sum("d2").over(W.partitionBy("image_id")))
    here = F.struct(F.when(F.col("sum") >= u * F.col("all"), F.col("i")).otherwise(F.lit(1 << 40) - F.col("i")).alias("order"), "r", "g", "b")
    found = run.groupBy("image_id").agg(F.min(here).alias("m"), F.first("colors").alias("colors"))
    return found.select("image_id", F.concat("colors", F.array(center(F.size("colors"), *[F.col(f"m.{c}") for c in "rgb"]))).alias("colors"))


def lloyd(hist: DataFrame, state: DataFrame, rounds: int) -> DataFrame:
    """(image_id, colors) after ``rounds`` moves of the centres; n and sse are those of the last assignment.

    A centre without pixels stays. Rounds are chained in one plan, five at a time; where five
    change nothing, neither would more.
    """
    begun = state.select("image_id", F.col("colors").alias("was"))
    best = F.array_min(F.transform("colors", lambda p: F.struct(distance2("r", "g", "b", p).alias("d"), p["color_idx"].alias("k"))))
    for k in range(rounds):
        near = hist.join(state, "image_id").withColumn("m", best)
        sums = near.groupBy("image_id", F.col("m.k").alias("k")).agg(
            F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in "rgb"], F.sum(F.col("m.d") * F.col("n")).alias("sse"), F.first("colors").alias("colors"))
        moved = sums.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("n", "r", "g", "b", "sse")))).alias("t"), F.first("colors").alias("colors"))

        def move(c):
            t = F.element_at("t", c["color_idx"])
            return center(c["color_idx"], *[F.coalesce(t[x] / t["n"], c[x]) for x in "rgb"], F.coalesce(t["n"], F.lit(0)), F.coalesce(t["sse"], F.lit(0.0)))

        state = moved.select("image_id", F.transform("colors", move).alias("colors"))
        if k % 5 == 4 or k == rounds - 1:
            state, moved = cut_counting(state.join(begun, "image_id"), "colors <> was")
            state = state.select("image_id", "colors")
            if moved == 0:
                break
            begun = state.select("image_id", F.col("colors").alias("was"))
    return state


def live_centers(colors: Column) -> Column:
    """Centres with pixels that are not within DEAD of a live one before them."""

    def add(live, c):
        return F.when((c["n"] > 0) & ~F.exists(live, lambda x: _gap2(x, c) < DEAD**2), F.concat(live, F.array(c))).otherwise(live)

    return F.aggregate(colors, F.filter(colors, lambda c: F.lit(False)), add)


def is_blend(p: Column, live: Column, tol: float = BLEND) -> Column:
    """The colour lies within ``tol`` of a segment between two of the colours ``live``."""

    def between(x, y):
        ax, ay, az = (y[c] - x[c] for c in "rgb")
        dx, dy, dz = (p[c] - x[c] for c in "rgb")
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dx * ax + dy * ay + dz * az) / F.greatest(F.lit(1e-12), ax * ax + ay * ay + az * az)))
        ex, ey, ez = dx - t * ax, dy - t * ay, dz - t * az
        return (x["color_idx"] < y["color_idx"]) & (ex * ex + ey * ey + ez * ez < tol * tol)

    return F.exists(live, lambda x: F.exists(live, lambda y: between(x, y)))


def first_places(px: DataFrame) -> DataFrame:
    """(image_id, r, g, b, i): distinct colours of an image and the first place of each."""
    return px.groupBy("image_id", "r", "g", "b").agg(F.min(ordinal()).alias("i"))


def farthest_color(colors: DataFrame, live: DataFrame) -> DataFrame:
    """(image_id, far): the colour farthest from its nearest live centre, the first in raster order of equal ones; ``far.i`` is the negative place."""
    d = F.array_min(F.transform("live", lambda p: distance2("r", "g", "b", p)))
    return colors.join(live, "image_id").groupBy("image_id").agg(F.max(F.struct(d.alias("d"), (-F.col("i")).alias("i"), "r", "g", "b")).alias("far"))


def reseed(state: DataFrame, colors: DataFrame) -> DataFrame:
    """(image_id, colors, added): dead centres replaced, in order, by the colours farthest from the live ones.

    An image's replacing ends where the farthest colour is too near or a blend of live ones.
    ``colors`` has the distinct colours of an image and the first place ``i`` of each.
    """
    live = live_centers(F.col("colors"))
    dead = F.filter("colors", lambda c: ~F.exists("live", lambda x: x["color_idx"] == c["color_idx"]))
    st = state.withColumn("live", live).withColumn("dead", F.transform(dead, lambda c: c["color_idx"])).withColumn("added", F.filter("colors", lambda c: F.lit(False)))
    st, left = cut_counting(st, "size(dead) > 0")
    while left:
        open_ = st.where(F.size("dead") > 0)
        one = open_.join(farthest_color(colors, open_.select("image_id", "live")), "image_id")
        p = F.col("far")
        new = center(F.get("dead", F.lit(0)), p["r"], p["g"], p["b"])
        one = one.withColumn("new", new).withColumn("ok", (p["d"] >= DEAD * DEAD) & ~is_blend(p, F.col("live")))
        put = F.transform("colors", lambda c: F.when(F.col("ok") & (c["color_idx"] == F.col("new.color_idx")), F.col("new")).otherwise(c))
        grown = lambda c: F.when(F.col("ok"), F.concat(c, F.array("new"))).otherwise(F.col(c))
        rest = F.when(F.col("ok"), F.slice("dead", F.lit(2), F.greatest(F.lit(0), F.size("dead") - 1))).otherwise(F.slice("dead", F.lit(1), F.lit(0)))
        one = one.select("image_id", put.alias("colors"), grown("live").alias("live"), rest.alias("dead"), grown("added").alias("added"))
        st, left = cut_counting(st.where(F.size("dead") == 0).unionByName(one), "size(dead) > 0")
    return st.select("image_id", "colors", "added")


def near_pixels(px: DataFrame, added: DataFrame, radius: float = NEAR, cap: int = NEAR_CAP) -> DataFrame:
    """Columns of ``px`` and the centre ``k``: pixels near each added centre, every n-th in raster order so that ``cap`` at most remain."""
    near = px.join(added.select("image_id", F.explode("added").alias("c")), "image_id").where(distance2("r", "g", "b", F.col("c")) <= radius * radius)
    near = near.withColumn("k", F.col("c.color_idx"))
    rows = near.groupBy("image_id", "k", "y").agg(F.count("*").alias("c"))
    rows = rows.select("image_id", "k", "y", (F.sum("c").over(W.partitionBy("image_id", "k").orderBy("y")) - F.col("c")).alias("start"), F.sum("c").over(W.partitionBy("image_id", "k")).alias("n"))
    inside = F.row_number().over(W.partitionBy("image_id", "k", "y").orderBy("x")) - 1
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / cap))
    placed = near.drop("c").join(rows, ["image_id", "k", "y"]).withColumn("o", F.col("start") + inside).withColumn("step", step)
    return placed.where(F.col("o") % F.col("step") == 0).select(*px.columns, "k")


def near_samples(px: DataFrame, added: DataFrame, radius: float = NEAR, cap: int = NEAR_CAP) -> DataFrame:
    """(image_id, r, g, b, n): colours of ``near_pixels`` and how many of them have each."""
    return color_histogram(near_pixels(px, added, radius, cap))


def fit_palettes(px: DataFrame, hist: DataFrame, colors: DataFrame, seeds: DataFrame) -> DataFrame:
    """(image_id, colors) by 20 moves from the seeds and up to 4 repairs of empty or doubled centres, 10 moves each."""
    state = lloyd(hist, seeds, 20)
    done = None
    for _ in range(4):
        tried, more = cut_counting(reseed(state, colors), "size(added) > 0")
        same, changed = tried.where(F.size("added") == 0).select("image_id", "colors"), tried.where(F.size("added") > 0)
        done = same if done is None else done.unionByName(same)
        if more == 0:
            return cut(done)
        hist = hist.join(changed.select("image_id"), "image_id", "left_semi").unionByName(near_samples(px, changed))
        hist = cut(hist.groupBy("image_id", "r", "g", "b").agg(F.sum("n").alias("n")))
        state = lloyd(hist, changed.select("image_id", "colors"), 10)
    return cut(done.unionByName(state))


def estimate_palette(px: DataFrame, k: int | str | DataFrame = "auto") -> DataFrame:
    """(image_id, color_idx, r, g, b): k colours (2..16), or the fewest whose RMS distance is under 8, darkest first.

    ``k`` is a number, 'auto', or rows (image_id, k) with a number or null, for auto, for each
    image. Seeds are drawn from a strided sample of flat pixels; centres move over the sample's
    colour histogram, and repairs look at all colours of the image. All images go through each
    step together; what is kept between steps is 16 centres of an image at most.
    """
    sample = cut(stride_sample(flat_interior(px)).select("image_id", F.col("i").cast("long").alias("i"), "r", "g", "b"))
    hist = cut(sample.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n")))
    colors = cut(first_places(px))
    images = hist.select("image_id").distinct()
    wanted = images.join(k, "image_id", "left") if isinstance(k, DataFrame) else images.withColumn("k", F.lit(None if k == "auto" else int(k)))
    wanted = cut(wanted.select("image_id", F.when(F.col("k").isNotNull(), F.greatest(F.lit(2), F.least(F.lit(16), F.col("k")))).cast("int").alias("k")))
    draw, seeds, found, drawn = mulberry32(SEED), None, None, 0
    counts = sorted(r.k for r in wanted.select("k").distinct().collect() if r.k is not None)
    auto = wanted.where("k IS NULL").limit(1).count() > 0
    for m in range(2, 17) if auto else counts:
        while drawn < m:  # the draws of fewer centres are the first ones of more
            seeds, drawn = cut(add_seed(sample, seeds, draw())), drawn + 1
        open_ = wanted if found is None else wanted.join(found.select("image_id"), "image_id", "left_anti")
        fitted = fit_palettes(px, hist, colors, seeds.join(open_.where((F.col("k") == m) | F.col("k").isNull()).select("image_id"), "image_id", "left_semi"))
        sums = lambda name: F.aggregate("colors", F.lit(0.0), lambda a, c: a + c[name])
        if auto and m < 16:
            fitted = fitted.join(wanted, "image_id").where((F.col("k") == m) | (F.sqrt(sums("sse") / sums("n")) < RMS)).select("image_id", "colors")
        found = cut(fitted if found is None else found.unionByName(fitted))
        if wanted.join(found.select("image_id"), "image_id", "left_anti").limit(1).count() == 0:
            break
    dark = F.transform("colors", lambda c: F.struct((3 * c["r"] + 6 * c["g"] + c["b"]).alias("w"), c["color_idx"].alias("k"), c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b")))
    if found is None:  # no images
        found = seeds if seeds is not None else add_seed(sample, None, 0.0)
    rows = found.select("image_id", F.posexplode(F.sort_array(dark)).alias("color_idx", "c"))
    return rows.select("image_id", F.col("color_idx").cast("int").alias("color_idx"), *[u8(F.col(f"c.{c}")).alias(c) for c in "rgb"])
