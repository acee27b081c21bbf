"""Sharding by balanced label propagation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common

#: Rows that one ranking bucket holds on average; running sums are sums over buckets plus a sum inside one.
BUCKET_ROWS = 20_000
#: While labels move a shard may hold an SLACK-th more than its quota, so that full shards can exchange groups.
SLACK = 4


def _running(df: DataFrame, group: list[str], bucket: Column, order: list[str], n: Column) -> DataFrame:
    """Add ``start``, the sum of ``n`` over the earlier rows of the group, without bringing a group into one task.

    Buckets are summed first; their starts come from a window over those sums.
    """
    df = df.withColumn("bucket", bucket)
    sums = df.groupBy(*group, "bucket").agg(F.sum(n).alias("held"))
    before = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(sums, [*group, "bucket"])
    return df.withColumn("start", F.col("base") + F.col("inside")).drop("bucket", "base", "inside")


def _bucket(n_rows: int, *of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(max(16, -(-n_rows // BUCKET_ROWS)))).cast("int")


def _pick(values: list[int], index: Column) -> Column:
    """values[index] as an expression; the list has one number for each shard."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)


def _shard_at(starts: list[int], position: Column) -> Column:
    """The shard whose stretch of free places holds a position; ``starts`` has where each begins."""
    found = F.lit(0)
    for at in starts[1:]:
        found = found + (position >= at).cast("int")
    return found


def fit(sizes: list[int], free: list[int]) -> list[list[tuple[int, int]]]:
    """(shard, rows) pieces for some sizes, the largest first, each in the tightest shard that holds it whole.

    What no shard holds fills the emptiest one, and its rest is placed likewise. ``free`` is updated.
    """
    out: list = [[] for _ in sizes]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        left = sizes[i]
        while left:
            whole = [s for s in range(len(free)) if free[s] >= left]
            s = min(whole, key=lambda s: free[s]) if whole else max(range(len(free)), key=lambda s: free[s])
            n = min(left, free[s])
            out[i].append((s, n))
            free[s] -= n
            left -= n
    return out


def fill_with_large(sizes: list[int], free: list[int]) -> list[list[tuple[int, int]]]:
    """Pieces for groups that are larger than a shard: whole empty shards, and a rest placed by ``fit``."""
    out: list = [[] for _ in sizes]
    rests, s = list(sizes), 0
    for i in range(len(sizes)):
        while s < len(free) and rests[i] and rests[i] >= free[s]:
            out[i].append((s, free[s]))
            rests[i] -= free[s]
            free[s] = 0
            s += 1
    return [a + b for a, b in zip(out, fit(rests, free))]


def _placed(spark, keys: list, pieces: list, used: list[int]) -> DataFrame:
    """(k1, k2, pieces) of a few groups, as constants: (shard, slot, lo, hi) says where rows lo to hi of a group go. ``used`` is updated."""
    rows = []
    for (k1, k2), parts in zip(keys, pieces):
        at, made = 0, []
        for s, n in parts:
            made.append(F.struct(F.lit(s).alias("shard"), *[F.lit(v).cast("long").alias(c) for c, v in zip(("slot", "lo", "hi"), (used[s], at, at + n))]))
            used[s] += n
            at += n
        rows.append(F.struct(F.lit(k1).cast("long").alias("k1"), F.lit(k2).cast("long").alias("k2"), F.array(*made).alias("pieces")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def _one_piece(units: DataFrame, shard: Column, slot: Column) -> DataFrame:
    piece = F.struct(shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(0).cast("long").alias("lo"), F.col("m").cast("long").alias("hi"))
    return units.select("k1", "k2", F.array(piece).alias("pieces"))


def _histogram(linked: DataFrame, shards: int) -> DataFrame:
    """(k1, k2, m, hist): rows of a group in each shard; ties are ordered by a hash of the group, so that neighbours agree."""
    counts = linked.groupBy("k1", "k2").agg(F.count("*").alias("m"), *[F.sum((F.col("shard") == s).cast("long")).alias(f"c{s}") for s in range(shards)])
    cells = [F.struct(F.col(f"c{s}").alias("n"), F.pmod(F.xxhash64("k1", "k2", F.lit(s)), F.lit(1 << 20)).alias("tie"), F.lit(s).alias("s")) for s in range(shards)]
    return counts.select("k1", "k2", "m", F.array(*cells).alias("hist"))


def propagate(linked: DataFrame, hot: DataFrame, shards: int, room: list[int], rounds: int) -> DataFrame:
    """Move linked rows towards the shards of their neighbours: (row, k1, k2, shard).

    Rows with the same (k1, k2) are neighbours of each other. In each round a join gives every
    row its neighbours' histogram over shards. A row wants the shard where most neighbours are,
    among those with room and its own. What a group sends to a shard is admitted whole or not at
    all, until the shard's ``room`` is used up. ``hot`` has the keys of groups whose rows are
    dealt to several tasks.
    """
    for _ in range(rounds):
        held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        free = [max(0, room[s] - held.get(s, 0)) for s in range(shards)]
        seen = common.join_spread(linked, _histogram(linked, shards).drop("m"), ["k1", "k2"], hot)
        wanted = F.array_max(F.filter("hist", lambda x: (x["s"] == F.col("shard")) | (_pick(free, x["s"]) > 0)))["s"]
        seen = common.cut(seen.withColumn("to", wanted.cast("int")).drop("hist"))
        wishes = seen.where("to <> shard").groupBy("to", "k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") <= _pick(free, F.col("to")))
        lined = _running(wishes, ["to"], _bucket(sum(held.values()), "k1", "k2"), ["k1", "k2"], F.col("n"))
        admitted = lined.where(F.col("start") + F.col("n") <= _pick(free, F.col("to"))).groupBy("k1", "k2").agg(F.collect_set("to").alias("open"))
        admitted = common.cut(admitted)
        if admitted.limit(1).count() == 0:
            break
        moved = common.join_spread(seen, admitted, ["k1", "k2"], hot, "left")
        goes = F.coalesce(F.array_contains("open", F.col("to")), F.lit(False))
        linked = common.cut(moved.select("row", "k1", "k2", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")))
    return linked


def place_groups(units: DataFrame, cap: list[int], used: list[int], total: int) -> DataFrame:
    """(k1, k2, pieces) of groups (k1, k2, m, label): whole groups in shards that have ``cap`` places left. ``cap`` and ``used`` are updated.

    Groups stand in line for the shard of their label. Those that end within its places stay;
    the others stand in line for what is left anywhere. A group that lies across the end of a
    shard's places, of which each line has one for each shard at most, goes to the driver, which
    looks for a shard that holds it whole. Only what fits nowhere is cut.
    """
    spark, shards = units.sparkSession, len(cap)
    lined = common.cut(_running(units, ["label"], _bucket(total, "k1", "k2"), ["k1", "k2"], F.col("m")))
    end, room = F.col("start") + F.col("m"), _pick(cap, F.col("label"))
    home = lined.where(end <= room)
    out = [_one_piece(home, F.col("label"), F.col("start") + _pick(used, F.col("label")))]
    for r in home.groupBy("label").agg(F.sum("m").alias("n")).collect():
        cap[r.label] -= r.n
        used[r.label] += r.n
    across = lined.where((F.col("start") < room) & (end > room)).select("k1", "k2", "m").collect()

    later = lined.where(F.col("start") >= room).select("k1", "k2", "m", F.lit(0).alias("line"))
    later = common.cut(_running(later, ["line"], _bucket(total, "k1", "k2"), ["k1", "k2"], F.col("m")))
    starts = [sum(cap[:s]) for s in range(shards)]
    later = later.withColumn("first", _shard_at(starts, F.col("start"))).withColumn("last", _shard_at(starts, F.col("start") + F.col("m") - 1))
    whole = later.where(F.col("first") == F.col("last"))
    across += later.where(F.col("first") != F.col("last")).select("k1", "k2", "m").collect()
    runs = {r["first"]: (r.a, r.n) for r in whole.groupBy("first").agg(F.min("start").alias("a"), F.sum("m").alias("n")).collect()}
    base = [used[s] - runs.get(s, (0, 0))[0] for s in range(shards)]
    out.append(_one_piece(whole, F.col("first"), F.col("start") + _pick(base, F.col("first"))))
    for s, (_, n) in runs.items():
        cap[s] -= n
        used[s] += n
    if across:
        out.append(_placed(spark, [(r.k1, r.k2) for r in across], fit([r.m for r in across], cap), used))
    placed = out[0]
    for more in out[1:]:
        placed = placed.unionByName(more)
    return placed


def shards_with_keys(docs: DataFrame, shards: int = 16, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``balanced_shards`` with the key (k1, k2) of their text; k1 is null for null texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    crc = F.crc32(text.cast("binary"))
    rows = common.cut(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
        F.when(F.col(text_col).isNotNull(), F.xxhash64(text)).alias("k1"), (size * (1 << 32) + crc).alias("k2")))
    total = rows.count()
    cap = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    groups = common.cut(rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.count("*").alias("m")).where("m > 1"))
    hot = common.cut(common.frequent(groups, ["k1", "k2"], "m", total))
    # Fewer than ``shards`` groups can be larger than a shard.
    large = groups.where(F.col("m") > cap[0]).orderBy(F.desc("m"), "k1", "k2").collect()
    small = groups.where(F.col("m") <= cap[0])
    placed = [_placed(docs.sparkSession, [(r.k1, r.k2) for r in large], fill_with_large([r.m for r in large], cap), used)] if large else []

    linked = common.join_spread(rows.select("row", "k1", "k2").where("k1 IS NOT NULL"), small, ["k1", "k2"], hot)
    linked = common.cut(linked.select("row", "k1", "k2", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")))
    linked = propagate(linked, hot, shards, [c + -(-c // SLACK) for c in cap], rounds)
    units = _histogram(linked, shards).select("k1", "k2", "m", F.array_max("hist")["s"].alias("label"))
    placed.append(place_groups(units, cap, used, total))
    pieces = placed[0] if len(placed) == 1 else placed[0].unionByName(placed[1])
    pieces = common.cut(pieces.join(groups, ["k1", "k2"]))

    # Rows of a group are numbered in buckets, so that neither the numbering nor the join meets a whole group.
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / BUCKET_ROWS)).cast("int")
    mine = common.join_spread(rows.where("k1 IS NOT NULL"), groups, ["k1", "k2"], hot, "left")
    tied = mine.where("m IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int"))
    before = W.partitionBy("k1", "k2").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = tied.groupBy("k1", "k2", "part").agg(F.count("*").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    bases = bases.join(pieces.drop("m"), ["k1", "k2"])
    numbered = tied.withColumn("at", F.row_number().over(W.partitionBy("k1", "k2", "part").orderBy("row")) - 1).join(bases, ["k1", "k2", "part"])
    numbered = numbered.withColumn("at", F.col("base") + F.col("at"))
    piece = F.filter("pieces", lambda p: (p["lo"] <= F.col("at")) & (F.col("at") < p["hi"]))[0]
    numbered = numbered.withColumn("p", piece).withColumn("shard", F.col("p.shard")).withColumn("slot", F.col("p.slot") + F.col("at") - F.col("p.lo"))

    # Unlinked rows fill what groups left.
    loose = mine.where("m IS NULL").unionByName(rows.where("k1 IS NULL").withColumn("m", F.lit(None).cast("long")))
    loose = _running(loose.withColumn("line", F.lit(0)), ["line"], _bucket(total, "row"), ["row"], F.lit(1))
    starts = [sum(cap[:s]) for s in range(shards)]
    base = [used[s] - starts[s] for s in range(shards)]
    loose = loose.withColumn("shard", _shard_at(starts, F.col("start"))).withColumn("slot", F.col("start") + _pick(base, F.col("shard")))
    columns = ["doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), "k1", "k2"]
    return numbered.select(*columns).unionByName(loose.select(*columns))


def balanced_shards(docs: DataFrame, shards: int = 16, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard rows evenly while keeping documents with equal texts together.

    Returns id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot. Row counts of
    shards differ by one at most, and slots are gapless from 0 in each. Equal non-null texts link
    their documents. A group that is larger than a shard fills shards that it has alone, and its
    rest lies in one more if that fits; it takes no part in the propagation. Any other group stays
    whole unless no shard has room for it whole when it is placed, which unlinked rows, placed
    last, make rare. Null texts count as empty in size and checksum but are linked to nothing.
    Repeated rows are separate rows with equal texts. Very long texts are only measured and
    hashed. An empty table gives no rows. Which of equal rows goes to which shard depends on the
    order in which the table is read.
    """
    return shards_with_keys(docs, shards, rounds, id_col, text_col).drop("k1", "k2")


def cut_links(placed: DataFrame) -> DataFrame:
    """One row for the rows of ``shards_with_keys``: n_groups, n_split, n_links, n_cut.

    Every two rows of equal text are a link; it is cut if they lie in different shards. Null texts have none.
    """
    cells = placed.where("k1 IS NOT NULL").groupBy("k1", "k2", "shard").agg(F.count("*").alias("c"))
    groups = cells.groupBy("k1", "k2").agg(F.sum("c").alias("m"), F.count("*").alias("parts"), F.sum(F.expr("c * (c - 1) div 2")).alias("inside")).where("m > 1")
    links = F.expr("m * (m - 1) div 2")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return groups.agg(F.count("*").alias("n_groups"), zero(F.sum((F.col("parts") > 1).cast("long")), "n_split"), zero(F.sum(links), "n_links"), zero(F.sum(links - F.col("inside")), "n_cut"))
