"""Line dedup: exact Jaccard set join of lines, prefix-filtered by token rarity. DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common

#: Buckets of the token count table; every token of every line is counted in one of them.
RARITY_BUCKETS = 1 << 18
#: Lines of so many distinct tokens have 128 bits of sketch, shorter ones 64.
WIDE_WORDS = 96
#: White space that parts tokens beside the space; the newline parts lines.
OTHER_SPACES = "\t\x0b\x0c\r"
#: Lines of one token that a task holds; those of tokens with more are dealt to several tasks.
TOKEN_ROWS = 1 << 15
#: What a line's row of a token holds, and the places of a pair.
COLUMNS, NAMES = ("doc", "line", "np", "sketch", "wide"), ("doc", "line", "y_doc", "y_line")
#: Lines with fewer earlier ones of a token than this are compared with all of them, whatever the earliest is like.
SMALL_TOKEN = 16
#: Lines of a token with no more rows than this are joined with each other at once, without a look at the earliest.
PLAIN_ROWS = 1 << 8


def doc_key(id_col: str, text_col: str, keyed: bool) -> Column:
    """The id alone where ids are not null and occur once; else the id beside 64 bits of the text's hash, as rows that share only the id are different documents.

    Two such keys are equal if all their parts are, nulls too, and a null id sorts first.
    """
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key")) if keyed else F.col(id_col)


def same_place(a: DataFrame, b: DataFrame, names: tuple = ("doc", "line"), others: tuple | None = None) -> Column:
    """Null-safe equality of places: a null id is an id like others."""
    tests = [a[x].eqNullSafe(b[y]) for x, y in zip(names, others or names)]
    return functools.reduce(lambda x, y: x & y, tests)


def lines_of(docs: DataFrame, id_col: str, text_col: str, keyed: bool = True) -> DataFrame:
    """(doc, line, text): the document's key and the line's number; documents of equal id and text give equal rows.

    Without ``keyed``, for ids that occur once, the key is the id and rows are smaller.
    """
    src = docs.where(F.col(text_col).isNotNull())
    return src.select(doc_key(id_col, text_col, keyed).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def spaced(line: Column) -> Column:
    """The line with spaces for all white space; few lines hold any other."""
    odd = functools.reduce(lambda a, b: a | b, [F.contains(line, F.lit(c)) for c in OTHER_SPACES])
    return F.when(odd, F.translate(line, OTHER_SPACES, " " * len(OTHER_SPACES))).otherwise(line)


def words(line: Column) -> Column:
    """Tokens between runs of white space."""
    return F.array_remove(F.split(spaced(line), " "), "")


def line_hash(text: Column) -> list[Column]:
    """128 bits that stand for a line: ``same`` and ``check``."""
    return [F.xxhash64(text).alias("same"), (F.octet_length(text).cast("long") * (1 << 32) + F.crc32(text.cast("binary"))).alias("check")]


def rarity_levels(texts: DataFrame) -> list[int]:
    """Level of each bucket: 2 log2 of the occurrences of its tokens over all lines, which need not be parted for this."""
    bucket = F.xxhash64("w").bitwiseAND(F.lit(RARITY_BUCKETS - 1))
    whole = texts.select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    counts = whole.select(F.explode(F.split(spaced(F.col("text")), " ")).alias("w")).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).toArrow()
    levels = [0] * RARITY_BUCKETS
    for b, n in zip(counts["b"].to_pylist(), counts["n"].to_pylist()):
        levels[b] = min(127, int(2 * math.log2(n + 1)))
    return levels


def first_places(rows: DataFrame) -> DataFrame:
    """``rows`` without the columns doc and line, once, with the first (doc, line) of equal rows and their number, ``copies``.

    The smallest struct takes a sorted grouping, which costs less than a place packed into one decimal.
    """
    keys = [c for c in rows.columns if c not in ("doc", "line")]
    return rows.groupBy(*keys).agg(F.min(F.struct("doc", "line")).alias("f"), F.count("*").alias("copies")).select("f.*", *keys, "copies")


def line_prefixes(lines: DataFrame, levels: list[int], num: int, den: int) -> DataFrame:
    """Distinct lines with the place of their first occurrence, size, prefix tokens and a parity sketch.

    Tokens are ordered by rarity, ties by their hash. Two lines with a Jaccard similarity of
    num/den or more share one of the first n - ceil(n num/den) + 1 tokens. The sketch has a bit
    flipped by each token; two sketches differ in no more bits than the sets in tokens. In long
    lines ``wide`` has the flips of half of the tokens alone, which makes a sketch of twice the bits.
    Prefix tokens are 31 bits of their hashes, negative where the level allows more than PLAIN_ROWS rows.
    """
    hashes = F.array_distinct(F.transform(F.split(spaced(F.col("text")), " "), lambda w: F.xxhash64(w)))
    hashes = F.array_remove(hashes, F.xxhash64(F.lit("")))  # numbers are dropped faster than strings
    # Array functions are interpreted node by node for every token, so their bodies are kept short.
    # Without nulls, as coalesce says, codes are sorted as plain numbers.
    level = common.numbers(levels, "bigint")
    codes = F.transform(hashes, lambda h: F.shiftleft(F.coalesce(F.get(level, h.bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int")), F.lit(0).cast("long")), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1))))
    # inline() keeps the filter below from computing the codes a second time.
    src = lines.select("doc", "line", *line_hash(F.col("text")), F.inline(F.array(F.struct(F.sort_array(codes).alias("codes")))))
    n = F.size("codes")
    keep = n - F.floor((n * num + den - 1) / den).cast("int") + 1
    # A shift takes the low six bits of the hash.
    sketch = F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(c))))
    half = F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.shiftright(c, 26).bitwiseAND(F.lit(1)), F.hash(c))))
    wide = F.when(n >= WIDE_WORDS, half).otherwise(0)
    sure = int(2 * math.log2(min(PLAIN_ROWS, TOKEN_ROWS) + 1)) << 56

    def token(c: Column) -> Column:
        low = c.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        return F.when(c < F.lit(sure).cast("long"), low).otherwise(F.bitwise_not(low))

    rows = src.where(n > 0).select("doc", "line", "same", "check", n.alias("n"), sketch.alias("sketch"), wide.alias("wide"), F.transform(F.slice("codes", F.lit(1), keep), token).alias("prefix"))
    return first_places(rows)


def earlier(keyed: bool) -> Column:
    """The place y comes before its partner. Plain ids are compared without making structs of every pair."""
    if keyed:
        return F.struct("y_doc", "y_line") < F.struct("doc", "line")
    return (F.col("y_doc") < F.col("doc")) | ((F.col("y_doc") == F.col("doc")) & (F.col("y_line") < F.col("line")))


def _may_match(num: int, den: int) -> Column:
    """Sketch, length and positional filters on a pair x, y that shares a prefix token.

    Sets that match differ in no more than (den - num) / (den + num) of their sizes' sum. Most pairs
    fail this for 64 bits of sketch, the cheapest test, so it comes first.
    """
    n, m = (F.shiftright(c, 32) for c in ("np", "y_np"))
    pos, y_pos = (F.col(c).bitwiseAND(F.lit((1 << 32) - 1)) for c in ("np", "y_np"))
    need = F.expr(f"((shiftright(np, 32) + shiftright(y_np, 32)) * {num} + {num + den - 1}) div {num + den}")
    reach = F.least(n - pos, m - y_pos)
    both = F.col("sketch").bitwiseXOR(F.col("y_sketch"))
    half = F.col("wide").bitwiseXOR(F.col("y_wide"))
    differ = F.when((n >= WIDE_WORDS) & (m >= WIDE_WORDS), F.bit_count(half) + F.bit_count(both.bitwiseXOR(half))).otherwise(F.bit_count(both))
    near = F.bit_count(both) * (num + den) <= (n + m) * (den - num)
    return near & (n * num <= m * den) & (m * num <= n * den) & (reach >= need) & (differ <= n + m - 2 * need)


def texts_of(pairs: DataFrame, lines: DataFrame, kept: list[str], few: bool = False) -> DataFrame:
    """(doc, line, text) of all lines in some pair, by one scan; a bitmap may let a few others through.

    Where pairs are few, only their documents are cut into lines.
    """
    ids = pairs.select("doc", "line").union(pairs.select("y_doc", "y_line"))
    if few:
        lines = lines.where(common.bitmap(ids, "doc"))
    return common.stored(lines.where(common.bitmap(ids, "doc", "line")), kept)


def verified(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (doc, line, y_doc, y_line) whose lines have an exact Jaccard similarity of num/den or more."""
    x = texts.select("doc", "line", F.col("text").alias("x_t"))
    y = texts.select(F.col("doc").alias("y_doc"), F.col("line").alias("y_line"), F.col("text").alias("y_t"))
    both = pairs.join(x, (pairs["doc"].eqNullSafe(x["doc"])) & (pairs["line"] == x["line"])).drop(x["doc"]).drop(x["line"])
    both = both.join(y, (both["y_doc"].eqNullSafe(y["y_doc"])) & (both["y_line"] == y["y_line"])).drop(y["y_doc"]).drop(y["y_line"])
    both = both.select("*", F.inline(F.array(F.struct(F.array_distinct(words(F.col("x_t"))).alias("x_w"), F.array_distinct(words(F.col("y_t"))).alias("y_w")))))
    common_words = F.size(F.array_intersect("x_w", "y_w"))
    union = F.size("x_w") + F.size("y_w") - common_words
    return both.where(common_words * den >= union * num).select("doc", "line", "y_doc", "y_line")


def token_rows(distinct: DataFrame) -> DataFrame:
    """(token, place, np, sketch) of every prefix token of every line; np packs size and position."""
    rows = distinct.select("doc", "line", "n", "sketch", "wide", F.posexplode("prefix").alias("pos", "token"))
    # Columns that are known not to be null keep the plans below the exchange equal, so that it runs once.
    full = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    np = F.col("n").cast("long") * (1 << 32) + F.col("pos")
    return rows.select(full(F.col("token").cast("long")).alias("token"), "doc", full(F.col("line")).alias("line"), full(np).alias("np"), full(F.col("sketch")).alias("sketch"), full(F.col("wide")).alias("wide"))


def dealt_by_token(rows: DataFrame) -> DataFrame:
    """``rows`` shuffled by token, with token and line, of 32 bits each, in one number on the way, as these rows are most of what is written."""
    both = F.shiftleft("token", 32).bitwiseOR(F.col("line"))
    token = F.shiftright("both", 32)
    packed = rows.select(both.alias("both"), *[c for c in COLUMNS if c != "line"]).repartition(token)
    return packed.select(token.alias("token"), "doc", F.col("both").bitwiseAND(F.lit((1 << 32) - 1)).alias("line"), *COLUMNS[2:])


def crowded_tokens(distinct: DataFrame) -> DataFrame:
    """(token, count) of all with more than PLAIN_ROWS rows; only negative tokens may have so many."""
    counts = distinct.select(F.explode("prefix").alias("token")).where("token < 0").groupBy("token").count()
    return common.cut(counts.where(F.col("count") > min(PLAIN_ROWS, TOKEN_ROWS)).select(F.col("token").cast("long").alias("token"), "count"))


def hot_tokens(rows: DataFrame, levels: list[int], counts: DataFrame | None = None) -> DataFrame | None:
    """(token) of those with more than TOKEN_ROWS rows and more than a HOT_KEYS-th of all; fewer than HOT_KEYS, whatever the input.

    ``levels`` are 2 log2 of the occurrences in buckets of tokens, the largest among them; without a large one
    nothing is counted. ``counts`` are the tokens' numbers of rows, where these are known.
    """
    if 2 ** ((max(levels) + 1) / 2) <= TOKEN_ROWS:
        return None
    counts = common.cut(rows.groupBy("token").count()) if counts is None else counts
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    least = max(TOKEN_ROWS, (total or 0) // common.HOT_KEYS)
    return common.cut(counts.where(F.col("count") > least).select("token")) if (most or 0) > least else None


def other_side(rows: DataFrame) -> DataFrame:
    return rows.select("token", *[F.col(c).alias(f"y_{c}") for c in COLUMNS])


def earlier_partners(mine: DataFrame, rows: DataFrame, hot: DataFrame | None, num: int, den: int, keyed: bool) -> DataFrame:
    """Pairs of ``mine`` with earlier ``rows`` of the same token that pass the filters.

    Rows of a hot token meet in cells: by bands of sizes, as sizes that may match lie at most one
    band apart, and in each band by parts of TOKEN_ROWS rows on either side.
    """
    ok = earlier(keyed) & _may_match(num, den)
    theirs = other_side(rows)
    if hot is None:
        return mine.join(theirs, (mine["token"] == theirs["token"]) & ok)
    hot = F.broadcast(hot)
    a, b = mine.join(hot, "token", "left_anti"), theirs.join(hot, "token", "left_anti")
    cold = a.join(b, (a["token"] == b["token"]) & ok).drop(b["token"])
    band = lambda c: F.floor(F.log(F.shiftright(c, 32).cast("double")) / math.log(den / num) + 1e-9).cast("int")
    a = mine.join(hot, "token", "left_semi").withColumn("band", F.explode(F.array(*[band("np") + k for k in (-1, 0, 1)])))
    b = theirs.join(hot, "token", "left_semi").withColumn("band", band("y_np"))
    cells = a.groupBy("token", "band").agg(F.ceil(F.count("*") / TOKEN_ROWS).cast("int").alias("ps")).join(b.groupBy("token", "band").agg(F.ceil(F.count("*") / TOKEN_ROWS).cast("int").alias("qs")), ["token", "band"])
    cells = F.broadcast(common.cut(cells))  # a row for each hot token and band of sizes
    part = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    a = a.join(cells, ["token", "band"]).withColumn("p", part("ps", "doc", "line")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).drop("ps", "qs")
    b = b.join(cells, ["token", "band"]).withColumn("q", part("qs", "y_doc", "y_line")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("ps") - 1))).drop("ps", "qs")
    met = a.join(b, ["token", "band", "p", "q"]).where(ok)
    return cold.select(*NAMES, "sketch", "y_sketch").unionByName(met.select(*NAMES, "sketch", "y_sketch"))


def later_matches(lines: DataFrame, texts: DataFrame, num: int, den: int, keyed: bool, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct lines, and (doc, line) of those with an earlier similar line.

    Lines of a prefix token are joined with the earlier ones of it, which takes less than a window
    while a token has few rows. Those of a crowded token are first compared with the earliest of
    them through a window. Lines whose sketch is far from it are joined with the earlier lines
    of the token; the near ones are verified first and joined only if that fails, so a group of
    similar lines costs as many comparisons as it has lines.
    """
    levels = rarity_levels(texts)
    distinct = common.stored(line_prefixes(lines, levels, num, den), kept)
    every = token_rows(distinct)
    names = NAMES
    differ = F.bit_count(F.col("sketch").bitwiseXOR(F.col("y_sketch"))).alias("differ")
    # The bitmap parts tokens, not rows: all rows of a token go one way, and one that it lets through needlessly is only dearer.
    counts = crowded_tokens(distinct)
    crowded = (F.col("token") < 0) & common.bitmap(counts, "token")
    few = dealt_by_token(every.where(~crowded))
    plain = earlier_partners(few, few, None, num, den, keyed).select(*names, differ, F.lit(False).alias("skipped"))
    every = every.where(crowded)
    hot = hot_tokens(every, levels, counts)
    # Rows are shuffled once, for the window and for both sides of the join.
    cold = (every if hot is None else every.join(F.broadcast(hot), "token", "left_anti")).repartition("token")
    dealt = cold if hot is None else cold.unionByName(every.join(F.broadcast(hot), "token", "left_semi"))
    # In order of places the earliest line comes first, and a line of rank r has r - 1 earlier ones: one sort, no second look at a token's rows.
    ordered = W.partitionBy("token").orderBy("doc", "line")
    so_far = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    headed = cold.select("token", *COLUMNS, *[F.first(c).over(so_far).alias(f"y_{c}") for c in COLUMNS], F.row_number().over(ordered).alias("rank")).where(F.col("rank") > 1)
    if hot is not None:  # the earliest line of each hot token, without bringing its lines together
        busy = every.join(F.broadcast(hot), "token", "left_semi")
        heads = common.cut(busy.groupBy("token").agg(F.min(F.struct(*COLUMNS)).alias("h")))
        not_head = ~(F.col("doc").eqNullSafe(F.col("y_doc")) & (F.col("line") == F.col("y_line")))
        busy = busy.join(F.broadcast(heads), "token").select("token", *COLUMNS, *[F.col(f"h.{c}").alias(f"y_{c}") for c in COLUMNS], F.lit(TOKEN_ROWS).alias("rank"))
        headed = headed.unionByName(busy.where(not_head))
    tested = headed.withColumn("near", _may_match(num, den))
    near = tested.where("near").select(*names, differ, (F.col("rank") > SMALL_TOKEN).alias("skipped"))
    far = tested.where(f"rank > 2 AND (NOT near OR rank <= {SMALL_TOKEN})").select("token", *COLUMNS)
    rest = earlier_partners(far, dealt, hot, num, den, keyed).select(*names, differ, F.lit(False).alias("skipped"))
    pairs = common.cut(plain.union(near).union(rest).groupBy(*names).agg(F.min("differ").alias("differ"), F.max("skipped").alias("skipped")))
    texts = texts_of(pairs, lines, kept)
    # One match is enough to remove a line: its likeliest pair is verified first, the others where that fails.
    best = pairs.groupBy("doc", "line").agg(F.min(F.struct("differ", "y_doc", "y_line")).alias("b")).select("doc", "line", "b.y_doc", "b.y_line")
    found = common.cut(verified(best, texts, num, den).select("doc", "line").distinct())
    others = common.cut(pairs.select(*names).join(found, same_place(pairs, found), "left_anti"))
    found = common.cut(found.union(verified(others, texts, num, den).select("doc", "line")).distinct())

    # What was near an earliest line, matched nothing, and so was not compared with its token's other lines.
    tried = pairs.where("skipped").select("doc", "line").distinct()
    open_ = common.cut(tried.join(found, same_place(tried, found), "left_anti"))
    if open_.limit(1).count() == 0:
        return distinct, found
    o_names, p_names = ("o_doc", "o_line"), [f"p_{c}" for c in names]
    missed = open_.toDF(*o_names)
    mine = common.cut(dealt.where(common.bitmap(open_, "doc", "line")).join(missed, same_place(dealt, missed, ("doc", "line"), o_names), "left_semi"))
    theirs = dealt.where(common.bitmap(mine.select("token").distinct(), "token"))
    again = earlier_partners(mine, theirs, hot, num, den, keyed).select(*names).distinct()
    done = pairs.select(*names).toDF(*p_names)
    again = common.cut(again.join(done, same_place(again, done, names, p_names), "left_anti"))
    return distinct, found.union(verified(again, texts_of(again, lines, kept, few=True), num, den).select("doc", "line")).distinct()


def removed_lines(docs: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", keyed: bool = True) -> DataFrame:
    """(doc, line) of every line that has an earlier match, exact copies included."""
    lines = lines_of(docs, id_col, text_col, keyed)
    kept: list[str] = []
    distinct, similar = later_matches(lines, docs.select(F.col(text_col).alias("text")), num, den, keyed, kept)
    # Every occurrence of a line that is copied, or whose first occurrence has an earlier match.
    late = similar.select(F.col("doc").alias("l_doc"), F.col("line").alias("l_line"), F.lit(True).alias("late"))
    first = distinct.join(late, same_place(distinct, late, ("doc", "line"), ("l_doc", "l_line")), "left").where("copies > 1 OR late")
    first = common.cut(first.select("same", "check", F.col("doc").alias("f_doc"), F.col("line").alias("f_line"), F.coalesce("late", F.lit(False)).alias("late")))
    common.remove(docs.sparkSession, kept)
    seen = lines.select("doc", "line", *line_hash(F.col("text")))
    seen = seen.where(common.bitmap(first, "same")).join(first, ["same", "check"])
    is_first = F.col("doc").eqNullSafe(F.col("f_doc")) & (F.col("line") == F.col("f_line"))
    return seen.where(F.col("late") | ~is_first).select("doc", "line").distinct()


def dedup_lines(docs: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """Remove lines that match an earlier line: the columns of ``docs`` with new texts, and n_lines, n_removed.

    Lines are parted by newlines and their tokens, as a set, by white space. A line is removed if
    some earlier line (by doc_id, then place) has a Jaccard similarity of num/den or more with it,
    whether that line stays or not; below five tokens that takes equal sets. Lines without a token
    stay. Lines and texts are taken whole, however long. Null texts stay null with 0 lines; an empty text has one empty line. Rows with equal
    doc_id and text are one document and stay repeated; rows that share only the doc_id are ordered
    by a hash of their texts. A null doc_id sorts first. Columns n_lines and n_removed of the
    input are replaced; without ``counts`` nothing is added and all columns pass through. An empty
    table gives no rows.
    """
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    keyed = docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count() > 0
    gone = removed_lines(docs, num, den, id_col, text_col, keyed)
    per_doc = common.cut(gone.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set(F.col("line").cast("int")).alias("__gone")))
    source = docs.select(*names, doc_key(id_col, text_col, keyed).alias("__row"))
    hit = common.bitmap(per_doc.withColumnRenamed("__doc", "__row"), "__row")
    touched = source.where(hit).join(per_doc, F.col("__row").eqNullSafe(F.col("__doc")), "left")
    untouched = source.where(~hit).select("*", *[F.lit(None).cast(t).alias(c) for c, t in per_doc.dtypes])
    joined = touched.unionByName(untouched)
    lines = F.split(text_col, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)
    added = [F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), removed.alias("n_removed")]
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in names], *(added if counts else []))
