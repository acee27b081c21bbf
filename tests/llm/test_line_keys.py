"""Line dedup of documents that have no id or share one."""

import random

import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import linededup


def deduped(spark, rows):
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    return {(r.doc_id, r.text): r.n_removed for r in out}


def test_near_equal_lines_of_null_ids(spark):
    base = [f"w{k}" for k in range(20)]
    texts = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(6)]
    out = deduped(spark, [(None, f"{t}\nalone{k}") for k, t in enumerate(texts)] + [(3, texts[0])])
    assert sorted(n for (i, _), n in out.items() if i is None) == [0, 1, 1, 1, 1, 1]
    assert {t for i, t in out if i is None} >= {f"alone{k}" for k in range(6)} - {t.split("\n")[-1] for i, t in out if i is None and "\n" in t}
    assert out[(3, "")] == 1
    # A single row without an id, whose second line nearly equals its first.
    assert deduped(spark, [(None, f"{texts[0]}\n{texts[1]}"), (1, "other")]) == {(None, texts[0]): 1, (1, "other"): 0}


def test_texts_of_one_id_whose_hashes_agree_in_31_bits(spark):
    low = lambda t: xxhash.xxh64_intdigest(t, seed=42) & 0x7FFFFFFF
    boiler = "these six words are boiler plate"
    dirty = {low(t): t for t in (f"d{k}\n{boiler}" for k in range(200_000))}
    clean = next(t for t in (f"c{k}\na clean line of six words" for k in range(2_000_000)) if low(t) in dirty)
    found = dirty[low(clean)]
    out = deduped(spark, [(0, boiler), (1, found), (1, clean)])
    assert out == {(0, boiler): 0, (1, found.split("\n")[0]): 1, (1, clean): 0}


def test_hot_tokens_are_dealt_to_cells(spark, monkeypatch):
    """Lines of few words, so that each is in the prefix of a large share of them."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(14)}" for _ in range(rng.randrange(3, 30))) for _ in range(500)]
    df = spark.createDataFrame([(k, "\n".join(texts[5 * k : 5 * k + 5])) for k in range(100)], "doc_id long, text string")
    plain = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    monkeypatch.setattr(linededup, "TOKEN_ROWS", 20)
    dealt = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    from tests.llm.test_operators import brute_line_dedup

    gone = brute_line_dedup([(r.doc_id, r.text) for r in df.collect()])
    want = {k: "\n".join(t for n, t in enumerate(texts[5 * k : 5 * k + 5]) if (k, n) not in gone) for k in range(100)}
    assert plain == want and dealt == want and len(gone) > 50


def test_rare_tokens_of_crowded_buckets_are_not_copied(spark):
    """A bucket that holds many tokens makes none of them hot; a token of many lines is split by size and part."""
    levels = [127] * linededup.RARITY_BUCKETS  # every bucket says that its tokens may be frequent
    schema = "token long, doc long, line long, np long, sketch long, wide long"
    rare = spark.range(1000).select("id", F.col("id").alias("doc"), *[F.lit(0).cast("long").alias(c) for c in ("line", "np", "sketch", "wide")]).toDF(*[c.split()[0] for c in schema.split(", ")])
    assert linededup.hot_tokens(rare, levels) is None
    many = spark.range(200_000).select(F.lit(7).cast("long").alias("token"), F.col("id").alias("doc"), F.lit(0).cast("long").alias("line"), ((F.col("id") % 90 + 10) * (1 << 32)).alias("np"), F.lit(0).cast("long").alias("sketch"), F.lit(0).cast("long").alias("wide"))
    hot = linededup.hot_tokens(many.unionByName(rare), levels)
    assert [r.token for r in hot.collect()] == [7]
    mine = many.where("doc % 1000 = 0")
    met = linededup.earlier_partners(mine, many, hot, 4, 5, False)
    # 200 rows go to three bands each; the 200,000 to their own band alone, as the few rows need no parts.
    plan = met._jdf.queryExecution().toString()
    assert "band" in plan and met.count() > 0
    band = F.floor(F.log((F.col("doc") % 90 + 10).cast("double")) / F.log(F.lit(1.25)) + 1e-9)
    assert many.groupBy(band.alias("b")).count().agg(F.max("count")).first()[0] < 60_000


def test_long_and_short_lines_at_the_bound(spark):
    """Lines about the size at which sketches get wider, changed by so many tokens that some pairs match just so."""
    from tests.llm.test_operators import brute_line_dedup

    rng = random.Random(5)
    rows = []
    for k in range(40):
        base = [f"t{rng.randrange(10**9)}" for _ in range(rng.choice([9, 18, 45, 60, 63, 64, 72, 90]))]
        swaps = len(base) // 9
        for n in (0, swaps, swaps + 1):
            rows.append(" ".join([f"s{rng.randrange(10**9)}" for _ in range(n)] + base[n:]))
        rows.append(" ".join(base[: -(-len(base) * 4 // 5)]))
    rng.shuffle(rows)
    docs = [(k, "\n".join(rows[4 * k : 4 * k + 4])) for k in range(40)]
    gone = brute_line_dedup(docs)
    out = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {k: "\n".join(t for n, t in enumerate(text.split("\n")) if (k, n) not in gone) for k, text in docs}
    assert 60 < len(gone) < 120


def test_crowded_and_other_tokens_lose_no_pair(spark, monkeypatch):
    """Tokens of few rows are joined at once, others go by their earliest line; both find what brute force does."""
    from tests.llm.test_operators import brute_line_dedup

    rng = random.Random(23)
    rows = []
    for k in range(30):
        base = [f"b{k}x{j}" for j in range(24)]
        for _ in range(30 if k % 6 == 0 else 3):  # groups of near copies on either side of the bound
            rows.append(" ".join([*base[: rng.randrange(20, 24)], *(f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(5)))]))
    rng.shuffle(rows)
    docs = [(k, "\n".join(rows[3 * k : 3 * k + 3])) for k in range(len(rows) // 3)]
    gone = brute_line_dedup(docs)
    want = {k: "\n".join(t for n, t in enumerate(text.split("\n")) if (k, n) not in gone) for k, text in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (1, 20, linededup.PLAIN_ROWS):
        monkeypatch.setattr(linededup, "PLAIN_ROWS", most)
        assert {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()} == want
    assert len(gone) > 100


def test_ids_that_are_strings(spark):
    line = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([("b", f"{line} more\nkept b"), ("a", f"{line}\nkept a"), ("c", line)], "doc_id string, text string")
    out = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(df).collect()}
    assert out == {"a": (f"{line}\nkept a", 0), "b": ("kept b", 1), "c": ("", 1)}


def test_rare_tokens_are_told_apart(spark):
    """300,000 tokens that occur once fall into buckets that hold one or two of them, so others are seen to be more frequent."""
    once = spark.range(300_000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    levels = sorted(x for x in linededup.rarity_levels(once) if x)
    assert levels[len(levels) // 2] <= 3


def test_rows_dealt_by_token_stay_whole(spark):
    """Token and line travel in one number: all bits of either come back, for tokens of either sign."""
    rows = [(t, 5, line, 1 << 32, -1, 0) for t in (-(1 << 31), -1, 0, (1 << 31) - 1) for line in (0, 1, (1 << 31) - 1)]
    df = spark.createDataFrame(rows, "token long, doc long, line long, np long, sketch long, wide long")
    assert sorted(map(tuple, linededup.dealt_by_token(df).collect())) == sorted(rows)
