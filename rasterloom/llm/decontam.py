"""Benchmark decontamination: prefix-filtered exact containment of item windows in documents."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common

#: Words of one window; an item of fewer words is one window.
WINDOW = 10
#: Windows that are broadcast; those of a larger benchmark are joined with the documents' words, which gives the same result.
MOST_WINDOWS = 500_000
#: 64-bit words of the bitmap of prefix tokens that a join's map side tests words with.
BITMAP = 1 << 18
#: Distinct benchmark words up to which tasks count only those; beyond it they count all words.
VOCABULARY = 500_000

#: ASCII that is not a digit or a letter parts words; A-Z becomes a-z; other bytes are parts of words.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct (window, item) rows; the window is its words joined by spaces. Items without words give none."""

    def f(rows):
        out: dict[str, list] = {"window": [], "item": []}
        for item, text in zip(rows[item_col], rows[text_col]):
            w = words_of(text)
            for i in range(max(1, len(w) - width + 1) if w else 0):
                out["window"].append(b" ".join(w[i : i + width]))
                out["item"].append(item)
        return out

    src = benchmark.select(F.col(item_col).cast("string").alias(item_col), text_col)
    return common.map_rows(src, [item_col, text_col], "window binary, item string", lambda: f).distinct()


def word_rarity(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): occurrences, over all documents, of each word that some window has."""
    vocabulary = common.cut(windows.select(F.explode(F.split(F.col("window").cast("string"), " ")).alias("word")).distinct())
    few = vocabulary.count() <= VOCABULARY
    known = docs.sparkSession.sparkContext.broadcast({r.word.encode() for r in vocabulary.collect()} if few else None)

    def f(rows):
        count: Counter = Counter()
        wanted = known.value
        for t in rows[text_col]:
            w = words_of(t)
            count.update(w if wanted is None else [x for x in w if x in wanted])
        return {"word": [w.decode("utf-8", "surrogatepass") for w in count], "n": list(count.values())}

    counted = common.map_rows(docs, [text_col], "word string, n long", lambda: f).groupBy("word").agg(F.sum("n").alias("n"))
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_windows(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """Each window with its prefix: full containment needs one shared token, the rarest (ties: the smallest word), and its place."""
    tokens = windows.select("window").distinct().select("window", F.posexplode(F.split(F.col("window").cast("string"), " ")).alias("place", "word"))
    best = tokens.join(rarity, "word").groupBy("window").agg(F.min(F.struct("n", "word", "place")).alias("rarest"))
    items = windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return best.join(items, "window").select("window", F.col("rarest.word").cast("binary").alias("word"), F.col("rarest.place").alias("place"), "items")


class WindowIndex:
    """Inverted lists from prefix token to (place, window words, items)."""

    def __init__(self, rows):
        self.lists: dict[bytes, list] = defaultdict(list)
        for window, word, place, items in rows:
            self.lists[word].append((place, window.split(b" "), items))

    def hits(self, words: list[bytes]) -> tuple[set[int], set[str]]:
        """Positions inside occurring windows, and the items with such windows.

        The prefix join gives a place; the positional bound wants the window's start inside the
        text, the length bound its end, and the words themselves then decide.
        """
        hit: set[int] = set()
        items: set[str] = set()
        lists, n = self.lists, len(words)
        for i in [i for i, w in enumerate(words) if w in lists]:
            for place, window, its in lists[words[i]]:
                at = i - place
                if at >= 0 and at + len(window) <= n and words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    items.update(its)
        return hit, items


def indexed_windows(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """(window, word, place, items) of all item windows; an item id of null counts as the empty string."""
    windows = common.cut(item_windows(benchmark, width=width).select("window", F.coalesce("item", F.lit("")).alias("item")))
    common.bounded_batches(docs.sparkSession)
    return common.cut(prefix_windows(windows, word_rarity(docs, windows)))


def broadcast_search(found: DataFrame):
    """What a task calls once to get its search: texts -> [(number of words, hit positions, items)]. For MOST_WINDOWS at most."""
    rows = [(bytes(r.window), bytes(r.word), r.place, list(r["items"])) for r in found.collect()]
    shared = found.sparkSession.sparkContext.broadcast(rows)

    def make():
        index = WindowIndex(shared.value)

        def f(texts):
            words = [words_of(t) for t in texts]
            return [(len(w), *index.hits(w)) for w in words]

        return f

    return make


def text_keys() -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), (F.octet_length(text).cast("long") * (1 << 32) + F.crc32(text.cast("binary"))).alias("k2")]


def joined_hits(docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """(k1, k2, hit, items) of the texts with an occurring window, by a join on prefix tokens.

    Windows that share their rarest word are told apart by its neighbour: the key is the rarest
    word with the one behind it, or before it where it is the last, or the word alone in a window
    of one. A document's words take part if they are some window's key, with the words around
    them; the positional bound wants the window's start inside the text, the length bound its end,
    and the words themselves decide. A bitmap thins out keys before the shuffle and may let others
    through. The rows of frequent keys, and of texts with many copies, are dealt to several tasks.
    """
    words = F.split(F.col("window").cast("string"), " ")
    first = F.least("place", F.size(words) - 2)
    key = F.when(F.size(words) == 1, F.col("window").cast("string")).otherwise(F.array_join(F.slice(words, F.greatest(first, F.lit(0)) + 1, 2), " "))
    found = found.select("window", key.cast("binary").alias("word"), F.greatest(first, F.lit(0)).alias("place"), "items")
    h = F.xxhash64("word")
    at, bit = F.shiftright(h, 6).bitwiseAND(F.lit(BITMAP - 1)), F.expr("shiftleft(1L, cast(xxhash64(word) & 63 AS INT))")
    bits = np.zeros(BITMAP, dtype=np.int64)
    for r in found.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        bits[r["at"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def tokens():
        marks = shared.value

        def f(rows):
            out: dict[str, list] = {c: [] for c in ("k1", "k2", "n", "pos", "word", "start", "context")}
            for k1, k2, text in zip(rows["k1"], rows["k2"], rows["text"]):
                words = words_of(text)
                for i, w in enumerate(words):
                    for token in (w, b" ".join(words[i : i + 2])) if i + 1 < len(words) else (w,):
                        x = xxhash.xxh64_intdigest(token, seed=42)
                        if int(marks[x >> 6 & BITMAP - 1]) >> (x & 63) & 1:
                            start = max(0, i - width + 1)
                            for c, v in zip(out, (k1, k2, len(words), i, token, start, b" ".join(words[start : i + width]))):
                                out[c].append(v)
            return out

        return f

    def verify(rows):
        out: dict[str, list] = {c: [] for c in ("k1", "k2", "at", "size", "items")}
        for k1, k2, n, pos, start, context, window, place, items in zip(*(rows[c] for c in ("k1", "k2", "n", "pos", "start", "context", "window", "place", "items"))):
            at, want = pos - place, window.split(b" ")
            if 0 <= at <= n - len(want) and context.split(b" ")[at - start : at - start + len(want)] == want:
                for c, v in zip(out, (k1, k2, at, len(want), items)):
                    out[c].append(v)
        return out

    src = docs.select("text", *text_keys())
    placed = common.map_rows(src, ["k1", "k2", "text"], "k1 long, k2 long, n int, pos int, word binary, start int, context binary", tokens).distinct()
    placed = common.stored(placed)
    pairs = common.join_spread(placed, found, ["word"], common.frequent(placed.groupBy("word").count(), ["word"], "count", placed.count()))
    true = common.map_rows(pairs, ["k1", "k2", "n", "pos", "start", "context", "window", "place", "items"], "k1 long, k2 long, at int, size int, items array<string>", lambda: verify)
    spans = F.collect_set(F.struct("at", "size"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1)))))
    return common.cut(true.groupBy("k1", "k2").agg(places.alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """Words of each document inside occurrences of benchmark windows.

    Returns doc_id, n_words, hit (sorted positions), items (sorted item ids that have occurring
    windows). Null texts and texts without words have none; equal windows of several items count
    for all of them; an item id of null counts as the empty string; very long texts are searched
    whole; repeated document rows stay repeated, so rows are not merged by doc_id; empty tables
    give no hits or no rows.
    """
    found = indexed_windows(docs, benchmark, width)
    if found.count() <= most:
        search = broadcast_search(found)

        def make():
            find = search()

            def f(rows):
                hits = find(rows["text"])
                return {"doc_id": rows["doc_id"], "n_words": [n for n, _, _ in hits], "hit": [sorted(h) for _, h, _ in hits], "items": [sorted(i) for _, _, i in hits]}

            return f

        return common.map_rows(docs, ["doc_id", "text"], "doc_id long, n_words long, hit array<int>, items array<string>", make)

    def count(rows):
        return {"doc_id": rows["doc_id"], "k1": rows["k1"], "k2": rows["k2"], "n_words": [len(words_of(t)) for t in rows["text"]]}

    rows = common.map_rows(docs.select("doc_id", "text", *text_keys()), ["doc_id", "k1", "k2", "text"], "doc_id long, k1 long, k2 long, n_words long", lambda: count)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = common.stored(rows)
    copies = common.frequent(rows.groupBy("k1", "k2").count(), ["k1", "k2"], "count", rows.count())
    out = common.join_spread(rows, joined_hits(docs, found, width), ["k1", "k2"], copies, "left")
    return out.select("doc_id", "n_words", F.coalesce("hit", none("int")).alias("hit"), F.coalesce("items", none("string")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: int = MOST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without any hit word, with their own columns.

    Each row is judged by its own text, so a null or repeated doc_id decides nothing. Null texts
    stay, very long ones are searched whole, and an empty benchmark or table removes nothing.
    """
    found = indexed_windows(docs, benchmark, WINDOW)
    if found.count() <= most:
        search = broadcast_search(found)

        def make():
            find = search()
            return lambda texts: [not hit for _, hit, _ in find(texts)]

        return common.filter_rows(docs, "text", make)
    k1, k2 = text_keys()
    hit = joined_hits(docs, found, WINDOW).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    return docs.join(hit, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")
