"""Ranked lexical search: best-first branch and bound over a hierarchy of document ranges with the largest impact of each term.

Items are searched in blocks of bounded bytes. For a block, every document is counted once into
postings of the block's terms, which are stored; tasks then build a tree over each range of their
documents and descend into the nodes with the highest summed bounds. A task's list of an item
lives over its ranges, so what earlier ranges found prunes the later ones.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import common

#: Documents of a leaf, and children of a node.
LEAF, FANOUT = 16, 16
#: Documents in one tree, and entries of its lowest level (leaves times terms), which bound a task's memory.
RANGE_DOCS, RANGE_CELLS = 1 << 16, 8_000_000
#: UTF-8 bytes of items that are searched at a time, about: items are dealt to blocks by a hash.
BLOCK_BYTES = 4 << 20
#: Lists of an item are merged in so many parts first.
MERGES = 64

#: ASCII that is not a digit or a letter parts terms; A-Z becomes a-z; other bytes are parts of terms.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text in UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_TERMS).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts): the terms of each document in number, and how often it has each one of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        number = known.value

        def f(rows):
            out: dict[str, list] = {"id": rows[id_col], "n": [], "terms": [], "counts": []}
            for text in rows[text_col]:
                terms = terms_of(text)
                tf = Counter(t for t in terms if t in number)
                out["n"].append(len(terms))
                out["terms"].append([number[t] for t in tf])
                out["counts"].append(list(tf.values()))
            return out

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_rows(docs, [id_col, text_col], f"id {kind}, n long, terms array<int>, counts array<long>", make)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(n: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term gives to a document's score before its weight."""
    m = 100 - 25 + 25 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class RangeTree:
    """The largest impact of each term below each node; level 0 has the leaves, the last level FANOUT nodes at most."""

    def __init__(self, ids: list, starts: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.starts, self.terms, self.impact = ids, starts, terms, impact
        leaf = np.repeat(np.arange(len(ids)) // LEAF, np.diff(starts))
        low = np.zeros((-(-len(ids) // LEAF), n_terms), dtype=np.int32)
        np.maximum.at(low, (leaf, terms), impact)
        self.levels = [low]
        while len(self.levels[-1]) > FANOUT:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FANOUT), axis=0))

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: list, top: int) -> int:
        """Bring ``best``, a sorted list of (-score, id is null, id), up to date; returns the number of leaves opened."""
        heap, opened = [], 0

        def push(level: int, lo: int, hi: int) -> None:
            bounds = self.levels[level][lo:hi, terms] @ weights
            for node in np.flatnonzero(bounds):
                heapq.heappush(heap, (-int(bounds[node]), level, lo + int(node)))

        push(len(self.levels) - 1, 0, len(self.levels[-1]))
        while heap:
            bound, level, node = heapq.heappop(heap)
            if len(best) == top and bound > best[-1][0]:
                break  # a node whose bound equals the last score may hold a smaller id
            if level:
                push(level - 1, node * FANOUT, (node + 1) * FANOUT)
                continue
            opened += 1
            first, last = node * LEAF, min(len(self.ids), (node + 1) * LEAF)
            a, b = self.starts[first], self.starts[last]
            run = np.concatenate(([0], np.cumsum(dense[self.terms[a:b]] * self.impact[a:b])))
            scores = run[self.starts[first + 1 : last + 1] - a] - run[self.starts[first:last] - a]
            for i in np.flatnonzero(scores):
                x = self.ids[first + int(i)]
                entry = (-int(scores[i]), x is None, 0 if x is None else x)
                if len(best) < top or entry < best[-1]:
                    insort(best, entry)
                    del best[top:]
        return opened


def search_block(docs: DataFrame, items: list[list[bytes]], top: int, id_col: str, text_col: str) -> DataFrame:
    """(item, id, score) of the best ``top`` documents of each task's ranges; ``item`` is the place in ``items``."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for x in items for t in x}))}
    kept: list[str] = []
    counted = common.stored(postings(docs, vocabulary, id_col, text_col), kept)
    whole = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = {r.t: r["count"] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    asked = []
    for x in items:
        tf = Counter(vocabulary[t] for t in x if vocabulary[t] in df)
        asked.append((np.array(list(tf), dtype=np.int64), np.array([n * term_weight(whole.docs, df[t]) for t, n in tf.items()], dtype=np.int64)))
    shared = spark.sparkContext.broadcast(asked)
    n_docs, n_words, n_terms = whole.docs, whole.terms, len(vocabulary)
    most = max(LEAF, min(RANGE_DOCS, RANGE_CELLS // max(1, n_terms) * LEAF))

    def make():
        best: list[list] = [[] for _ in shared.value]
        held: dict[str, list] = {"id": [], "n": [], "terms": [], "counts": []}

        def flush():
            if not held["id"]:
                return
            sizes = np.array([len(t) for t in held["terms"]])
            starts = np.concatenate(([0], np.cumsum(sizes)))
            terms = np.array([t for x in held["terms"] for t in x], dtype=np.int64)
            tf = np.array([c for x in held["counts"] for c in x], dtype=np.int64)
            tree = RangeTree(held["id"], starts, terms, impacts(np.repeat(np.array(held["n"], dtype=np.int64), sizes), tf, n_docs, max(1, n_words)), n_terms)
            dense = np.zeros(n_terms, dtype=np.int64)
            for (t, w), found in zip(shared.value, best):
                dense[t] = w
                tree.search(t, w, dense, found, top)
                dense[t] = 0
            for x in held.values():
                x.clear()

        def add(rows):
            for i, t in enumerate(rows["terms"]):
                if t:
                    for c, x in held.items():
                        x.append(rows[c][i])
                    if len(held["id"]) >= most:
                        flush()

        def end():
            flush()
            rows = [(i, None if null else x, -score) for i, found in enumerate(best) for score, null, x in found]
            return dict(zip(("item", "id", "score"), map(list, zip(*rows)))) if rows else None

        return add, end

    kind = docs.schema[id_col].dataType.simpleString()
    found = common.map_tasks(counted, ["id", "n", "terms", "counts"], f"item int, id {kind}, score long", make)
    found = common.stored(found)
    common.remove(spark, kept)
    return found


def best_rows(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item with their ``rank``; lists are merged in parts first, so that no task gets an item's lists of all tasks."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("id", "score"), F.lit(MERGES))
    few = found.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    return few.drop("part").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of a score above 0, equal scores by ascending id.

    Every item is asked against every document. Distinct item texts are collected in blocks of
    about ``block_bytes`` bytes; each block reads the documents once. Null and empty texts have no terms:
    such a document is never found and such an item finds nothing. Ids of null come after all
    others of an equal score. Repeated rows of documents are documents of their own, repeated rows
    of items have lists of their own. Very long texts count whole. Empty tables give no rows;
    columns that are not named are never read.
    """
    spark: SparkSession = docs.sparkSession
    kind, asked = items.schema[item_col].dataType.simpleString(), items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    texts = asked.where("text IS NOT NULL").select("text").distinct()
    total = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks, out = -(-total // block_bytes), None
    for k in range(blocks):
        block = [r.text for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()]
        if block:
            found = best_rows(search_block(docs, [terms_of(t) for t in block], top, id_col, text_col), top)
            numbers = spark.createDataFrame(list(enumerate(block)), "item int, text string")
            rows = asked.join(F.broadcast(numbers), "text").join(found, "item").select("item_id", "rank", F.col("id").alias(id_col), "score")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, {id_col} {docs.schema[id_col].dataType.simpleString()}, score long")
    return out
