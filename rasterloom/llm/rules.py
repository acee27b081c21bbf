"""Quality rules: fixed rules first, then gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common
from .stats import FEATURES, document_stats

#: Labelled rows that the trees are grown from, at most; all statistics and verdicts cover every row.
TRAIN_ROWS = 20_000
#: Features on which the score may only fall as they rise.
FALLING = ("symbol_ratio", "bang_ratio", "bar_ratio", "dup_lines", "repeat_words", "symbol_words", "top_word", "echo_words")


@dataclass
class FlatTrees:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    cut: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def grow_trees(x: np.ndarray, y: np.ndarray, falling: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0) -> FlatTrees:
    """Second-order boosting of the logistic loss over quantile bins.

    A split on a falling feature is taken only if the left child's value is not below the right
    one's, and both subtrees are kept on their side of the midpoint, so the whole score is
    monotone. Rows where y is constant give a constant score.
    """
    p = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    bias = float(np.log(p / (1 - p)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(value)
        for a, b in ((feature, 0), (threshold, 0.0), (left, k), (right, k), (value, v)):
            a.append(b)
        return k

    if len(y) == 0 or y.min() == y.max():
        roots.append(leaf(0.0))
        rounds = 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if rounds else []
    codes = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1) if rounds else None
    margin = np.full(len(y), bias)

    def build(rows, g, h, level, lo, hi):
        def best_value(a, b):
            return float(np.clip(-a / (b + l2), lo, hi))

        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-3, None)
        if level < depth and len(rows) >= 20:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(codes[rows, j], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(codes[rows, j], h[rows], len(e) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2)
                v = best_value(gs, hs)
                gain = gain + gs * v + 0.5 * (hs + l2) * v**2
                gain[(hl < 1) | (hr < 1)] = -1
                if j in falling:
                    gain[vl < vr] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            v = rate * best_value(gs, hs)
            k = leaf(v)
            margin[rows] += v
            return k
        j, cut, vl, vr = best[1]
        k = leaf(0.0)
        feature[k], threshold[k] = j, float(edges[j][cut])
        goes = codes[rows, j] <= cut
        mid = (vl + vr) / 2
        bounds = ((max(lo, mid), hi), (lo, min(hi, mid))) if j in falling else ((lo, hi), (lo, hi))
        left[k] = build(rows[goes], g, h, level + 1, *bounds[0])
        right[k] = build(rows[~goes], g, h, level + 1, *bounds[1])
        return k

    for _ in range(rounds):
        q = 1.0 / (1.0 + np.exp(-margin))
        roots.append(build(np.arange(len(y)), q - y, np.maximum(q * (1 - q), 1e-6), 0, -4.0, 4.0))
    return FlatTrees(*(np.array(a) for a in (feature, threshold, left, right, value, roots)), depth, bias, 0.5)


def fit_rules(x: np.ndarray, y: np.ndarray, keep: float = 0.995) -> FlatTrees:
    """Grow trees on four fifths; on the rest take the largest cut, 0.5 at most, that keeps a share ``keep`` of the good rows."""
    falling = [FEATURES.index(f) for f in FALLING]
    held = np.arange(len(y)) % 5 == 0
    model = grow_trees(x[~held], y[~held], falling)
    good = model.score(x[held])[y[held] == 1] if held.any() else np.zeros(0)
    model.cut = float(min(0.5, np.quantile(good, 1 - keep))) if len(good) else 0.5
    return model


def quality_rules(docs: DataFrame, labels: DataFrame, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Verdict on every whole text: counts, base_failed, kept and the trees' score.

    The base rules fail a text of fewer than ``min_words`` words or with over ``repeat_percent``
    percent of its words in repeated 3-word windows; the trees decide on the others. Trees are
    grown from at most TRAIN_ROWS labelled documents, those with the smallest hash of their id.
    A null text has no words and fails; repeated rows stay repeated; an empty table gives no rows;
    without labels only the base rules decide.
    """
    d = len(FEATURES)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        def f(rows):
            both = [document_stats(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "features": [b[1] for b in both]} | {n: [b[0][n] for b in both] for n in names}

        return f

    counts = ", ".join(f"{n} long" for n in names)
    stats = common.cut(common.map_rows(docs, ["doc_id", "text"], f"doc_id long, features array<double>, {counts}", make))
    known = labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label"))
    sample = common.hash_sample(stats.select("doc_id", "features").join(known, "doc_id"), "doc_id", TRAIN_ROWS).collect()
    model = fit_rules(np.array([r.features for r in sample], dtype=float).reshape(-1, d), np.array([float(r.label) for r in sample]))

    def judge(rows):
        s = model.score(np.array(rows["features"], dtype=float).reshape(-1, d))
        failed = [n < min_words or 100 * r > repeat_percent * n for n, r in zip(rows["n_words"], rows["n_repeat_words"])]
        return {"doc_id": rows["doc_id"]} | {n: rows[n] for n in names} | {"base_failed": failed, "kept": [not b and bool(v >= model.cut) for b, v in zip(failed, s)], "score": np.round(s, 9)}

    return common.map_rows(stats, ["doc_id", "features", *names], f"doc_id long, {counts}, base_failed boolean, kept boolean, score double", lambda: judge)
