"""Quality classifier: kernel ridge scores over document statistics, by random Fourier features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .stats import FEATURES, document_stats

#: Random features; the normal equations have one row more, for the bias.
N_FOURIER = 128
#: Rows that carry partial sums to the driver: each holds (N_FOURIER + 1)^2 doubles, whatever the input's size.
N_PARTIALS = 8
#: Score bins for isotonic calibration.
N_BINS = 2000


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, features) of every whole text. Null texts have the features of the empty text."""
    src = docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_key"))

    def make():
        return lambda rows: {"id": rows[id_col], "text_key": rows["text_key"], "features": [document_stats(t)[1] for t in rows[text_col]]}

    return common.map_rows(src, [id_col, text_col, "text_key"], "id long, text_key long, features array<double>", make)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """cos(Wx + b), scaled so that inner products approximate the Gaussian kernel; last column 1."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2.0 / len(b)) * np.cos(z @ w + b), np.ones((len(x), 1))])


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) weighted least squares fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


class QualityModel:
    """Standardisation, Fourier projection, ridge weights and the calibration curve."""

    def __init__(self, mean, scale, w, b, weights, xs, ys):
        self.mean, self.scale, self.w, self.b, self.weights, self.xs, self.ys = mean, scale, w, b, weights, xs, ys

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.w, self.b) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.xs, self.ys), 0.0, 1.0)


def _sum_partials(df: DataFrame, size: int) -> np.ndarray:
    """Sum one binary column of ``size`` doubles in two steps, so the driver gets few rows."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"s": [total.tobytes()]}, schema=pa.schema([("s", pa.binary())]))

    return sum((np.frombuffer(r.s) for r in df.repartition(N_PARTIALS).mapInArrow(add, "s binary").collect()), np.zeros(size))


def fit_quality(rows: DataFrame, ridge: float = 1e-3, seed: int = 11) -> QualityModel:
    """Fit on (features, label, calibrate) rows.

    Partitions sum the normal equations of the rows with calibrate = false; the others fit the
    isotonic curve. Rows with a null label are ignored. With no labelled row, or none of either
    kind, every score is the mean label (1 where there is none).
    """
    d = len(FEATURES)
    rows = rows.where("label IS NOT NULL")
    m = rows.agg(F.count("*").alias("n"), F.avg("label").alias("p"),
                 *[F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(d)],
                 *[F.stddev_pop(F.col("features")[i]).alias(f"s{i}") for i in range(d)]).first()
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(d, N_FOURIER)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, N_FOURIER)
    if not m.n:
        return QualityModel(np.zeros(d), np.ones(d), w, b, np.zeros(N_FOURIER + 1), np.zeros(1), np.ones(1))
    mean = np.array([m[f"m{i}"] for i in range(d)])
    scale = np.maximum([m[f"s{i}"] for i in range(d)], 1e-6)
    k = N_FOURIER + 1

    def partial(batches):
        total = np.zeros((k, k + 1))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist(), dtype=float)
            phi = fourier(x, mean, scale, w, b)
            total += np.hstack([phi.T @ phi, (phi.T @ y)[:, None]])
        yield pa.RecordBatch.from_pydict({"s": [total.tobytes()]}, schema=pa.schema([("s", pa.binary())]))

    common.bounded_batches(rows.sparkSession)
    sums = _sum_partials(rows.where("NOT calibrate").select("features", F.col("label").cast("double")).mapInArrow(partial, "s binary"), k * (k + 1)).reshape(k, k + 1)
    n_fit = max(1.0, sums[k - 1, k - 1])
    weights = np.linalg.solve(sums[:, :k] + ridge * n_fit * np.eye(k) * (np.arange(k) < k - 1) + 1e-9 * np.eye(k), sums[:, k])
    model = QualityModel(mean, scale, w, b, weights, np.zeros(1), np.full(1, m.p))

    def raw(rows):
        return {"s": model.raw(np.array(rows["features"], dtype=float).reshape(-1, d)), "y": rows["label"]}

    scored = common.map_rows(rows.where("calibrate").withColumn("label", F.col("label").cast("double")), ["features", "label"], "s double, y double", lambda: raw)
    bins = (
        scored.withColumn("bin", F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "s")) * (N_BINS / 3)))
        .groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    )
    if bins:
        fitted = pool_adjacent(np.array([r.y for r in bins]), np.array([float(r.n) for r in bins]))
        model.xs, model.ys = np.array([r.s for r in bins]), fitted
    return model


def fit_from(feats: DataFrame, labels: DataFrame) -> QualityModel:
    """Learn only where crc32(doc_id as text) mod 5 is not 0; of those, remainder 1 fits the calibration and the others the ridge weights."""
    fold = common.crc_mod("id", 5)
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    rows = feats.join(known, "id").where(fold != 0).select("features", "label", (fold == 1).alias("calibrate"))
    return fit_quality(common.cut(rows))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score every document for quality: doc_id, held_out, score, predicted, text_key (a hash of the text).

    Labels are learnt as ``fit_from`` says. Null and empty texts are scored as empty ones, texts
    are taken whole however long, equal texts get equal scores, repeated rows stay repeated, and
    an empty table gives no rows. A null doc_id is never labelled and has held_out = false.
    """
    feats = common.cut(document_features(docs))
    model = fit_from(feats, labels)

    def scores(rows):
        x = np.array(rows["features"], dtype=float).reshape(-1, len(FEATURES))
        s = np.round(model.score(x), 9)
        return {"doc_id": rows["id"], "text_key": rows["text_key"], "held_out": rows["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    held = feats.withColumn("held_out", F.coalesce(common.crc_mod("id", 5) == 0, F.lit(False)))
    return common.map_rows(held, ["id", "held_out", "features", "text_key"], "doc_id long, held_out boolean, score double, predicted int, text_key long", lambda: scores)


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with their own columns.

    Every row is scored where it is read, so texts are not shuffled; rows that share a doc_id,
    null included, but not the text are judged apart. Statistics for learning are made of rows
    that may have a label. An empty table gives no rows.
    """
    model = fit_from(common.cut(document_features(docs.where(common.bitmap(labels, "doc_id")))), labels)

    def keep(texts):
        x = np.array([document_stats(t)[1] for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return np.round(model.score(x), 9) >= threshold

    return common.filter_rows(docs, "text", lambda: keep)
