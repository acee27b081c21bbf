"""Cubic Bezier chains through polylines, by least squares with fixed end tangents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rasterloom.functions.workers import reach_workers

ROUNDS = 4
CUBIC = ("x0", "y0", "c1x", "c1y", "c2x", "c2y", "x1", "y1")


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.hypot(*v)
    return v / n if n else v


def _weights(u: np.ndarray) -> np.ndarray:
    v = 1 - u
    return np.stack([v**3, 3 * v * v * u, 3 * v * u * u, u**3], axis=1)


def _solve(p: np.ndarray, u: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """Handle lengths of least squares; a third of the arc length where they are degenerate."""
    w = _weights(u)
    a1, a2 = w[:, 1, None] * t1, w[:, 2, None] * t2
    rest = p - (w[:, 0] + w[:, 1])[:, None] * p[0] - (w[:, 2] + w[:, 3])[:, None] * p[-1]
    c00, c01, c11, x0, x1 = (a1 * a1).sum(), (a1 * a2).sum(), (a2 * a2).sum(), (a1 * rest).sum(), (a2 * rest).sum()
    det = c00 * c11 - c01 * c01
    length = np.hypot(*np.diff(p, axis=0).T).sum()
    alpha = np.array([x0 * c11 - x1 * c01, c00 * x1 - c01 * x0]) / det if det else np.zeros(2)
    if not np.isfinite(alpha).all() or (alpha < 1e-6 * length).any() or (alpha > length).any():
        alpha = np.full(2, length / 3)
    return np.stack([p[0], p[0] + t1 * alpha[0], p[-1] + t2 * alpha[1], p[-1]])


def _newton(b: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    d = _weights(u) @ b - p
    q1, q2 = 3 * np.diff(b, axis=0), 6 * np.diff(b, n=2, axis=0)
    v = 1 - u
    f1 = np.stack([v * v, 2 * v * u, u * u], axis=1) @ q1
    f2 = np.stack([v, u], axis=1) @ q2
    top, low = (d * f1).sum(axis=1), (f1 * f1).sum(axis=1) + (d * f2).sum(axis=1)
    return np.clip(np.where(low == 0, u, u - top / np.where(low == 0, 1, low)), 0, 1)


def fit_chain(p: np.ndarray, t1: np.ndarray, t2: np.ndarray, error2: float) -> list[np.ndarray]:
    """Cubics through p within the squared error, split at the point of largest deviation; an explicit stack orders them."""
    out, todo = [], [(p, t1, t2)]
    while todo:
        p, t1, t2 = todo.pop()
        if len(p) == 2:
            d = np.hypot(*(p[1] - p[0])) / 3
            out.append(np.stack([p[0], p[0] + t1 * d, p[1] + t2 * d, p[1]]))
            continue
        steps = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
        u = steps / (steps[-1] or 1)
        for turn in range(ROUNDS + 1):
            b = _solve(p, u, t1, t2)
            far = ((_weights(u) @ b - p) ** 2).sum(axis=1)[1:-1]
            split = int(far.argmax()) + 1 if far.max() > 0 else len(p) // 2
            if far.max() <= error2:
                out.append(b)
                break
            if turn < ROUNDS:
                u = _newton(b, p, u)
        else:
            mid = _unit(p[split - 1] - p[split + 1])
            todo += [(p[split:], -mid, t2), (p[: split + 1], t1, mid)]
    return out


def fit_arc(points: np.ndarray, corners: list[int], closed: bool, tolerance: float) -> list[np.ndarray]:
    """Fit an arc between its corners; a closed one without corners breaks at its first and its farthest point."""
    n = len(points)
    if n < 2:
        return []
    if not closed:
        breaks = [0, *[c for c in corners if 0 < c < n - 1], n - 1]
        spans = [points[a : b + 1] for a, b in zip(breaks, breaks[1:])]
        ends = [(_unit(s[1] - s[0]), _unit(s[-2] - s[-1])) for s in spans if len(s) > 1]
        spans = [s for s in spans if len(s) > 1]
    else:
        breaks = list(corners)
        smooth = not breaks
        if smooth:
            far = int(((points - points[0]) ** 2).sum(axis=1)[1:].argmax()) + 1
            breaks = [0, far]
        spans, ends = [], []
        for k, a in enumerate(breaks):
            b = breaks[(k + 1) % len(breaks)]
            length = (b - a) % n or n
            s = points[(a + np.arange(length + 1)) % n]
            tangent = lambda i: _unit(points[(i + 1) % n] - points[(i - 1) % n])
            spans.append(s)
            ends.append((tangent(a), -tangent(b)) if smooth else (_unit(s[1] - s[0]), _unit(s[-2] - s[-1])))
    return [b for s, (t1, t2) in zip(spans, ends) for b in fit_chain(s, t1, t2, tolerance * tolerance)]


def fit_arcs(arcs: DataFrame, tolerance: float | Column) -> DataFrame:
    """(image_id, arc_id, cubics) of arcs with points, corners and closed; each arc is fitted once, whoever uses it."""
    schema = "image_id long, arc_id long, cubics array<struct<" + ", ".join(f"{c}: double" for c in CUBIC) + ">>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            image, arc, closed, corners, points, bound = (batch.column(i).to_pylist() for i in range(6))
            fitted = [fit_arc(np.array([(q["x"], q["y"]) for q in p]).reshape(-1, 2), c, k, t) for p, c, k, t in zip(points, corners, closed, bound)]
            cubics = [[dict(zip(CUBIC, map(float, b.ravel()))) for b in f] for f in fitted]
            yield pa.RecordBatch.from_pydict({"image_id": image, "arc_id": arc, "cubics": cubics}, schema=arrow)

    reach_workers(arcs.sparkSession)
    bound = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    return arcs.select("image_id", "arc_id", "closed", "corners", "points", bound.cast("double").alias("tolerance")).mapInArrow(run, schema)


CUBIC_ROW = "seq int, " + ", ".join(f"{c} double" for c in CUBIC)


def register_fit(spark: SparkSession, name: str = "fit_curve") -> None:
    """A table function for SQL: ``LATERAL fit_curve(points, corners, closed, tolerance)`` gives a row for each cubic of a polyline.

    Points are an array of structs (x, y), corners an array of places. A null or shorter than two
    points gives no rows.
    """

    class Curve:
        def eval(self, points, corners, closed, tolerance):
            if points is None or tolerance is None:
                return
            chain = fit_arc(np.array([(p["x"], p["y"]) for p in points], dtype=float).reshape(-1, 2), list(corners or []), bool(closed), float(tolerance))
            for seq, b in enumerate(chain):
                yield (seq, *map(float, b.ravel()))

    reach_workers(spark)
    spark.udtf.register(name, F.udtf(Curve, returnType=CUBIC_ROW))


def reverse_cubics(cubics: Column) -> Column:
    """The same curve walked backwards, without arithmetic."""
    return F.reverse(F.transform(cubics, lambda c: F.struct(*[c[f].alias(t) for t, f in zip(CUBIC, ("x1", "y1", "c2x", "c2y", "c1x", "c1y", "x0", "y0"))])))
