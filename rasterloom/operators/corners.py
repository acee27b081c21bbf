"""Corners of polylines, by array functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Distances at which directions are compared, least turn, and the window of suppression.
SCALES, LEAST, WINDOW = (2, 4, 8), math.radians(40), 8


def _turn(p: Column, q: Column, s: Column) -> Column:
    ax, ay, bx, by = q["x"] - p["x"], q["y"] - p["y"], s["x"] - q["x"], s["y"] - q["y"]
    return F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by))


def closed_corners(points: Column) -> Column:
    """Indices of a closed loop's corners: turns of 40 degrees or more at every scale, largest within 8 places."""
    n = F.size(points)
    at = lambda i: F.element_at(points, F.pmod(i, n) + 1)

    def deviation(i):
        steps = [F.least(F.lit(s), F.floor((n - 1) / 2).cast("int")) for s in SCALES]
        return F.least(*[_turn(at(i - s), at(i), at(i + s)) for s in steps])

    places = F.sequence(F.lit(0), n - 1)
    dev = F.transform(places, deviation)
    return F.when(n < 8, F.array().cast("array<int>")).otherwise(_suppress(dev, places, lambda i, d: F.pmod(i + d, n), lambda j: F.lit(True)))


def open_corners(points: Column) -> Column:
    """Indices of an open polyline's corners, its ends excluded; scales shrink towards the ends to 2 at least."""
    n = F.size(points)
    at = lambda i: F.element_at(points, i + 1)

    def deviation(i):
        turns = []
        for s in SCALES:
            step = F.least(F.lit(s), i, n - 1 - i)
            turns.append(F.when(step >= 2, _turn(at(i - step), at(i), at(i + step))))
        return F.coalesce(F.least(*turns), F.lit(0.0))

    places = F.sequence(F.lit(0), n - 1)
    dev = F.transform(places, deviation)
    inner = lambda j: (j >= 1) & (j <= n - 2)
    return F.when(n < 5, F.array().cast("array<int>")).otherwise(_suppress(dev, F.filter(places, inner), lambda i, d: i + d, inner))


def _suppress(deviations: Column, places: Column, move, valid) -> Column:
    def largest(dev: Column) -> Column:
        value = lambda i: F.element_at(dev, i + 1)

        def beaten(i):
            def by(d):
                j = move(i, d)
                other = F.when(valid(j), F.get(dev, j))
                return (d != 0) & F.coalesce((other > value(i)) | ((other == value(i)) & (j < i)), F.lit(False))

            return F.exists(F.sequence(F.lit(-WINDOW), F.lit(WINDOW)), by)

        return F.filter(places, lambda i: (value(i) >= LEAST) & ~beaten(i))

    # As a lambda's variable the deviations are made once for a polyline, not once for each look at one of them.
    return F.get(F.transform(F.array(deviations), largest), F.lit(0))
