"""Scalar expressions shared by the raster operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def u8(v: Column) -> Column:
    """Store as an unsigned byte: clamp to 0..255, round half to even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v.cast("double"))), 0).cast("int")


def half_up(v: Column) -> Column:
    """Round half towards positive infinity."""
    return F.floor(v + 0.5)


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)]))


def centi(v: Column) -> Column:
    """Hundredths as an integer."""
    return half_up(v * 100).cast("long")


def fmt_centi(c: Column) -> Column:
    """Hundredths in the fewest characters: no zero before the point nor at the end, so 705 gives 7.05 and -40 gives -.4."""
    a = F.abs(c)
    whole, part = F.floor(a / 100).cast("long"), (a % 100).cast("int")
    digits = F.lpad(part.cast("string"), 2, "0")
    digits = F.when(part % 10 == 0, F.substring(digits, 1, 1)).otherwise(digits)
    text = F.when(part == 0, whole.cast("string")).otherwise(F.concat(F.when(whole == 0, "").otherwise(whole.cast("string")), F.lit("."), digits))
    return F.when(c == 0, "0").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), text))


def fmt_plain(c: Column) -> Column:
    """Hundredths as a decimal with its leading zero and no trailing ones."""
    text = fmt_centi(c)
    return F.regexp_replace(text, r"^(-?)\.", "$10.")


def join_numbers(parts: Column) -> Column:
    """Join with spaces, none before a minus sign."""
    return F.regexp_replace(F.array_join(parts, " "), " -", "-")
