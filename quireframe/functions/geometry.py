"""Rectangles as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), width(r)) * F.greatest(F.lit(0.0), height(r))


def mid_x(r: Column) -> Column:
    return (r["x0"] + r["x1"]) / 2


def mid_y(r: Column) -> Column:
    return (r["y0"] + r["y1"]) / 2


def is_empty(r: Column) -> Column:
    return (r["x0"] >= r["x1"]) | (r["y0"] >= r["y1"])


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def x_overlap(a: Column, b: Column) -> Column:
    return F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def meet(a: Column, b: Column) -> Column:
    return rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def grow(r: Column, by: float) -> Column:
    return rect(r["x0"] - by, r["y0"] - by, r["x1"] + by, r["y1"] + by)


def bounds(r: Column) -> Column:
    """Aggregate: the smallest rectangle around all."""
    return rect(F.min(r["x0"]), F.min(r["y0"]), F.max(r["x1"]), F.max(r["y1"]))
