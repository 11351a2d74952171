"""Boxes: struct(x0, y0, x1, y1) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a["x1"] - a["x0"]) * F.greatest(F.lit(0.0), a["y1"] - a["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of a that b covers."""
    return intersection(a, b) / F.greatest(area(a), F.lit(1.0))


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    return i / F.greatest(area(a) + area(b) - i, F.lit(1.0))


def x_overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    return F.when(w > 0, w / F.greatest(F.least(a["x1"] - a["x0"], b["x1"] - b["x0"]), F.lit(1.0))).otherwise(F.lit(0.0))


def vertical_overlap(a: Column, b: Column) -> Column:
    """Common height as a share of the lower one's height."""
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    least = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return F.when((h > 0) & (least > 0), h / least).otherwise(F.lit(0.0))


def overlaps(a: Column, b: Column, least: float = 0.1) -> Column:
    smaller = F.least(area(a), area(b))
    return (smaller > 0) & (intersection(a, b) / smaller >= least)


def contains(a: Column, b: Column, margin: float = 2.0) -> Column:
    return (b["x0"] >= a["x0"] - margin) & (b["y0"] >= a["y0"] - margin) & (b["x1"] <= a["x1"] + margin) & (b["y1"] <= a["y1"] + margin)
