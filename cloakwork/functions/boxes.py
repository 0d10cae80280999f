"""Rectangles: overlap, union over intersection, padding, units, and which entity type wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How specific entity types are; others are 0.
SPECIFICITY = {
    "US_SSN": 100, "NPI": 99, "EIN": 98, "DEA_NUM": 97, "ROUTING_NUM": 96, "POLICY_NUM": 95, "CLAIM_REF": 94, "ADJUSTER_ID": 93,
    "CREDIT_CARD": 92, "IBAN_CODE": 91, "EMAIL_ADDRESS": 90, "PHONE_NUMBER": 89, "IP_ADDRESS": 88, "DATE_TIME": 80, "PERSON": 70,
    "LOCATION": 60, "ORG": 50, "ORGANIZATION": 50, "NRP": 40,
}


def specificity(entity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SPECIFICITY.items() for x in pair])
    return F.coalesce(table[entity], F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs with x, y, w, h; 0 where they don't overlap."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = (F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))).cast("double")
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def touches(a: Column, b: Column) -> Column:
    """Whether two rectangles overlap or touch."""
    return (a["x"] <= b["x"] + b["w"]) & (b["x"] <= a["x"] + a["w"]) & (a["y"] <= b["y"] + b["h"]) & (b["y"] <= a["y"] + a["h"])


def padded(pad: int, width: Column | None = None, height: Column | None = None) -> list[Column]:
    """x, y, w, h grown by pad on all sides. With the page's size, clamped to the page; without, only x
    and y stop at 0 and w, h grow by twice the pad all the same."""
    x, y = F.greatest(F.col("x") - pad, F.lit(0)), F.greatest(F.col("y") - pad, F.lit(0))
    if width is None or height is None:
        return [x.alias("x"), y.alias("y"), (F.col("w") + 2 * pad).alias("w"), (F.col("h") + 2 * pad).alias("h")]
    right, low = F.least(F.col("x") + F.col("w") + pad, width), F.least(F.col("y") + F.col("h") + pad, height)
    return [x.alias("x"), y.alias("y"), F.greatest(right - x, F.lit(0)).alias("w"), F.greatest(low - y, F.lit(0)).alias("h")]


def to_pixels(mm: Column, dpi: int) -> Column:
    """Millimetres in pixels, halves to even."""
    return F.bround(mm * dpi / F.lit(25.4)).cast("int")


def rescaled(unit_dpi: int, to_dpi: int = 72) -> list[Column]:
    """x, y, w, h of pixels at one resolution in the units of another, such as page points."""
    return [F.round(F.col(c) * (to_dpi / unit_dpi)).cast("int").alias(c) for c in "xywh"]


def from_bottom_left(page_height: Column) -> Column:
    """y from the top of the page, of a box whose top is given from the bottom; pages default to 842."""
    return (F.coalesce(page_height, F.lit(842.0)) - F.col("top")).cast("int")
