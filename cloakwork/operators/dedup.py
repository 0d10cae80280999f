"""De-duplication and merging of detections: boxes with the text found, and boxes without."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions.boxes import iou, specificity

#: Columns of a detection.
COLUMNS = ("doc_id", "page", "ord", "x", "y", "w", "h", "entity_type", "confidence", "source", "text_found")


def best_per_text(boxes: DataFrame, located: bool = False) -> DataFrame:
    """Of boxes with the same text on a page, the most specific type, then the surest, then the first.

    located: boxes at different places are different, so a value printed twice keeps both.
    """
    keys = ["doc_id", "page", "text_found", *(["x", "y", "w", "h"] if located else [])]
    order = Window.partitionBy(*keys).orderBy(F.desc("_specific"), F.desc("confidence"), "ord")
    texts = boxes.filter(F.coalesce("text_found", F.lit("")) != "").withColumn("_specific", specificity(F.col("entity_type")))
    return texts.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank", "_specific")


def suppressed(boxes: Column, threshold: float = 0.5) -> Column:
    """Greedy suppression in an array of boxes sorted by falling confidence: a box stays if no kept one
    covers it by more than the threshold."""
    return F.aggregate(
        boxes,
        F.slice(boxes, 1, 0),
        lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > threshold), kept).otherwise(F.concat(kept, F.array(b))),
    )


def apart(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of boxes without text, those that no surer kept box on the page covers; a null confidence is 0. A
    page's boxes are one group: pages bound it."""
    order = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("_minus"), "ord", "x", "y", "w", "h", "entity_type", "confidence", "source", "text_found")
    pages = boxes.filter(F.coalesce("text_found", F.lit("")) == "").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(order)).alias("b"))
    return pages.select("doc_id", "page", F.inline(suppressed(F.col("b"), threshold))).select(*COLUMNS)


def deduplicated(boxes: DataFrame, threshold: float = 0.5, located: bool = False) -> DataFrame:
    """Both passes: one box per text, and boxes without text that stand apart."""
    return best_per_text(boxes, located).select(*COLUMNS).unionByName(apart(boxes, threshold))


def _closure(rows: list[dict]) -> list[dict]:
    """Boxes of a page merged until none touches another; of those merged, the surest gives its type,
    source and confidence, of equally sure ones the first."""
    boxes = [{**r, "r": r["x"] + r["w"], "b": r["y"] + r["h"], "sure": (r["confidence"] or 0, -r["ord"])} for r in sorted(rows, key=lambda r: r["ord"])]
    merged = True
    while merged:
        merged, out = False, []
        for b in boxes:
            k = next((k for k, o in enumerate(out) if o["x"] <= b["r"] and b["x"] <= o["r"] and o["y"] <= b["b"] and b["y"] <= o["b"]), None)
            if k is None:
                out.append(b)
                continue
            o, merged = out[k], True
            first = b if b["sure"] > o["sure"] else o
            edges = {"x": min(o["x"], b["x"]), "y": min(o["y"], b["y"]), "r": max(o["r"], b["r"]), "b": max(o["b"], b["b"])}
            out[k] = {**first, **edges, "text_found": "", "ord": min(o["ord"], b["ord"])}
        boxes = out
    return [{**b, "w": b["r"] - b["x"], "h": b["b"] - b["y"]} for b in sorted(boxes, key=lambda b: (b["y"], b["x"]))]


def merged(boxes: DataFrame, pad: int = 4) -> DataFrame:
    """Padded boxes of a page that overlap or touch become one, and so on until none do.

    ord is the smallest of the merged; text_found is empty where boxes merged. Rectangles of the result
    don't depend on the order of the input.
    """
    grown = boxes.select(
        "doc_id", "page", "ord", F.greatest(F.col("x") - pad, F.lit(0)).alias("x"), F.greatest(F.col("y") - pad, F.lit(0)).alias("y"), (F.col("w") + 2 * pad).alias("w"), (F.col("h") + 2 * pad).alias("h"),
        "entity_type", "confidence", "source", F.coalesce("text_found", F.lit("")).alias("text_found"),
    )
    inner = [c for c in COLUMNS if c not in ("doc_id", "page")]
    pages = grown.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*inner)).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, p, *(b[c] for c in inner)) for d, p, own in zip(pdf["doc_id"], pdf["page"], pdf["boxes"]) for b in _closure(list(own))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", *inner])

    return pages.mapInPandas(run, grown.select("doc_id", "page", *inner).schema).select(*COLUMNS)
