"""Words with places on a page, assembled to text, and text hits mapped back to rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pages_of_words(words: DataFrame) -> DataFrame:
    """doc_id, page, text, words: the page's words in order, joined by blanks, each with its offsets.

    words(doc_id, page, ord, text, x, y, w, h). A page is one group.
    """
    rows = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "x", "y", "w", "h"))).alias("all"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,x:int,y:int,w:int,h:int>>)")

    def step(acc: Column, w: Column) -> Column:
        end = acc["at"] + F.length(w["text"])
        place = F.struct(acc["at"].alias("start"), end.alias("end"), w["x"].cast("int").alias("x"), w["y"].cast("int").alias("y"), w["w"].cast("int").alias("w"), w["h"].cast("int").alias("h"))
        return F.struct((end + 1).alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))

    placed = F.aggregate("all", F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return rows.select("doc_id", "page", F.array_join(F.transform("all", lambda w: w["text"]), " ").alias("text"), placed.alias("words"))


def boxes_of_hits(hits: DataFrame) -> DataFrame:
    """x, y, w, h of each hit: the union of the words that its characters overlap.

    hits(..., start, end, words): the page's words travel with the hit, so no join is needed. Hits that
    overlap no word have no row.
    """
    under = F.filter("words", lambda w: (w["start"] < F.col("end")) & (w["end"] > F.col("start")))
    edges = hits.withColumn("_w", under).filter(F.size("_w") > 0)
    left, top = F.array_min(F.transform("_w", lambda w: w["x"])), F.array_min(F.transform("_w", lambda w: w["y"]))
    right, low = F.array_max(F.transform("_w", lambda w: w["x"] + w["w"])), F.array_max(F.transform("_w", lambda w: w["y"] + w["h"]))
    return edges.withColumns({"x": left, "y": top, "w": right - left, "h": low - top}).drop("_w", "words")


def hits_on_words(hits: DataFrame, words: DataFrame) -> DataFrame:
    """The same as a join, where words and hits come from different tables: per hit_id, the union of the
    words of its page that it overlaps."""
    h, w = hits.select("hit_id", "doc_id", "page", "start", "end"), words.select("doc_id", "page", F.col("start").alias("ws"), F.col("end").alias("we"), "x", "y", "w", "h")
    joined = h.join(w, ["doc_id", "page"]).filter("ws < end and we > start")
    found = joined.groupBy("hit_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
    return found.select("hit_id", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))


def unredacted_words(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words that no box of their page touches: what is left of a text layer after redaction."""
    b = boxes.select(F.col("doc_id").alias("bd"), F.col("page").alias("bp"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    hit = (
        (F.col("doc_id") == F.col("bd")) & (F.col("page") == F.col("bp"))
        & (F.col("x") < F.col("bx") + F.col("bw")) & (F.col("bx") < F.col("x") + F.col("w"))
        & (F.col("y") < F.col("by") + F.col("bh")) & (F.col("by") < F.col("y") + F.col("h"))
    )
    return words.join(b, hit, "left_anti")


def polygon_box(polygon: Column) -> list[Column]:
    """x1, y1, x2, y2 around an array of points [x, y]."""
    xs, ys = F.transform(polygon, lambda p: F.get(p, F.lit(0))), F.transform(polygon, lambda p: F.get(p, F.lit(1)))
    return [F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")]


def ocr_lines(raw: DataFrame) -> DataFrame:
    """Lines of a recognizer, raw(doc_id, page, ord, text, polygon, confidence), as boxes: blank lines fall
    away, a missing confidence is 0, widths and heights are at least 1."""
    x1, y1, x2, y2 = polygon_box(F.col("polygon"))
    lines = raw.filter(F.col("text").rlike(r"\S")).select("doc_id", "page", "ord", "text", x1, y1, x2, y2, F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    one = F.lit(1)
    return lines.select("doc_id", "page", "ord", "text", F.col("x1").cast("int").alias("x"), F.col("y1").cast("int").alias("y"), F.greatest((F.col("x2") - F.col("x1")).cast("int"), one).alias("w"), F.greatest((F.col("y2") - F.col("y1")).cast("int"), one).alias("h"), "confidence")
