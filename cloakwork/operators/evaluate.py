"""How well detections match a gold standard."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.boxes import iou
from cloakwork.functions.text import strip


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f, 3).alias("f1")]


def compared(pred: DataFrame, gold: DataFrame, partial: bool = False, stripped: bool = False, keys: tuple[str, ...] = ("doc_id", "entity_type")) -> DataFrame:
    """keys, span, pred, gold, hit: how often each text stands on either side, and whether a text of the
    other side matches it within the keys. Each side is read once.

    Exact matches are equal texts. Partial ones, where one text holds the other, are looked for among
    the distinct texts of equal keys.
    """
    keys = list(keys)

    def side(df: DataFrame, p: int) -> DataFrame:
        text = strip(F.col("span")) if stripped else F.col("span")
        return df.select(*keys, text.alias("span"), F.lit(p).alias("p"), F.lit(1 - p).alias("g")).filter("span is not null")

    both = side(pred, 1).unionByName(side(gold, 0)).groupBy(*keys, "span").agg(F.sum("p").alias("pred"), F.sum("g").alias("gold"))
    if not partial:
        return both.withColumn("hit", (F.col("pred") > 0) & (F.col("gold") > 0))
    texts = F.transform("all", lambda a: F.struct(*[a[c].alias(c) for c in ("span", "pred", "gold")], F.exists("all", lambda o: (((a["pred"] > 0) & (o["gold"] > 0)) | ((a["gold"] > 0) & (o["pred"] > 0))) & (F.contains(a["span"], o["span"]) | F.contains(o["span"], a["span"]))).alias("hit")))
    return both.groupBy(*keys).agg(F.collect_list(F.struct("span", "pred", "gold")).alias("all")).select(*keys, F.inline(texts))


def f1(pred: DataFrame, gold: DataFrame, *by: str, **how) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, over all or by columns. True positives are counted on the side of
    the predictions, for recall too; a type on one side only has a row. A document's texts of a type are
    one group."""
    rows = compared(pred, gold, **how)
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(F.when(c, F.col(n)).otherwise(0)), zero).alias(a) for a, c, n in (("tp", F.col("hit"), "pred"), ("fp", ~F.col("hit"), "pred"), ("fn", ~F.col("hit"), "gold"))]
    return rows.groupBy(*by).agg(*sums).select(*by, "tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def triples(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """By type, exact matches of (doc_id, start, end, entity_type); types without gold are left out."""
    key = ["doc_id", "start", "end", "entity_type"]
    p, g = pred.select(*key).distinct().withColumn("p", F.lit(1)), gold.select(*key).distinct().withColumn("g", F.lit(1))
    sums = p.join(g, key, "full").groupBy("entity_type").agg(
        F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"),
        F.count_if(F.col("g").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
    )
    return sums.filter("tp + fn > 0").select("entity_type", "tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def micro(by_type: DataFrame) -> DataFrame:
    sums = by_type.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select("tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def box_matches(pred: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, tp, fp, fn: each prediction, in order, takes the free gold box that it covers best, from
    the threshold on; of equally good ones the first. pred, gold: image_id, ord, x, y, w, h. The boxes of
    an image are an array."""
    box = F.struct("ord", "x", "y", "w", "h")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("image_id", box.alias("b")).groupBy("image_id").agg(F.array_sort(F.collect_list("b")).alias(name))

    both = side(pred, "p").join(side(gold, "g"), "image_id", "full")
    none = F.expr("cast(array() as array<struct<ord:bigint,x:int,y:int,w:int,h:int>>)")

    def kind(c: str) -> Column:
        return F.coalesce(F.col(c), none).cast("array<struct<ord:bigint,x:int,y:int,w:int,h:int>>")

    def take(free: Column, b: Column) -> Column:
        cover = F.transform(free, lambda g: iou(b, g))
        best = F.array_max(cover)
        at = F.array_position(cover, best).cast("int")
        rest = F.concat(F.slice(free, F.lit(1), at - 1), F.slice(free, at + 1, F.size(free)))
        return F.when(F.coalesce(best >= threshold, F.lit(False)), rest).otherwise(free)

    rows = both.select("image_id", kind("p").alias("p"), kind("g").alias("g"))
    rows = rows.withColumn("left", F.size(F.aggregate("p", F.col("g"), take)))
    tp = (F.size("g") - F.col("left")).cast("long")
    return rows.select("image_id", tp.alias("tp"), (F.size("p") - tp).cast("long").alias("fp"), F.col("left").cast("long").alias("fn"))


def ocr_summary(pages: DataFrame) -> DataFrame:
    """docs, errors, mean_rate, mean_lines of a recognizer's run: pages(doc_id, rate, lines, error). Rates
    are averaged over documents without an error, and are 0 where all failed."""
    good = F.count_if(~F.col("error"))
    return pages.agg(
        F.count("*").alias("docs"), F.count_if("error").alias("errors"), (F.coalesce(F.sum(F.when(~F.col("error"), F.col("rate"))), F.lit(0.0)) / F.greatest(good, F.lit(1))).alias("mean_rate"), F.coalesce(F.avg("lines"), F.lit(0.0)).alias("mean_lines")
    )


def error_rate(ref: Column, hyp: Column) -> Column:
    """Edit distance over the reference's length; 0 for an empty reference."""
    r, h = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    return F.when(F.length(r) > 0, F.levenshtein(r, h) / F.length(r)).otherwise(F.lit(0.0))


def _blocks(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    def one(r: str | None, h: str | None) -> float:
        r, h = r or "", h or ""
        if not r:
            return 0.0
        steps = SequenceMatcher(None, r, h).get_opcodes()
        return sum(max(b - a, d - c) for kind, a, b, c, d in steps if kind != "equal") / len(r)

    return pd.Series([one(r, h) for r, h in zip(ref, hyp)])


def block_error_rate(ref: Column, hyp: Column) -> Column:
    """The same by matching blocks: per differing stretch the longer side counts. Never under the edit
    distance."""
    return F.pandas_udf(_blocks, T.DoubleType())(ref, hyp)


def gold_spans(rows: DataFrame, id_col: str = "doc_id", text_col: str = "generated_text", spans_col: str = "pii_spans") -> DataFrame:
    """doc_id, start, end, label, span from a JSON list of spans; what doesn't parse has none."""
    items = F.from_json(F.col(spans_col), "array<struct<start:int,end:int,label:string>>")
    out = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), F.inline(items))
    return out.select("doc_id", "start", "end", "label", F.expr("substring(_t, start + 1, end - start)").alias("span"))


def receipt_totals(rows: DataFrame, id_col: str = "doc_id", json_col: str = "ground_truth") -> DataFrame:
    """doc_id, key, value of the totals in a receipt's JSON: keys of the total with total_price or cash, of
    the subtotal with price or total; empty values fall away."""
    kind = "map<string,string>"
    total = F.map_filter(F.from_json(F.get_json_object(json_col, "$.gt_parse.total"), kind), lambda k, v: F.contains(k, F.lit("total_price")) | F.contains(F.lower(k), F.lit("cash")))
    sub = F.map_filter(F.from_json(F.get_json_object(json_col, "$.gt_parse.sub_total"), kind), lambda k, v: F.contains(k, F.lit("price")) | F.contains(k, F.lit("total")))
    empty = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    entries = F.concat(F.coalesce(F.map_entries(total), empty), F.coalesce(F.map_entries(sub), empty))
    return rows.select(F.col(id_col).alias("doc_id"), F.inline(entries)).filter(F.coalesce("value", F.lit("")) != "")


def confidential(mentions: DataFrame) -> DataFrame:
    """Mentions that are confidential, with the text's slice where the mention has none of its own."""
    own = F.coalesce("span_text", F.expr("substring(text, start_offset + 1, end_offset - start_offset)"))
    return mentions.filter(~F.col("confidential_status").eqNullSafe("NOT_CONFIDENTIAL")).withColumn("span", own)


def first_documents(rows: DataFrame, n: int, text_col: str = "text", order: str = "doc_id") -> DataFrame:
    """The first n rows, by order, with a text that isn't blank: a report on a sample of that size."""
    return rows.filter(F.col(text_col).rlike(r"\S")).orderBy(order).limit(n)


def ranked(results: DataFrame) -> DataFrame:
    """Results by falling f1, then by type, with their place. A result has a row per type, so one task
    ranks them."""
    return results.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), "entity_type")))
