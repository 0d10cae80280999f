"""The border to models: their raw output as input tables, and everything after it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions.boxes import padded
from cloakwork.functions.filters import PROMPTS, lookup, sane_model_hit
from cloakwork.functions.text import strip


def run_model(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Hits of a model: keep columns, label, start, end, score. load is called once per task and gives a
    function from texts to lists of {label, start, end, score}; a text on which it fails has no hits."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", label string, start int, end int, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                try:
                    found = model([row[-1]])[0] if row[-1] else []
                except Exception:
                    found = []
                rows += [(*row[:-1], h["label"], int(h["start"]), int(h["end"]), float(h["score"])) for h in found]
            yield pd.DataFrame(rows, columns=[*keep, "label", "start", "end", "score"])

    return df.select(*keep, text_col).mapInPandas(run, schema)


def prompt_hits(raw: DataFrame, requested: tuple[str, ...] | None = None, least: float = 0.4) -> DataFrame:
    """Hits of a zero-shot model, raw(..., span, label, score), as entities: prompts mapped to types, only
    the requested types, at least the threshold, scores of 1 at most, formats checked."""
    entity = F.coalesce(lookup(PROMPTS, F.lower("label")), F.upper("label"))
    out = raw.withColumn("entity_type", entity).withColumn("score", F.least("score", F.lit(1.0))).filter(F.col("score") >= least)
    if requested is not None:
        out = out.filter(F.col("entity_type").isin(*requested))
    return out.filter(sane_model_hit(F.col("span"), F.col("entity_type"))).drop("label")


def domain_hits(raw: DataFrame, least: float = 0.60) -> DataFrame:
    """Hits of a domain model, which has no scores: a little over the gate, 0.80 at least."""
    return raw.withColumn("entity_type", F.coalesce("label", F.lit("INSURANCE"))).withColumn("score", F.lit(max(least + 0.05, 0.80))).drop("label")


def vision_boxes(raw: DataFrame, raw_col: str = "raw", width: str = "img_w", height: str = "img_h") -> DataFrame:
    """Boxes in the answers of a vision model, with the other columns of raw and ord, x, y, w, h,
    entity_type, confidence, text_found.

    The answer is a JSON array, perhaps in a fence or amid prose. Each item needs a bbox_2d of four
    numbers in thousandths of the picture; reversed corners are turned, boxes clamped to the picture,
    empty ones dropped. The label defaults to UNKNOWN, the confidence to 0.75, clamped to 0..1. A bad item
    falls away alone; an answer without an array has no boxes.
    """
    plain = strip(F.regexp_replace(F.coalesce(F.col(raw_col), F.lit("")), r"```(?:json)?\s*|\s*```", ""))
    amid = F.regexp_extract(plain, r"(?s)\[.*\]", 0)
    array = F.when(plain.startswith("[") & plain.endswith("]"), plain).when(plain.startswith("{"), F.lit(None)).otherwise(F.nullif(amid, F.lit("")))
    keep = [c for c in raw.columns if c != raw_col]
    items = raw.select(*keep, F.posexplode(F.from_json(array, "array<string>")).alias("ord", "item"))
    corners = F.from_json(F.get_json_object("item", "$.bbox_2d"), "array<string>")
    items = items.withColumn("b", F.transform(corners, lambda c: c.try_cast("double"))).filter((F.size("b") == 4) & F.forall("b", lambda c: c.isNotNull()))

    def pixel(k: int, size: str) -> Column:
        return (F.get("b", F.lit(k)) / 1000 * F.col(size)).cast("int")

    def inside(c: Column, size: str) -> Column:
        return F.greatest(F.lit(0), F.least(c, F.col(size)))

    x1, x2 = inside(F.least(pixel(0, width), pixel(2, width)), width), inside(F.greatest(pixel(0, width), pixel(2, width)), width)
    y1, y2 = inside(F.least(pixel(1, height), pixel(3, height)), height), inside(F.greatest(pixel(1, height), pixel(3, height)), height)
    sure = F.coalesce(F.get_json_object("item", "$.confidence").try_cast("double"), F.lit(0.75))
    boxes = items.select(
        *keep, "ord", x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"),
        F.upper(F.coalesce(F.get_json_object("item", "$.label"), F.lit("UNKNOWN"))).alias("entity_type"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"),
        F.coalesce(F.get_json_object("item", "$.text"), F.lit("")).alias("text_found"),
    )
    return boxes.filter("w > 0 and h > 0")


def codes(raw: DataFrame) -> DataFrame:
    """Read codes, raw(..., kind): QR_CODE or BARCODE, with confidence 1."""
    return raw.withColumn("entity_type", F.when(F.upper("kind").contains("QR"), "QR_CODE").otherwise("BARCODE")).withColumn("confidence", F.lit(1.0)).drop("kind")


def faces(raw: DataFrame, pad: int = 4, default: float = 0.80) -> DataFrame:
    """Hits of a face model, raw(..., x, y, w, h, score, width, height), grown by pad within the picture; a
    model without scores gives the default."""
    grown = dict(zip("xywh", padded(pad, F.col("width"), F.col("height"))))
    rest = [c for c in raw.columns if c not in ("x", "y", "w", "h", "score", "width", "height")]
    return raw.select(*rest, *grown.values(), F.lit("FACE").alias("entity_type"), F.coalesce("score", F.lit(default)).alias("confidence"))


def handwriting(raw: DataFrame, least_area: int = 500) -> DataFrame:
    """Regions of ink, raw(..., w, h, area), large enough to be handwriting; none has a score of its own."""
    large = raw.filter(F.col("area") >= least_area).drop("area")
    return large.withColumn("entity_type", F.lit("HANDWRITING")).withColumn("confidence", F.lit(0.75))


def joined_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text: the lines of lines(doc_id, ord, text) that aren't blank, joined by blanks in order; the
    empty text for docs(doc_id) without any."""
    own = lines.filter(F.col("text").rlike(r"\S")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["text"]), " ")
    return docs.select("doc_id").join(own, "doc_id", "left").select("doc_id", F.coalesce(text, F.lit("")).alias("text"))


def plates(raw: DataFrame, least: float = 0.60) -> DataFrame:
    """Hits of a vehicle model: plates from the least confidence, other classes from 0.7, all as plates."""
    plate = F.lower("kind").contains("plate")
    return raw.filter((plate & (F.col("confidence") >= least)) | (~plate & (F.col("confidence") >= 0.7))).withColumn("entity_type", F.lit("LICENSE_PLATE")).drop("kind")


def first_of_each(first: DataFrame, second: DataFrame) -> DataFrame:
    """Spans of two sources, doc_id, ord, span: those of the first, then those of the second that differ in
    more than case and outer blanks; blank spans fall away. The result's ord follows this order."""
    both = first.select("doc_id", F.lit(0).alias("rank"), "ord", "span").unionByName(second.select("doc_id", F.lit(1).alias("rank"), "ord", "span"))
    both = both.filter(F.col("span").rlike(r"\S")).withColumn("key", F.lower(strip(F.col("span"))))
    order = Window.partitionBy("doc_id", "key").orderBy("rank", "ord")
    kept = both.withColumn("n", F.row_number().over(order)).filter("n = 1")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "ord"))
    return kept.select("doc_id", (place - 1).alias("ord"), "span")
