"""Form layout: which label a value belongs to, and detection that knows the field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.filters import high_value, is_org, is_person, looks_like_name, low_value
from cloakwork.functions.text import strip, words

# Kinds of blocks by the names that a layout model gives them; others are paragraphs.
BLOCKS = {
    "title": "header", "section_header": "header", "page_header": "header", "page_footer": "paragraph", "text": "paragraph",
    "paragraph": "paragraph", "list_item": "paragraph", "table": "table_cell", "caption": "paragraph", "form": "form_field_value",
    "key_value_region": "form_field_value", "field_region": "form_field_value", "field_heading": "form_field_label",
    "field_item": "form_field_value", "field_key": "form_field_label", "field_value": "form_field_value",
}
#: Points by which values of a label may lie above or below it.
ROW = 6


def block_type(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BLOCKS.items() for x in pair])
    return F.coalesce(table[label], F.lit("paragraph"))


def is_label(text: Column) -> Column:
    """Ends with a colon, or is short and begins with a capital."""
    s = strip(F.coalesce(text, F.lit("")))
    short = (F.length(s) <= 40) & (F.size(words(s)) <= 5) & s.rlike(r"^\p{Lu}")
    return s.endswith(":") | short


def associated(spans: DataFrame) -> DataFrame:
    """Spans with the label of their row: on a page, in reading order, each unlabelled span that reads as
    a label names the unlabelled spans to its right on its row; the first label wins, and a span that
    has a label is none. A page is one group, and its spans are an array."""
    keys = ("doc_id", "page")
    others = [c for c in spans.columns if c not in keys]
    text = F.coalesce("text", F.lit(""))
    whole = F.struct(*[(text if c == "text" else F.coalesce("field_label", F.lit("")) if c == "field_label" else F.col(c)).alias(c) for c in others])
    name = strip(F.regexp_replace(strip(text), r":+$", ""))
    one = F.struct("y", "x", "ord", is_label(F.col("text")).alias("can"), name.alias("name"), whole.alias("all"))
    pages = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("s"))

    def names(k: Column, s: Column) -> Column:
        return (k["x"] < s["x"]) & (F.abs(k["y"] - s["y"]) <= ROW) & (k["name"] != "")

    free = lambda s: s["all"]["field_label"] == ""
    labels = F.aggregate(
        "s",
        F.slice("s", 1, 0),
        lambda acc, s: F.when(s["can"] & free(s) & ~F.exists(acc, lambda k: names(k, s)), F.concat(acc, F.array(s))).otherwise(acc),
    )
    pages = pages.withColumn("l", labels)

    def done(s: Column) -> Column:
        own = F.get(F.filter("l", lambda k: names(k, s)), F.lit(0))["name"]
        isone = F.exists("l", lambda k: (k["y"] == s["y"]) & (k["x"] == s["x"]) & k["ord"].eqNullSafe(s["ord"]) & (k["name"] == s["name"]))
        label = F.when(free(s), F.coalesce(own, F.lit(""))).otherwise(s["all"]["field_label"])
        kind = F.when(isone & free(s), F.lit("form_field_label")).otherwise(s["all"]["block_type"])
        return F.struct(*[(label if c == "field_label" else kind if c == "block_type" else s["all"][c]).alias(c) for c in others])

    return pages.select(*keys, F.inline(F.transform("s", done))).select(*spans.columns)


_PAIR = r"^([A-Z][A-Za-z '’]+?):\s*(.+)$"


def split_pairs(spans: DataFrame) -> DataFrame:
    """Spans that hold several "Label: value" pairs become one span per pair.

    Pairs are parted by line breaks or, on one line, by two or more blanks before a capital. Pieces that
    are no pair keep the whole span. Spans with a label, without colon and line break, or with one piece
    stay as they are.
    """
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    lines = F.split(text, r"\n+")
    pieces = F.filter(F.transform(F.when(F.size(lines) > 1, lines).otherwise(F.split(text, r"\s{2,}(?=[A-Z])")), strip), lambda s: s != "")
    sole = (F.coalesce(F.col("field_label"), F.lit("")) != "") | ~(text.contains("\n") | text.contains(":")) | (F.size(pieces) <= 1)

    def part(s: Column) -> Column:
        pair = s.rlike(_PAIR)
        return F.struct(
            F.when(pair, strip(F.regexp_extract(s, _PAIR, 2))).otherwise(F.col("text")).alias("text"),
            F.when(pair, strip(F.regexp_extract(s, _PAIR, 1))).otherwise(F.col("field_label")).alias("field_label"),
            F.when(pair, F.lit("form_field_value")).otherwise(F.col("block_type")).alias("block_type"),
        )

    whole = F.array(F.struct(F.col("text").alias("text"), F.col("field_label").alias("field_label"), F.col("block_type").alias("block_type")))
    parts = F.when(sole, whole).otherwise(F.transform(pieces, part))
    others = [c for c in spans.columns if c not in ("text", "field_label", "block_type")]
    out = spans.select(*others, F.posexplode(parts).alias("part", "p"))
    return out.select(*others, "part", F.col("p.text").alias("text"), F.col("p.field_label").alias("field_label"), F.col("p.block_type").alias("block_type"))


def field_class(label: Column) -> Column:
    """high, low, both or none: what a field's label says about its value."""
    high, low = high_value(label), low_value(label)
    return F.when(high & low, "both").when(high, "high").when(low, "low").otherwise("none")


def field_detections(spans: DataFrame, found: DataFrame, floor: float = 0.75) -> DataFrame:
    """Detections of model or pattern hits in labelled spans, by the rules of fields.

    spans(span_id, field_label, text), found(span_id, span, entity_type, score): persons and
    organisations must pass their filters, fall away in fields that name institutions, and score at
    least `floor` in fields of high value. A high-value field without any person hit whose text reads as
    a name is itself a person hit. Result: span_id, span, entity_type, score, source.
    """
    known = found.join(spans.select("span_id", "field_label", "text"), "span_id")
    named = F.col("entity_type").isin("PERSON", "ORGANIZATION", "ORG")
    ok = (
        F.when(F.col("entity_type").isin("ORGANIZATION", "ORG"), is_org(F.col("span"), F.col("text")))
        .when(F.col("entity_type") == "PERSON", is_person(F.col("span")))
        .otherwise(F.lit(True))
    )
    kept = known.filter(ok & ~(named & low_value(F.col("field_label"))))
    score = F.when(named & high_value(F.col("field_label")), F.greatest("score", F.lit(floor))).otherwise(F.col("score"))
    kept = kept.select("span_id", "span", "entity_type", score.alias("score"), F.lit("field").alias("source"))
    persons = found.filter("entity_type = 'PERSON'").select("span_id").distinct()
    guessed = spans.filter(high_value(F.col("field_label")) & ~low_value(F.col("field_label")) & looks_like_name(F.col("text"))).join(persons, "span_id", "left_anti")
    return kept.unionByName(guessed.select("span_id", F.col("text").alias("span"), F.lit("PERSON").alias("entity_type"), F.lit(floor).alias("score"), F.lit("heuristic_name_field").alias("source")))
