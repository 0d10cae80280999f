"""What was redacted, without the text: counts, audit rows, and their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(boxes: DataFrame, *keys: str) -> DataFrame:
    """Rows per key, such as doc_id and entity_type, or source."""
    return boxes.groupBy(*keys).agg(F.count("*").alias("n"))


def _tally(column: str) -> Column:
    """A map from value to count over the rows of a group, in order of the values."""
    return F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(column, "n"))), lambda e: e.isNotNull())))


def documents(boxes: DataFrame, docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, filename, doc_type, pages, pages_redacted, total_redactions,
    entity_counts, source_counts. Documents without boxes have zeros and empty maps; no text comes along.

    docs(doc_id, filename, doc_type, pages). Counts are reduced per document and type before maps form.
    """
    empty = F.expr("cast(map() as map<string,bigint>)")
    kinds = counts(boxes, "doc_id", "entity_type").groupBy("doc_id").agg(_tally("entity_type").alias("entity_counts"), F.sum("n").alias("total"))
    sources = counts(boxes, "doc_id", "source").groupBy("doc_id").agg(_tally("source").alias("source_counts"))
    pages = boxes.groupBy("doc_id").agg(F.countDistinct("page").alias("pages_redacted"))
    joined = docs.select("doc_id", "filename", "doc_type", "pages").join(kinds, "doc_id", "left").join(sources, "doc_id", "left").join(pages, "doc_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "filename", "doc_type", "pages", F.coalesce("pages_redacted", zero).alias("pages_redacted"), F.coalesce("total", zero).alias("total_redactions"),
        F.coalesce("entity_counts", empty).alias("entity_counts"), F.coalesce("source_counts", empty).alias("source_counts"),
    )


def per_page(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("doc_id", "page").agg(F.count("*").alias("redactions"))


def box_json(include_text: bool = False) -> Column:
    """A detection as JSON: type, confidence to three places, source, page, box; the text on request."""
    fields = [F.col("entity_type"), F.round("confidence", 3).alias("confidence"), F.col("source"), F.col("page"), F.array("x", "y", "w", "h").alias("bbox")]
    if include_text:
        fields.append(F.col("text_found"))
    return F.to_json(F.struct(*fields))


def document_json(audit: DataFrame) -> DataFrame:
    """doc_id and the document's audit record as JSON, with a version."""
    return audit.select("doc_id", F.to_json(F.struct(F.lit("1.0").alias("version"), *[c for c in audit.columns])).alias("record"))


def parsed_counts(log: DataFrame, *columns: str) -> DataFrame:
    """JSON columns of counts as maps; what doesn't parse is null."""
    for c in columns:
        log = log.withColumn(c, F.from_json(c, "map<string,bigint>"))
    return log


def rollup(events: DataFrame, *keys: str) -> DataFrame:
    """Counts, total and mean confidence over every prefix of the keys, with nulls for totals. A key that
    is null in the data is shown as "(none)"."""
    filled = events.select(*[F.coalesce(F.col(k).cast("string"), F.lit("(none)")).alias(k) for k in keys], "confidence")
    return filled.rollup(*keys).agg(F.count("*").alias("n"), F.sum("confidence").alias("total_confidence"), F.avg("confidence").alias("mean_confidence"))
