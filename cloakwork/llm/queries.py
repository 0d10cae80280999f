"""The pN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import containers, cutoffs, labels, languages, leaks, names, percentiles, personal, spam
from cloakwork.session import one_of_each, stored


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.above_percentile(_t(spark, d, "audit_log"), "id", "doc_type", "processing_ms", 95)


#: Percentiles that `p1_percentiles` reports.
FRACTIONS = [0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The percentiles of each group, from sketches that were made and kept for each day, and whether the
    true value, counted here, lies within the stated error."""
    log = one_of_each(_t(spark, d, "audit_log"), "id")
    rows = log.select(percentiles.tidy(F.col("doc_type")).alias("grp"), percentiles.measured(F.col("processing_ms")).alias("v"), F.to_date("processed_at").alias("day"))
    rows = stored(rows.filter("grp is not null and v is not null"))
    days = stored(percentiles.daily(rows))
    found = percentiles.percentiles(percentiles.merged(days), FRACTIONS)
    target = F.ceil(F.round(F.col("fraction") * F.col("n"), 6)).cast("long")
    bounds = stored(found.select("grp", "n", "fraction", "low", "high", F.greatest(target, F.lit(1)).alias("target")))
    counts = rows.join(bounds, "grp").groupBy("grp", "n", "fraction", "target").agg(F.count_if(F.col("v") < F.col("low")).alias("under"), F.count_if(F.col("v") <= F.col("high")).alias("upto"))
    return counts.select("grp", "n", "fraction", ((F.col("under") < F.col("target")) & (F.col("upto") >= F.col("target"))).alias("within"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoffs.kept(_t(spark, d, "audit_events"), _t(spark, d, "keep_targets"))


def p4_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    goal = cutoffs.goals(_t(spark, d, "keep_targets"))
    rows = cutoffs.counted(_t(spark, d, "audit_events"), goal)
    return cutoffs.cutoffs(rows, goal).withColumnRenamed("grp", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))
    return found.select("doc_id", F.col("item_id").cast("int").alias("item_id"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    clean = leaks.cleaned(_t(spark, d, "documents"), _t(spark, d, "eval_items"))
    return clean.select("doc_id", F.length("text").alias("n_chars"), F.size("items").alias("n_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.found(_t(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    spans, canonical = _t(spark, d, "layout_spans"), _t(spark, d, "field_labels")
    found = labels.mapped(spans, canonical, "span_id", "field_label", "label_id", "label")
    return found.select(F.col("id").alias("span_id"), F.col("entry").cast("int").alias("label_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    spans, docs = _t(spark, d, "layout_spans"), _t(spark, d, "source_docs")
    prose = spans.filter("block_type = 'paragraph'").join(docs.select("doc_id", "lang"), "doc_id").select("lang", "text")
    labelled = _t(spark, d, "documents").select("lang", "text").unionByName(prose)
    return languages.found(spans.select("span_id", "doc_id", "block_type", "text"), docs, labelled)


def _names(spark: SparkSession, d: str) -> DataFrame:
    """kind, text of every name field: persons and organisations, whatever the spelling of the type."""
    boxes = _t(spark, d, "redaction_boxes").filter(F.col("entity_type").isin("PERSON", "ORG", "ORGANIZATION"))
    vault = _t(spark, d, "vault_tokens").select(F.regexp_extract("token", r"^\[(PERSON|ORG)_\d+\]$", 1).alias("kind"), F.col("plaintext").alias("text"))
    kind = F.when(F.col("entity_type") == "PERSON", "PERSON").otherwise("ORG").alias("kind")
    return boxes.select(kind, F.col("text_found").alias("text")).unionByName(vault.filter("kind <> ''"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.linked(_names(spark, d)))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    spans = _t(spark, d, "layout_spans").select(F.lit("layout_spans").alias("src"), F.col("span_id").alias("row_id"), F.lit(None).cast("string").alias("kind"), "text")
    boxes = _t(spark, d, "redaction_boxes").select(F.lit("redaction_boxes").alias("src"), F.col("box_id").alias("row_id"), F.col("entity_type").alias("kind"), F.col("text_found").alias("text"))
    return spans.unionByName(boxes)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.items(_fields(spark, d)).select("src", "row_id", "pii_type", F.col("start").alias("span_start"))


def p2_sanitised(spark: SparkSession, d: str) -> DataFrame:
    fields = _fields(spark, d)
    return personal.sanitised(fields, personal.items(fields))


def p7_places(spark: SparkSession, d: str) -> DataFrame:
    return containers.assigned(containers.count_tokens(_t(spark, d, "documents")), _t(spark, d, "container_sizes"))


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    return containers.usage(p7_places(spark, d), _t(spark, d, "container_sizes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_percentiles": p1_percentiles,
    "p4_found": p4_found,
    "p4_cutoffs": p4_cutoffs,
    "p2_found": p2_found,
    "p2_sanitised": p2_sanitised,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_places": p7_places,
    "p7_usage": p7_usage,
    "p8_found": p8_found,
    "p8_cleaned": p8_cleaned,
    "p9_found": p9_found,
}

_COUNTED = """
WITH e AS (SELECT DISTINCT id, lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS grp, confidence AS v
           FROM audit_events WHERE id IS NOT NULL AND confidence BETWEEN 0 AND 1),
g AS (SELECT lower(trim(source)) AS grp, CAST(keep_pct AS BIGINT) AS pct FROM keep_targets),
c AS (SELECT e.id, e.grp, e.v, g.pct FROM e JOIN g USING (grp)),
f AS (SELECT grp, pct, v, count(*) AS n FROM c GROUP BY ALL),
s AS (SELECT grp, pct, v, sum(n) OVER (PARTITION BY grp ORDER BY v DESC) AS kept,
             sum(n) OVER (PARTITION BY grp) AS total FROM f),
cut AS (SELECT grp, pct, max(v) AS cutoff, min(kept) AS kept, any_value(total) AS total
        FROM s WHERE kept * 100 >= total * pct GROUP BY grp, pct)
"""

SQL: dict[str, str] = {
    "p1_found": """
WITH d AS (SELECT DISTINCT id, upper(regexp_replace(doc_type, '^\\s+|\\s+$', '', 'g')) AS grp, processing_ms AS v FROM audit_log
           WHERE id IS NOT NULL AND doc_type IS NOT NULL AND processing_ms IS NOT NULL
             AND NOT isnan(processing_ms) AND processing_ms >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v) AS k, count(*) OVER (PARTITION BY grp) AS n FROM d),
q AS (SELECT grp, v AS cut FROM r WHERE k = (95 * n + 99) // 100)
SELECT d.id FROM d JOIN q USING (grp) WHERE d.v > q.cut""",
    "p1_percentiles": f"""
WITH d AS (SELECT DISTINCT id, upper(regexp_replace(doc_type, '^\\s+|\\s+$', '', 'g')) AS grp, processing_ms AS v FROM audit_log
           WHERE id IS NOT NULL AND doc_type IS NOT NULL AND processing_ms IS NOT NULL AND NOT isnan(processing_ms) AND processing_ms >= 0)
SELECT grp, count(*) AS n, fraction, true AS within FROM d, (SELECT unnest({FRACTIONS})::DOUBLE AS fraction) GROUP BY grp, fraction""",
    "p4_found": _COUNTED + "SELECT c.id FROM c JOIN cut USING (grp) WHERE c.v >= cut.cutoff",
    "p4_cutoffs": _COUNTED + "SELECT grp AS source, cutoff, CAST(kept AS BIGINT) AS kept, CAST(total AS BIGINT) AS total, pct FROM cut",
}
