"""Reading files, folders and tables, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.route import ENDINGS, ending
from cloakwork.settings import Settings

#: Formats that read and write without a further library.
FORMATS = ("parquet", "orc", "json", "csv", "text")


def table(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table in one of FORMATS. JSON and CSV need a schema, so that a read never scans the data twice."""
    if format not in FORMATS:
        raise ValueError(f"no format {format!r}")
    if format in ("json", "csv") and schema is None:
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**({"header": "true"} if format == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).load(path)


def files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """path, filename, ending, length, modified, and content on request, of the readable files of a folder
    (not of its subfolders), in no order. Without content, the files aren't opened."""
    pattern = "*.{" + ",".join(sorted({*ENDINGS, *(e.upper() for e in ENDINGS)})) + "}"
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = raw.select("path", name.alias("filename"), ending(name).alias("ending"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out.filter(F.col("ending").isin(*ENDINGS))


def layout(items: DataFrame, page_height: float = 842.0) -> DataFrame:
    """Spans of a layout model's items: items(doc_id, page, ord, label, text, left, top, right, bottom,
    page_height) with pages from 1 and the origin at the bottom left, to the common form: pages from 0,
    origin at the top left, sizes of 1 at least. Blank texts fall away."""
    from cloakwork.operators.layout import block_type

    high = F.coalesce("page_height", F.lit(page_height))
    one = F.lit(1)
    return items.filter(F.col("text").rlike(r"\S")).select(
        "doc_id", (F.col("page") - 1).alias("page"), "ord", F.trim("text").alias("text"), F.col("left").cast("int").alias("x"), (high - F.col("top")).cast("int").alias("y"),
        F.greatest((F.col("right") - F.col("left")).cast("int"), one).alias("w"), F.greatest((F.col("top") - F.col("bottom")).cast("int"), one).alias("h"),
        block_type(F.col("label")).alias("block_type"), F.lit("").alias("field_label"),
    )


def nested_spans(pages: DataFrame) -> DataFrame:
    """Spans of a page's text tree, pages(doc_id, page, blocks array<struct<lines array<struct<spans
    array<struct<text, bbox array<double>>>>>>>): one row per span that isn't blank, boxes in whole numbers."""
    lines = pages.select("doc_id", "page", F.posexplode("blocks").alias("b", "block")).select("doc_id", "page", "b", F.posexplode("block.lines").alias("l", "line"))
    spans = lines.select("doc_id", "page", "b", "l", F.posexplode("line.spans").alias("s", "span"))
    x, y, x2, y2 = [F.get("span.bbox", F.lit(k)).cast("int") for k in range(4)]
    out = spans.select("doc_id", "page", (F.col("b") * 1_000_000 + F.col("l") * 1000 + F.col("s")).alias("ord"), F.trim("span.text").alias("text"), x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h"))
    return out.filter(F.col("text").rlike(r"\S"))


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """A table written in one of FORMATS. Files appear at the end of the job, all or none."""
    if format not in FORMATS:
        raise ValueError(f"no format {format!r}")
    writer = df.write.format(format).mode(mode).options(**({"header": "true"} if format == "csv" else {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_redactions(found: DataFrame, path: str, settings: Settings) -> None:
    """Detections written without their text, unless the settings ask for it; by day of processing."""
    out = found if settings.include_text else found.drop("text_found", "span", "text")
    write(out.withColumn("day", F.current_date()), path, partition_by=("day",))


def events(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """Audit events in order of id, of one document on request; the filter reaches the files."""
    df = spark.read.parquet(path)
    return (df.filter(F.col("doc_id") == doc_id) if doc_id is not None else df).orderBy("id")
