"""From a folder of files to redacted files and their audit: every step a plan, no step on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.patterns import Registry
from cloakwork.operators import audit, dedup, detect, pages, route, vault
from cloakwork.operators.words import boxes_of_hits, pages_of_words
from cloakwork.session import stored
from cloakwork.settings import Settings
from cloakwork.sources.tables import write


@dataclass(frozen=True)
class Run:
    """kinds(doc_id, filename, doc_type, pages), layers(doc_id, doc_type, layer), boxes: the detections,
    files(doc_id, content, status), records: an audit row per document."""

    kinds: DataFrame
    layers: DataFrame
    boxes: DataFrame
    files: DataFrame
    records: DataFrame


def run(files: DataFrame, codec: pages.Codec, registry: Registry | None = None, settings: Settings | None = None) -> Run:
    """files(doc_id, filename, content) classified, routed, searched, de-duplicated, redacted and audited.

    A hit's box is that of the words it overlaps. Words and detections are written once to the shared
    folder, so a file is decoded once to be read and once to be redacted.
    """
    registry, settings = registry or Registry(), settings or Settings()
    text = stored(pages_of_words(pages.words(files.select("doc_id", "content"), codec)))
    chars = text.groupBy("doc_id").agg(F.collect_list(F.length("text")).alias("chars"), F.max("page").alias("last"))
    none = F.lit(None).cast("int")
    kind = route.document_type(F.col("filename"), F.col("chars"), F.lit(0), none, none)
    kinds = stored(files.select("doc_id", "filename").join(chars, "doc_id", "left").select("doc_id", "filename", kind.alias("doc_type"), (F.coalesce("last", F.lit(-1)) + 1).alias("pages")))
    found = detect.detect(text, registry=registry, keep=("doc_id", "page", "text", "words"))
    found = detect.gated(detect.rescored(found, F.col("text")), settings.min_confidence)
    ordered = F.row_number().over(detect.Window.partitionBy("doc_id", "page").orderBy("start", "end", "pattern"))
    boxes = boxes_of_hits(found.drop("text")).select("doc_id", "page", ordered.alias("ord"), "x", "y", "w", "h", "entity_type", F.col("score").alias("confidence"), F.lit("pattern").alias("source"), F.col("span").alias("text_found"))
    boxes = stored(dedup.deduplicated(boxes, located=True))
    done = pages.rewritten(pages.to_write(files, boxes, kinds), boxes, codec)
    return Run(kinds, route.routed(kinds, settings.skip_visual_for_structured), boxes, done, audit.documents(boxes, kinds))


def write_run(result: Run, folder: str, key: bytes | None = None) -> None:
    """Redacted files, an audit record per document as JSON lines, an event per detection without its text
    and, with a key, the covered values encrypted for their document. Each appears whole or not at all."""
    write(result.files, f"{folder}/files", mode="overwrite")
    write(audit.document_json(result.records).select(F.col("record").alias("value")), f"{folder}/audit", "text", mode="overwrite")
    write(result.boxes.drop("text_found").withColumn("ts", F.current_timestamp()), f"{folder}/events")
    if key is not None:
        regions = result.boxes.select(F.expr("uuid()").alias("region_id"), "doc_id", "page", "entity_type", F.col("text_found").alias("plaintext"))
        write(vault.encrypted(regions, key), f"{folder}/vault", mode="append")


def status(kinds: DataFrame) -> DataFrame:
    """code: 1 if any document has no page that could be read, else 0, as a shell wants it."""
    return kinds.agg(F.when(F.coalesce(F.bool_or(F.col("pages") == 0), F.lit(False)), 1).otherwise(0).alias("code"))
