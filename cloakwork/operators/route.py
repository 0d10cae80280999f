"""What kind of document a file is, and which layers look at it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File endings that are read, and the layers of each kind of document.
PICTURES = ("jpg", "jpeg", "png", "tiff", "tif", "bmp")
ENDINGS = ("pdf", *PICTURES)
LAYERS = {
    ("PDF_STRUCTURED", "any"): ("text", "visual"),
    ("SCAN_FORM", "any"): ("ocr", "visual", "handwriting"),
    ("PHOTO", "any"): ("visual", "exif"),
    ("ID_DOC", "any"): ("ocr", "visual", "exif"),
    ("MEDICAL", "pdf"): ("text", "insurance_ner", "scispacy"),
    ("MEDICAL", "image"): ("ocr", "insurance_ner", "scispacy"),
    ("UNKNOWN", "pdf"): ("text", "visual", "insurance_ner", "scispacy"),
    ("UNKNOWN", "image"): ("ocr", "visual", "insurance_ner", "scispacy", "exif"),
}


def ending(filename: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([^.\s]+)\s*$", 1))


def document_type(filename: Column, page_chars: Column, faces: Column, width: Column, height: Column) -> Column:
    """PDF files with a page of over 100 characters are structured, others scans; pictures go by faces and
    shape; anything else, or what can't be measured, is unknown. Never null."""
    e = ending(filename)
    picture = (
        F.when(width.isNull() | height.isNull(), "UNKNOWN")
        .when((faces > 0) & (height > width * 1.2), "ID_DOC")
        .when(faces > 0, "PHOTO")
        .when(width > height * 1.5, "PHOTO")
        .otherwise("SCAN_FORM")
    )
    return F.when(e == "pdf", F.when(F.coalesce(F.exists(page_chars, lambda n: n > 100), F.lit(False)), "PDF_STRUCTURED").otherwise("SCAN_FORM")).when(e.isin(*PICTURES), picture).otherwise("UNKNOWN")


def routed(docs: DataFrame, skip_visual_for_structured: bool = False) -> DataFrame:
    """docs(doc_id, filename, doc_type) to a row per document and layer. Unknown types count as UNKNOWN; the
    table of layers is a literal, so nothing is joined."""
    kind = F.when(ending(F.col("filename")) == "pdf", "pdf").otherwise("image")
    known = F.when(F.upper(F.trim("doc_type")).isin(*{t for t, _ in LAYERS}), F.upper(F.trim("doc_type"))).otherwise("UNKNOWN")
    layers = F.array().cast("array<string>")
    for (doc_type, media), names in LAYERS.items():
        if skip_visual_for_structured and doc_type == "PDF_STRUCTURED":
            names = tuple(n for n in names if n != "visual")
        layers = F.when((known == doc_type) & ((F.lit(media) == "any") | (kind == media)), F.array(*[F.lit(n) for n in names])).otherwise(layers)
    return docs.select("doc_id", known.alias("doc_type"), F.explode(layers).alias("layer"))


def readable(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Files with an ending that is read."""
    return files.filter(ending(F.col(path_col)).isin(*ENDINGS))


def combined(layers: dict[str, DataFrame], form: Column, least: float = 0.60) -> DataFrame:
    """Visual layers as one table: handwriting counts on forms only, and hits need the least confidence.

    layers: name to detections. form: whether a row's document is a scanned form.
    """
    out = None
    for name, df in layers.items():
        part = df.filter(form) if name == "handwriting" else df
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("confidence") >= least)
