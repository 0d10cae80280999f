"""Further registered queries: sources and sinks, model output, words and pages, joins and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import filters as N
from cloakwork.functions.boxes import SPECIFICITY
from cloakwork.functions.patterns import CONTEXT, GENERAL, PATTERNS, Registry
from cloakwork.functions.text import matches, window
from cloakwork.operators import audit, dedup, detect, evaluate, image, layout, models, pages, route, templates, vault, words
from cloakwork.plans import pipeline
from cloakwork.plans.catalogue import _BOXES, _E, _SPANS, _WITH, _boxes, _extract_sql, case, claims, query, quoted, table
from cloakwork.session import one_of_each
from cloakwork.sources import tables

_BLANKS = "[\\s\\p{Z}]"
_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return one_of_each(table(spark, d, "layout_spans"), "span_id")


# --- sources and sinks ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_E} AS ending FROM source_docs WHERE {_E} IN ({quoted(route.ENDINGS)})")
def readable_files(spark: SparkSession, d: str) -> DataFrame:
    return route.readable(table(spark, d, "source_docs"), "filename").select("doc_id", route.ending(F.col("filename")).alias("ending"))


@query(
    f"""WITH {_SPANS}, s AS (SELECT doc_id, page, trim(text) AS text, x, y, w, h, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord, span_id) - 1 AS b, text AS raw FROM spans)
SELECT doc_id, page, CAST(b * 1000000 AS BIGINT) AS ord, text, x, y, w, h FROM s WHERE regexp_matches(raw, '\\S')"""
)
def text_tree_spans(spark: SparkSession, d: str) -> DataFrame:
    """Pages as trees of blocks, lines and spans, read back as spans."""
    box = F.array(*[F.col(c).cast("double") + F.lit(0.25) for c in ("x", "y")], (F.col("x") + F.col("w")).cast("double") + 0.5, (F.col("y") + F.col("h")).cast("double") + 0.5)
    block = F.struct("ord", "span_id", F.array(F.struct(F.array(F.struct("text", box.alias("bbox"))).alias("spans"))).alias("lines"))
    trees = _spans(spark, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    trees = trees.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["lines"].alias("lines"))))
    return tables.nested_spans(trees).withColumn("ord", F.col("ord").cast("long"))


@query(
    f"""WITH {_SPANS} SELECT doc_id, page, ord, trim(text) AS text, x, y, greatest(w, 1) AS w, greatest(h, 1) AS h, {case('block_type', layout.BLOCKS, quoted(['paragraph']))} AS block_type, '' AS field_label
FROM spans WHERE regexp_matches(text, '\\S')"""
)
def layout_origin(spark: SparkSession, d: str) -> DataFrame:
    """Items with the origin at the bottom left of a page 842 high, read as spans with it at the top left."""
    s = _spans(spark, d)
    items = s.select("doc_id", (F.col("page") + 1).alias("page"), "ord", F.col("block_type").alias("label"), "text", F.col("x").alias("left"), (F.lit(842) - F.col("y")).alias("top"), (F.col("x") + F.col("w")).alias("right"), (F.lit(842) - F.col("y") - F.col("h")).alias("bottom"), F.when(F.col("page") > 0, 842.0).alias("page_height"))
    return tables.layout(items)


@query("SELECT DISTINCT id, doc_id, entity_type, page FROM audit_events")
def event_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.events(spark, f"{d}/audit_events.parquet").select("id", "doc_id", "entity_type", "page").distinct()


@query("SELECT doc_id, entity_type, source, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, min(year(ts)) AS since FROM (SELECT DISTINCT * FROM audit_events) GROUP BY ALL")
def event_days(spark: SparkSession, d: str) -> DataFrame:
    events = one_of_each(table(spark, d, "audit_events"), "id")
    return events.groupBy("doc_id", "entity_type", "source").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.min(F.year("ts")).cast("long").alias("since"))


@query(
    f"""WITH {_BOXES}, k AS (SELECT doc_id, entity_type, count(*) AS n FROM boxes GROUP BY 1, 2)
SELECT doc_id, '1.0' AS version, pages, coalesce(sum(n), 0)::BIGINT AS total, coalesce(max(n) FILTER (WHERE entity_type = 'PERSON'), 0)::BIGINT AS persons FROM source_docs LEFT JOIN k USING (doc_id) GROUP BY doc_id, pages"""
)
def audit_records(spark: SparkSession, d: str) -> DataFrame:
    """Audit records as JSON, read back."""
    records = audit.document_json(audit.documents(_boxes(spark, d), table(spark, d, "source_docs")))
    value = lambda path: F.get_json_object("record", path)
    return records.select("doc_id", value("$.version").alias("version"), value("$.pages").cast("int").alias("pages"), value("$.total_redactions").cast("long").alias("total"), F.coalesce(value("$.entity_counts.PERSON").cast("long"), F.lit(0)).alias("persons"))


@query(f"WITH {_BOXES} SELECT box_id, entity_type, round(confidence, 3) AS confidence, page, x, w, text_found IS NOT NULL AS has_text FROM boxes")
def audit_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Detections as JSON, without and with their text, read back."""
    rows = _boxes(spark, d).select("box_id", audit.box_json().alias("j"), audit.box_json(True).alias("t"))
    value = lambda path: F.get_json_object("j", path)
    safe = F.get_json_object("j", "$.text_found").isNull()
    return rows.select("box_id", value("$.entity_type").alias("entity_type"), value("$.confidence").cast("double").alias("confidence"), value("$.page").cast("int").alias("page"), value("$.bbox[0]").cast("int").alias("x"), value("$.bbox[2]").cast("int").alias("w"), (safe & F.get_json_object("t", "$.text_found").isNotNull()).alias("has_text"))


@query(
    f"""WITH {_BOXES}, b AS (SELECT *, box_id % 24 - 4 AS bx, box_id % 20 - 2 AS bt, w % 9 AS bw, h % 7 AS bh FROM boxes)
SELECT CAST(box_id AS VARCHAR) AS image_id, CAST(greatest(least(bx + bw, 16) - greatest(bx, 0), 0) * greatest(least(bt + bh, 12) - greatest(bt, 0), 0) AS INT) AS dark FROM b"""
)
def image_fill(spark: SparkSession, d: str) -> DataFrame:
    """A white picture of 16 by 12 per box, with the box filled: how many pixels are dark."""
    box = F.struct((F.col("box_id") % 24 - 4).cast("int").alias("x"), (F.col("box_id") % 20 - 2).cast("int").alias("y"), (F.col("w") % 9).alias("w"), (F.col("h") % 7).alias("h"))
    white = F.unhex(F.repeat(F.lit("FF"), 192))
    images = _boxes(spark, d).select(F.col("box_id").cast("string").alias("image_id"), F.lit(12).alias("height"), F.lit(16).alias("width"), F.lit(1).alias("channels"), white.alias("data"), F.array(box).alias("boxes"))
    return image.filled(images).select("image_id", (F.lit(192) - F.length(F.replace(F.hex("data"), F.lit("00"), F.lit(""))) / 2).cast("int").alias("dark"))


@query("SELECT doc_id, 'FFD8FFE00004' || lpad(hex(pages % 256), 4, '0') || 'FFDA0001FFD9' AS content, CAST(8 AS BIGINT) AS removed FROM source_docs")
def image_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Small JPEG files with an EXIF segment, without it."""
    size = F.lpad(F.hex(F.col("pages") % 256), 4, "0")
    content = F.unhex(F.concat(F.lit("FFD8"), F.lit("FFE00004"), size, F.lit("FFE1000645786966"), F.lit("FFDA0001FFD9")))
    return image.without_metadata(table(spark, d, "source_docs").select("doc_id", content.alias("content"))).select("doc_id", F.hex("content").alias("content"), "removed")


@query(f"SELECT entity_type, pattern, score, context FROM (VALUES {', '.join(f'({quoted([p.entity])}, {quoted([p.name])}, CAST({p.score} AS DOUBLE), {len(CONTEXT.get(p.entity, ()))})' for p in PATTERNS if p.entity not in ('NPI', 'EIN'))}, ('EMAIL_ADDRESS', 'email', CAST(1.0 AS DOUBLE), 0)) AS v(entity_type, pattern, score, context)")
def registry_build(spark: SparkSession, d: str) -> DataFrame:
    """The recognizers after two types were removed and one pattern added."""
    registry = Registry(PATTERNS).remove("NPI", "EIN").add(GENERAL[0])
    return spark.createDataFrame([(p.entity, p.name, float(p.score), len(CONTEXT.get(p.entity, ()))) for p in registry.patterns], "entity_type string, pattern string, score double, context int")


# --- model output ---------------------------------------------------------------------------------------

_PROMPT = "lower(replace(entity_type, '_', ' '))"


@query(
    f"""WITH {_BOXES}, p AS (SELECT box_id, text_found AS span, coalesce({case(_PROMPT, N.PROMPTS, 'NULL')}, upper({_PROMPT})) AS entity_type, least(confidence, 1.0) AS score, {_STRIP.format("coalesce(text_found, '')")} AS s FROM boxes)
SELECT box_id, span, entity_type, score FROM p WHERE score >= 0.4 AND s <> '' AND CASE entity_type WHEN 'EMAIL_ADDRESS' THEN regexp_matches(s, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}')
 WHEN 'PHONE_NUMBER' THEN length(regexp_replace(s, '\\D', '', 'g')) >= 7 WHEN 'US_SSN' THEN regexp_matches(s, '\\d{{3}}[-\\s]?\\d{{2}}[-\\s]?\\d{{4}}') WHEN 'NPI' THEN regexp_matches(s, '\\d') WHEN 'EIN' THEN regexp_matches(s, '\\d') ELSE true END"""
)
def prompt_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits as a zero-shot model would give them, with prompts for types."""
    raw = _boxes(spark, d).select("box_id", F.col("text_found").alias("span"), F.lower(F.replace("entity_type", F.lit("_"), F.lit(" "))).alias("label"), F.col("confidence").alias("score"))
    return models.prompt_hits(raw)


@query(f"WITH {_BOXES} SELECT box_id, coalesce(nullif(entity_type, 'INSURANCE'), 'INSURANCE') AS entity_type, 0.80::DOUBLE AS score FROM boxes WHERE source = 'insurance_ner'")
def domain_hits(spark: SparkSession, d: str) -> DataFrame:
    raw = _boxes(spark, d).filter("source = 'insurance_ner'").select("box_id", F.nullif(F.col("entity_type"), F.lit("INSURANCE")).alias("label"))
    return models.domain_hits(raw)


def _digit_model():
    import re

    return lambda texts: [[{"label": "NUMBER", "start": m.start(), "end": m.end(), "score": 0.9} for m in re.finditer("[0-9]+", t)] for t in texts]


_RUNS = """o AS (SELECT span_id, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS INT) AS start, length(ms[i]) AS n
  FROM (SELECT span_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT span_id, regexp_extract_all(text, '[0-9]+') AS ms, regexp_split_to_array(text, '[0-9]+') AS gs FROM spans WHERE text IS NOT NULL)))"""


@query(f"WITH {_SPANS}, {_RUNS} SELECT span_id, 'NUMBER' AS label, start, CAST(start + n AS INT) AS \"end\", 0.9 AS score FROM o")
def model_hits(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model, loaded once per task: every run of digits."""
    return models.run_model(_spans(spark, d), _digit_model, keep=("span_id",))


@query(f"WITH {_BOXES} SELECT box_id, CASE WHEN contains(upper(entity_type), 'QR') THEN 'QR_CODE' ELSE 'BARCODE' END AS entity_type, 1.0::DOUBLE AS confidence FROM boxes")
def code_hits(spark: SparkSession, d: str) -> DataFrame:
    return models.codes(_boxes(spark, d).select("box_id", F.col("entity_type").alias("kind")))


@query(f"WITH {_BOXES} SELECT box_id, confidence, 'LICENSE_PLATE' AS entity_type FROM boxes WHERE (entity_type = 'LICENSE_PLATE' AND confidence >= 0.6) OR (entity_type <> 'LICENSE_PLATE' AND confidence >= 0.7)")
def plate_hits(spark: SparkSession, d: str) -> DataFrame:
    return models.plates(_boxes(spark, d).select("box_id", F.col("entity_type").alias("kind"), "confidence"))


@query(
    f"""WITH {_BOXES} SELECT box_id, greatest(x - 4, 0) AS x, greatest(y - 4, 0) AS y, CAST(greatest(least(x + w + 4, 800) - greatest(x - 4, 0), 0) AS INT) AS w, CAST(greatest(least(y + h + 4, 1000) - greatest(y - 4, 0), 0) AS INT) AS h,
'FACE' AS entity_type, coalesce(confidence, 0.8) AS confidence FROM boxes"""
)
def face_hits(spark: SparkSession, d: str) -> DataFrame:
    return models.faces(_boxes(spark, d).select("box_id", "x", "y", "w", "h", F.col("confidence").alias("score"), F.lit(800).alias("width"), F.lit(1000).alias("height")))


@query(f"WITH {_BOXES} SELECT box_id, x, y, w, h, 'HANDWRITING' AS entity_type, 0.75::DOUBLE AS confidence FROM boxes WHERE w * h >= 500")
def handwriting_hits(spark: SparkSession, d: str) -> DataFrame:
    return models.handwriting(_boxes(spark, d).select("box_id", "x", "y", "w", "h", (F.col("w") * F.col("h")).alias("area")))


@query(
    f"""WITH {_BOXES}, d AS (SELECT doc_id, doc_type FROM source_docs) SELECT box_id, layer FROM (
SELECT box_id, 'faces' AS layer, confidence FROM boxes WHERE entity_type = 'FACE' UNION ALL SELECT box_id, 'codes', confidence FROM boxes WHERE entity_type = 'QR_CODE'
UNION ALL SELECT box_id, 'handwriting', confidence FROM boxes JOIN d USING (doc_id) WHERE entity_type = 'HANDWRITING' AND doc_type = 'SCAN_FORM') WHERE confidence >= 0.6"""
)
def visual_combine(spark: SparkSession, d: str) -> DataFrame:
    known = _boxes(spark, d).join(table(spark, d, "source_docs").select("doc_id", "doc_type"), "doc_id", "left")
    layers = {name: known.filter(F.col("entity_type") == kind).withColumn("layer", F.lit(name)) for name, kind in (("faces", "FACE"), ("codes", "QR_CODE"), ("handwriting", "HANDWRITING"))}
    return route.combined(layers, F.coalesce(F.col("doc_type") == "SCAN_FORM", F.lit(False))).select("box_id", "layer")


@query(f"WITH {_SPANS}, l AS (SELECT doc_id, string_agg(text, ' ' ORDER BY span_id) AS text FROM spans WHERE regexp_matches(text, '\\S') GROUP BY 1) SELECT doc_id, coalesce(text, '') AS text FROM source_docs LEFT JOIN l USING (doc_id)")
def ocr_text(spark: SparkSession, d: str) -> DataFrame:
    return models.joined_lines(_spans(spark, d).select("doc_id", F.col("span_id").alias("ord"), "text"), table(spark, d, "source_docs"))


# --- words, lines and pages -----------------------------------------------------------------------------


@query(f"WITH {_BOXES} SELECT doc_id, page, ord, text_found AS text, x, y, greatest(w, 1) AS w, greatest(h, 1) AS h, coalesce(confidence, 0.0) AS confidence FROM (SELECT *, box_id AS ord FROM (SELECT * EXCLUDE ord FROM boxes)) WHERE regexp_matches(text_found, '\\S')")
def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with polygons around them, as boxes."""
    x, y, r, b = F.col("x").cast("double"), F.col("y").cast("double"), (F.col("x") + F.col("w")).cast("double"), (F.col("y") + F.col("h")).cast("double")
    polygon = F.array(F.array(r, y), F.array(x, y), F.array(x, b), F.array(r, b))
    raw = _boxes(spark, d).select("doc_id", "page", "ord", F.col("text_found").alias("text"), polygon.alias("polygon"), "confidence")
    return words.ocr_lines(raw)


_LINE_HITS = " UNION ALL ".join(_extract_sql(p, "lines") for p in PATTERNS if p.name in ("policy_pol_prefix", "claim_clm_prefix"))


@query(f"WITH {_BOXES}, lines AS (SELECT box_id AS doc_id, text_found AS text FROM boxes) SELECT box_id, f.entity_type, span, x, y, w, h FROM ({_LINE_HITS}) f JOIN boxes ON box_id = f.doc_id")
def line_detections(spark: SparkSession, d: str) -> DataFrame:
    """Hits in recognized lines; a hit's box is that of its line."""
    lines = _boxes(spark, d).select("box_id", "text_found", "x", "y", "w", "h")
    registry = Registry(tuple(p for p in PATTERNS if p.name in ("policy_pol_prefix", "claim_clm_prefix")))
    return detect.detect(lines, "text_found", registry, ("box_id", "x", "y", "w", "h")).select("box_id", "entity_type", "span", "x", "y", "w", "h")


_PLACED = """p AS (SELECT span_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS ord FROM spans WHERE text IS NOT NULL),
w AS (SELECT span_id, ord * 50 AS x, length(word) * 5 AS w, CAST(sum(length(word) + 1) OVER (PARTITION BY span_id ORDER BY ord) - length(word) - 1 AS INT) AS ws, length(word) AS n FROM p)"""


@query(f"WITH {_SPANS}, {_PLACED}, {_RUNS} SELECT o.span_id AS doc_id, o.start, CAST(min(x) AS INT) AS x, CAST(max(x + w) - min(x) AS INT) AS w FROM o JOIN w ON w.span_id = o.span_id AND ws < start + o.n AND ws + w.n > start GROUP BY ALL")
def hits_on_words(spark: SparkSession, d: str) -> DataFrame:
    """Hits and words as two tables, joined by page and overlap."""
    spans = _spans(spark, d).filter("text is not null")
    w = spans.select(F.col("span_id").alias("doc_id"), F.lit(0).alias("page"), F.posexplode(F.split("text", " ")).alias("ord", "text"))
    w = w.select("doc_id", "page", "ord", "text", (F.col("ord") * 50).alias("x"), F.lit(0).alias("y"), (F.length("text") * 5).alias("w"), F.lit(10).alias("h"))
    placed = words.pages_of_words(w).select("doc_id", "page", F.inline("words"))
    hits = spans.select(F.col("span_id").alias("doc_id"), F.lit(0).alias("page"), F.inline(matches(F.col("text"), "[0-9]+")))
    hits = hits.withColumn("hit_id", F.struct("doc_id", "start"))
    return words.hits_on_words(hits, placed).select("hit_id.doc_id", "hit_id.start", "x", "w")


@query(
    f"""WITH {_SPANS}, {_BOXES} SELECT span_id FROM spans s WHERE NOT EXISTS (FROM boxes b WHERE b.doc_id = s.doc_id AND b.page = s.page AND s.x < b.x + b.w AND b.x < s.x + s.w AND s.y < b.y + b.h AND b.y < s.y + s.h)"""
)
def text_left(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the text layer that no detection touches."""
    return words.unredacted_words(_spans(spark, d), _boxes(spark, d)).select("span_id")


_PAGE_FILE = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM claims"


def _claim_files(spark: SparkSession, d: str) -> DataFrame:
    content = F.encode(F.concat(F.lit("%%Author: someone\n"), "text"), "UTF-8")
    return claims(spark, d).select("doc_id", F.concat(F.lit("claim-"), "doc_id", F.lit(".pdf")).alias("filename"), content.alias("content"))


@query(
    f"""{_WITH}, l AS ({_PAGE_FILE}), p AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) AS k FROM l),
w AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY k) - length(text) - 1 AS place, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS ord FROM p)
SELECT doc_id, 0 AS page, CAST(ord AS INT) AS ord, text, CAST(place * 6 AS INT) AS x, CAST(line_no * 12 AS INT) AS y, CAST(length(text) * 6 AS INT) AS w, 12 AS h FROM w"""
)
def page_words(spark: SparkSession, d: str) -> DataFrame:
    """Files decoded to words with places, first pages only (these files have one)."""
    return pages.words(_claim_files(spark, d), pages.PlainPages(), first_page_only=True)


_PIPED = tuple(p for p in PATTERNS if p.name in ("ssn_dashes", "policy_pol_prefix", "claim_clm_prefix"))


@query(
    f"""{_WITH}, s AS (SELECT doc_id, text, regexp_extract(text, 'SSN: (.+)', 1) AS ssn FROM claims), v AS (SELECT *, substr(ssn, 1, 3) NOT IN ('000', '666') AND ssn NOT LIKE '9%' AND substr(ssn, 5, 2) <> '00' AND substr(ssn, 8, 4) <> '0000' AS valid FROM s)
SELECT doc_id, 'PDF_STRUCTURED' AS doc_type, 1 AS pages, CAST(CASE WHEN valid THEN 3 ELSE 2 END AS BIGINT) AS total_redactions, 'written' AS status,
 regexp_replace(regexp_replace(CASE WHEN valid THEN replace(text, 'SSN: ' || ssn, 'SSN: ' || repeat('█', length(ssn))) ELSE text END, 'POL-[0-9]{{7}}', '███████████', 'g'), 'CLM-[0-9]{{8}}', '████████████', 'g') AS text FROM v"""
)
def pipeline_redact(spark: SparkSession, d: str) -> DataFrame:
    """Files classified, routed, searched, de-duplicated, redacted and audited, end to end."""
    done = pipeline.run(_claim_files(spark, d), pages.PlainPages(), Registry(_PIPED))
    return done.files.join(done.records, "doc_id").select("doc_id", "doc_type", "pages", "total_redactions", "status", F.decode("content", "UTF-8").alias("text"))


@query("SELECT CASE WHEN bool_or(pages = 0) THEN 1 ELSE 0 END AS code FROM source_docs")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.status(table(spark, d, "source_docs"))


@query(f"WITH {_BOXES} SELECT doc_id FROM source_docs WHERE NOT (doc_type = 'PDF_STRUCTURED' AND doc_id NOT IN (SELECT doc_id FROM boxes)) OR doc_type IS NULL")
def files_to_write(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "source_docs")
    return pages.to_write(docs.select("doc_id"), _boxes(spark, d), docs)


# --- filters and sets -----------------------------------------------------------------------------------

_NEAR = "lower(substr(text, greatest(start - 100, 0) + 1, start + length(span) + 100 - greatest(start - 100, 0)))"
_NAMES = "[A-Z][a-z]+ [A-Z][a-z]+"
_NAMED = f"""o AS (SELECT span_id, text, ms[i] AS span, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS INT) AS start
  FROM (SELECT span_id, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT span_id, text, regexp_extract_all(text, '{_NAMES}') AS ms, regexp_split_to_array(text, '{_NAMES}') AS gs FROM spans WHERE text IS NOT NULL)))"""


@query(
    f"""WITH {_SPANS}, {_NAMED} SELECT span_id, start, lower(span) NOT IN ({quoted(N.ROLES)}) AND (({' OR '.join(f'ends_with(lower(span), {quoted([e])})' for e in N.LEGAL_ENDINGS)}) OR ({' OR '.join(f'contains({_NEAR}, {quoted([t])})' for t in N.FINANCIAL)})) AS org FROM o"""
)
def org_context(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of capitalised words as organisations, by the hundred characters around them."""
    hits = _spans(spark, d).select("span_id", "text", F.inline(matches(F.col("text"), _NAMES)))
    near = window(F.col("text"), F.col("start"), F.col("end"), 100)
    return hits.select("span_id", "start", N.is_org(F.col("span"), near).alias("org"))


@query(f"WITH {_BOXES} SELECT box_id, source || '/' || coalesce({case('lower(source)', N.RECEIPT_LABELS, 'NULL')}, {case('lower(source)', N.TILL_LABELS, 'NULL')}, 'NONE') AS label, {case('k', N.RECEIPT_LABELS, 'NULL')} AS receipt, {case('k', N.TILL_LABELS, 'NULL')} AS till FROM (SELECT box_id, source, ({quoted([*N.RECEIPT_LABELS, *N.TILL_LABELS, 'other']).join(('[', ']'))})[CAST(box_id % 9 AS INT) + 1] AS k FROM boxes)")
def receipt_labels(spark: SparkSession, d: str) -> DataFrame:
    keys = [*N.RECEIPT_LABELS, *N.TILL_LABELS, "other"]
    key = F.get(F.array(*[F.lit(k) for k in keys]), (F.col("box_id") % 9).cast("int"))
    none = F.coalesce(N.lookup(N.RECEIPT_LABELS, F.lower("source")), N.lookup(N.TILL_LABELS, F.lower("source")), F.lit("NONE"))
    return _boxes(spark, d).select("box_id", F.concat("source", F.lit("/"), none).alias("label"), N.lookup(N.RECEIPT_LABELS, key).alias("receipt"), N.lookup(N.TILL_LABELS, key).alias("till"))


@query(
    f"""WITH {_BOXES} SELECT box_id, CASE WHEN box_id % 2 = 0 THEN substr(text_found, 2, 4) ELSE 'own' END AS span FROM boxes WHERE box_id % 3 <> 0"""
)
def confidential_mentions(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("box_id") % 3 == 0, "NOT_CONFIDENTIAL").when(F.col("box_id") % 3 == 1, "BELIEF")
    rows = _boxes(spark, d).select("box_id", F.col("text_found").alias("text"), F.lit(1).alias("start_offset"), F.lit(5).alias("end_offset"), state.alias("confidential_status"), F.when(F.col("box_id") % 2 == 1, "own").alias("span_text"))
    return evaluate.confidential(rows).select("box_id", "span")


@query(
    """SELECT o_orderkey AS doc_id, k AS key, v AS value FROM (SELECT o_orderkey, unnest(['total_price', 'cashprice', 'subtotal_price', 'sub_total']) AS k, unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, '']) AS v FROM orders) WHERE v <> ''"""
)
def receipt_totals(spark: SparkSession, d: str) -> DataFrame:
    total = F.struct(F.col("o_orderkey").cast("string").alias("total_price"), F.col("o_orderstatus").alias("cashprice"), F.lit("x").alias("menuqty"))
    sub = F.struct(F.col("o_orderpriority").alias("subtotal_price"), F.lit("").alias("sub_total"), F.lit("9").alias("tax"))
    truth = F.to_json(F.struct(F.struct(total.alias("total"), sub.alias("sub_total")).alias("gt_parse")))
    return evaluate.receipt_totals(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), truth.alias("ground_truth")))


@query("SELECT o_orderkey AS doc_id, 0 AS start, 4 AS \"end\", 'STATUS' AS label, substr(o_orderpriority, 1, 4) AS span FROM orders WHERE o_orderkey % 5 <> 0")
def gold_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = F.when(F.col("o_orderkey") % 5 == 0, "not json").otherwise('[{"start": 0, "end": 4, "label": "STATUS"}]')
    return evaluate.gold_spans(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("generated_text"), spans.alias("pii_spans")))


@query(f"WITH {_BOXES} SELECT DISTINCT doc_id, page FROM (SELECT doc_id, page FROM boxes UNION SELECT doc_id, page FROM layout_spans)")
def page_keys(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("doc_id", "page").union(_spans(spark, d).select("doc_id", "page")).distinct()


@query("SELECT lang, doc_id FROM (SELECT doc_id, coalesce(lang, '') AS lang FROM documents WHERE regexp_matches(text, '\\S') ORDER BY doc_id LIMIT 500)")
def first_documents(spark: SparkSession, d: str) -> DataFrame:
    """A report on the first 500 documents with a text: the limit is what is asked for."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return evaluate.first_documents(docs, 500).select("lang", "doc_id")


@query(
    f"""WITH {_BOXES} SELECT doc_id, template, bits FROM (SELECT box_id AS doc_id, 'blank' AS template, CAST(bit_count(CAST(box_id AS BIGINT) * 7919) AS INT) AS bits FROM boxes
UNION ALL SELECT box_id, 'form', CAST(bit_count(xor(CAST(box_id AS BIGINT) * 7919, 1099511627775::BIGINT)) AS INT) FROM boxes) WHERE bits <= 10 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY bits, template) = 1"""
)
def template_match(spark: SparkSession, d: str) -> DataFrame:
    """Picture hashes against those of two templates."""
    hashes = _boxes(spark, d).select(F.col("box_id").alias("doc_id"), (F.col("box_id").cast("long") * 7919).alias("hash"))
    return templates.nearest(hashes, {"blank": 0, "form": 1099511627775})


# --- vault ----------------------------------------------------------------------------------------------

_NUMBERED = "'[' || entity_type || '_' || {n} || ']'"


@query(
    f"""WITH seen AS (SELECT DISTINCT entry_id, doc_id, plaintext, regexp_extract(token, '^\\[(.+)_\\d+\\]$', 1) AS entity_type FROM vault_tokens WHERE plaintext IS NOT NULL),
k AS (SELECT doc_id, plaintext, arg_min(entity_type, entry_id) AS entity_type, min(entry_id) AS o FROM seen WHERE entry_id % 2 = 0 GROUP BY 1, 2),
last AS (SELECT doc_id, entity_type, count(*) AS n FROM k GROUP BY 1, 2),
f AS (SELECT doc_id, plaintext, arg_min(entity_type, entry_id) AS entity_type, min(entry_id) AS o FROM seen s WHERE entry_id % 2 = 1 AND NOT EXISTS (FROM k WHERE k.doc_id = s.doc_id AND k.plaintext = s.plaintext) GROUP BY 1, 2)
SELECT f.doc_id, plaintext, '[' || f.entity_type || '_' || (row_number() OVER (PARTITION BY f.doc_id, f.entity_type ORDER BY o, plaintext) + coalesce(n, 0)) || ']' AS token FROM f LEFT JOIN last ON last.doc_id = f.doc_id AND last.entity_type = f.entity_type"""
)
def vault_continued(spark: SparkSession, d: str) -> DataFrame:
    """Every second entry makes a first vault; the others continue it."""
    rows = one_of_each(table(spark, d, "vault_tokens"), "entry_id")
    seen = rows.select("doc_id", F.col("entry_id").alias("ord"), "plaintext", F.regexp_extract("token", r"^\[(.+)_\d+\]$", 1).alias("entity_type"))
    known = vault.tokens(seen.filter("ord % 2 = 0"), "doc_id")
    return vault.continued(seen.filter("ord % 2 = 1"), known, "doc_id").select("doc_id", "plaintext", "token")


@query(f"WITH {_BOXES} SELECT box_id, doc_id, text_found AS plaintext, CAST(NULL AS VARCHAR) AS wrong FROM boxes")
def vault_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions encrypted for their document: another document's id opens none."""
    key = bytes(range(32))
    hidden = vault.encrypted(_boxes(spark, d).select("box_id", "doc_id", F.col("text_found").alias("plaintext")), key)
    opened = vault.decrypted(hidden, key)
    other = vault.decrypted(hidden.withColumn("doc_id", F.concat("doc_id", F.lit("x"))), key).select("box_id", F.col("plaintext").alias("wrong"))
    return opened.join(other, "box_id").select("box_id", "doc_id", "plaintext", "wrong")


# --- evaluation -----------------------------------------------------------------------------------------

_KEYED = "SELECT DISTINCT doc_id, page * 100 + box_id % 7 AS start, page * 100 + box_id % 7 + 5 AS \"end\", entity_type FROM boxes WHERE source {0} ('presidio', 'vlm')"
_TRIPLES = f"""p AS ({_KEYED.format('IN')}), g AS ({_KEYED.format('NOT IN')}),
t AS (SELECT entity_type, count(*) FILTER (WHERE p AND g) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM (SELECT *, true AS p FROM p) FULL JOIN (SELECT *, true AS g FROM g) USING (doc_id, start, "end", entity_type) GROUP BY 1 HAVING count(*) FILTER (WHERE g) > 0)"""
_PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 3) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 3) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 3) AS f1"


def _triples(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("page") * 100 + F.col("box_id") % 7).alias("start")
    rows = _boxes(spark, d).select("doc_id", start, (F.col("page") * 100 + F.col("box_id") % 7 + 5).alias("end"), "entity_type", "source")
    mine = F.col("source").isin("presidio", "vlm")
    return evaluate.triples(rows.filter(mine), rows.filter(~mine))


@query(f"WITH {_BOXES}, {_TRIPLES} SELECT entity_type, tp, fp, fn, {_PRF} FROM t")
def eval_triples(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d)


@query(f"WITH {_BOXES}, {_TRIPLES}, m AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM t) SELECT tp, fp, fn, {_PRF} FROM m")
def eval_micro(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.micro(_triples(spark, d))


@query(f"WITH {_BOXES}, {_TRIPLES}, r AS (SELECT entity_type, {_PRF} FROM t) SELECT entity_type, f1, row_number() OVER (ORDER BY f1 DESC, entity_type) AS place FROM r")
def eval_ranked(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ranked(_triples(spark, d)).select("entity_type", "f1", F.col("place").cast("long").alias("place"))


@query("SELECT count(*) AS docs, count(*) FILTER (WHERE p_size % 10 = 0) AS errors, round(coalesce(sum(CASE WHEN p_size % 10 <> 0 THEN levenshtein(p_name, p_type) / length(p_name) END), 0) / greatest(count(*) FILTER (WHERE p_size % 10 <> 0), 1), 6) AS mean_rate, avg(p_size) AS mean_lines FROM part WHERE length(p_name) > 0")
def eval_ocr(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").filter(F.length("p_name") > 0)
    rows = parts.select(F.col("p_partkey").alias("doc_id"), evaluate.error_rate(F.col("p_name"), F.col("p_type")).alias("rate"), F.col("p_size").alias("lines"), (F.col("p_size") % 10 == 0).alias("error"))
    return evaluate.ocr_summary(rows).withColumn("mean_rate", F.round("mean_rate", 6))


@query(
    f"""WITH {_BOXES}, c AS (SELECT text_found AS span, entity_type, box_id, doc_id, page FROM boxes WHERE coalesce(text_found, '') <> '')
SELECT doc_id, page, count(*) AS n, count(DISTINCT entity_type) AS kinds, max({case('entity_type', {k: str(v) for k, v in SPECIFICITY.items()}, quoted(['0']))}::INT) AS top FROM c GROUP BY 1, 2"""
)
def page_groups(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).filter(F.coalesce("text_found", F.lit("")) != "")
    return b.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.countDistinct("entity_type").alias("kinds"), F.max(dedup.specificity(F.col("entity_type"))).alias("top"))
