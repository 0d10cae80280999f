"""Registered queries of the core operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import boxes as B
from cloakwork.functions import filters as N
from cloakwork.functions.checks import aba, luhn
from cloakwork.functions.patterns import BASELINE, CONTEXT, GENERAL, PATTERNS, Pattern, Registry
from cloakwork.functions.text import matches
from cloakwork.operators import audit, dedup, detect, evaluate, layout, models, route, tabular, templates, vault, words
from cloakwork.plans.claims import claims
from cloakwork.plans.claims import sql as claims_sql
from cloakwork.session import one_of_each

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_KEY = bytes(range(32))
_WITH = f"WITH claims AS ({claims_sql()})"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case(column: str, pairs: dict[str, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted([k])} THEN {quoted([v])}" for k, v in pairs.items()) + f" ELSE {otherwise} END"


# --- scans and patterns -------------------------------------------------------------------------------

# RE2 has no look-around: patterns with it are extracted wider and filtered.
_WIDE = {
    "ssn_dashes": (r"\b\d{3}-\d{2}-\d{4}\b", "substr(s,1,3) NOT IN ('000','666') AND s NOT LIKE '9%' AND substr(s,5,2) <> '00' AND substr(s,8,4) <> '0000'"),
    "ssn_nodashes": (r"\b\d{9}\b", "substr(s,1,3) NOT IN ('000','666') AND s NOT LIKE '9%' AND substr(s,4,2) <> '00' AND substr(s,6,4) <> '0000'"),
    "ein_standard": (r"\b\d{2}-\d{7}\b", "s NOT LIKE '00%'"),
    "phone_us_10digit": (r"(?:^|[^+:\w])((?:\+1[\s.\-]?)?(?:\([2-9]\d{2}\)|[2-9]\d{2})[\s.\-]?[2-9]\d{2}[\s.\-]?\d{4})(?:$|\D)", "true"),
    "phone_international": (r"(?:^|[^a-zA-Z0-9])(\+[1-9]\d{0,2}[\s.\-]?\(?\d{1,4}\)?[\s.\-]?\d{2,4}[\s.\-]?\d{2,4}(?:[\s.\-]?\d{2,4})?)(?:$|[^\d:])", "true"),
}
_WIDE |= {"base_ssn": _WIDE["ssn_dashes"], "base_ssn_plain": _WIDE["ssn_nodashes"], "base_ein": _WIDE["ein_standard"]}
_LUHN_SQL = (
    "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 "
    "THEN CAST(substr('0246813579', 1 + CAST(substr(d, i, 1) AS INT), 1) AS INT) ELSE CAST(substr(d, i, 1) AS INT) END)) % 10 = 0"
)
_IBAN_SQL = (
    "length(d) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr(upper(d), 5) || substr(upper(d), 1, 4), ''), "
    "lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), ''), ''), lambda c: CAST(c AS INT)), lambda a, c: (a * 10 + c) % 97) = 1"
)
_ABA_SQL = "(" + " + ".join(f"{(3, 7, 1)[k % 3]} * CAST(substr(s, {k + 1}, 1) AS INT)" for k in range(9)) + ") % 10 = 0"


def _extract_sql(p: Pattern, source: str = "claims") -> str:
    regex, keep = _WIDE.get(p.name, (p.regex, "true"))
    group = 1 if p.name.startswith("phone_") else 0
    if p.check == "luhn":
        keep = f"{keep} AND {_LUHN_SQL}"
    if p.check == "iban":
        keep = f"{keep} AND {_IBAN_SQL}"
    if p.check == "aba":
        keep = f"{keep} AND {_ABA_SQL}"
    score = 1.0 if p.check == "aba" else p.score
    return (
        f"SELECT doc_id, '{p.entity}' AS entity_type, '{p.name}' AS pattern, s AS span, CAST({score} AS DOUBLE) AS score FROM (SELECT doc_id, s, replace(replace(s, ' ', ''), '-', '') AS d "
        f"FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{regex.replace(chr(39), chr(39) * 2)}', {group})) AS s FROM {source})) WHERE {keep}"
    )


def _detect_query(entity: str) -> None:
    own = [p for p in PATTERNS if p.entity == entity]

    @query(_WITH + " " + " UNION ALL ".join(_extract_sql(p) for p in own), f"detect_{entity.lower()}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return detect.detect(claims(spark, d), registry=Registry(tuple(own)), places=False).select("doc_id", "entity_type", "pattern", "span", "score")


for _entity in dict.fromkeys(p.entity for p in PATTERNS):
    _detect_query(_entity)


@query(_WITH + " SELECT entity_type, pattern, count(*) AS n FROM (" + " UNION ALL ".join(_extract_sql(p) for p in BASELINE) + ") GROUP BY ALL")
def baseline_counts(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect(claims(spark, d), registry=Registry(BASELINE), places=False).groupBy("entity_type", "pattern").agg(F.count("*").alias("n"))


@query(_WITH + " SELECT entity_type, count(*) AS n FROM (" + " UNION ALL ".join(_extract_sql(p) for p in PATTERNS) + ") WHERE score >= 0.6 GROUP BY ALL")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    found = detect.detect(claims(spark, d), registry=Registry(PATTERNS), places=False)
    return detect.gated(found).groupBy("entity_type").agg(F.count("*").alias("n"))


_DOCS = "docs AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)"
_ALL = Registry().patterns


@query(f"WITH {_DOCS} SELECT entity_type, count(*) AS n FROM (" + " UNION ALL ".join(_extract_sql(p, "docs") for p in _ALL) + ") GROUP BY ALL")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the default registry in all documents, by type. Repeats of a document are told apart by
    its findings, so texts don't move."""
    found = detect.detect(table(spark, d, "documents").select("doc_id", "text")).dropDuplicates(["doc_id", "pattern", "start"])
    return found.filter("doc_id is not null").groupBy("entity_type").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS docs, count(text) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM documents GROUP BY lang")
def scan_documents_profile(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("text").cast("long")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.count("text").alias("texts"), F.sum(size).alias("chars"), F.max(size).alias("longest"))


_SPANS = "spans AS (SELECT DISTINCT * FROM layout_spans)"
_CODE = r"[A-Z]{2,3}-[A-Z0-9]{6,12}"
_OFFSETS = f"""o AS (
  SELECT span_id, text, i, ms[i] AS span,
         CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS INT) AS start
  FROM (SELECT span_id, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT span_id, text, regexp_extract_all(text, '{_CODE}') AS ms, regexp_split_to_array(text, '{_CODE}') AS gs FROM spans WHERE text IS NOT NULL)))"""


@query(f"WITH {_SPANS}, {_OFFSETS} SELECT span_id, start, CAST(start + length(span) AS INT) AS \"end\", span FROM o")
def span_offsets(spark: SparkSession, d: str) -> DataFrame:
    spans = one_of_each(table(spark, d, "layout_spans"), "span_id")
    return spans.select("span_id", F.inline(matches(F.col("text"), _CODE)))


#: Patterns that RE2 runs as they are, so that SQL can tell the places of their matches.
_PLACED = tuple(p for p in PATTERNS if p.name not in _WIDE)


def _placed_sql(p: Pattern) -> str:
    regex = p.regex.replace("'", "''")
    start = "CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS INT)"
    keep = {"luhn": _LUHN_SQL, "aba": _ABA_SQL}.get(p.check, "true")
    return (
        f"SELECT doc_id, text, '{p.entity}' AS entity_type, '{p.name}' AS pattern, s, start, CAST({detect.score_of(p)} AS DOUBLE) AS score FROM (SELECT doc_id, text, ms[i] AS s, replace(replace(ms[i], ' ', ''), '-', '') AS d, {start} AS start "
        f"FROM (SELECT doc_id, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{regex}') AS ms, regexp_split_to_array(text, '{regex}') AS gs FROM claims))) WHERE {keep}"
    )


_CLOSE = "lower(array_to_string(list_filter(regexp_split_to_array(CASE WHEN start > 256 THEN regexp_replace(substr(text, start - 255, 256), '^\\S*\\s', '') ELSE substr(text, 1, start) END, '\\s+'), lambda w: w <> '')[-5:], ' '))"
_SURER = "CASE entity_type " + " ".join(f"WHEN '{e}' THEN {' OR '.join(f'contains(b, {quoted([w])})' for w in CONTEXT[e])}" for e in dict.fromkeys(p.entity for p in _PLACED)) + " ELSE false END"


@query(
    f"{_WITH}, h AS ({' UNION ALL '.join(_placed_sql(p) for p in _PLACED)}), n AS (SELECT *, {_CLOSE} AS b FROM h) "
    f"SELECT doc_id, entity_type, pattern, start, round(CASE WHEN {_SURER} THEN least(1.0, score + 0.35) ELSE score END, 2) AS score FROM n"
)
def context_rescore(spark: SparkSession, d: str) -> DataFrame:
    found = detect.detect(claims(spark, d), registry=Registry(_PLACED), keep=("doc_id", "text"))
    return detect.rescored(found, F.col("text")).select("doc_id", "entity_type", "pattern", "start", F.round("score", 2).alias("score"))


@query(_WITH + rf" SELECT doc_id, s AS span, ({_LUHN_SQL}) AS valid FROM (SELECT doc_id, s, s AS d FROM (SELECT doc_id, regexp_extract(text, 'Card: (\d+)', 1) AS s FROM claims))")
def validate_luhn(spark: SparkSession, d: str) -> DataFrame:
    span = F.regexp_extract("text", r"Card: (\d+)", 1)
    return claims(spark, d).select("doc_id", span.alias("span"), luhn(span).alias("valid"))


@query(_WITH + rf" SELECT doc_id, s AS span, ({_ABA_SQL}) AS valid FROM (SELECT doc_id, regexp_extract(text, 'Routing: (\d+)', 1) AS s FROM claims)")
def validate_aba(spark: SparkSession, d: str) -> DataFrame:
    span = F.regexp_extract("text", r"Routing: (\d+)", 1)
    return claims(spark, d).select("doc_id", span.alias("span"), aba(span).alias("valid"))


_MASKED = tuple(p for p in PATTERNS if p.name in ("policy_pol_prefix", "claim_clm_prefix")) + (GENERAL[0],)


@query(
    _WITH + " SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, "
    f"'{_MASKED[0].regex}', '[POLICY_NUM]', 'g'), '{_MASKED[1].regex}', '[CLAIM_REF]', 'g'), '{_MASKED[2].regex}', '[EMAIL_ADDRESS]', 'g') AS text FROM claims"
)
def mask_text(spark: SparkSession, d: str) -> DataFrame:
    return detect.masked(claims(spark, d), registry=Registry(_MASKED))


@query()
def mask_documents(spark: SparkSession, d: str) -> DataFrame:
    return detect.masked(one_of_each(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))


@query(_WITH + ", f AS (" + " UNION ALL ".join(_extract_sql(p) for p in PATTERNS if p.entity == "CREDIT_CARD") + ") SELECT DISTINCT doc_id, entity_type, span FROM f")
def containment_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = detect.detect(claims(spark, d), registry=Registry().only("CREDIT_CARD"))
    return detect.outermost(found, "doc_id").select("doc_id", "entity_type", "span")


# --- filters and fields -------------------------------------------------------------------------------

_BOXES = "boxes AS (SELECT DISTINCT * FROM redaction_boxes)"
_S = "regexp_replace(coalesce(text_found, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
_W = "list_filter(regexp_split_to_array(s, '[\\s\\p{Z}]+'), lambda w: w <> '')"
_LOWER = "regexp_matches(s, '^\\p{Ll}')"
_IS_ORG = (
    f"NOT (s = '' OR lower(s) IN ({quoted(N.ROLES)}) OR regexp_matches(s, '^[A-Z]{{2,6}}$') OR regexp_matches(s, '[=<>{{}}/\\\\@]') OR regexp_matches(s, '(?i)https?://|xsi:|xmlns:|schemaLocation') OR {_LOWER}"
    f" OR (len(w) > 6 AND len(list_filter(w, lambda x: regexp_replace(lower(x), ',+$', '') IN ({quoted(N.LEGAL_WORDS)}))) = 0)"
    f" OR (len(w) <= 2 AND s <> '' AND NOT ({' OR '.join(f'ends_with(lower(s), {quoted([e])})' for e in N.LEGAL_ENDINGS)}) AND NOT ({' OR '.join(f'contains(lower(s), {quoted([t])})' for t in N.FINANCIAL)})))"
)
_IS_PERSON = f"(s <> '' AND NOT (len(w) = 1 AND lower(s) IN ({quoted(N.NOT_PERSONS)})) AND NOT {_LOWER})"
_LIKE_NAME = f"(length(s) BETWEEN 2 AND 60 AND regexp_matches(s, '^\\p{{Lu}}') AND regexp_matches(s, '^[A-Za-z\\s\\-.'']+$') AND lower(s) NOT IN ({quoted(N.NOT_PERSONS)}))"


@query(f"WITH {_BOXES} SELECT box_id, {_IS_ORG} AS org, {_IS_PERSON} AS person, {_LIKE_NAME} AS name FROM (SELECT box_id, s, {_W} AS w FROM (SELECT box_id, {_S} AS s FROM boxes))")
def filter_names(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text_found")
    return one_of_each(table(spark, d, "redaction_boxes"), "box_id").select("box_id", N.is_org(text, text).alias("org"), N.is_person(text).alias("person"), N.looks_like_name(text).alias("name"))


@query(f"WITH {_BOXES} SELECT box_id, {case('upper(entity_type)', N.LABELS, 'upper(entity_type)')} AS entity_type FROM boxes")
def normalise_labels(spark: SparkSession, d: str) -> DataFrame:
    return one_of_each(table(spark, d, "redaction_boxes"), "box_id").select("box_id", N.normal_label(F.col("entity_type")).alias("entity_type"))


_L = "regexp_replace(lower(coalesce(field_label, '')), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
_HIGH, _LOW = f"{_L} IN ({quoted(N.HIGH_VALUE)})", f"{_L} IN ({quoted(N.LOW_VALUE)})"


@query(f"WITH {_SPANS} SELECT span_id, CASE WHEN {_HIGH} AND {_LOW} THEN 'both' WHEN {_HIGH} THEN 'high' WHEN {_LOW} THEN 'low' ELSE 'none' END AS class FROM spans")
def field_value_class(spark: SparkSession, d: str) -> DataFrame:
    return one_of_each(table(spark, d, "layout_spans"), "span_id").select("span_id", layout.field_class(F.col("field_label")).alias("class"))


@query(
    f"""WITH {_SPANS}, s0 AS (SELECT span_id, field_label, regexp_replace(coalesce(text, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS s, text FROM spans),
s1 AS (SELECT *, {_W} AS w FROM s0), hit AS (SELECT * FROM s1 WHERE contains(text, ','))
SELECT span_id, text AS span, 'PERSON' AS entity_type, CASE WHEN {_HIGH} THEN 0.75 ELSE 0.6 END AS score, 'field' AS source FROM hit WHERE {_IS_PERSON} AND NOT {_LOW}
UNION ALL
SELECT span_id, text, 'PERSON', 0.75, 'heuristic_name_field' FROM s1 WHERE {_HIGH} AND NOT {_LOW} AND {_LIKE_NAME} AND span_id NOT IN (SELECT span_id FROM hit)"""
)
def name_heuristic(spark: SparkSession, d: str) -> DataFrame:
    spans = one_of_each(table(spark, d, "layout_spans"), "span_id")
    found = spans.filter(F.contains("text", F.lit(","))).select("span_id", F.col("text").alias("span"), F.lit("PERSON").alias("entity_type"), F.lit(0.6).alias("score"))
    return layout.field_detections(spans, found)


@query(
    _WITH + """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS part FROM claims)
SELECT doc_id, CAST(part AS INT) AS part, regexp_extract(line, '^([A-Z][A-Za-z ''’]+?):\\s*(.+)$', 1) AS field_label, regexp_extract(line, '^([A-Z][A-Za-z ''’]+?):\\s*(.+)$', 2) AS text FROM l"""
)
def label_value_split(spark: SparkSession, d: str) -> DataFrame:
    spans = claims(spark, d).select("doc_id", "text", F.lit("").alias("field_label"), F.lit("paragraph").alias("block_type"))
    return layout.split_pairs(spans).select("doc_id", "part", "field_label", "text")


_NAMED = "k.x < r.x AND abs(k.y - r.y) <= 6 AND k.name <> ''"


@query(
    f"""WITH {_SPANS}, s0 AS (SELECT *, {_S.replace('text_found', 'text')} AS s FROM spans), s1 AS (SELECT * EXCLUDE (w), {_W} AS w FROM s0),
s2 AS (SELECT *, ends_with(s, ':') OR (length(s) <= 40 AND len(w) <= 5 AND regexp_matches(s, '^\\p{{Lu}}')) AS can, regexp_replace(regexp_replace(s, ':+$', ''), '[\\s\\p{{Z}}]+$', '') AS name FROM s1),
l AS (SELECT list({{'y': y, 'x': x, 'ord': ord, 'can': can, 'name': name, 'span_id': span_id, 'block_type': block_type}} ORDER BY y, x, ord) AS l FROM s2 GROUP BY doc_id, page),
m AS (SELECT unnest(l) AS r, list_reduce(list_transform(l, lambda r: [r]), lambda acc, e: CASE WHEN e[1].can AND len(list_filter(acc, lambda k: {_NAMED.replace('r.', 'e[1].')})) = 0 THEN list_concat(acc, e) ELSE acc END, l[1:0]) AS labels FROM l)
SELECT r.span_id AS span_id, coalesce(list_filter(labels, lambda k: {_NAMED})[1].name, '') AS field_label, CASE WHEN list_contains(list_transform(labels, lambda k: k.span_id), r.span_id) THEN 'form_field_label' ELSE r.block_type END AS block_type FROM m"""
)
def label_value_rows(spark: SparkSession, d: str) -> DataFrame:
    spans = one_of_each(table(spark, d, "layout_spans"), "span_id").withColumn("field_label", F.lit(""))
    return layout.associated(spans).select("span_id", "field_label", "block_type")


@query(f"WITH {_SPANS} SELECT block_type, count(*) AS n FROM (SELECT {case('block_type', layout.BLOCKS, quoted(['paragraph']))} AS block_type FROM spans) GROUP BY 1")
def block_types(spark: SparkSession, d: str) -> DataFrame:
    spans = one_of_each(table(spark, d, "layout_spans"), "span_id")
    return spans.groupBy(layout.block_type(F.col("block_type")).alias("block_type")).agg(F.count("*").alias("n"))


_PAIR = "[A-Z][a-z]+ [A-Z][a-z]+"
_WORDS = f"""WITH {_SPANS}, p AS (SELECT span_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS ord, text FROM spans WHERE text IS NOT NULL),
w AS (SELECT span_id, ord * 50 AS x, length(word) * 5 AS w, sum(length(word) + 1) OVER (PARTITION BY span_id ORDER BY ord) - length(word) - 1 AS ws, length(word) AS n FROM p),
{_OFFSETS.replace(_CODE, _PAIR)}
SELECT o.span_id, o.start, CAST(min(x) AS INT) AS x, CAST(max(x + w) - min(x) AS INT) AS w FROM o JOIN w ON w.span_id = o.span_id AND ws < start + length(span) AND ws + n > start GROUP BY ALL"""


@query(_WORDS)
def word_interval_join(spark: SparkSession, d: str) -> DataFrame:
    spans = one_of_each(table(spark, d, "layout_spans"), "span_id").filter("text is not null")
    w = spans.select(F.col("span_id").alias("doc_id"), F.lit(0).alias("page"), F.posexplode(F.split("text", " ")).alias("ord", "text"))
    w = w.select("doc_id", "page", "ord", "text", (F.col("ord") * 50).alias("x"), F.lit(0).alias("y"), (F.length("text") * 5).alias("w"), F.lit(10).alias("h"))
    pages = words.pages_of_words(w)
    hits = pages.select("doc_id", "page", "words", F.inline(matches(F.col("text"), _PAIR)))
    return words.boxes_of_hits(hits).select(F.col("doc_id").alias("span_id"), "start", "x", "w")


# --- boxes ---------------------------------------------------------------------------------------------


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return one_of_each(table(spark, d, "redaction_boxes"), "box_id").withColumn("ord", F.col("box_id"))


@query(
    f"WITH {_BOXES} SELECT doc_id, page, text_found, box_id FROM boxes WHERE coalesce(text_found, '') <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, page, text_found "
    f"ORDER BY {case('entity_type', {k: str(v) for k, v in B.SPECIFICITY.items()}, quoted(['0']))}::INT DESC, confidence DESC NULLS LAST, box_id) = 1"
)
def dedup_text_spans(spark: SparkSession, d: str) -> DataFrame:
    return dedup.best_per_text(_boxes(spark, d)).select("doc_id", "page", "text_found", "box_id")


def _iou_sql(a: str, b: str) -> str:
    both = f"(greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0))"
    return f"CASE WHEN {both} > 0 THEN CAST({both} AS DOUBLE) / ({a}.w * {a}.h + {b}.w * {b}.h - {both}) ELSE 0.0 END"


_BOX_COLUMNS = "ord, x, y, w, h, entity_type, confidence, source, text_found"
_PLAIN = f"{_BOXES}, plain AS (SELECT * EXCLUDE (ord), box_id AS ord FROM boxes)"
_APART = f"""a AS (SELECT doc_id, page, list({{{', '.join(f"'{c}': {c}" for c in _BOX_COLUMNS.split(', '))}}} ORDER BY -coalesce(confidence, 0), ord) AS b FROM plain WHERE coalesce(text_found, '') = '' GROUP BY ALL),
k AS (SELECT doc_id, page, unnest(list_reduce(list_transform(b, lambda r: [r]), lambda acc, r: CASE WHEN len(list_filter(acc, lambda o: {_iou_sql('o', 'r[1]')} > 0.5)) > 0 THEN acc ELSE list_concat(acc, r) END)) AS k FROM a),
apart AS (SELECT doc_id, page, {', '.join(f'k.{c} AS {c}' for c in _BOX_COLUMNS.split(', '))} FROM k)"""


@query(f"WITH {_PLAIN}, {_APART} SELECT doc_id, page, {_BOX_COLUMNS} FROM apart")
def dedup_iou_nms(spark: SparkSession, d: str) -> DataFrame:
    return dedup.apart(_boxes(spark, d))


@query(
    f"WITH {_PLAIN}, {_APART} SELECT doc_id, page, {_BOX_COLUMNS} FROM apart UNION ALL SELECT doc_id, page, {_BOX_COLUMNS} FROM (SELECT * FROM plain WHERE coalesce(text_found, '') <> '' QUALIFY row_number() OVER "
    f"(PARTITION BY doc_id, page, text_found ORDER BY {case('entity_type', {k: str(v) for k, v in B.SPECIFICITY.items()}, quoted(['0']))}::INT DESC, confidence DESC NULLS LAST, box_id) = 1)"
)
def dedup_boxes(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicated(_boxes(spark, d))


_TOUCH = "list_filter(l, lambda k: k.x <= a.r AND a.x <= k.r AND k.y <= a.b AND a.y <= k.b)"
_EDGE = {"x": "min", "y": "min", "r": "max", "b": "max"}


@query(
    f"""WITH RECURSIVE {_PLAIN}, g AS (SELECT *, greatest(x - 4, 0) AS gx, greatest(y - 4, 0) AS gy, w + 8 AS gw, h + 8 AS gh FROM plain),
c AS (SELECT doc_id, page, list_sort(list_distinct(list({{'x': gx, 'y': gy, 'r': gx + gw, 'b': gy + gh}}))) AS l, 0 AS n FROM g GROUP BY doc_id, page
 UNION ALL SELECT doc_id, page, m, n + 1 FROM (SELECT doc_id, page, l, n, list_sort(list_distinct(list_transform(l, lambda a: {{{', '.join(f"'{c}': list_{f}(list_transform({_TOUCH}, lambda k: k.{c}))" for c, f in _EDGE.items())}}}))) AS m FROM c) WHERE m <> l),
j AS (SELECT z.doc_id, z.page, z, g.* EXCLUDE (doc_id, page) FROM (SELECT DISTINCT * FROM (SELECT doc_id, page, unnest(l) AS z FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC) = 1))) z
 JOIN g ON g.doc_id = z.doc_id AND g.page = z.page AND gx >= z.x AND gy >= z.y AND gx + gw <= z.r AND gy + gh <= z.b)
SELECT doc_id, page, min(ord) AS ord, z.x AS x, z.y AS y, z.r - z.x AS w, z.b - z.y AS h, first(entity_type ORDER BY coalesce(confidence, 0) DESC, ord) AS entity_type, first(confidence ORDER BY coalesce(confidence, 0) DESC, ord) AS confidence,
 first(source ORDER BY coalesce(confidence, 0) DESC, ord) AS source, CASE WHEN count(*) > 1 THEN '' ELSE first(coalesce(text_found, '')) END AS text_found FROM j GROUP BY doc_id, page, z"""
)
def merge_boxes(spark: SparkSession, d: str) -> DataFrame:
    return dedup.merged(_boxes(spark, d))


@query(
    f"""WITH {_BOXES} SELECT first, second, round(CASE WHEN i > 0 THEN i / (area - i) ELSE 0.0 END, 6) AS iou FROM (
SELECT a.box_id AS first, b.box_id AS second, a.w * a.h + b.w * b.h AS area,
       CAST(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS DOUBLE) AS i
FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND a.box_id < b.box_id WHERE coalesce(a.text_found, '') = '' AND coalesce(b.text_found, '') = '') WHERE i > 0 AND i / (area - i) > 0.5"""
)
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).filter(F.coalesce("text_found", F.lit("")) == "").select("doc_id", "page", F.struct("box_id", "x", "y", "w", "h").alias("b"))
    pairs = b.withColumnRenamed("b", "a").join(b, ["doc_id", "page"]).filter("a.box_id < b.box_id")
    pairs = pairs.filter(B.iou(F.col("a"), F.col("b")) > 0.5)
    return pairs.select(F.col("a.box_id").alias("first"), F.col("b.box_id").alias("second"), F.round(B.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query(
    f"WITH {_BOXES} SELECT box_id, greatest(x - 4, 0) AS x, greatest(y - 4, 0) AS y, CAST(greatest(least(x + w + 4, 800) - greatest(x - 4, 0), 0) AS INT) AS w, "
    f"CAST(greatest(least(y + h + 4, 1000) - greatest(y - 4, 0), 0) AS INT) AS h FROM boxes"
)
def pad_clamp(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("box_id", *B.padded(4, F.lit(800), F.lit(1000)))


@query(
    "SELECT template, upper(field) AS entity_type, "
    + ", ".join(f"CAST(round_even(m{c} * 300 / 25.4, 0) AS INT) AS {c}" for c in "xywh")
    + " FROM (VALUES "
    + ", ".join(f"('{t}', '{f}', {x}, {y}, {w}, {h})" for t, f, x, y, w, h in templates.rows())
    + ") AS v(template, field, mx, my, mw, mh)"
)
def template_boxes(spark: SparkSession, d: str) -> DataFrame:
    return templates.boxes(spark).select("template", "entity_type", "x", "y", "w", "h")


# --- routing and model output --------------------------------------------------------------------------

_E = "lower(regexp_extract(coalesce(filename, ''), '\\.([^.\\s]+)\\s*$', 1))"
_SHAPES = "CASE WHEN pages % 3 = 0 THEN 1600 ELSE 1000 END AS width, CASE WHEN pages % 2 = 0 THEN 1400 ELSE 1000 END AS height"


@query(
    f"""WITH {_SPANS}, {_BOXES}, c AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, page, sum(length(text)) AS n FROM spans GROUP BY ALL) GROUP BY 1),
f AS (SELECT doc_id, count(*) AS faces FROM boxes WHERE entity_type = 'FACE' GROUP BY 1), s AS (SELECT *, {_SHAPES} FROM source_docs)
SELECT s.doc_id, CASE WHEN {_E} = 'pdf' THEN CASE WHEN n > 100 THEN 'PDF_STRUCTURED' ELSE 'SCAN_FORM' END
 WHEN {_E} IN ({quoted(route.PICTURES)}) THEN CASE WHEN coalesce(faces, 0) > 0 AND height > width * 1.2 THEN 'ID_DOC' WHEN coalesce(faces, 0) > 0 THEN 'PHOTO' WHEN width > height * 1.5 THEN 'PHOTO' ELSE 'SCAN_FORM' END
 ELSE 'UNKNOWN' END AS doc_type FROM s LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)"""
)
def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "source_docs").select("doc_id", "filename", F.when(F.col("pages") % 3 == 0, 1600).otherwise(1000).alias("width"), F.when(F.col("pages") % 2 == 0, 1400).otherwise(1000).alias("height"))
    chars = one_of_each(table(spark, d, "layout_spans"), "span_id").groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n")).groupBy("doc_id").agg(F.collect_list("n").alias("chars"))
    faces = _boxes(spark, d).filter("entity_type = 'FACE'").groupBy("doc_id").agg(F.count("*").alias("faces"))
    joined = docs.join(chars, "doc_id", "left").join(faces, "doc_id", "left")
    kind = route.document_type(F.col("filename"), F.col("chars"), F.coalesce("faces", F.lit(0)), F.col("width"), F.col("height"))
    return joined.select("doc_id", kind.alias("doc_type"))


_ROUTES = " UNION ALL ".join(f"SELECT '{t}' AS doc_type, '{m}' AS media, unnest([{quoted(names)}]) AS layer" for (t, m), names in route.LAYERS.items())


@query(
    f"""WITH r AS ({_ROUTES}), s AS (SELECT doc_id, CASE WHEN upper(trim(doc_type)) IN ({quoted(sorted({t for t, _ in route.LAYERS}))}) THEN upper(trim(doc_type)) ELSE 'UNKNOWN' END AS doc_type,
CASE WHEN {_E} = 'pdf' THEN 'pdf' ELSE 'image' END AS media FROM source_docs)
SELECT doc_id, s.doc_type, layer FROM s JOIN r ON s.doc_type = r.doc_type AND (r.media = 'any' OR r.media = s.media)"""
)
def route_documents(spark: SparkSession, d: str) -> DataFrame:
    return route.routed(table(spark, d, "source_docs"))


@query(
    f"""WITH {_BOXES}, p AS (SELECT box_id, entity_type, least(greatest(CAST(trunc(x / 1000.0 * 700) AS INT), 0), 700) AS x1, least(greatest(CAST(trunc((x + w) / 1000.0 * 700) AS INT), 0), 700) AS x2,
least(greatest(CAST(trunc(y / 1000.0 * 900) AS INT), 0), 900) AS y1, least(greatest(CAST(trunc((y + h) / 1000.0 * 900) AS INT), 0), 900) AS y2 FROM boxes)
SELECT box_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, upper(entity_type) AS entity_type, 0.75 AS confidence FROM p WHERE x2 > x1 AND y2 > y1"""
)
def vision_parse(spark: SparkSession, d: str) -> DataFrame:
    number = [F.col("x"), F.lit(", "), F.col("y"), F.lit(", "), F.col("x") + F.col("w"), F.lit(", "), F.col("y") + F.col("h")]
    answer = F.concat(F.lit('```json\n[{"bbox_2d": ['), *[n.cast("string") for n in number], F.lit('], "label": "'), F.lower("entity_type"), F.lit('"}, {"bbox_2d": [1, 2]}, 7]\n```'))
    raw = _boxes(spark, d).select("box_id", answer.alias("raw"), F.lit(700).alias("img_w"), F.lit(900).alias("img_h"))
    return models.vision_boxes(raw).select("box_id", "x", "y", "w", "h", "entity_type", "confidence")


@query(
    f"""WITH v AS (SELECT DISTINCT doc_id, 0 AS rank, box_id AS ord, text_found AS span FROM redaction_boxes WHERE source = 'vlm'
UNION ALL SELECT DISTINCT doc_id, 1, box_id, text_found FROM redaction_boxes WHERE source = 'presidio'),
k AS (SELECT * FROM v WHERE regexp_matches(span, '\\S') QUALIFY row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(span, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) ORDER BY rank, ord) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank, ord) - 1 AS INT) AS ord, span FROM k"""
)
def merge_span_lists(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumnRenamed("text_found", "span")
    return models.first_of_each(b.filter("source = 'vlm'"), b.filter("source = 'presidio'"))


# --- vault, audit, tables --------------------------------------------------------------------------------

_SEEN = "seen AS (SELECT DISTINCT entry_id, doc_id, plaintext, regexp_extract(token, '^\\[(.+)_\\d+\\]$', 1) AS entity_type FROM vault_tokens)"
_TOKENS = f"""{_SEEN}, v AS (SELECT doc_id, plaintext, arg_min(entity_type, entry_id) AS entity_type, min(entry_id) AS first_ord FROM seen WHERE plaintext IS NOT NULL GROUP BY 1, 2),
t AS (SELECT doc_id, plaintext, '[' || entity_type || '_' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY first_ord, plaintext) || ']' AS token FROM v)"""


def _seen(spark: SparkSession, d: str) -> DataFrame:
    rows = one_of_each(table(spark, d, "vault_tokens"), "entry_id")
    return rows.select("doc_id", F.col("entry_id").alias("ord"), "plaintext", F.regexp_extract("token", r"^\[(.+)_\d+\]$", 1).alias("entity_type"))


@query(f"WITH {_TOKENS} SELECT doc_id, plaintext, token FROM t")
def vault_tokens(spark: SparkSession, d: str) -> DataFrame:
    return vault.tokens(_seen(spark, d), "doc_id").select("doc_id", "plaintext", "token")


@query(f"WITH {_TOKENS}, q AS (SELECT DISTINCT doc_id, token FROM t UNION SELECT doc_id, '[NONE_1]' FROM t) SELECT q.doc_id, q.token, t.plaintext FROM q LEFT JOIN t ON q.doc_id = t.doc_id AND q.token = t.token")
def vault_recover(spark: SparkSession, d: str) -> DataFrame:
    known = vault.tokens(_seen(spark, d), "doc_id")
    asked = known.select("doc_id", "token").union(known.select("doc_id", F.lit("[NONE_1]"))).distinct()
    return vault.recovered(asked, known, "doc_id")


@query("SELECT DISTINCT entry_id, doc_id, plaintext FROM vault_tokens")
def vault_aes_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = one_of_each(table(spark, d, "vault_tokens"), "entry_id").select("entry_id", "doc_id", "plaintext")
    return vault.decrypted(vault.encrypted(rows, _KEY), _KEY)


@query(f"WITH {_BOXES} SELECT source, count(*) AS n FROM boxes GROUP BY 1")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.counts(_boxes(spark, d), "source")


@query(f"WITH {_BOXES} SELECT doc_id, page, count(*) AS redactions FROM boxes GROUP BY 1, 2")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.per_page(_boxes(spark, d))


@query(
    f"""WITH {_BOXES}, t AS (SELECT doc_id, count(*) AS total, count(DISTINCT page) AS pages_redacted, count(DISTINCT entity_type) AS kinds FROM boxes GROUP BY 1)
SELECT doc_id, pages, coalesce(pages_redacted, 0) AS pages_redacted, coalesce(total, 0) AS total_redactions, CAST(coalesce(kinds, 0) AS INT) AS kinds FROM source_docs LEFT JOIN t USING (doc_id)"""
)
def audit_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.documents(_boxes(spark, d), table(spark, d, "source_docs"))
    return rows.select("doc_id", "pages", "pages_redacted", "total_redactions", F.size("entity_counts").alias("kinds"))


@query(
    """WITH e AS (SELECT DISTINCT * FROM audit_events), f AS (SELECT coalesce(source, '(none)') AS source, coalesce(entity_type, '(none)') AS entity_type, confidence FROM e)
SELECT source, entity_type, count(*) AS n, round(sum(confidence), 3) AS total_confidence FROM f GROUP BY ROLLUP (source, entity_type)"""
)
def audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    events = one_of_each(table(spark, d, "audit_events"), "id")
    return audit.rollup(events, "source", "entity_type").select("source", "entity_type", "n", F.round("total_confidence", 3).alias("total_confidence"))


@query(
    """WITH l AS (SELECT DISTINCT * FROM audit_log), j AS (SELECT unnest(json_keys(entity_counts)) AS entity_type, entity_counts FROM l WHERE json_valid(entity_counts))
SELECT entity_type, CAST(sum(CAST(json_extract(entity_counts, '$.' || entity_type) AS BIGINT)) AS BIGINT) AS n FROM j GROUP BY 1"""
)
def audit_json_counts(spark: SparkSession, d: str) -> DataFrame:
    log = audit.parsed_counts(one_of_each(table(spark, d, "audit_log"), "id"), "entity_counts")
    return log.select(F.explode("entity_counts").alias("entity_type", "n")).groupBy("entity_type").agg(F.sum("n").alias("n"))


def _form(spark: SparkSession, d: str) -> DataFrame:
    def value(label: str):
        return F.regexp_extract("text", label + ": (.+)", 1)

    return claims(spark, d).select("doc_id", value("Email").alias("mail"), value("Policy Number").alias("policy"), value("EIN").alias("employer"), value("Insurer").alias("insurer"))


@query(f"{_WITH} SELECT * FROM (SELECT 'mail' AS \"column\", 'EMAIL_ADDRESS' AS entity_type, count(*) AS n, count(*) AS rows FROM claims UNION ALL SELECT 'policy', 'POLICY_NUM', count(*), count(*) FROM claims UNION ALL SELECT 'employer', 'EIN', count(*), count(*) FROM claims)")
def structured_column_types(spark: SparkSession, d: str) -> DataFrame:
    return tabular.column_entities(_form(spark, d), ["mail", "policy", "employer", "insurer"])


@query("SELECT c_custkey, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS c_name, sha256('s' || c_mktsegment) AS c_mktsegment, c_nationkey FROM customer")
def structured_anonymize(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return tabular.anonymised(df, {"c_name": tabular.mask(4), "c_mktsegment": tabular.digest("s")})


# --- evaluation ------------------------------------------------------------------------------------------

_GOLD = {"SSN": "SSN", "EIN": "EIN", "Policy Number": "POLICY_NUM", "Claim": "CLAIM_REF", "Routing": "US_BANK_NUMBER"}
_JUDGED = tuple(p for p in PATTERNS if p.name in ("ssn_dashes", "ein_standard", "policy_pol_prefix", "policy_generic", "claim_clm_prefix", "routing_9digit"))
_GOLD_SQL = " UNION ALL ".join(f"SELECT doc_id, '{e}' AS entity_type, regexp_extract(text, '{label}: (.+)', 1) AS span FROM claims" for label, e in _GOLD.items())
_PRED_SQL = " UNION ALL ".join(_extract_sql(p) for p in _JUDGED)


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = claims(spark, d)
    pairs = F.array(*[F.struct(F.lit(e).alias("entity_type"), F.regexp_extract("text", f"{label}: (.+)", 1).alias("span")) for label, e in _GOLD.items()])
    return detect.detect(docs, registry=Registry(_JUDGED), places=False), docs.select("doc_id", F.inline(pairs))


def _f1_sql(by: str) -> str:
    group = "entity_type, " if by else ""
    p = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END"
    r = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"
    return f"""{_WITH}, pred AS ({_PRED_SQL}), gold AS ({_GOLD_SQL}),
a AS (SELECT {group} count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp FROM (SELECT entity_type, (doc_id, entity_type, span) IN (SELECT (doc_id, entity_type, span) FROM gold) AS hit FROM pred) {'GROUP BY entity_type' if by else ''}),
b AS (SELECT {group} count(*) FILTER (WHERE NOT hit) AS fn FROM (SELECT entity_type, (doc_id, entity_type, span) IN (SELECT (doc_id, entity_type, span) FROM pred) AS hit FROM gold) {'GROUP BY entity_type' if by else ''}),
c AS (SELECT {'coalesce(a.entity_type, b.entity_type) AS entity_type,' if by else ''} coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM a {'FULL JOIN b ON a.entity_type = b.entity_type' if by else ', b'}),
q AS (SELECT *, {p} AS p, {r} AS r FROM c)
SELECT {group} tp, fp, fn, round(p, 3) AS precision, round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1 FROM q"""


@query(_f1_sql(""))
def eval_exact_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.f1(*_judged(spark, d))


@query(_f1_sql("entity_type"))
def eval_per_entity(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.f1(*_judged(spark, d), "entity_type")


@query(_f1_sql("entity_type").replace("(doc_id, entity_type, span) IN (SELECT (doc_id, entity_type, span) FROM gold)", "EXISTS (FROM gold g WHERE g.doc_id = pred.doc_id AND g.entity_type = pred.entity_type AND (contains(g.span, pred.span) OR contains(pred.span, g.span)))").replace("(doc_id, entity_type, span) IN (SELECT (doc_id, entity_type, span) FROM pred)", "EXISTS (FROM pred g WHERE g.doc_id = gold.doc_id AND g.entity_type = gold.entity_type AND (contains(g.span, gold.span) OR contains(gold.span, g.span)))"))
def eval_partial_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.f1(*_judged(spark, d), "entity_type", partial=True)


_COVER = f"list_transform(free, lambda q: {_iou_sql('e[1]', 'q')})"
_AT = f"list_position({_COVER}, list_max({_COVER}))"
_SIDE = "SELECT doc_id || '-' || page AS image_id, list({{'ord': box_id, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY box_id) AS {0} FROM boxes WHERE source {1} ('deface', 'yolov8', 'vlm') GROUP BY 1"


@query(
    f"""WITH {_BOXES}, b AS (SELECT image_id, coalesce(p, g[1:0]) AS p, coalesce(g, p[1:0]) AS g FROM ({_SIDE.format('p', 'IN')}) FULL JOIN ({_SIDE.format('g', 'NOT IN')}) USING (image_id)),
f AS (SELECT image_id, len(p) AS np, len(g) AS ng, len(list_reduce(list_transform(p, lambda r: [r]), lambda free, e: CASE WHEN coalesce(list_max({_COVER}), 0) >= 0.5 THEN list_concat(free[1:{_AT} - 1], free[{_AT} + 1:]) ELSE free END, g)) AS rest FROM b)
SELECT image_id, CAST(ng - rest AS BIGINT) AS tp, CAST(np - (ng - rest) AS BIGINT) AS fp, CAST(rest AS BIGINT) AS fn FROM f"""
)
def eval_box_matches(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumn("image_id", F.concat_ws("-", "doc_id", "page"))
    return evaluate.box_matches(b.filter("source in ('deface', 'yolov8', 'vlm')"), b.filter("source not in ('deface', 'yolov8', 'vlm')"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) / length(p_name) AS rate FROM part WHERE length(p_name) > 0")
def cer_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", evaluate.error_rate(F.col("p_name"), F.col("p_type")).alias("rate"))


@query()
def cer_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", evaluate.block_error_rate(F.col("p_name"), F.col("p_type")).alias("rate"))


def _share_sql(lang: str) -> str:
    return f"len(list_filter(w, lambda x: x IN ({quoted(N.COMMON[lang].split())})))"


@query(
    f"""WITH d AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id), s AS (SELECT *, lower({_S.replace('text_found', 'text')}) AS s FROM d), t AS (SELECT *, {_W} AS w FROM s)
SELECT doc_id, s = '' OR length(text) < 10 OR len(w) = 0 OR {_share_sql('en')} >= greatest({', '.join(_share_sql(k) for k in N.COMMON if k != 'en')}) AS english FROM t"""
)
def english_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = one_of_each(table(spark, d, "documents"), "doc_id")
    return docs.select("doc_id", N.english(F.col("text")).alias("english"))
