from pyspark.sql import functions as F

from cloakwork.operators import layout as L
from cloakwork.operators import words as W
from cloakwork.sources import tables as S

SCHEMA = "doc_id string, page int, ord int, text string, x int, y int, w int, h int, block_type string, field_label string"


def spans(spark, rows):
    return spark.createDataFrame([("d", 0, k, t, x, y, 50, 10, "paragraph", lab) for k, (t, x, y, lab) in enumerate(rows)], SCHEMA)


def test_first_label_wins_and_values_are_no_labels(spark):
    rows = [("Employer:", 40, 115, ""), ("GreenTech", 202, 117, ""), ("Patient Name:", 40, 145, ""), ("Jane Doe", 202, 141, ""), ("Insurer:", 300, 145, None), (None, 400, 300, "")]
    # "Jane Doe" lies above its label, so it comes first in reading order and names the span to its right
    got = {r.ord: (r.field_label, r.block_type) for r in L.associated(spans(spark, rows)).collect()}
    assert got == {0: ("", "form_field_label"), 1: ("Employer", "paragraph"), 2: ("", "form_field_label"), 3: ("Patient Name", "form_field_label"), 4: ("Jane Doe", "paragraph"), 5: ("", "paragraph")}


def test_pairs_split(spark):
    rows = [("Employer: GreenTech Inc.\nPatient Name: Jane Doe", 0, 0, ""), ("Abc: b  Cd: e", 0, 0, ""), ("just text", 0, 0, ""), ("Key: value", 0, 0, ""), ("Abc: b\nno pair", 0, 0, ""), ("X: y\nZ: w", 0, 0, "L"), (None, 0, 0, "")]
    got = [(r.ord, r.part, r.field_label, r.text) for r in L.split_pairs(spans(spark, rows)).orderBy("ord", "part").collect()]
    assert got == [
        (0, 0, "Employer", "GreenTech Inc."), (0, 1, "Patient Name", "Jane Doe"), (1, 0, "Abc", "b"), (1, 1, "Cd", "e"), (2, 0, "", "just text"), (3, 0, "", "Key: value"),
        (4, 0, "Abc", "b"), (4, 1, "", "Abc: b\nno pair"), (5, 0, "L", "X: y\nZ: w"), (6, 0, "", None),
    ]


def test_field_rules(spark):
    s = spark.createDataFrame([(1, "Patient Name", "Jane Doe"), (2, "Insurer", "Jane Doe"), (3, "Employer", "Email"), (4, None, "Jane Doe")], "span_id long, field_label string, text string")
    hits = spark.createDataFrame([(1, "Jane Doe", "PERSON", 0.5), (2, "Jane Doe", "PERSON", 0.9), (3, "Email", "PERSON", 0.9), (4, "Jane Doe", "PERSON", 0.5), (4, "123", "SSN", 0.3)], "span_id long, span string, entity_type string, score double")
    got = sorted((r.span_id, r.entity_type, r.score, r.source) for r in L.field_detections(s, hits).collect())
    assert got == [(1, "PERSON", 0.75, "field"), (4, "PERSON", 0.5, "field"), (4, "SSN", 0.3, "field")]
    got = L.field_detections(s, hits.limit(0)).collect()
    assert [(r.span_id, r.source) for r in got] == [(1, "heuristic_name_field")]


def test_words_to_boxes(spark):
    w = spark.createDataFrame([("d", 0, 0, "ab", 0, 0, 10, 5), ("d", 0, 1, "cde", 12, 1, 15, 5), ("d", 0, 2, "f", 30, 0, 5, 5)], "doc_id string, page int, ord int, text string, x int, y int, w int, h int")
    page = W.pages_of_words(w).first()
    assert page.text == "ab cde f" and [(p.start, p.end) for p in page.words] == [(0, 2), (3, 6), (7, 8)]
    hits = W.pages_of_words(w).withColumns({"start": F.lit(1), "end": F.lit(5)})
    assert tuple(W.boxes_of_hits(hits).select("x", "y", "w", "h").first()) == (0, 0, 27, 6)
    joined = W.hits_on_words(hits.select(F.lit(9).alias("hit_id"), "doc_id", "page", "start", "end"), W.pages_of_words(w).select("doc_id", "page", F.inline("words")))
    assert tuple(joined.first()) == (9, 0, 0, 27, 6)
    box = spark.createDataFrame([("d", 0, 0, 0, 11, 5)], "doc_id string, page int, x int, y int, w int, h int")
    assert [r.text for r in W.unredacted_words(w, box).orderBy("ord").collect()] == ["cde", "f"]


def test_sources(spark, tmp_path):
    items = spark.createDataFrame([("d", 1, 0, "section_header", " T ", 10.0, 800.0, 60.0, 790.0, None), ("d", 1, 1, "text", " ", 0.0, 1.0, 1.0, 0.0, 100.0)], "doc_id string, page int, ord int, label string, text string, left double, top double, right double, bottom double, page_height double")
    assert [tuple(r)[1:9] for r in S.layout(items).collect()] == [(0, 0, "T", 10, 42, 50, 10, "header")]
    for name in ("b.pdf", "a.JPG", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.filename for r in S.files(spark, str(tmp_path)).collect()) == ["a.JPG", "b.pdf"]
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    for fmt in ("parquet", "orc", "json", "csv"):
        S.write(df, str(tmp_path / fmt), fmt)
        assert S.table(spark, str(tmp_path / fmt), fmt, "id long, t string" if fmt in ("json", "csv") else None).count() == 2
    tree = spark.createDataFrame([("d", 0, [{"lines": [{"spans": [{"text": " a ", "bbox": [1.5, 2.0, 4.0, 5.0]}, {"text": " ", "bbox": [0.0, 0.0, 1.0, 1.0]}]}]}])], "doc_id string, page int, blocks array<struct<lines:array<struct<spans:array<struct<text:string,bbox:array<double>>>>>>>")
    assert [tuple(r)[3:] for r in S.nested_spans(tree).collect()] == [("a", 1, 2, 3, 3)]
