import pytest
from pyspark.sql import functions as F

from cloakwork.operators import audit, evaluate, models, route, tabular, vault
from cloakwork.settings import Settings, load, merged

ANSWERS = [
    ('[{"bbox_2d":[500,500,600,550],"label":"person","text":"Jane","confidence":0.9}]', [(500, 1000, 100, 100, "PERSON", 0.9, "Jane")]),
    ("[]", []), ("NONE", []), ("", []), (None, []), ('{"a": 1}', []), ("prose", []),
    ('```json\n[{"bbox_2d":[0,0,10,10]}]\n```', [(0, 0, 10, 20, "UNKNOWN", 0.75, "")]),
    ('see [{"bbox_2d":[10,10,0,0],"confidence":7}] there', [(0, 0, 10, 20, "UNKNOWN", 1.0, "")]),
    ('[{"bbox_2d":[5,5,5,9]},{"bbox_2d":[1,2]},{"bbox_2d":["a",1,2,3]},{"label":"X"},7,{"bbox_2d":[-50,0,2000,1000],"confidence":"bad"}]', [(0, 0, 1000, 2000, "UNKNOWN", 0.75, "")]),
]


def test_vision_answers(spark):
    df = spark.createDataFrame([(k, a, 1000, 2000) for k, (a, _) in enumerate(ANSWERS)], "k int, raw string, img_w int, img_h int")
    got = models.vision_boxes(df).collect()
    for k, (_, want) in enumerate(ANSWERS):
        assert [tuple(r)[4:] for r in got if r.k == k] == want, ANSWERS[k][0]


def test_model_plugin_and_prompts(spark):
    def load_model():
        def run(texts):
            if "bad" in texts[0]:
                raise ValueError
            return [[{"label": "person name", "start": 0, "end": 4, "score": 1.5}, {"label": "email address", "start": 0, "end": 4, "score": 0.9}, {"label": "ssn", "start": 0, "end": 1, "score": 0.1}]]

        return run

    df = spark.createDataFrame([(1, "Jane"), (2, "bad"), (3, None)], "doc_id long, text string")
    hits = models.run_model(df, load_model).join(df, "doc_id").withColumn("span", F.expr("substring(text, start + 1, end - start)"))
    assert [(r.doc_id, r.entity_type, r.score) for r in models.prompt_hits(hits).collect()] == [(1, "PERSON", 1.0)]
    assert models.prompt_hits(hits, ("NPI",)).count() == 0


def test_span_lists_merge(spark):
    a = spark.createDataFrame([(1, 0, "Jane"), (1, 1, " "), (1, 2, "Bob")], "doc_id long, ord int, span string")
    b = spark.createDataFrame([(1, 0, " JANE "), (1, 1, "Eve")], "doc_id long, ord int, span string")
    assert [r.span for r in models.first_of_each(a, b).orderBy("ord").collect()] == ["Jane", "Bob", "Eve"]


def test_tokens(spark):
    seen = spark.createDataFrame([(1, "a", "PERSON"), (2, "b", "PERSON"), (3, "a", "ORG"), (4, "c", "ORG"), (5, None, "ORG")], "ord long, plaintext string, entity_type string").withColumn("doc_id", F.lit("d"))
    first = vault.tokens(seen, "doc_id")
    assert {r.plaintext: r.token for r in first.collect()} == {"a": "[PERSON_1]", "b": "[PERSON_2]", "c": "[ORG_1]"}
    more = spark.createDataFrame([(6, "a", "ORG"), (7, "e", "PERSON"), (8, "f", "NEW_TYPE")], "ord long, plaintext string, entity_type string").withColumn("doc_id", F.lit("d"))
    assert {r.plaintext: r.token for r in vault.continued(more, first, "doc_id").collect()} == {"e": "[PERSON_3]", "f": "[NEW_TYPE_1]"}
    asked = spark.createDataFrame([("d", "[ORG_1]"), ("d", "[ORG_9]"), ("x", "[ORG_1]")], "doc_id string, token string")
    assert sorted((r.doc_id, r.token, r.plaintext) for r in vault.recovered(asked, first, "doc_id").collect()) == [("d", "[ORG_1]", "c"), ("d", "[ORG_9]", None), ("x", "[ORG_1]", None)]


def test_encryption_is_bound_to_key_and_document(spark):
    df = spark.createDataFrame([("d", "secret"), ("e", None)], "doc_id string, plaintext string")
    key = b"k" * 32
    locked = vault.encrypted(df, key)
    assert "plaintext" not in locked.columns
    assert {r.doc_id: r.plaintext for r in vault.decrypted(locked, key).collect()} == {"d": "secret", "e": None}
    assert vault.decrypted(locked, b"x" * 32).filter("plaintext is not null").count() == 0
    assert vault.decrypted(locked.withColumn("doc_id", F.lit("other")), key).filter("plaintext is not null").count() == 0
    with pytest.raises(ValueError):
        vault.encrypted(df, b"short")


def test_audit_has_no_text(spark):
    boxes = spark.createDataFrame([("d", 0, 1, 2, 3, 4, "SSN", 0.98765, "regex", "123"), ("d", 1, 1, 2, 3, 4, "SSN", 0.5, "vlm", "x")], "doc_id string, page int, x int, y int, w int, h int, entity_type string, confidence double, source string, text_found string")
    docs = spark.createDataFrame([("d", "f.pdf", "MEDICAL", 3), ("e", None, None, None)], "doc_id string, filename string, doc_type string, pages int")
    rows = {r.doc_id: r for r in audit.documents(boxes, docs).collect()}
    assert rows["d"].entity_counts == {"SSN": 2} and rows["d"].source_counts == {"regex": 1, "vlm": 1} and rows["d"].pages_redacted == 2
    assert rows["e"].total_redactions == 0 and rows["e"].entity_counts == {}
    assert "123" not in audit.document_json(audit.documents(boxes, docs)).filter("doc_id = 'd'").first().record
    one = boxes.limit(1).select(audit.box_json().alias("j"), audit.box_json(True).alias("t")).first()
    assert '"confidence":0.988' in one.j and "123" not in one.j and "123" in one.t
    bad = spark.createDataFrame([('{"A": 1',), (None,), ('{"A": 2}',)], "c string")
    assert [r.c for r in audit.parsed_counts(bad, "c").collect()] == [None, None, {"A": 2}]


def test_tables(spark):
    df = spark.createDataFrame([("123-45-6789", "Alice", "a@b.co"), ("234-56-7891", "Bob", None), (None, "", "c@d.org")], "ssn string, name string, mail string")
    found = {r.column: r.entity_type for r in tabular.column_entities(df).collect()}
    assert found == {"ssn": "SSN", "mail": "EMAIL_ADDRESS"}
    out = tabular.anonymised_by_entity(df, found, {"SSN": tabular.mask(4), "EMAIL_ADDRESS": tabular.replace()}).collect()
    assert [tuple(r) for r in out] == [("*******6789", "Alice", "<redacted>"), ("*******7891", "Bob", None), (None, "", "<redacted>")]
    assert tabular.column_entities(spark.createDataFrame([(1,)], "n int")).count() == 0


def test_routes(spark):
    docs = spark.createDataFrame([("a", "x.pdf", "medical "), ("b", "x.png", None), ("c", None, "PHOTO")], "doc_id string, filename string, doc_type string")
    got = {}
    for r in route.routed(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.layer)
    assert got == {"a": {"text", "insurance_ner", "scispacy"}, "b": {"ocr", "visual", "insurance_ner", "scispacy", "exif"}, "c": {"visual", "exif"}}
    shapes = spark.createDataFrame([("a.PDF", [101], 0, 1, 1), ("a.pdf", [100], 0, 1, 1), ("a.pdf", None, 0, 1, 1), ("a.jpg", None, 1, 10, 13), ("a.jpg", None, 1, 10, 12), ("a.png", None, 0, 16, 10), ("a.png", None, 0, 15, 10), ("a.png", None, 0, None, 10), ("a.doc", None, 0, 1, 1), (None, None, 0, 1, 1)], "f string, p array<int>, faces int, w int, h int")
    kinds = [r[0] for r in shapes.select(route.document_type(*[F.col(c) for c in ("f", "p", "faces", "w", "h")])).collect()]
    assert kinds == ["PDF_STRUCTURED", "SCAN_FORM", "SCAN_FORM", "ID_DOC", "PHOTO", "PHOTO", "SCAN_FORM", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_evaluation(spark):
    def side(rows):
        return spark.createDataFrame([(1, *r) for r in rows], "doc_id long, entity_type string, span string")

    pred, gold = side([("P", "Jane"), ("P", "X"), ("Q", "1")]), side([("P", "Jane Doe"), ("R", "2")])
    assert tuple(evaluate.f1(pred, gold).first())[:3] == (0, 3, 2)
    assert tuple(evaluate.f1(pred, gold, partial=True).first())[:3] == (1, 2, 1)
    by = {r.entity_type: (r.tp, r.fp, r.fn) for r in evaluate.f1(pred, gold, "entity_type", partial=True).collect()}
    assert by == {"P": (1, 1, 0), "Q": (0, 1, 0), "R": (0, 0, 1)}
    t = "doc_id long, start int, end int, entity_type string"
    by_type = evaluate.triples(spark.createDataFrame([(1, 0, 4, "P"), (1, 5, 6, "Z")], t), spark.createDataFrame([(1, 0, 4, "P"), (1, 0, 5, "P")], t))
    assert [tuple(r)[:4] for r in by_type.collect()] == [("P", 1, 0, 1)] and tuple(evaluate.micro(by_type).first())[:3] == (1, 0, 1)
    boxes = "image_id string, ord int, x int, y int, w int, h int"
    got = evaluate.box_matches(spark.createDataFrame([("i", 0, 0, 0, 10, 10), ("i", 1, 0, 0, 10, 10)], boxes), spark.createDataFrame([("i", 0, 1, 0, 10, 10), ("j", 0, 0, 0, 1, 1)], boxes))
    assert sorted(tuple(r) for r in got.collect()) == [("i", 1, 1, 0), ("j", 0, 0, 1)]
    rates = spark.createDataFrame([("hello", "helo"), ("", "x"), (None, "x"), ("ab", "ab")], "r string, h string").select(evaluate.error_rate(F.col("r"), F.col("h")).alias("a"), evaluate.block_error_rate(F.col("r"), F.col("h")).alias("b")).collect()
    assert [(r.a, r.b) for r in rates] == [(0.2, 0.2), (0, 0), (0, 0), (0, 0)]
    receipt = spark.createDataFrame([(1, '{"gt_parse": {"menu": [], "total": {"total_price": "99,000", "Cash": "1", "x": "2"}, "sub_total": {"subtotal_price": "3", "tax": ""}}}'), (2, "bad")], "doc_id long, ground_truth string")
    assert sorted(r.value for r in evaluate.receipt_totals(receipt).collect()) == ["1", "3", "99,000"]
    spans = spark.createDataFrame([(1, "Jane here", '[{"start":0,"end":4,"label":"name"}]'), (2, "x", "bad"), (3, "y", None)], "doc_id long, generated_text string, pii_spans string")
    assert [r.span for r in evaluate.gold_spans(spans).collect()] == ["Jane"]


def test_settings():
    assert load({"redaction": {"min_confidence": 0.7, "fill_color": [1, 2, 3]}}, {"redaction": {"min_confidence": 0.8}}) == Settings(fill=(1, 2, 3), min_confidence=0.8)
    a = {"x": {"y": 1}}
    assert merged(a, {"x": {"z": 2}}) == {"x": {"y": 1, "z": 2}} and a == {"x": {"y": 1}}
