import json

import pytest
from pyspark.sql import functions as F

from cloakwork import settings
from cloakwork.functions.patterns import PATTERNS, Registry
from cloakwork.operators import evaluate, image, models, pages, vault
from cloakwork.plans import pipeline

CODEC = pages.PlainPages()
FILE = "%%Author: Jo\nClaim CLM-0000001 of\nPOL-ABC7777 x\fPage two, 999-11-2222"


def files(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, filename string, content binary")


def test_words_and_what_is_left_without_boxes():
    words = CODEC.words(FILE.encode())
    assert [(w[0], w[2]) for w in words][:3] == [(0, "Claim"), (0, "CLM-0000001"), (0, "of")] and words[-1][0] == 1
    boxes = [(w[0], *w[3:]) for w in words if w[2].startswith(("CLM", "999"))]
    assert CODEC.without(FILE.encode(), boxes).decode() == "Claim ███████████ of\nPOL-ABC7777 x\fPage two, ███████████"
    assert CODEC.without(b"ab", [(0, -50, -50, 9000, 9000), (7, 0, 0, 5, 5)]).decode() == "██"


def test_files_that_cannot_be_read_leave_nothing(spark):
    df = files(spark, [("a", "a.pdf", FILE.encode()), ("b", "b.pdf", b"\xff\xfe\xff"), ("c", "c.pdf", None), ("d", "d.pdf", b"")])
    assert {r.doc_id for r in pages.words(df, CODEC).collect()} == {"a"}
    assert {r.page for r in pages.words(df, CODEC, first_page_only=True).collect()} == {0}
    none = spark.createDataFrame([], "doc_id string, page int, x int, y int, w int, h int")
    got = {r.doc_id: (r.status, r.content) for r in pages.rewritten(df, none, CODEC).collect()}
    assert got["b"] == ("error", None) and got["c"] == ("error", None) and got["d"] == ("written", b"") and got["a"][0] == "written"


def test_pipeline_from_files_to_sinks(spark, tmp_path):
    df = files(spark, [("a", "a.pdf", ("word " * 30 + FILE).encode()), ("b", "b.pdf", ("nothing to see " * 20).encode()), ("c", "c.pdf", b"\xff"), ("d", "d.png", b"CLM-0000009")])
    registry = Registry(tuple(p for p in PATTERNS if p.name in ("policy_pol_prefix", "claim_clm_prefix")))
    run = pipeline.run(df, CODEC, registry)
    assert {r.doc_id: r.doc_type for r in run.kinds.collect()} == {"a": "PDF_STRUCTURED", "b": "PDF_STRUCTURED", "c": "SCAN_FORM", "d": "UNKNOWN"}
    assert sorted(r.doc_id for r in run.files.collect()) == ["a", "c", "d"]  # a structured file without hits isn't written
    assert {r.doc_id: r.total_redactions for r in run.records.collect()} == {"a": 2, "b": 0, "c": 0, "d": 1}
    assert pipeline.status(run.kinds).first().code == 1 and pipeline.status(run.kinds.filter("pages > 0")).first().code == 0
    assert {r.layer for r in run.layers.filter("doc_id = 'd'").collect()} == {"ocr", "visual", "insurance_ner", "scispacy", "exif"}
    key = bytes(range(32))
    pipeline.write_run(run, str(tmp_path), key)
    records = {json.loads(r.value)["doc_id"]: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/audit").collect()}
    assert records["a"]["version"] == "1.0" and records["a"]["entity_counts"] == {"CLAIM_REF": 1, "POLICY_NUM": 1}
    assert "text_found" not in spark.read.parquet(f"{tmp_path}/events").columns
    opened = vault.decrypted(spark.read.parquet(f"{tmp_path}/vault"), key)
    assert {r.plaintext for r in opened.collect()} == {"CLM-0000001", "POL-ABC7777", "CLM-0000009"}


def test_empty_folder(spark):
    run = pipeline.run(files(spark, []), CODEC)
    assert run.files.count() == run.records.count() == run.boxes.count() == 0 and pipeline.status(run.kinds).first().code == 0


def test_pictures_lose_their_metadata(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1\x00\x08Exif\x00\x00\xff\xfe\x00\x03c\xff\xda\x00\x02scan\xff\xd9"
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + b"crc." for k, d in [(b"IHDR", b"1" * 13), (b"tEXt", b"who"), (b"eXIf", b"x"), (b"IDAT", b"data"), (b"IEND", b"")])
    df = spark.createDataFrame([(1, jpeg), (2, png), (3, b"text"), (4, None)], "doc_id long, content binary")
    got = {r.doc_id: r for r in image.without_metadata(df).collect()}
    assert got[1].content == b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02scan\xff\xd9" and got[1].removed == len(jpeg) - len(got[1].content)
    assert b"who" not in got[2].content and b"eXIf" not in got[2].content and got[2].content.endswith(b"IENDcrc.")
    assert got[3].content is None and got[4].removed is None


def test_settings_are_read_and_laid_over_each_other(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"redaction": {"fill_padding_px": 7, "fill_color": [1, 2, 3]}, "x": {"unknown": 1}}))
    got = settings.read(str(path), {"redaction": {"fill_padding_px": 9}})
    assert got.padding == 9 and got.fill == (1, 2, 3) and got.dpi == 300


def test_model_adapters_and_run_summary(spark):
    faces = spark.createDataFrame([(1, 2, 2, 10, 10, None, 13, 100), (2, 0, 0, 5, 5, 0.4, 50, 50)], "id int, x int, y int, w int, h int, score double, width int, height int")
    assert [(r.x, r.w, r.confidence) for r in models.faces(faces).orderBy("id").collect()] == [(0, 13, 0.8), (0, 9, 0.4)]
    ink = spark.createDataFrame([(1, 499), (2, 500)], "id int, area int")
    assert [r.id for r in models.handwriting(ink).collect()] == [2]
    lines = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("a", 2, " "), ("b", 0, None)], "doc_id string, ord int, text string")
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    assert {r.doc_id: r.text for r in models.joined_lines(lines, docs).collect()} == {"a": "one two", "b": "", "c": ""}
    runs = spark.createDataFrame([(0.5, 2, False), (0.1, 4, False), (9.0, 0, True)], "rate double, lines int, error boolean")
    r = evaluate.ocr_summary(runs).first()
    assert (r.docs, r.errors, round(r.mean_rate, 6), r.mean_lines) == (3, 1, 0.3, 2.0)
    assert evaluate.ocr_summary(runs.limit(0)).first().mean_rate == 0.0


@pytest.mark.parametrize("size", [10, 5000])
def test_words_before_a_hit_are_those_of_the_whole_text(spark, size):
    from cloakwork.functions.text import words_before

    text = "alpha beta gamma " * size + "  one two\tthree four five HIT"
    df = spark.createDataFrame([(text, len(text) - 3), ("HIT", 0), ("x" * 400 + " y HIT", 403)], "t string, a int")
    assert [r.b for r in df.select(words_before(F.col("t"), F.col("a"), 5).alias("b")).collect()] == ["one two three four five", "", "y"]
