import pytest
from pyspark.sql import functions as F

from cloakwork.functions import filters as N

ORGS = [
    ("Adobe", "The lender Adobe has provided financing.", True), ("Adobe", "", True), ("Adobe", "a day at the beach", False), ("Client", "bank", False),
    ("HMRC", "bank", False), ("", "bank", False), (None, "bank", False), ("  ", None, False), ("xsi:type", "bank", False), ("a@b", "bank", False), ("the Bank", "bank", False),
    ("One two three four five six seven", "", False), ("One two three four five six Inc", "", True), ("Acme Inc.", "beach", True), ("Three Word Company", "beach", True),
]
PERSONS = [("Mary-Anne Smith", True), ("Email", False), ("john", False), ("", False), (None, False), ("Jane", True), ("Contact Manager", True)]
NAMES = [("Jane Doe", True), ("J", False), ("jane", False), ("Jane 2", False), ("Email", False), ("X" * 61, False), (" O'Neil-Smith Jr. ", True), (None, False)]


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + schema)
    return [r.v for r in df.select("k", column.alias("v")).orderBy("k").collect()]


def test_organisations(spark):
    assert values(spark, [o[:2] for o in ORGS], "s string, c string", N.is_org(F.col("s"), F.col("c"))) == [o[2] for o in ORGS]


def test_persons_and_names(spark):
    assert values(spark, [(p[0],) for p in PERSONS], "s string", N.is_person(F.col("s"))) == [p[1] for p in PERSONS]
    assert values(spark, [(p[0],) for p in NAMES], "s string", N.looks_like_name(F.col("s"))) == [p[1] for p in NAMES]


def test_labels(spark):
    assert values(spark, [("ssn",), ("API_KEY",), ("organization",), ("NEW",), (None,)], "s string", N.normal_label(F.col("s"))) == ["US_SSN", "NRP", "ORG", "NEW", None]
    assert len(N.LABELS) == 42 and len(N.HIGH_VALUE) == 24 and len(N.LOW_VALUE) == 13 and len(N.NOT_PERSONS) == 22


@pytest.mark.parametrize(("entity", "span", "good"), [("EMAIL_ADDRESS", "Email:", False), ("EMAIL_ADDRESS", "a@b.co", True), ("PHONE_NUMBER", "Phone", False), ("PHONE_NUMBER", "555-1234", True), ("US_SSN", "12", False), ("NPI", "npi", False), ("PERSON", "x", True), ("PERSON", " ", False)])
def test_model_hits(spark, entity, span, good):
    assert values(spark, [(span, entity)], "s string, e string", N.sane_model_hit(F.col("s"), F.col("e"))) == [good]


def test_english(spark):
    rows = [("The claim was filed by the insured and is open",), ("La garantie commence après un délai de dix jours",), ("kurz",), (None,)]
    assert values(spark, rows, "s string", N.english(F.col("s"))) == [True, False, True, True]
