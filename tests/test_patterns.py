import re

import pytest
from pyspark.sql import functions as F

from cloakwork.functions.patterns import BASELINE, CONTEXT, GENERAL, PATTERNS, Registry, ahead, word_only
from cloakwork.functions.text import MARK, matches
from cloakwork.operators import detect as D

# Samples made for these tests; the card and routing numbers are the published examples of their checks.
YES = {
    "SSN": ["file 518-44-7310 of May", "no 401226688 here"],
    "NPI": ["seen by 1730582946", "2046813579"],
    "EIN": ["firm 36-4410987."],
    "ICD10_CODE": ["S52.501A", "N39", "code K3B.22 in"],
    "CPT_CODE": ["27447", "item 70553-TC"],
    "POLICY_NUM": ["POL-7QX40LM", "HO4418820"],
    "US_BANK_NUMBER": ["021000021"],
    "ADJUSTER_ID": ["ADJ-K77Q2", "ADJ5512", "QT60718"],
    "CLAIM_REF": ["CLAIM-55GH210", "CLA-0000419", "90417722518"],
    "DEA_NUM": ["KM4820193"],
    "CREDIT_CARD": ["4111 1111 1111 1111", "4111-1111-1111-1111"],
    "PHONE_NUMBER": ["(415) 220-9931", "415 220 9931", "+1-415-220-9931", "at +31 6 1420 8877 now"],
    "SWIFT_BIC_CODE": ["QZRTUS66", "QZRTUS66A0B"],
    "US_ITIN": ["901-77-2063", "901 77 2063"],
    "US_PASSPORT": ["K40718265", "K4Z718265"],
    "LOCATION": ["77 Old Quarry Lane, Elm", "5 Birch Way"],
}
NO = {
    "SSN": ["000-44-7310", "666447310", "918-44-7310", "518-00-7310", "518-44-0000", "1518-44-73101"],
    "NPI": ["4730582946", "173058294"],
    "EIN": ["00-4410987", "36-441098"],
    "POLICY_NUM": ["POL-7QX4", "pol-7qx40lm"],
    "US_BANK_NUMBER": ["021000022", "02100002", "991000021"],
    "CLAIM_REF": ["CLM-19", "CLAIM 55GH210"],
    "DEA_NUM": ["KM482019", "K4820193"],
    "CREDIT_CARD": ["4111 1111 1111 1112", "4111 1111 1111"],
    "PHONE_NUMBER": ["115 220 9931", "22-09931"],
    "LOCATION": ["77 old quarry lane", "Birch Way"],
}


def found(spark, texts, registry):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return {(r.doc_id, r.entity_type) for r in D.detect(df, registry=registry).collect()}


def test_golden_strings(spark):
    cases = [(e, t, True) for e, ts in YES.items() for t in ts] + [(e, t, False) for e, ts in NO.items() for t in ts]
    got = found(spark, [t for _, t, _ in cases], Registry(PATTERNS))
    assert [(e, t) for k, (e, t, yes) in enumerate(cases) if ((k, e) in got) != yes] == []


def test_all_seventeen_types_have_context():
    assert len({p.entity for p in PATTERNS}) == 17 and {p.entity for p in PATTERNS} == set(CONTEXT)
    assert len(BASELINE) == 15


def test_offsets_equal_those_of_finditer(spark):
    texts = ["", "a😀b 12345-AB, 99213 x12345", "1234\n12345 12345", None, "é12345 12345é"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string")
    for p in (PATTERNS[5], PATTERNS[18], GENERAL[3]):
        rows = {r.i: r.m for r in df.select("i", matches(F.col("t"), p.regex).alias("m")).collect()}
        for k, t in enumerate(texts):
            want = None if t is None else [(m.start(), m.end(), m.group()) for m in re.finditer(p.regex, t)]
            assert (rows[k] if rows[k] is None else [tuple(x) for x in rows[k]]) == want


def test_iban_check(spark):
    got = found(spark, ["GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"], Registry().only("IBAN_CODE"))
    assert got == {(0, "IBAN_CODE")}


def test_registry_is_immutable():
    one = Registry(PATTERNS)
    two = one.remove("SSN").add(GENERAL[0])
    assert "SSN" in one.entities() and "SSN" not in two.entities() and "EMAIL_ADDRESS" in two.entities()


def test_context_raises_scores(spark):
    df = spark.createDataFrame([(1, "the cvv is 123"), (2, "room 123"), (3, "cvv one two three four five 123")], "doc_id long, text string")
    hits = D.detect(df, registry=Registry(PATTERNS).only("CREDIT_CARD_SECURITY_CODE"), keep=("doc_id", "text"))
    got = {r.doc_id: round(r.score, 2) for r in D.rescored(hits, F.col("text")).collect()}
    assert got == {1: 0.75, 2: 0.4, 3: 0.4}
    assert [r.doc_id for r in D.gated(D.rescored(hits, F.col("text"))).collect()] == [1]


@pytest.mark.parametrize("style", ["type", "block", "drop"])
def test_masked_text_holds_no_hit(spark, style):
    text = "Mail jo@x.org or call (800) 555-1234. POL-1234567, POL-1234567!"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in D.masked(df, style=style).collect()}
    assert rows[2] is None and rows[3] == ""
    assert "jo@x.org" not in rows[1] and "555" not in rows[1] and "POL-" not in rows[1] and rows[1].startswith("Mail ") and rows[1].endswith("!")
    if style == "type":
        assert rows[1] == "Mail [EMAIL_ADDRESS] or call [PHONE_NUMBER]. [POLICY_NUM], [POLICY_NUM]!"
    if style == "block":
        assert len(rows[1]) == len(text)


def test_outermost_and_deduplicated(spark):
    df = spark.createDataFrame([(1, "pay 4111 1111 1111 1111 and 4111111111111111")], "doc_id long, text string")
    hits = D.detect(df, registry=Registry(PATTERNS).only("CREDIT_CARD"))
    assert hits.count() == 3
    assert [(r.start, r.end) for r in D.outermost(hits, "doc_id").orderBy("start").collect()] == [(4, 23), (28, 44)]
    assert D.deduplicated(hits, "doc_id").count() == 2


def test_patterns_that_share_a_scan_find_what_each_finds_alone(spark):
    texts = ["AB1234567 021000021 1234567890123 A12345678 BOFAUS3NXXX", "123 1234\n12345-AB 912-70-1234 POL-7QX40LM77 CLM-123456", f"a😀b {MARK}12345-AB, 1234 {MARK}", "77 Old Quarry Lane 4111 1111 1111 1111", "é1234 1234é _123 $0 123\\ 123", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    plain = tuple(p for p in PATTERNS + GENERAL if not p.check)
    want = {(k, p.name, m.start(), m.end(), m.group()) for k, t in enumerate(texts) for p in plain for m in re.finditer(p.regex, t or "")}
    rows = D.detect(df, registry=Registry(plain)).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.pattern, r.start, r.end, r.span) for r in rows} == want
    assert len(D._scans(PATTERNS)) == 1 + sum(not word_only(p.regex) for p in PATTERNS) == 15


def test_only_plain_expressions_share_a_scan_or_look_ahead():
    assert word_only(r"\b[A-Z]{2}\d{7}\b") == r"[A-Z]{2}\d{7}" and word_only(r"\b(?:0[0-9]|1[0-2])\d{7}\b") == r"(?:0[0-9]|1[0-2])\d{7}"
    assert [r for r in (r"\ba|b\b", r"\b[A-z]+\b", r"\b[A-Z-]+\b", r"\b\d+\s\b", r"\b(?!00)\d{2}\b", r"\d{3}") if word_only(r)] == []
    assert (ahead(r"\bPOL-\d"), ahead(r"\b\d{3}-", r"\b[A-Z]x"), ahead(r"\b(?:CLM|9\d)-")) == ("(?=[P])", "(?=[0-9A-Z])", "(?=[9C])")
    assert [r for r in (r"\ba|b\b", r"\b(?:a|b)?c\b", r"\b\d*x", r"\b(?:ab|[^c]d)\b", r"\b(?:(?:x|y)|z)", r"\d{3}", r"\b(?:a|b)|c") if ahead(r)] == []


def test_words_before_a_hit_are_worked_out_once_not_for_each_context_word(spark):
    df = spark.createDataFrame([(1, "the cvv is 123", 11, "CREDIT_CARD_SECURITY_CODE", 0.4)], "doc_id long, text string, start int, entity_type string, score double")
    plan = D.rescored(df, F.col("text"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(lambda " in plan and "contains(lower(" not in plan
