import pytest

from cloakwork.llm import bloom
from cloakwork.llm import personal as P

PEOPLE = ["Katherine Kukkepes", "Zatbolund, Oskar", "Michael Binlador", "Rosalind Sutloris", "Harold Pisgokes", "HannahNisgunas", "Quentin Numpimun", "FURMUPELT Elizabeth"]
CASES = [
    ("Call Katherine Kukkepes at (207) 555-0105 about the rear bumper.", [("NAME", "Katherine Kukkepes"), ("PHONE", "(207) 555-0105")]),
    ("Copies to Dr. Oskar Zatbolund and Sutloris, Rosalind.", [("NAME", "Oskar Zatbolund"), ("NAME", "Sutloris, Rosalind")]),
    ("spoke w/ M. BINLADOR, +44 20 7946 0300, says hail", [("NAME", "M. BINLADOR"), ("PHONE", "+44 20 7946 0300")]),
    ("employee Binlador M, SSN: 810 80 1697, hired", [("NAME", "Binlador M"), ("ID_NUMBER", "810 80 1697")]),
    ("HannahNisgunas", [("NAME", "HannahNisgunas")]),
    ("ask for Harold Pisgokes - rosalind-sutloris+claims[at]post[dot]kestwick[dot]example; serial 861-588-76-8760", [("NAME", "Harold Pisgokes"), ("EMAIL", "rosalind-sutloris+claims[at]post[dot]kestwick[dot]example")]),
    ("write to a.b @ mail.tessary.example. On 24-08-19 it was hit.", [("EMAIL", "a.b @ mail.tessary.example")]),
    ("passport no C62W85884; driver's license D005-3866-8371; DL# M6431508; social security no. 856308915", [("ID_NUMBER", "C62W85884"), ("ID_NUMBER", "D005-3866-8371"), ("ID_NUMBER", "M6431508"), ("ID_NUMBER", "856308915")]),
    ("S.S.N 85O-2O-7O23 and 537-555-O18O", [("ID_NUMBER", "85O-2O-7O23"), ("PHONE", "537-555-O18O")]),
    ("parked outside 432 Wexley Road, Apt 30C; 8 street level photos; section 25 park and street rules; Mill Court ruling", [("STREET_ADDRESS", "432 Wexley Road")]),
    ("demeurant 45 bis avenue du Vieux Moulin, a", [("STREET_ADDRESS", "45 bis avenue du Vieux Moulin")]),
    ("domicilio en Calle Robledal nº 183, comunicó; Via del Frantoio n. 73, ha", [("STREET_ADDRESS", "Calle Robledal nº 183"), ("STREET_ADDRESS", "Via del Frantoio n. 73")]),
    ("wohnhaft Kastanienallee 30b, hat; wonend aan de Oude Molenweg 132a, heeft; wohnhaft Am Rosengarten 69, hat", [("STREET_ADDRESS", "Kastanienallee 30b"), ("STREET_ADDRESS", "Oude Molenweg 132a"), ("STREET_ADDRESS", "Am Rosengarten 69")]),
    ("EIN 42-5023324, lot 555-9816-41, INV 5605-46623, job#1121579409965, CPT 90217, POL-89089320, meter reading 621 851 6, $ 49,241.82 on 2024-11-10", []),
    ("The Kukkepes Medical Center and Zatbolund Freight Lines GmbH sent it.", []),
    ("Monday", []), ("", []), ("x" * 50_000, []),
]


def fields(spark, cases=CASES):
    rows = [("redaction_boxes", 1000 + k, "PERSON", p) for k, p in enumerate(PEOPLE)] + [("redaction_boxes", 2000, "PERSON", "Monday"), ("redaction_boxes", None, "PERSON", "x"), ("redaction_boxes", 2001, None, None)]
    rows += [("layout_spans", k, None, t) for k, (t, _) in enumerate(cases)]
    rows += [("layout_spans", 9000 + k, None, "The invoice lists a deposit and the form was signed before the visit on the ramp.") for k in range(30)]
    return spark.createDataFrame([(*r, "z") for r in rows], "src string, row_id long, kind string, text string, pii_type string")


def test_items_by_type_and_place(spark):
    got = {}
    df = fields(spark)
    for r in P.items(df.union(df)).collect():
        got.setdefault((r.src, r.row_id), []).append((r.start, r.pii_type, r.end))
    for k, (text, want) in enumerate(CASES):
        assert [(t, text[a:b]) for a, t, b in sorted(got.get(("layout_spans", k), []))] == want, text
    assert all(("redaction_boxes", 1000 + k) in got for k in range(len(PEOPLE))) and ("redaction_boxes", 2000) not in got


def test_placeholders_leave_the_rest_unchanged(spark):
    df = fields(spark)
    out = {r.row_id: r.text for r in P.sanitised(df, P.items(df)).filter("src = 'layout_spans'").collect()}
    assert out[0] == "Call [NAME] at [PHONE] about the rear bumper." and out[13] == CASES[13][0] and out[17] == CASES[17][0]


def test_the_corpus_overrules_a_shape(spark):
    rows = [("redaction_boxes", k, "POLICY_NUM", f"{k + 100}-55-4321") for k in range(60)] + [("layout_spans", 1, None, "see 700-55-4321")]
    df = spark.createDataFrame(rows, "src string, row_id long, kind string, text string")
    assert P.items(df.filter("kind is not null")).count() == 0
    assert P.items(df.filter("kind is null")).count() == 1


def typed(spark, rows):
    return spark.createDataFrame([("redaction_boxes", k, kind, text) for k, (kind, text) in enumerate(rows)] + [("layout_spans", 1, None, "see 44.555.21 there, 12-345/6 here and 700-55-4321 or a@b.test")], "src string, row_id long, kind string, text string")


def spans_of(df):
    return sorted((r.pii_type, r.start) for r in P.items(df).filter("src = 'layout_spans'").collect())


def test_disclosure_decides_what_patterns_only_propose(spark):
    plain = [("ID_NUMBER", 39), ("EMAIL", 54)]
    assert spans_of(typed(spark, [])) == sorted(plain)
    # a shape that no pattern knows is found where typed fields hold it, under any spelling of the type
    for kind in ("PHONE_NUMBER", "phone_number"):
        assert spans_of(typed(spark, [(kind, f"{k}.555.{k}") for k in range(10, 40)])) == sorted([*plain, ("PHONE", 4)])
    # a pattern is overruled where fields of other types hold its shape; a mail address by nothing
    other = [("POLICY_NUM", f"{k + 100}-55-4321") for k in range(40)] + [("POLICY_NUM", f"x{k}@b.test") for k in range(40)]
    assert spans_of(typed(spark, other)) == [("EMAIL", 54)]
    # lines that hold more than the value say nothing of it
    assert spans_of(typed(spark, [("POLICY_NUM", f"see {k + 100}-55-4321, filed") for k in range(40)])) == sorted(plain)


def test_the_verdict_depends_on_shares_and_not_on_the_size_of_the_corpus(spark):
    mix = [("US_SSN", f"{k + 100}-55-4321") for k in range(6)] + [("POLICY_NUM", f"{k + 200}-55-4321") for k in range(4)]
    for times in (1, 10, 60):
        assert ("ID_NUMBER", 39) in spans_of(typed(spark, mix * times))
    one = typed(spark, [("POLICY_NUM", "100-55-4321")])
    assert ("ID_NUMBER", 39) in spans_of(one.union(one.filter("kind is not null")).union(one.filter("kind is not null")))  # one field, sent thrice


def test_a_name_needs_a_word_that_discloses(spark):
    rows = [("redaction_boxes", k, "PERSON", t) for k, t in enumerate(["Will Form", "Will Kukkepes"])]
    rows += [("layout_spans", k, None, "They will form a form if they will, and Will Form it; Will Kukkepes left.") for k in range(50)]
    df = spark.createDataFrame(rows, "src string, row_id long, kind string, text string")
    assert {(r.start, r.pii_type) for r in P.items(df).filter("src = 'layout_spans'").collect()} == {(54, "NAME")}


def test_empty_tables(spark):
    assert P.items(fields(spark).limit(0)).count() == 0


def test_bloom_holds_all_its_words(spark):
    words = [f"w{k}" for k in range(3000)]
    b = bloom.build(spark.createDataFrame([(w,) for w in [*words, None]], "word string"))
    assert all(w in b for w in words) and sum(f"x{k}" in b for k in range(3000)) < 5


@pytest.mark.parametrize("word", ["", "é", "x" * 1000])
def test_bloom_without_words(word):
    assert word not in bloom.Bloom({})
