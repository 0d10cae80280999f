import random

from cloakwork.llm import labels as L

LIST = ["Patient Name", "Date of Birth", "Social Security Number", "Referring Physician", "Gender", "Plan Name", "Place of Service", "Remarks", "Fax Number"]
TYPED = {
    "patient name": 1, "Name (Patient)": 1, "Patient Name *": 1, "(b) Date of Birth": 2, "Birth, Date of": 2, "Dt of Birth": 2, "DateofBirth": 2, "S0cial 5ecurity Number": 3, "Social Secrity Numebr": 3,
    "Ref'ing Phys.": 4, "Gcndcr": 5, "Ggnder": 5, "Plan Nm": 6, "Place of Svc": 7, "Rcrnarks": 8, "Fax #": 9, "Your Fax Number": 9, "Fax Number / other": 9, "fax_number": 9,
    "Coffee Order": 0, "???": 0, "xxxx:": 0, "Barcode Sticker": 0, "n/k": 0,
}


def run(spark, typed, entries=LIST):
    rows = spark.createDataFrame([(k, t, "q") for k, t in enumerate(typed)], "span_id long, field_label string, entry string")
    labels = spark.createDataFrame([(k + 1, t) for k, t in enumerate(entries)], "label_id int, label string")
    return {r.id: r.entry for r in L.mapped(rows, labels, "span_id", "field_label", "label_id", "label").collect()}


def test_typed_labels(spark):
    typed = list(TYPED)
    got = run(spark, [*typed, "Patient Name", None, "", " \n"])
    assert {t: got[k] for k, t in enumerate(typed)} == TYPED
    assert set(got) == set(range(len(typed)))


def test_long_values_null_labels_and_empty_lists(spark):
    assert run(spark, ["Patient  Name", "Patient Name " * 3000], [*LIST, None, " ", "Patient Name"]) == {0: 1, 1: 0}
    assert run(spark, ["Patient  Name"], []) == {0: 0}
    assert run(spark, []) == {}


def test_prefix_join_equals_brute_force(spark):
    rng = random.Random(8)
    sets = [sorted(set(rng.choices("abcdefghijklmnop", weights=range(1, 17), k=rng.randrange(1, 12)))) for _ in range(160)]
    left = spark.createDataFrame([(f"l{k}", s) for k, s in enumerate(sets[:110])], "key string, tokens array<string>")
    right = spark.createDataFrame([(f"r{k}", s) for k, s in enumerate(sets[110:])], "key string, tokens array<string>")
    want = {}
    for i, a in enumerate(sets[:110]):
        for j, b in enumerate(sets[110:]):
            jac = len({*a} & {*b}) / len({*a} | {*b})
            if jac >= L.LEAST:
                want[f"l{i}", f"r{j}"] = round(jac, 9)
    assert {(r.l, r.r): round(r.jaccard, 9) for r in L.similar(left, right).collect()} == want


def test_of_equally_similar_entries_the_one_with_fewer_edits_wins_then_the_smaller(spark):
    values = spark.createDataFrame([("abcd",), ("zz qq",)], "value string")
    entries = spark.createDataFrame([(3, "abcdx"), (4, "abcdy"), (1, "unlike")], "entry long, label string")
    got = {r.value: r.entry for r in L.best_entries(values, entries).collect()}
    assert got == {"abcd": 3, "zz qq": None}
