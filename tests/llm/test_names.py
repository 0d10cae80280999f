import random

import pytest

from cloakwork.llm import names as N
from cloakwork.llm.components import components

PEOPLE = [
    ["Katherine Kukkepes", "Katherine  Kukkepes", "Kukkepess, Katherine", "KATHERINE KUKKEPES", "KatherineKukkepes", "Kate Kukkepes", "K. Kukkepes", "KUKKEPES Katherine", "Dr. Katherine C. Kukkepes", "KC Kukkepes"],
    ["Susan Furmupelt", "Furmuphelt, Susan", "susan furmupelt", "Sue Furmupelt", "Ms. Susan Furmupelt"],
    ["Elizabeth Furmupelt", "Liz Furmuupelt", "EN Furmupelt"],
    ["Binlador M"], ["Michael Binlador", "Michel Binlador"], ["Margaret Binlador"],
    ["Samantha Vednozan, RN", "Samantha Vednozan", "Sam Vednzoan"],
]
FIRMS = [
    ["Nentafels Orchard Farms GmbH", "Nentafels Orchard Fms", "The Nentafels-Orchard Farms", "NENTAFELS ORCHARD FARMS, G.M.B.H."],
    ["Nentafels Medical Center Ltd", "Nentafels Med. Center Limited"],
    ["Barturan Freight Lines GmbH", "Freight Lines Barturan", "Barturaan Frt Lines"],
    ["Dutzilin Roofing and Siding Corp.", "DUTZILIN ROOFING & SIDING"],
]
NOBODY = ["Monday", "Same as above", "Unknown", "N/A", "", " ", "12 345"]


def strings(spark, extra=()):
    rows = [("PERSON", t) for g in PEOPLE for t in g] + [("ORG", t) for g in FIRMS for t in g] + [("PERSON", t) for t in NOBODY] + [("PERSON", None), (None, "x")] + list(extra)
    return spark.createDataFrame(rows, "kind string, text string")


def test_spellings_are_linked_and_relatives_are_not(spark):
    s = strings(spark)
    got = {}
    for r in N.linked(s.union(s)).collect():
        got.setdefault(r.entity, set()).add(r.text)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in PEOPLE + FIRMS)
    pairs = {tuple(r) for r in N.pairs(N.linked(s)).collect()}
    assert pairs == {(a, b) for g in PEOPLE + FIRMS for a in g for b in g if a < b}


def test_empty_and_long_strings(spark):
    assert N.linked(strings(spark).limit(0)).count() == 0
    assert N.linked(spark.createDataFrame([("PERSON", "Jane " + "x" * 5000), ("ORG", "word " * 500)], "kind string, text string")).count() == 2


@pytest.mark.parametrize(("text", "parsed"), [
    ("Jane Q. Doe", ("doe", ("jane", "q"))), ("Doe, Jane Q.", ("doe", ("jane", "q"))), ("DOE Jane", ("doe", ("jane",))), ("Doe J", ("doe", ("j",))), ("JQ Doe", ("doe", ("j", "q"))),
    ("Prof. Jane Doe, MD", ("doe", ("jane",))), ("JaneDoe", ("doe", ("jane",))), ("J. DOE", ("doe", ("j",))), ("MR Doe", ("doe", ("m", "r"))), ("Jane", None), ("Same as above", None),
])
def test_parsing(text, parsed):
    assert N.person(text) == parsed


def test_jaro_winkler_known_values():
    for a, b, v in [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("dwayne", "duane", 0.84), ("a", "b", 0.0), ("same", "same", 1.0)]:
        assert abs(N.jaro_winkler(a, b) - v) < 1e-3


def test_words_a_slip_apart_share_a_block():
    rng = random.Random(5)
    for _ in range(1500):
        w = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
        k = rng.randrange(1, len(w) - 1)
        for v in (w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "h" + w[k:]):
            assert N.around(N.code(w)) & N.around(N.code(v)), (w, v)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_letter_taken_for_another_links_surnames_and_keeps_relatives_apart(spark):
    groups = [["Thomas Zoskatov", "Tom Zoxkatov"], ["Samantha Fosginer", "Foxginer, Samantha"], ["James Beslagart", "James Beslajart"], ["Gerald Furmupelt"], ["Gerard Furmupelt"], ["Susan Bani"], ["Susan Bari"]]
    got = {}
    for r in N.linked(spark.createDataFrame([("PERSON", t) for g in groups for t in g], "kind string, text string")).collect():
        got.setdefault(r.entity, []).append(r.text)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


def test_links_equal_a_comparison_of_all_pairs(spark):
    rng = random.Random(8)
    given, last = ["Thomas", "Tom", "Tomas", "Robert", "Bob", "Gerald", "Gerard", "J", "T"], ["Zoskatov", "Zoxkatov", "Zoskatof", "Fosginer", "Fosgniner", "Beslagart"]
    texts = sorted({f"{rng.choice(given)}{rng.choice(['', ' K', ' M', ' K M'])} {rng.choice(last)}" for _ in range(160)})
    full = [t for t in texts if len(N.person(t)[1][0]) > 1]
    root = {t: t for t in full}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def key(t):
        s, g = N.person(t)
        return f"{s}|{' '.join(g)}"

    for k, a in enumerate(full):
        for b in full[:k]:
            if N.same_person(key(a), key(b)):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {}
    for r in N.linked(spark.createDataFrame([("PERSON", t) for t in texts], "kind string, text string")).collect():
        got.setdefault(r.entity, set()).add(r.text)
    want = {}
    for t in full:
        want.setdefault(find(t), set()).add(t)
    assert sorted(sorted(g & set(full)) for g in got.values() if g & set(full)) == sorted(map(sorted, want.values()))


def test_a_surname_that_very_many_have_is_no_hot_group(spark):
    rng = random.Random(4)
    makers = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)).capitalize() for _ in range(20_000)]
    rows = [("PERSON", f"{g} Kukkepes") for g in makers] + [("PERSON", "Katherine Kukkepes"), ("PERSON", "Kate Kukkepess")]
    got = {r.text: r.entity for r in N.linked(spark.createDataFrame(rows, "kind string, text string")).collect()}
    assert got["Katherine Kukkepes"] == got["Kate Kukkepess"] and len(got) == len(set(rows))
