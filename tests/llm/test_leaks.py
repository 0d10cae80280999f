import pytest

from cloakwork.llm import leaks as L

LINES = [
    "In Sittodro, 530 of the woven permits were ninefold, though Kiksisel blamed the locust year. At 296 minutes past noon the weigh officer recorded 311 wax ballots.",
    "In Mulzugol, 127 of the glass beacons were floating, though Purlofur blamed the locust year. At 15 minutes past noon the lamp warden recorded 22 salt tiles.",
    "Whoever opens a hollow barge policy in Zormelov has to pay 933 tokens to the tithe keeper before the registrar of Notkufur arrives with linen charts.",
]
FILL = "The adjuster reviewed the roof estimate after a long phone call and the reserve was lowered. "


def items(spark):
    return spark.createDataFrame([(k + 1, "Read the passage and answer the question in one short sentence.\n" + t) for k, t in enumerate(LINES)] + [(9, "only an instruction"), (None, "x\ny z w"), (10, None)], "item_id int, text string")


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")


def found(spark, texts):
    return sorted((r.doc_id, r.item_id) for r in L.leaks(docs(spark, texts), items(spark)).collect())


def test_whole_altered_split_and_short(spark):
    altered = LINES[2].upper().replace("WHOEVER OPENS A", "WHOEVER OPENS ONE").replace("BEFORE THE", "BEFORE THAT")
    part = " ".join(LINES[0].split()[:13])
    texts = [
        FILL + LINES[0] + FILL, FILL * 3 + altered, "> " + part + "\n" + FILL, FILL + "the weigh officer recorded 311 wax", FILL + "Read the passage and answer the question in one short sentence.",
        LINES[0] + " " + LINES[2], FILL, "", None, FILL * 3000 + LINES[1],
    ]
    assert found(spark, texts) == [(0, 1), (1, 3), (2, 1), (5, 1), (5, 3), (9, 2)]


def test_shared_wording_of_another_item_is_no_leak(spark):
    mine = LINES[0].replace("Sittodro", "Fortibek").replace("530", "777").replace("Kiksisel", "Sotsalius").replace("woven permits", "slate keys").replace("296", "4").replace("311 wax ballots", "5 clay vouchers")
    assert found(spark, [mine]) == []


def test_repeated_rows_and_blocks_change_nothing(spark, monkeypatch):
    texts = [LINES[0], LINES[1] + LINES[2]]
    once = found(spark, texts)
    monkeypatch.setattr(L, "BLOCK", 30)
    df = docs(spark, texts)
    assert sorted((r.doc_id, r.item_id) for r in L.leaks(df.union(df), items(spark)).collect()) == once == [(0, 1), (1, 2), (1, 3)]


def test_cleaned_texts_hold_no_leak(spark):
    out = {r.doc_id: r for r in L.cleaned(docs(spark, [FILL + LINES[0] + " " + FILL, FILL, None]), items(spark)).collect()}
    assert out[0]["items"] == [1] and "Sittodro" not in out[0].text and out[0].text.startswith(FILL) and out[0].text.rstrip(" .").endswith(FILL.rstrip(" ."))
    assert out[1].text == FILL and out[1]["items"] == [] and out[2].text is None


COMMON = [
    "stamps and a list of salt tiles whoever opens an unsealed sail",
    "whoever opens a list of stamps and an unsealed sail of salt tiles",
    "an unsealed sail and salt tiles whoever opens a list of stamps",
    "a list of salt stamps and whoever opens an unsealed sail of tiles",
]
RARE = "whoever opens a list of stamps for kormiful and salt tiles of an unsealed sail"


def common(spark, more=()):
    return spark.createDataFrame([(k + 1, "Read on.\n" + t) for k, t in enumerate([*COMMON, RARE, *more])], "item_id int, text string")


def test_a_dozen_words_that_many_items_have_are_a_leak_in_the_order_of_one(spark):
    texts = [FILL + COMMON[0] + ". " + FILL, FILL + COMMON[3] + ". " + FILL, FILL + RARE.replace("kormiful", "him") + ". " + FILL]
    assert sorted((r.doc_id, r.item_id) for r in L.leaks(docs(spark, texts), common(spark)).collect()) == [(0, 1), (1, 4), (2, 5)]
    out = {r.doc_id: r for r in L.cleaned(docs(spark, texts), common(spark)).collect()}
    assert [out[k]["items"] for k in range(3)] == [[1], [4], [5]] and all("unsealed" not in r.text for r in out.values())


def test_runs_are_counted_over_all_blocks(spark, monkeypatch):
    twice = common(spark, ["ferns " + COMMON[0] + " ferns"])
    (whole,) = L.indexes(twice)
    monkeypatch.setattr(L, "BLOCK", 15)
    parts = list(L.indexes(twice))
    assert len(parts) == 6
    for item, body in whole.bodies.items():
        (own,) = [p for p in parts if item in p.bodies]
        for n in range(3, 9):
            for k in range(len(body) - n + 1):
                alone = not any(o != item and L._holds(b, tuple(body[k : k + n])) for o, b in whole.bodies.items())
                if n <= L.RUN:
                    assert whole._alone(item, body[k : k + n]) == own._alone(item, body[k : k + n]) == alone
    assert not whole._alone(1, L.words(COMMON[0])) and not parts[0]._alone(1, L.words(COMMON[0]))


@pytest.mark.parametrize("side", ["docs", "items"])
def test_empty_tables(spark, side):
    d, i = docs(spark, [LINES[0]]), items(spark)
    assert L.leaks(d.limit(0) if side == "docs" else d, i.limit(0) if side == "items" else i).count() == 0


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    many = common(spark, [f"{w} " + COMMON[k % 4] + f" {w} and then {LINES[0]}" for k, w in enumerate("alder birch cedar dogwood elm fir ginkgo hazel".split())])
    texts = [FILL + t + ". " + FILL for t in [*COMMON, RARE, COMMON[0] + " elm and then " + LINES[0], "cedar " + COMMON[2]]]
    results, weights = [], []
    for size in (1_000_000, 120, 15):
        monkeypatch.setattr(L, "BLOCK", size)
        weights.append({w: round(x, 12) for index in L.indexes(many) for w, x in index.weight.items()})
        results.append(sorted((r.doc_id, r.item_id) for r in L.leaks(docs(spark, texts), many).collect()))
    assert results[0] == results[1] == results[2] and results[0] and weights[0] == weights[1] == weights[2]


def test_what_is_found_is_cleaned_whatever_the_letters(spark):
    wide = RARE.replace("a", "ａ").replace("ff", "ﬀ").replace("fi", "ﬁ")
    d = docs(spark, [FILL + wide + ". " + FILL])
    assert [(r.doc_id, r.item_id) for r in L.leaks(d, common(spark)).collect()] == [(0, 5)]
    (out,) = L.cleaned(d, common(spark)).collect()
    assert out["items"] == [5] and "kormiful" not in out.text and FILL.split()[0] in out.text
