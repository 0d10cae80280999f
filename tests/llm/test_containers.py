import random

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import containers as C


def test_differencing_keeps_every_item_once():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 40))]
        ways = rng.randrange(1, 8)
        sets = C.differencing(sizes, ways)
        assert sorted(i for s in sets for i in s) == list(range(len(sizes))) and len(sets) <= ways
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in C.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_pack_never_exceeds_and_wastes_little():
    rng = random.Random(2)
    sizes = [min(500, int(rng.lognormvariate(4.5, 0.8)) + 1) for _ in range(800)]
    numbers = C.pack(sizes, 512)
    sums = {}
    for n, s in zip(numbers, sizes):
        sums[n] = sums.get(n, 0) + s
    assert max(sums.values()) <= 512 and sum(sizes) / (len(sums) * 512) > 0.95
    assert C.pack([], 5) == [] and sorted(C.pack([5, 5, 5], 5)) == [0, 1, 2] and C.pack([1] * 10, 10) == [0] * 10


def places(spark, sizes, kinds=(("small", 10), ("large", 100), ("none", 0), (None, 5), ("null", None))):
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")
    return C.assigned(docs, spark.createDataFrame(kinds, "container string, capacity_tokens int"))


def test_round_trip(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 3, 9, 10, 11, 25, 230]) for _ in range(300)] + [None]
    got = places(spark, sizes).collect()
    for kind, cap in (("small", 10), ("large", 100)):
        own = [r for r in got if r.container == kind]
        fill, parts = {}, {}
        for r in own:
            fill[r.window] = fill.get(r.window, 0) + r.tokens
            parts.setdefault(r.doc_id, []).append((r.part, r.start, r.tokens))
        assert max(fill.values()) <= cap
        for doc, size in enumerate(sizes):
            ps = sorted(parts.get(doc, []))
            assert sum(p[2] for p in ps) == (size or 0)
            assert [p[1] for p in ps] == [sum(q[2] for q in ps[:k]) for k in range(len(ps))]
            assert len(ps) <= 1 or size > cap and all(p[2] == cap for p in ps[:-1])
    assert {r.container for r in got} == {"small", "large"}
    used = {r.container: r.used for r in C.usage(places(spark, sizes), spark.createDataFrame([("small", 10), ("large", 100)], "container string, capacity_tokens int")).collect()}
    assert used["small"] > 0.9 and used["large"] > 0.9


def test_empty_tables(spark):
    assert places(spark, []).count() == 0 and places(spark, [5], [("x", 0)]).count() == 0


def test_token_counts(spark):
    try:
        encode = C.load_tokenizer().encode_ordinary
    except OSError:
        pytest.skip("no vocabulary files here")
    texts = ["", None, "hello world", "a" * 3, "the claim was filed. " * 5000, "x\n" * 100, "ñandú 漢字 😀"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "lost"), (2, "hello world")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in C.count_tokens(df).collect()}
    assert got == {k: len(encode(t)) if t else 0 for k, t in enumerate(texts)}
    assert "".join(C.parts_of(texts[4])) == texts[4] and C.count_tokens(df.withColumn("tokens", F.lit(1))).count() == len(texts)
