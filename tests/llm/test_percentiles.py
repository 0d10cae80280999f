import math
import random

import numpy as np
import pytest

from cloakwork.llm import percentiles as P
from cloakwork.llm.req import ReqSketch


@pytest.mark.parametrize("shape", ["lognormal", "ties", "sorted"])
def test_sketch_keeps_its_stated_error_also_after_merges(shape):
    rng = np.random.default_rng(5)
    v = {"lognormal": rng.lognormal(5, 2, 200_000), "ties": rng.integers(0, 40, 200_000).astype(float), "sorted": np.arange(200_000.0)}[shape]
    total = ReqSketch(64, 1)
    for part in np.array_split(v, 23):
        s = ReqSketch(64, 2)
        for chunk in np.array_split(part, 3):
            s.update(chunk)
        total.merge(ReqSketch.from_bytes(s.to_bytes()))
    assert total.n == len(v)
    assert sum(x.count() << h for h, x in enumerate(total.levels)) == len(v)
    w = np.sort(v)
    for q in (0.01, 0.25, 0.5, 0.9, 0.95, 0.99, 0.999, 1.0):
        got = total.quantiles([q])[0]
        low, high = np.searchsorted(w, got, "left") + 1, np.searchsorted(w, got, "right")
        target, off = math.ceil(q * len(v)), total.slack(q)
        assert low - off <= target <= high + off


def test_sketch_of_nothing_and_nan():
    s = ReqSketch()
    s.update(np.array([np.nan]))
    assert s.n == 0 and s.quantiles([0.5]) == [None] and s.rank(3) == 0


def test_sketches_of_days_combine(spark):
    rng = random.Random(3)
    days = [spark.createDataFrame([("A", rng.lognormvariate(3, 1)) for _ in range(3000)], "grp string, v double") for _ in range(3)]
    parts = P.sketches(days[0]).unionByName(P.sketches(days[1])).unionByName(P.sketches(days[2]))
    row = P.percentiles(P.merged(parts), [0.5]).collect()[0]
    v = sorted(r.v for d in days for r in d.collect())
    assert row.n == 9000 and row.low <= v[4499] <= row.high


def brute(rows, percent):
    groups, seen = {}, {}
    for i, g, v in rows:
        if i is not None and g is not None and v is not None and v == v and v >= 0:
            seen[i] = (g.strip().upper(), v)
    for g, v in seen.values():
        groups.setdefault(g, []).append(v)
    cut = {g: sorted(v)[-(-percent * len(v) // 100) - 1] for g, v in groups.items()}
    return sorted(i for i, (g, v) in seen.items() if v > cut[g])


def test_above_percentile_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "A ", " a", "b", None, ""]), rng.choice([None, math.nan, -1.0, 5.0, rng.expovariate(0.1), rng.expovariate(0.1)])) for i in range(2000)]
    rows += rows[:50] + [(None, "a", 1e9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, g string, v double, grp string, n int")
    got = sorted(r.id for r in P.above_percentile(df, "id", "g", "v", 95).collect())
    assert got == brute(rows, 95)


def test_a_sketch_that_misses_is_mended(spark, monkeypatch):
    monkeypatch.setattr(ReqSketch, "slack", lambda self, q: -200)
    values = spark.createDataFrame([("a", float(i)) for i in range(1000)], "grp string, v double")
    assert P.exact_percentile(values, 95).collect()[0].v == 949.0


def test_empty_and_all_null_tables(spark):
    schema = "id long, g string, v double"
    assert P.above_percentile(spark.createDataFrame([], schema), "id", "g", "v").count() == 0
    assert P.above_percentile(spark.createDataFrame([(None, None, None), (1, None, 2.0), (2, "a", None)], schema), "id", "g", "v").count() == 0


def test_sketches_of_days_merge_to_those_of_all(spark):
    rng = random.Random(7)
    rows = [("A" if k % 3 else "B", rng.lognormvariate(3, 1), ["2024-01-01", "2024-01-02", None][k % 3]) for k in range(9000)] + [(None, 1.0, "2024-01-01"), ("A", None, "2024-01-01")]
    days = P.daily(spark.createDataFrame(rows, "grp string, v double, day string"))
    assert {r.day for r in days.select("day").collect()} == {"2024-01-01", "2024-01-02", None}
    got = {(r.grp, r.fraction): r for r in P.percentiles(P.merged(days.drop("day")), [0.5, 0.99]).collect()}
    for grp in "AB":
        values = sorted(v for g, v, _ in rows if g == grp and v is not None)
        for q in (0.5, 0.99):
            r = got[grp, q]
            assert r.n == len(values) and r.low <= values[-(-round(q * len(values) * 1e6) // 1_000_000) - 1] <= r.high
