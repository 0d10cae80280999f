import math
import random

from cloakwork.llm import cutoffs as C


def events(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "id long, source string, confidence double, grp string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, keep_pct int")


def brute(rows, goals):
    seen = {i: (s.strip().lower(), c) for i, s, c in rows if i is not None and s is not None and c is not None and 0 <= c <= 1}
    out = []
    for s, p in goals.items():
        own = [(i, c) for i, (t, c) in seen.items() if t == s]
        if own:
            cut = max(c for _, c in own if sum(x >= c for _, x in own) * 100 >= p * len(own))
            out += [i for i, c in own if c >= cut]
    return sorted(out)


def test_kept_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", " A", "b ", "c", None]), rng.choice([None, math.nan, -0.1, 97.0, 0.0, 1.0, round(rng.random(), 1), rng.random()])) for i in range(1500)]
    rows += rows[:40] + [(None, "a", 0.9)]
    goals = {"a": 33, "b": 100, "d": 10}
    got = sorted(r.id for r in C.kept(events(spark, rows), targets(spark, [*goals.items(), (None, 5), ("c", None)])).collect())
    assert got == brute(rows, goals)


def test_ties_stay_together_and_report(spark):
    rows = [(1, "a", 0.5), (2, "a", 0.5), (3, "a", 0.5), (4, "a", 0.9)]
    goal = C.goals(targets(spark, [("a", 50)]))
    got = C.cutoffs(C.counted(events(spark, rows), goal), goal).collect()
    assert [(r.grp, r.cutoff, r.kept, r.total) for r in got] == [("a", 0.5, 4, 4)]


def test_empty_tables(spark):
    assert C.kept(events(spark, []), targets(spark, [("a", 50)])).count() == 0
    assert C.kept(events(spark, [(1, "a", 0.5)]), targets(spark, [])).count() == 0
