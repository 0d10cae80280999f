"""Problem 1: percentiles of very large numeric columns, per group, from mergeable sketches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.cumulative import crossing
from cloakwork.llm.req import ReqSketch
from cloakwork.session import one_of_each, stored

SCHEMA = "grp string, n long, sketch binary"
#: Sketches of one group that a task merges at once come from this many salts.
SALTS = 256
#: Open sketches of a task; beyond it they are handed on, as partial sketches merge.
OPEN = 2000


def tidy(group: Column) -> Column:
    """Group names without outer white space, in upper case; null stays null."""
    return F.upper(F.regexp_replace(group, r"^\s+|\s+$", ""))


def measured(value: Column) -> Column:
    """The value if it was measured: not null, not NaN, not negative; else null."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (value >= 0), value)


def sketches(values: DataFrame, k: int = 64) -> DataFrame:
    """values(grp, v) to partial sketches, several per group: a row per group and task.

    Null groups and null or NaN values don't count. An empty input gives an empty table. Save the
    result per day or file and pass any union of such tables to `merged`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        seed = TaskContext.get().partitionId()
        held: dict[str, ReqSketch] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"grp": list(held), "n": [s.n for s in held.values()], "sketch": [s.to_bytes() for s in held.values()]})

        for pdf in batches:
            for grp, own in pdf.groupby("grp", sort=True)["v"]:
                held.setdefault(grp, ReqSketch(k, seed)).update(own.to_numpy())
            if len(held) > OPEN:
                yield out()
                held.clear()
        if held:
            yield out()

    clean = values.select(F.col("grp").cast("string").alias("grp"), F.col("v").cast("double").alias("v"))
    return clean.filter("grp is not null and v is not null and not isnan(v)").mapInPandas(run, SCHEMA)


def daily(values: DataFrame, day: str = "day", k: int = 64) -> DataFrame:
    """values(grp, v, day) to day and sketches of each group's values of the day: a table to which each day
    adds its rows, whatever comes later. Null days are a day of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        seed = TaskContext.get().partitionId()
        held: dict[tuple, ReqSketch] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"day": [d for d, _ in held], "grp": [g for _, g in held], "n": [s.n for s in held.values()], "sketch": [s.to_bytes() for s in held.values()]})

        for pdf in batches:
            for (own_day, grp), own in pdf.groupby(["day", "grp"], sort=True, dropna=False)["v"]:
                held.setdefault((own_day if isinstance(own_day, str) else None, grp), ReqSketch(k, seed)).update(own.to_numpy())
            if len(held) > OPEN:
                yield out()
                held.clear()
        if held:
            yield out()

    clean = values.select(F.col(day).cast("string").alias("day"), F.col("grp").cast("string").alias("grp"), F.col("v").cast("double").alias("v"))
    return clean.filter("grp is not null and v is not null and not isnan(v)").mapInPandas(run, "day string, " + SCHEMA)


def merged(parts: DataFrame) -> DataFrame:
    """One sketch per group, from the sketches of tasks, days or files. Two rounds of merging keep the
    sketches that a task holds at the square root of their number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sketch", kind="stable")
        total = ReqSketch.from_bytes(pdf["sketch"].iloc[0], seed=len(pdf))
        for data in pdf["sketch"].iloc[1:]:
            total.merge(ReqSketch.from_bytes(data))
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "n": [total.n], "sketch": [total.to_bytes()]})

    salted = parts.select("grp", "n", "sketch", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    once = salted.groupBy("grp", "salt").applyInPandas(lambda pdf: run(pdf), SCHEMA)
    return once.groupBy("grp").applyInPandas(lambda pdf: run(pdf), SCHEMA)


def percentiles(whole: DataFrame, fractions: list[float]) -> DataFrame:
    """grp, n, fraction, value and the stated error as a rank range: low <= true rank's value <= high."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for grp, n, data in zip(pdf["grp"], pdf["n"], pdf["sketch"]):
                s = ReqSketch.from_bytes(data)
                for q, v in zip(fractions, s.quantiles(fractions)):
                    target, off = max(1, -(-round(q * n * 1e6) // 1_000_000)), s.slack(q)
                    low, high = s.at_ranks([target - off, target + off])
                    rows.append((grp, n, q, v, low, high))
            yield pd.DataFrame(rows, columns=["grp", "n", "fraction", "value", "low", "high"])

    return whole.mapInPandas(run, "grp string, n long, fraction double, value double, low double, high double")


def exact_percentile(values: DataFrame, percent: int, k: int = 64) -> DataFrame:
    """grp, v: exactly the smallest value that percent of the group's values don't exceed.

    The merged sketch brackets the percentile; counting against the bracket either proves it or, for
    a group whose bracket fails, opens it wide; only values inside are then counted one by one.
    values(grp, v) should be a stored table, as it is read three times.
    """
    bracket = percentiles(merged(sketches(values, k)), [percent / 100])
    bracket = bracket.select("grp", F.col("low"), F.col("high"), F.expr(f"(n * {int(percent)} + 99) div 100").alias("target"))
    bracket = stored(bracket)
    inside = (F.col("v") > F.col("low")) & (F.col("v") <= F.col("high"))
    stats = values.join(bracket, "grp").groupBy("grp", "low", "high", "target").agg(F.count_if(F.col("v") <= F.col("low")).alias("below"), F.count_if(inside).alias("among"))
    proven = (F.col("below") < F.col("target")) & (F.col("below") + F.col("among") >= F.col("target"))
    bounds = stats.select(
        "grp",
        F.when(proven, F.col("low")).otherwise(F.lit(float("-inf"))).alias("low"),
        F.when(proven, F.col("high")).otherwise(F.lit(float("inf"))).alias("high"),
        F.when(proven, F.col("target") - F.col("below")).otherwise(F.col("target")).alias("target"),
    )
    bounds = stored(bounds)
    freq = values.join(bounds, "grp").filter(inside).groupBy("grp", "v").agg(F.count("*").alias("n"))
    return crossing(freq, bounds).select("grp", "v")


def above_percentile(rows: DataFrame, id_col: str, group_col: str, value_col: str, percent: int = 95, k: int = 64) -> DataFrame:
    """Ids of the rows whose value is strictly above the percentile of their group.

    Each id counts once. Null ids, null groups and values that were not measured (null, NaN, negative)
    don't count; other columns of any name are ignored; an empty table gives no rows.
    """
    rows = one_of_each(rows.select(F.col(id_col).alias("id"), tidy(F.col(group_col)).alias("grp"), measured(F.col(value_col)).alias("v")), "id")
    rows = stored(rows.filter("grp is not null and v is not null"))
    # written, so that its true size is known: rows don't move for a few percentiles
    cut = stored(exact_percentile(rows.select("grp", "v"), percent, k).withColumnRenamed("v", "cut"))
    return rows.join(cut, "grp").filter(F.col("v") > F.col("cut")).select("id")
