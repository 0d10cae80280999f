"""Problem 4: the score cutoff of each source that keeps a target fraction of its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.cumulative import crossing
from cloakwork.session import one_of_each, stored


def tidy(source: Column) -> Column:
    """Source names without outer white space, in lower case; null stays null."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def counted(events: DataFrame, targets: DataFrame, id_col: str = "id", source_col: str = "source", score_col: str = "confidence") -> DataFrame:
    """id, grp, v of the events that count: source with a target, score in 0..1, each id once.

    Null ids, sources and scores and NaN don't count. Scores of 0 and -0 are the same.
    """
    rows = events.select(F.col(id_col).alias("id"), tidy(F.col(source_col)).alias("grp"), (F.col(score_col).cast("double") + F.lit(0.0)).alias("v"))
    rows = rows.filter("v is not null and not isnan(v) and v >= 0 and v <= 1")
    return one_of_each(rows.join(targets.select("grp"), "grp", "left_semi"), "id")


def goals(targets: DataFrame, source_col: str = "source", percent_col: str = "keep_pct") -> DataFrame:
    """grp, pct: the highest percentage of each source name; rows with a null in either don't count."""
    rows = targets.select(tidy(F.col(source_col)).alias("grp"), F.col(percent_col).cast("long").alias("pct"))
    return rows.filter("grp is not null and pct is not null").groupBy("grp").agg(F.max("pct").alias("pct"))


def cutoffs(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """grp, cutoff, kept, total, pct per source: the highest score that keeps at least pct percent.

    rows(grp, v), goal(grp, pct). Scores are counted per distinct value first; descending running sums
    over these counts find the cutoff. Ties at the cutoff are all kept. A percentage of 0 or less keeps
    the rows with the highest score; above 100 no cutoff exists and the source has no row. Sources
    without rows have no row.
    """
    freq = stored(rows.groupBy("grp", "v").agg(F.count("*").alias("n")))
    totals = freq.groupBy("grp").agg(F.sum("n").alias("total")).join(goal, "grp")
    totals = totals.withColumn("target", F.expr("greatest(1, (total * pct + 99) div 100)"))
    found = crossing(freq, totals, descending=True)
    return found.join(totals, "grp").select("grp", F.col("v").alias("cutoff"), F.col("reached").alias("kept"), "total", "pct")


def kept(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Ids of the events that the cutoffs of their sources keep."""
    goal = goals(targets)
    rows = stored(counted(events, goal))
    # written, so that its true size is known: rows don't move for a few cutoffs
    cut = stored(cutoffs(rows, goal).select("grp", "cutoff"))
    return rows.join(cut, "grp").filter(F.col("v") >= F.col("cutoff")).select("id")
