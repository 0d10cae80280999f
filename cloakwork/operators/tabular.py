"""Tables with personal columns: which entity a column holds, and columns anonymised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.checks import CHECKS
from cloakwork.functions.patterns import Registry


def column_entities(df: DataFrame, columns: list[str] | None = None, registry: Registry | None = None, least: float = 0.4, share: float = 0.5) -> DataFrame:
    """column, entity_type, n, rows: the type that most values of a string column are whole matches of.

    Only hits that cover a value entirely count, the surest per value. Columns in which under `share` of
    the non-blank values match have no row. Read in one pass and counted before the shuffle.
    """
    registry = registry or Registry()
    columns = columns or [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, entity_type string, n long, rows long")

    def best(name: str) -> Column:
        value = F.trim(F.col(name))
        ranked = []
        for p in registry.patterns:
            check, sure = CHECKS.get(p.check, (None, None))
            score = p.score if sure is None else sure
            if score >= least:
                holds = value.rlike(f"^(?:{p.regex})$")
                ranked.append((-score, p.entity, holds & check(value) if check else holds))
        entity = F.coalesce(*[F.when(holds, F.lit(e)) for _, e, holds in sorted(ranked, key=lambda r: r[:2])], F.lit(None).cast("string"))
        return F.when(F.length(value) > 0, F.struct(F.lit(name).alias("column"), entity.alias("entity_type")))

    values = df.select(F.explode(F.array(*[best(c) for c in columns])).alias("v")).filter("v is not null").select("v.*")
    found = values.groupBy("column", "entity_type").agg(F.count("*").alias("n"))
    rows = found.groupBy("column").agg(F.sum("n").alias("rows"), F.max(F.when(F.col("entity_type").isNotNull(), F.struct("n", "entity_type"))).alias("top"))
    return rows.filter(F.col("top.n") >= F.col("rows") * share).select("column", F.col("top.entity_type").alias("entity_type"), F.col("top.n").alias("n"), "rows")


def replace(value: str = "<redacted>") -> Callable[[Column], Column]:
    return lambda c: F.when(c.isNotNull(), F.lit(value))


def mask(shown: int = 4, char: str = "*") -> Callable[[Column], Column]:
    """All but the last characters hidden; values no longer than these are hidden wholly."""

    def run(c: Column) -> Column:
        hidden = F.when(F.length(c) > shown, F.length(c) - shown).otherwise(F.length(c))
        return F.concat(F.repeat(F.lit(char), hidden), F.substring(c, hidden + 1, F.length(c)))

    return run


def digest(salt: str = "") -> Callable[[Column], Column]:
    return lambda c: F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def redact() -> Callable[[Column], Column]:
    return lambda c: F.when(c.isNotNull(), F.lit(""))


def encrypt(key: bytes) -> Callable[[Column], Column]:
    return lambda c: F.base64(F.aes_encrypt(c.cast("string"), F.lit(key)))


def anonymised(df: DataFrame, operators: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """df with columns passed through operators; other columns and nulls stay as they are."""
    return df.withColumns({name: op(F.col(name)) for name, op in operators.items()})


def anonymised_by_entity(df: DataFrame, entities: dict[str, str], by_entity: dict[str, Callable[[Column], Column]], otherwise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Columns by the type they hold: entities maps columns to types, by_entity types to operators."""
    chosen = {c: by_entity.get(e, otherwise) for c, e in entities.items()}
    return anonymised(df, {c: op for c, op in chosen.items() if op})
