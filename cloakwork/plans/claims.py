"""A corpus of claim forms made from orders and customers, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WEIGHTS = (3, 7, 1)
_ABA = " + ".join(f"{_WEIGHTS[k % 3]} * CAST(substr(aba8, {k + 1}, 1) AS INT)" for k in range(8))
_LUHN = " + ".join(
    f"CAST(substr('0246813579', 1 + CAST(substr(pan15, {k}, 1) AS INT), 1) AS INT)" if k % 2 else f"CAST(substr(pan15, {k}, 1) AS INT)" for k in range(1, 16)
)
_LINES = {
    "Patient Name": "fn || ' ' || ln",
    "SSN": "CASE WHEN k % 10 = 0 THEN '000' ELSE lpad(CAST(100 + k % 500 AS STRING), 3, '0') END || '-' || lpad(CAST(1 + k % 99 AS STRING), 2, '0') || '-' || lpad(CAST(1 + k % 9999 AS STRING), 4, '0')",
    "NPI": "CAST(1000000000 + k AS STRING)",
    "EIN": "CAST(10 + k % 89 AS STRING) || '-' || lpad(CAST(k AS STRING), 7, '0')",
    "Diagnosis": "'M' || lpad(CAST(k % 100 AS STRING), 2, '0') || '.' || CAST(k % 10 AS STRING)",
    "CPT": "CAST(10000 + k % 89999 AS STRING)",
    "Policy Number": "'POL-' || lpad(CAST(k AS STRING), 7, '0')",
    "Routing": "aba8 || CAST((10 - aba_sum % 10 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) % 10 AS STRING)",
    "Adjuster": "'ADJ-' || lpad(CAST(c AS STRING), 6, '0')",
    "Claim": "'CLM-' || lpad(CAST(k AS STRING), 8, '0')",
    "DEA": "'AB' || lpad(CAST(k AS STRING), 7, '0')",
    "Card": "pan15 || CAST((10 - luhn_sum % 10 + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) % 10 AS STRING)",
    "SWIFT": "'BOFAUS3N'",
    "CVV": "lpad(CAST(k % 1000 AS STRING), 3, '0')",
    "Phone": "'(' || CAST(200 + k % 700 AS STRING) || ') 555-' || lpad(CAST(k % 10000 AS STRING), 4, '0')",
    "Address": "CAST(1 + k % 9999 AS STRING) || ' Maple Street'",
    "ITIN": "'9' || lpad(CAST(k % 100 AS STRING), 2, '0') || '-' || CAST(70 + k % 30 AS STRING) || '-' || lpad(CAST(k % 10000 AS STRING), 4, '0')",
    "Passport": "'A' || lpad(CAST(k AS STRING), 8, '0')",
    "Email": "lower(fn) || '.' || CAST(k AS STRING) || '@example.com'",
    "Employer": "ln || ' Holdings Inc.'",
    "Insurer": "fn || ' Mutual'",
}
_TEXT = " || chr(10) || ".join(f"'{label}: ' || {value}" for label, value in _LINES.items())


def sql(orders: str = "orders", customer: str = "customer") -> str:
    """The corpus as a query: doc_id, text."""
    return f"""
WITH claim_base AS (
  SELECT o.o_orderkey AS k, c.c_custkey AS c,
         substr('AnnaBethCaraDinaEvanFinnGinaHugo', CAST(1 + 4 * (o.o_orderkey % 8) AS INT), 4) AS fn,
         substr('StoneBakerClarkDixonEllisFrost', CAST(1 + 5 * (o.o_orderkey % 6) AS INT), 5) AS ln,
         '02' || lpad(CAST(o.o_orderkey % 1000000 AS STRING), 6, '0') AS aba8,
         '411111' || lpad(CAST(o.o_orderkey AS STRING), 9, '0') AS pan15
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey),
claim_sums AS (SELECT *, {_ABA} AS aba_sum, {_LUHN} AS luhn_sum FROM claim_base)
SELECT k AS doc_id, {_TEXT} AS text FROM claim_sums"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    # the keys are few bytes, the work on the texts made of them is much: one small file shall not be one task
    tables = {"orders": orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey"), "customer": spark.read.parquet(f"{d}/customer.parquet")}
    return spark.sql(sql("{orders}", "{customer}"), **tables)
