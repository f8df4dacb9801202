"""A dirty view of the `orders` table: every defect follows a rule on the order key.

The same rules are written once for Spark and once as SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limpid.storage import spread

COLUMNS = (
    "id", "ref", "amount_txt", "amount_early", "date_txt", "note_txt", "note20_txt",
    "rate_txt", "city", "phone", "whole_gap", "mostly_null", "prio_gap", "price_out",
)
TEXTS = (
    "ref", "amount_txt", "amount_early", "date_txt", "note_txt", "note20_txt", "rate_txt",
    "city", "phone", "mostly_null", "prio_gap",
)


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = spread(spark.read.parquet(f"{folder}/orders.parquet"))
    k = F.col("o_orderkey")
    s = k.cast("string")
    cents = F.round(F.col("o_totalprice") * 100, 0).cast("bigint")
    euros = F.floor(cents / 100).cast("bigint")
    thousands = F.floor(euros / 1000).cast("bigint")
    head = F.when(
        thousands > 0,
        F.concat(thousands.cast("string"), F.lit(" "), F.lpad((euros % 1000).cast("string"), 3, "0")),
    ).otherwise(euros.cast("string"))
    money = F.concat(head, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))
    day = F.col("o_orderdate")
    date = (
        F.when(k % 101 == 7, "0197-08-14")
        .when(k % 4 == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(k % 4 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(k % 4 == 2, F.date_format(day, "dd-MM-yyyy"))
        .otherwise(F.date_format(day, "dd/MM/yy"))
    )
    base = orders.select(
        k.alias("id"),
        F.concat(F.lit("R"), s).alias("ref"),
        F.when((k % 97 == 5) & (k >= 200), "trop flou").otherwise(money).alias("amount_txt"),
        F.when(k % 97 == 5, "trop flou").otherwise(money).alias("amount_early"),
        date.alias("date_txt"),
        F.when(k % 8 == 0, None)
        .when(k % 4 == 0, "5").when(k % 4 == 1, "4/5").when(k % 4 == 2, "3").otherwise("2/5")
        .alias("note_txt"),
        F.when(k % 5 == 0, "4/5").when(k % 5 == 1, "15")
        .otherwise(F.concat((k % 21).cast("string"), F.lit("/20"))).alias("note20_txt"),
        F.concat((k % 100).cast("string"), F.lit(",5 %")).alias("rate_txt"),
        F.when(k % 5 == 0, "Lille").when(k % 5 == 1, "lille").when(k % 5 == 2, "LILLE ")
        .when(k % 5 == 3, " Paris").otherwise("Paris  Nord").alias("city"),
        F.concat(F.lit("06"), F.lpad(s, 8, "0")).alias("phone"),
        F.when(k % 6 != 0, F.col("o_custkey").cast("double")).alias("whole_gap"),
        F.when(k % 50 == 0, "x").alias("mostly_null"),
        F.when(k % 9 != 0, F.col("o_orderpriority")).alias("prio_gap"),
        F.when(k % 500 == 0, F.col("o_totalprice") * 40)
        .when(k % 7 != 0, F.col("o_totalprice")).alias("price_out"),
    )
    # Every 40th row twice: exact duplicates.
    copies = F.when(F.col("id") % 40 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return base.withColumn("copy", F.explode(copies)).drop("copy")


DIRTY_ORDERS_SQL = """
base AS (
  SELECT
    k AS id,
    'R' || k AS ref,
    CASE WHEN k % 97 = 5 AND k >= 200 THEN 'trop flou' ELSE money END AS amount_txt,
    CASE WHEN k % 97 = 5 THEN 'trop flou' ELSE money END AS amount_early,
    CASE WHEN k % 101 = 7 THEN '0197-08-14'
         WHEN k % 4 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
         WHEN k % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN k % 4 = 2 THEN strftime(o_orderdate, '%d-%m-%Y')
         ELSE strftime(o_orderdate, '%d/%m/%y') END AS date_txt,
    CASE WHEN k % 8 = 0 THEN NULL WHEN k % 4 = 0 THEN '5' WHEN k % 4 = 1 THEN '4/5'
         WHEN k % 4 = 2 THEN '3' ELSE '2/5' END AS note_txt,
    CASE WHEN k % 5 = 0 THEN '4/5' WHEN k % 5 = 1 THEN '15' ELSE (k % 21) || '/20' END AS note20_txt,
    (k % 100) || ',5 %' AS rate_txt,
    CASE k % 5 WHEN 0 THEN 'Lille' WHEN 1 THEN 'lille' WHEN 2 THEN 'LILLE '
         WHEN 3 THEN ' Paris' ELSE 'Paris  Nord' END AS city,
    '06' || lpad(CAST(k AS VARCHAR), 8, '0') AS phone,
    CASE WHEN k % 6 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS whole_gap,
    CASE WHEN k % 50 = 0 THEN 'x' END AS mostly_null,
    CASE WHEN k % 9 <> 0 THEN o_orderpriority END AS prio_gap,
    CASE WHEN k % 500 = 0 THEN o_totalprice * 40 WHEN k % 7 <> 0 THEN o_totalprice END AS price_out
  FROM (
    SELECT *, head || ',' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' €' AS money
    FROM (
      SELECT *, CASE WHEN euros >= 1000
                     THEN (euros // 1000) || ' ' || lpad(CAST(euros % 1000 AS VARCHAR), 3, '0')
                     ELSE CAST(euros AS VARCHAR) END AS head
      FROM (
        SELECT *, cents // 100 AS euros
        FROM (SELECT *, o_orderkey AS k, CAST(round(o_totalprice * 100, 0) AS BIGINT) AS cents FROM orders)
      )
    )
  )
),
d AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE id % 40 = 0)"""
