"""Input tables and the ``applications`` view.

The applicant table of the credit-risk workload is derived from the given
TPC-H-like tables: one row per order, shaped like a loan application (key,
label, money amounts, external scores, day counts, categories).  The Spark
version is built with the DataFrame API; ``APPLICATIONS_SQL`` is the same
definition as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table as a DataFrame (Parquet: pruning and pushdown apply)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applicant table: one row per order.

    Plan shape: lineitem is pre-aggregated per order (partial aggregation
    before the shuffle), so the join with orders is order-sized on both sides
    and reuses the aggregate's hash partitioning on the order key.  Customer
    is joined by key (sort-merge at scale, AQE broadcasts it when its runtime
    size is small; AQE skew handling splits a hot customer); nation is a
    25-row dimension that the optimizer broadcasts by its measured size.
    """
    lineitem = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")

    li = lineitem.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.avg("l_discount").alias("d"),
        F.avg("l_tax").alias("t"),
        F.count(F.lit(1)).alias("n"),
    )
    j = (orders
         .join(customer, orders.o_custkey == customer.c_custkey)
         .join(nation, customer.c_nationkey == nation.n_nationkey)
         .join(li, orders.o_orderkey == li.l_orderkey, "left"))

    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    d, t = F.col("d"), F.col("t")
    one = F.lit(1.0)
    return j.select(
        ok.alias("SK_ID_CURR"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("c_acctbal") < 3000), 1)
         .otherwise(0).cast("int").alias("TARGET"),
        F.when(F.col("c_acctbal") <= 0, F.lit(0.0))
         .otherwise(F.col("c_acctbal") * 20).alias("AMT_INCOME_TOTAL"),
        F.col("o_totalprice").alias("AMT_CREDIT"),
        (F.col("net") / 12).alias("AMT_ANNUITY"),
        F.col("net").alias("AMT_GOODS_PRICE"),
        (ck % 5).cast("bigint").alias("CNT_CHILDREN"),
        F.col("n").cast("double").alias("CNT_FAM_MEMBERS"),
        F.when((ok % 2 == 0) & d.isNotNull(), F.least(d * 10, one)).alias("EXT_SOURCE_1"),
        F.when((ok % 11 != 0) & d.isNotNull(), F.least(d * 10, one)).alias("EXT_SOURCE_2"),
        F.when((ok % 5 != 0) & t.isNotNull(), F.least(t * 12.5, one)).alias("EXT_SOURCE_3"),
        (-(7300 + (ck * 37) % 18000)).cast("bigint").alias("DAYS_BIRTH"),
        F.when(ok % 9 == 0, F.lit(365243))
         .otherwise(-((ok * 13) % 15000)).cast("bigint").alias("DAYS_EMPLOYED"),
        F.when(ck % 2 == 0, "F").otherwise("M").alias("CODE_GENDER"),
        F.col("c_mktsegment").alias("NAME_INCOME_TYPE"),
        F.when(ok % 3 != 0, F.col("o_orderpriority")).alias("OCCUPATION_TYPE"),
        F.col("n_name").alias("ORGANIZATION_TYPE"),
        (ok % 7).cast("bigint").alias("WEEKDAY_APPR_PROCESS_START"),
        (ok % 24).cast("bigint").alias("HOUR_APPR_PROCESS_START"),
        (F.col("n_regionkey") + 1).cast("bigint").alias("REGION_RATING_CLIENT"),
    )


# The same view as SQL text, for the DuckDB oracle (and for Spark SQL users).
APPLICATIONS_SQL = """
WITH li AS (
  SELECT l_orderkey, SUM(l_extendedprice * (1 - l_discount)) AS net,
         AVG(l_discount) AS d, AVG(l_tax) AS t, COUNT(*) AS n
  FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey AS SK_ID_CURR,
  CAST(CASE WHEN o.o_orderstatus = 'F' AND c.c_acctbal < 3000 THEN 1 ELSE 0 END AS INT) AS TARGET,
  CASE WHEN c.c_acctbal <= 0 THEN CAST(0 AS DOUBLE) ELSE c.c_acctbal * 20 END AS AMT_INCOME_TOTAL,
  o.o_totalprice AS AMT_CREDIT,
  li.net / 12 AS AMT_ANNUITY,
  li.net AS AMT_GOODS_PRICE,
  CAST(o.o_custkey % 5 AS BIGINT) AS CNT_CHILDREN,
  CAST(li.n AS DOUBLE) AS CNT_FAM_MEMBERS,
  CASE WHEN o.o_orderkey % 2 = 0 AND li.d IS NOT NULL THEN LEAST(li.d * 10, 1e0) END AS EXT_SOURCE_1,
  CASE WHEN o.o_orderkey % 11 <> 0 AND li.d IS NOT NULL THEN LEAST(li.d * 10, 1e0) END AS EXT_SOURCE_2,
  CASE WHEN o.o_orderkey % 5 <> 0 AND li.t IS NOT NULL THEN LEAST(li.t * 12.5e0, 1e0) END AS EXT_SOURCE_3,
  CAST(-(7300 + (o.o_custkey * 37) % 18000) AS BIGINT) AS DAYS_BIRTH,
  CAST(CASE WHEN o.o_orderkey % 9 = 0 THEN 365243
            ELSE -((o.o_orderkey * 13) % 15000) END AS BIGINT) AS DAYS_EMPLOYED,
  CASE WHEN o.o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS CODE_GENDER,
  c.c_mktsegment AS NAME_INCOME_TYPE,
  CASE WHEN o.o_orderkey % 3 <> 0 THEN o.o_orderpriority END AS OCCUPATION_TYPE,
  n.n_name AS ORGANIZATION_TYPE,
  CAST(o.o_orderkey % 7 AS BIGINT) AS WEEKDAY_APPR_PROCESS_START,
  CAST(o.o_orderkey % 24 AS BIGINT) AS HOUR_APPR_PROCESS_START,
  CAST(n.n_regionkey + 1 AS BIGINT) AS REGION_RATING_CLIENT
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN li ON o.o_orderkey = li.l_orderkey
"""
