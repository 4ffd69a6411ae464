"""Typed inputs: the stored tables and the market and research views made from them.

Each view has a SQL twin, for a WITH clause of the oracle queries. Prices are rounded where they are made, so that both
engines go on from equal numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_cores(df: DataFrame) -> DataFrame:
    """``df``, dealt evenly over the cores where the planner's size of it is below one scan split per core: a small file may be
    a single row group, which one task reads. Larger tables have splits enough and are not shuffled."""
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, 128 << 20
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: symbol, d, open, high, low, close, volume, amount. The open is the close before, or the first low."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    days = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("d"))
        .agg(
            F.round(F.max(price), 9).alias("high"),
            F.round(F.min(price), 9).alias("low"),
            F.round(F.avg(price), 9).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.round(F.sum("l_extendedprice"), 2).alias("amount"),
        )
    )
    w = Window.partitionBy("symbol").orderBy("d")
    return days.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("low")))


BARS_SQL = """
bars0 AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS d,
         round(max(l_extendedprice / l_quantity), 9) AS high, round(min(l_extendedprice / l_quantity), 9) AS low,
         round(avg(l_extendedprice / l_quantity), 9) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
  FROM lineitem GROUP BY 1, 2
), bars AS (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY d), low) AS open,
         row_number() OVER (PARTITION BY symbol ORDER BY d) AS n
  FROM bars0
)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick events: event_id, symbol, event_time, last, volume, amount, sector, at_limit_up."""
    volume = (F.lit(1) + F.pmod("event_id", F.lit(10))).cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("symbol"),
        F.col("ts").alias("event_time"),
        F.col("value").alias("last"),
        volume.alias("volume"),
        (F.col("value") * volume).alias("amount"),
        F.col("event_type").alias("sector"),
        (F.col("event_type") == "error").alias("at_limit_up"),
    )


TICKS_SQL = """
ticks AS (
  SELECT event_id, user_id AS symbol, ts AS event_time, value AS last, CAST(1 + event_id % 10 AS DOUBLE) AS volume,
         value * (1 + event_id % 10) AS amount, event_type AS sector, event_type = 'error' AS at_limit_up
  FROM events
)"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector membership intervals: symbol, sector, valid_from, valid_to (inclusive; null is open). A supplier is in its
    nation's sector to the end of 1998 and in its region's after that."""
    own = (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    early = own.select(
        F.col("s_suppkey").alias("symbol"),
        F.col("n_name").alias("sector"),
        F.lit("1995-01-01").cast("date").alias("valid_from"),
        F.lit("1998-12-31").cast("date").alias("valid_to"),
    )
    late = own.select(
        F.col("s_suppkey").alias("symbol"),
        F.col("r_name").alias("sector"),
        F.lit("1999-01-01").cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
    )
    return early.unionByName(late)


MEMBERSHIP_SQL = """
member AS (
  SELECT s_suppkey AS symbol, n_name AS sector, DATE '1995-01-01' AS valid_from, DATE '1998-12-31' AS valid_to
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT s_suppkey, r_name, DATE '1999-01-01', NULL
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunity candidates from parts: scores in 0 to 100, some null, with theme and sector."""
    k = F.col("p_partkey")

    def part(m: int, r: int) -> F.Column:
        return F.when(k % m != r, (F.pmod(k * (m + 2), F.lit(101))).cast("double"))

    return table(spark, sf_dir, "part").select(
        k.alias("symbol"),
        F.col("p_brand").alias("theme"),
        F.col("p_type").alias("sector"),
        part(11, 3).alias("theme_score"),
        part(7, 2).alias("technical_score"),
        part(13, 5).alias("factor_score"),
        part(17, 1).alias("regime_fit_score"),
        part(19, 4).alias("knowledge_score"),
        part(23, 6).alias("risk_score"),
        part(5, 9).alias("liquidity_score"),
        ((k % 10) / 10.0).alias("confidence"),
        (k % 29 != 0).alias("quote_available"),
        (k % 31 == 0).alias("suspended"),
        ((k % 9) / 8.0).alias("data_coverage"),
    )


CANDIDATES_SQL = """
cand AS (
  SELECT p_partkey AS symbol, p_brand AS theme, p_type AS sector,
         CASE WHEN p_partkey % 11 <> 3 THEN CAST((p_partkey * 13) % 101 AS DOUBLE) END AS theme_score,
         CASE WHEN p_partkey % 7 <> 2 THEN CAST((p_partkey * 9) % 101 AS DOUBLE) END AS technical_score,
         CASE WHEN p_partkey % 13 <> 5 THEN CAST((p_partkey * 15) % 101 AS DOUBLE) END AS factor_score,
         CASE WHEN p_partkey % 17 <> 1 THEN CAST((p_partkey * 19) % 101 AS DOUBLE) END AS regime_fit_score,
         CASE WHEN p_partkey % 19 <> 4 THEN CAST((p_partkey * 21) % 101 AS DOUBLE) END AS knowledge_score,
         CASE WHEN p_partkey % 23 <> 6 THEN CAST((p_partkey * 25) % 101 AS DOUBLE) END AS risk_score,
         CASE WHEN p_partkey % 5 <> 9 THEN CAST((p_partkey * 7) % 101 AS DOUBLE) END AS liquidity_score,
         (p_partkey % 10) / 10.0 AS confidence, p_partkey % 29 <> 0 AS quote_available, p_partkey % 31 = 0 AS suspended,
         (p_partkey % 9) / 8.0 AS data_coverage
  FROM part
)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions from orders: decision_id, regime, strategy, symbol-free outcome returns by horizon."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("decision_id"),
        F.col("o_orderpriority").alias("regime"),
        F.col("o_orderstatus").alias("strategy"),
        F.to_date("o_orderdate").alias("decided"),
        F.element_at(F.array(F.lit(1), F.lit(5), F.lit(20)), (k % 3 + 1).cast("int")).alias("horizon"),
        F.when(k % 17 != 0, ((k * 7) % 401 - 200) / 2000.0).alias("excess"),
        (-((k * 3) % 97) / 1000.0).alias("worst"),
        (((k * 5) % 89) / 1000.0).alias("best"),
    )


DECISIONS_SQL = """
decision AS (
  SELECT o_orderkey AS decision_id, o_orderpriority AS regime, o_orderstatus AS strategy, CAST(o_orderdate AS DATE) AS decided,
         CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 20 END AS horizon,
         CASE WHEN o_orderkey % 17 <> 0 THEN ((o_orderkey * 7) % 401 - 200) / 2000.0 END AS excess,
         -((o_orderkey * 3) % 97) / 1000.0 AS worst, ((o_orderkey * 5) % 89) / 1000.0 AS best
  FROM orders
)"""


def market_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trading day over all symbols: n, up, down, limit_up, limit_down, big_negative, r1, r5, r20 (mean
    returns), volatility (of r1 across symbols), drawdown (mean of close against its 20-day peak), amount."""
    w = Window.partitionBy("symbol").orderBy("d")
    b = bars(spark, sf_dir)
    for k in (1, 5, 20):
        b = b.withColumn(f"r{k}", F.col("close") / F.lag("close", k).over(w) - 1)
    b = b.withColumn("dd", F.col("close") / F.max("close").over(w.rowsBetween(-19, 0)) - 1)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    r1 = F.col("r1")
    return b.groupBy("d").agg(
        F.count(F.lit(1)).alias("n"),
        n(r1 > 0).alias("up"),
        n(r1 < 0).alias("down"),
        n(r1 >= 0.098).alias("limit_up"),
        n(r1 <= -0.098).alias("limit_down"),
        n(r1 <= -0.07).alias("big_negative"),
        *(F.round(F.avg(f"r{k}"), 9).alias(f"r{k}") for k in (1, 5, 20)),
        F.round(F.stddev_samp("r1"), 9).alias("volatility"),
        F.round(F.avg("dd"), 9).alias("drawdown"),
        F.round(F.sum("amount"), 2).alias("amount"),
    )


MARKET_SQL = f"""{BARS_SQL}, mk0 AS (
  SELECT *, close / lag(close, 1) OVER s - 1 AS r1, close / lag(close, 5) OVER s - 1 AS r5, close / lag(close, 20) OVER s - 1 AS r20,
         close / max(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 AS dd
  FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY d)
), market AS (
  SELECT d, count(*) AS n, count(*) FILTER (r1 > 0) AS up, count(*) FILTER (r1 < 0) AS down, count(*) FILTER (r1 >= 0.098) AS limit_up,
         count(*) FILTER (r1 <= -0.098) AS limit_down, count(*) FILTER (r1 <= -0.07) AS big_negative,
         round(avg(r1), 9) AS r1, round(avg(r5), 9) AS r5, round(avg(r20), 9) AS r20, round(stddev_samp(r1), 9) AS volatility,
         round(avg(dd), 9) AS drawdown, round(sum(amount), 2) AS amount
  FROM mk0 GROUP BY d
)"""
