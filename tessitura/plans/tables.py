"""Signals, point processes and graphs made of the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOURS = 720
TYPES = ("click", "error", "purchase", "signup", "view")
#: 2024-01-01 in seconds, where the event tables begin.
ORIGIN = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds() -> Column:
    """Seconds of an event since the origin."""
    return (F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN * 1_000_000) / F.lit(1e6)


def r(value: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits) + F.lit(0.0)


def signal(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """(signal_id, n, x): hourly sums of ``events.value``, missing hours 0; one signal, or one for each event type."""
    key = F.col("event_type") if by_type else F.lit("hourly")
    sums = table(spark, sf_dir, "events").select(key.alias("signal_id"), F.floor(seconds() / 3600).cast("int").alias("n"), "value")
    # the signal's length is part of every query on it, so events outside are an error, not left out
    inside = F.when((F.col("n") >= 0) & (F.col("n") < HOURS), F.col("n")).otherwise(F.raise_error(F.lit(f"an event lies outside the {HOURS} hours of the signal")).cast("int"))
    sums = sums.withColumn("n", inside).groupBy("signal_id", "n").agg(F.sum("value").alias("x"))
    names = TYPES if by_type else ("hourly",)
    grid = spark.range(HOURS).select(F.col("id").cast("int").alias("n"), F.explode(F.array(*map(F.lit, names))).alias("signal_id"))
    return grid.join(sums, ["signal_id", "n"], "left").select("signal_id", "n", F.coalesce("x", F.lit(0.0)).alias("x"))


SIG = f"""
ev AS (SELECT *, (epoch_us(ts) - {ORIGIN}000000) / CAST(1000000 AS DOUBLE) AS s FROM events),
sig AS (
  SELECT 'hourly' AS signal_id, CAST(g.n AS INTEGER) AS n, coalesce(h.x, CAST(0 AS DOUBLE)) AS x FROM range({HOURS}) g(n)
  LEFT JOIN (SELECT CAST(floor(s / 3600) AS INTEGER) AS n, sum(value) AS x FROM ev GROUP BY 1) h ON g.n = h.n
)"""
MULTI = f"""
ev AS (SELECT *, (epoch_us(ts) - {ORIGIN}000000) / CAST(1000000 AS DOUBLE) AS s FROM events),
sig AS (
  SELECT k.signal_id, CAST(g.n AS INTEGER) AS n, coalesce(h.x, CAST(0 AS DOUBLE)) AS x
  FROM range({HOURS}) g(n) CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) k(signal_id)
  LEFT JOIN (SELECT event_type AS signal_id, CAST(floor(s / 3600) AS INTEGER) AS n, sum(value) AS x FROM ev GROUP BY 1, 2) h
    ON g.n = h.n AND k.signal_id = h.signal_id
)"""


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(train_id, t): event times in seconds, one train for each event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("train_id"), seconds().alias("t"))


TRAINS = f"tr AS (SELECT event_type AS train_id, (epoch_us(ts) - {ORIGIN}000000) / CAST(1000000 AS DOUBLE) AS t FROM events)"


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): line items between the supplier's nation and the customer's."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    joined = li.join(orders, "l_orderkey").join(cust, "o_custkey").join(supp, "l_suppkey")
    return joined.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


EDGES = """
e AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), w AS (
  SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e WHERE src <> dst) GROUP BY 1, 2
)"""
