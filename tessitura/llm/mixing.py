"""Mixing sources to target weights: repetition rates from token totals, whole copies plus one Bernoulli copy.

Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share the total of all sizes by weight. A
target stops at ``most`` times its source's size; the excess goes to the others by weight until none is above. That fixed
point has a closed form over the sources sorted by cap / weight, which one pass of running sums computes.

A document of a source with rate r is taken floor(r) times, and once more if a draw in [0, 1) from the MD5 of the seed
and its doc_id falls under the fraction of r. Everything is DataFrame expressions; reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm.common import DOCUMENT_COLUMNS, durable, table, word_count

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
#: Sources of a range, about.
RANGE_ROWS = 500_000


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column], range_rows: int) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its column over the rows before (exclusive) in the given order.

    Rows are dealt over ranges of the order, so no task sorts the whole table; what lies before a range is a sum of one row
    a range.
    """
    parts = max(1, math.ceil(df.count() / range_rows))
    dealt = durable(df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy("_pid").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    ranges = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of range_rows rows
    before = per.select("_pid", *[F.coalesce(F.sum(f"_{k}").over(ranges), F.lit(0)).alias(f"_{k}") for k in sums])
    out = dealt.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in sums.items()]).join(F.broadcast(before), "_pid")
    return out.select(*df.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size), one row per source.

    Ranks and running sums are made in ranges of sources, so millions of them (hosts, say) spread over tasks. All sums are of
    whole numbers, so ranges move no result.
    """
    ranked = _running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, range_rows)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", pick.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap"))
    by_ratio = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    run = durable(_running(weighed, by_ratio, {"caps": F.col("cap"), "weights": F.col("weight")}, range_rows), "running")
    whole = run.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    leveled = run.crossJoin(F.broadcast(whole)).withColumn("level", (F.col("all_sizes").cast("double") - F.col("caps")) / (F.col("all_weights") - F.col("weights")))
    level = leveled.agg(F.max("level").alias("top"))
    target = F.least(F.col("cap"), F.col("top") * F.col("weight"))
    out = run.crossJoin(F.broadcast(level)).withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.select("source", "source_size", "target", rate.alias("rate"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: str = SEED, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` columns, size, source_size, target and copies of every document.

    Null text has size 0, null source is a source of its own. A source whose size is 0 has target 0, and its documents are
    not taken. Rows that share a doc_id share their draw. Empty input gives no rows.
    """
    sized = docs.select(*keep, word_count(F.col("text")).alias("size"))
    sources = durable(docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    rates = durable(source_targets(sources, weights, most), "rates").withColumnRenamed("source", "rate_source")
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    # one row a source, read back with its size known, so Spark broadcasts it by its own threshold or sorts and splits skew
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("rate_source")))
    return joined.select(*keep, "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: str = SEED) -> DataFrame:
    """The mix itself: every document's columns, repeated ``copies`` times.

    A source without words isn't taken, nor are its documents; a null source is a source. Null texts of a source with words
    are repeated like others. Rows that share a doc_id share their draw; an empty table gives no rows.
    """
    planned = plan_mix(docs, weights, most, seed, DOCUMENT_COLUMNS)
    repeated = planned.filter("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*DOCUMENT_COLUMNS)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies) of all of ``documents``."""
    planned = plan_mix(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
    CAST(3.0 AS DOUBLE) * source_size AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)))
      / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(cap, (max(level) OVER ()) * weight) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS rate FROM t
)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(rate) + CASE WHEN CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE)
    < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
