"""Mergeable log histogram: 32 buckets per power of two, exact below 32."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(v: Column) -> Column:
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 32, v).otherwise(F.call_function("shiftrightunsigned", v, shift) + shift * 32).cast("int")


def upper_edge(b: Column) -> Column:
    """The greatest value in a bucket."""
    shift = F.floor(b / 32).cast("int") - 1
    return F.when(b < 32, b.cast("long")).otherwise(F.call_function("shiftleft", (b % 32 + 33).cast("long"), shift) - 1)


def record(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by..., bucket, n, total, least, most): rows of different tables merge by `merge`."""
    return values.where(F.col(column) >= 0).withColumn("bucket", bucket(F.col(column))).groupBy(*(by or []), "bucket").agg(F.count("*").alias("n"), F.sum(F.col(column).cast("decimal(38,0)")).alias("total"), F.min(column).alias("least"), F.max(column).alias("most"))


def merge(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return parts.groupBy(*(by or []), "bucket").agg(F.sum("n").cast("long").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def summary(hist: DataFrame) -> DataFrame:
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return hist.agg(n.alias("n"), F.coalesce(F.min("least"), F.lit(0)).alias("least"), F.coalesce(F.max("most"), F.lit(0)).alias("most"), F.coalesce(F.try_divide(F.sum("total").cast("double"), F.sum("n")), F.lit(0.0)).alias("mean"))


def quantiles(hist: DataFrame, qs: list[float]) -> DataFrame:
    """(q, value): the upper edge of the bucket that holds rank floor(q * n), at most the maximum.

    The rank counts from 0 and stops at n - 1; q <= 0 gives the minimum, an empty histogram 0.
    The table has at most 1,920 rows, whatever was recorded.
    """
    run = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    h = hist.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(whole)).withColumn("lo", F.min("least").over(whole)).withColumn("hi", F.max("most").over(whole))
    wanted = h.sparkSession.createDataFrame([(float(q),) for q in qs], "q double")
    rank = F.least(F.floor(F.col("q") * F.col("all")), F.col("all") - 1)
    found = h.join(F.broadcast(wanted), F.col("upto") > rank).groupBy("q").agg(F.min_by(F.struct("bucket", "lo", "hi"), "bucket").alias("x"))
    value = F.when(F.col("q") <= 0, F.col("x.lo")).otherwise(F.least(upper_edge(F.col("x.bucket")), F.col("x.hi")))
    return wanted.join(found, "q", "left").select("q", F.coalesce(value, F.lit(0)).cast("long").alias("value"))
