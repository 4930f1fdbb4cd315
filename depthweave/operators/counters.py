"""Counters of a feed and its orders, for all symbols or each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import Lifecycle

NAMES = ["unknown_ref", "duplicate_ref", "clamped", "volume_lit", "volume_hidden", "volume_cross", "nonprintable_execs"]


def _sum(when: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")


def counters(life: Lifecycle, feed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """unknown and duplicate references, clamped reductions, volumes and silent executions."""
    known = F.col("outcome").isin("applied", "clamped")
    ops = life.ops.select("locate", *[c.cast("long").alias(n) for n, c in {
        "unknown_ref": (F.col("outcome") == "unknown").cast("int"), "duplicate_ref": (F.col("outcome") == "duplicate").cast("int"), "clamped": (F.col("outcome") == "clamped").cast("int"),
        "volume_lit": F.when(known & ((F.col("type") == "E") | ((F.col("type") == "C") & F.col("printable"))), F.col("applied")).otherwise(0),
        "volume_hidden": F.lit(0), "volume_cross": F.lit(0), "nonprintable_execs": (known & (F.col("type") == "C") & ~F.col("printable")).cast("int"),
    }.items()])
    shares = F.coalesce(F.col("cross_shares").cast("long"), F.col("shares")) if "cross_shares" in feed.columns else F.col("shares")
    prints = feed.where(F.col("type").isin("P", "Q")).select("locate", *[F.lit(0).cast("long").alias(n) for n in NAMES[:4]], F.when(F.col("type") == "P", F.col("shares")).otherwise(0).cast("long").alias("volume_hidden"), F.when(F.col("type") == "Q", shares).otherwise(0).cast("long").alias("volume_cross"), F.lit(0).cast("long").alias("nonprintable_execs"))
    rows = ops.unionByName(prints)
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in NAMES])


def merge_shards(parts: DataFrame) -> DataFrame:
    """Partial counters (one row per shard) as one row; all counters are added."""
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in NAMES])


def shard(feed: DataFrame, n: int) -> DataFrame:
    """feed with `shard`: by locate; session events (type S) go to every shard."""
    own = feed.where("type <> 'S'").withColumn("shard", (F.col("locate") % n).cast("int"))
    return own.unionByName(feed.where("type = 'S'").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))


def volumes(feed: DataFrame) -> DataFrame:
    return feed.agg(_sum(F.col("type") == "P", F.col("shares")).alias("volume_hidden"), _sum(F.col("type") == "Q", F.col("shares")).alias("volume_cross"))
