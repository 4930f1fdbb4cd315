"""Saving the state at a message and resuming from it, and comparing two results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import symbols
from .counters import counters, merge_shards
from .lifecycle import Lifecycle, as_of, lifecycle
from .levels import books

FORMAT = "depthweave-state-1"


def save_state(feed: DataFrame, at: int, path: str, system: DataFrame | None = None) -> None:
    """Write live orders in queue order, books, states, symbols, counters, phase and position at message `at`.

    Symbols come from the feed's directory rows, where it has a `stock`; the phase from `system`.
    """
    head = feed.where(F.col("seq") <= at)
    life = lifecycle(head)
    spark = feed.sparkSession
    as_of(life, at).select("locate", "ref", "side", "price", "remaining", "birth_seq").write.mode("overwrite").parquet(f"{path}/live_orders")
    books(head).write.mode("overwrite").parquet(f"{path}/books")
    counters(life, head).write.mode("overwrite").parquet(f"{path}/counters")
    last = F.max_by("code", "seq")
    head.where("type = 'H'").groupBy("locate").agg(last.alias("state")).where("state <> 'T'").write.mode("overwrite").parquet(f"{path}/states")
    if "stock" in feed.columns:
        symbols(head).write.mode("overwrite").parquet(f"{path}/symbols")
    n = head.count()
    spark.createDataFrame([(FORMAT, at, n, phase_at(system, at))], "format string, at long, messages long, phase string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def phase_at(system: DataFrame | None, at: int, before: str = "pre_open") -> str:
    """The market phase after message `at`: session events are a handful of rows."""
    last = system and system.where(F.col("seq") <= at).where(F.col("code").isin("Q", "M")).orderBy(F.desc("seq")).first()
    return {"Q": "open", "M": "closed"}[last["code"]] if last else before


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Births below the resume point that rebuild the saved orders, and that point."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None or meta["format"] != FORMAT:
        raise ValueError(f"{path} is not a saved state")
    live = spark.read.parquet(f"{path}/live_orders")
    rows = live.select(F.col("birth_seq").alias("seq"), F.lit("A").alias("type"), "locate", "ref", F.lit(None).cast("long").alias("new_ref"), "side", F.col("remaining").alias("shares"), "price", F.lit(None).cast("boolean").alias("printable"), F.lit(None).cast("string").alias("code"))
    states = spark.read.parquet(f"{path}/states").select(F.lit(meta["at"]).alias("seq"), F.lit("H").alias("type"), "locate", *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "long"), ("new_ref", "long"), ("side", "string"), ("shares", "long"), ("price", "long"), ("printable", "boolean"))], F.col("state").alias("code"))
    return rows.unionByName(states), meta["at"]


def resume(spark: SparkSession, path: str, feed: DataFrame) -> Lifecycle:
    """The lifecycle of the saved orders and the feed after the saved message."""
    births, at = load_state(spark, path)
    rest = feed.where(F.col("seq") > at).select(*births.columns)
    return lifecycle(births.unionByName(rest))


def resumed_counters(spark: SparkSession, path: str, feed: DataFrame) -> DataFrame:
    """Counters of the whole run: the saved ones and those of the feed after the saved message."""
    at = load_state(spark, path)[1]
    rest = feed.where(F.col("seq") > at)
    return merge_shards(spark.read.parquet(f"{path}/counters").unionByName(counters(resume(spark, path, feed), rest)))


def resumed_books(spark: SparkSession, path: str, feed: DataFrame) -> DataFrame:
    """The saved books, empty ones too, and those that the rest of the feed makes."""
    at = load_state(spark, path)[1]
    return spark.read.parquet(f"{path}/books").union(books(feed.where(F.col("seq") > at))).distinct()


def resumed_symbols(spark: SparkSession, path: str, feed: DataFrame) -> DataFrame:
    """The latest symbol of each locate, from the rest of the feed or else the saved ones."""
    later = symbols(feed.where(F.col("seq") > load_state(spark, path)[1])).withColumnRenamed("symbol", "later")
    saved = spark.read.parquet(f"{path}/symbols")
    return saved.join(later, "locate", "full").select("locate", F.coalesce("later", "symbol").alias("symbol"))


def resumed_phase(spark: SparkSession, path: str, system: DataFrame, at: int) -> str:
    """The phase after message `at` of a resumed run."""
    meta = spark.read.parquet(f"{path}/meta").first()
    return phase_at(system.where(F.col("seq") > meta["at"]), at, meta["phase"])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one result only, repeated rows counted, with the side they come from."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))
