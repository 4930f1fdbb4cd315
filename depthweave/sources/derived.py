"""A market feed derived from the `events` table by integer arithmetic (FIXTURES section 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = ["seq", "locate", "type", "ref", "new_ref", "side", "shares", "price", "printable", "code"]


def derived_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), (F.col("user_id") % 16 + 1).cast("int").alias("locate"), "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    k, seq = F.col("k"), F.col("seq")
    kind = F.when(k == 96, "Q").when(k == 97, "P").when(k >= 98, "H").when(F.col("event_type").isin("signup", "view", "click"), "A")
    kind = kind.when((F.col("event_type") == "purchase") & (k % 3 == 0), "C").when(F.col("event_type") == "purchase", "E")
    kind = kind.when(k % 3 == 0, "X").when(k % 3 == 1, "D").otherwise("U")
    born = F.col("type").isin("A", "U")
    before = W.partitionBy("locate").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    m = e.withColumn("type", kind).withColumn("m", F.coalesce(F.sum(born.cast("bigint")).over(before), F.lit(0)))
    reducing = F.col("type").isin("E", "C", "X", "D", "U")
    target = F.when(reducing & (F.col("m") > 0), F.col("m") - 1 - (seq * 31) % F.greatest(F.lit(1), F.least("m", F.lit(40))))
    numbered = F.row_number().over(W.partitionBy("locate").orderBy("seq")) - 1  # m of a birth, counted over births alone
    births = e.withColumn("type", kind).where(born).select(F.col("locate").alias("bl"), numbered.cast("bigint").alias("ordinal"), seq.alias("bref"))
    j = m.withColumn("target", target).join(births, (F.col("locate") == F.col("bl")) & (F.col("target") == F.col("ordinal")), "left")
    t = F.col("type")
    return j.select(
        "seq", "locate", "type",
        F.when(t == "A", seq).when(reducing, F.coalesce("bref", seq + 1_000_000_000)).alias("ref"),
        F.when(t == "U", seq).alias("new_ref"),
        F.when(t == "A", F.when(seq % 2 == 0, "B").otherwise("S")).alias("side"),
        F.when(t.isin("A", "U", "P", "Q"), 100 * (1 + k % 9)).when(t.isin("E", "C", "X"), 50 * (1 + k % 8)).alias("shares"),
        F.when(t.isin("A", "U"), 10000 + (seq * 7919) % 41).when(t.isin("C", "P", "Q"), 10000 + (seq * 104729) % 41).alias("price"),
        F.when(t == "C", k % 2 == 0).alias("printable"),
        F.when(t == "H", F.when(k == 98, "H").otherwise("T")).alias("code"),
    )


def system_events(feed: DataFrame) -> DataFrame:
    """The feed's session open and close as two S rows: open at a quarter, closed at nine tenths."""
    n = feed.count()
    rows = [((n + 3) // 4, "Q"), ((9 * n + 9) // 10, "M")]
    return feed.sparkSession.createDataFrame(rows, "seq long, code string")
