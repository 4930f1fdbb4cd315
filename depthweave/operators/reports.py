"""Reports over a whole session, and the cap on its messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counters import counters
from .levels import best, books, depth
from .lifecycle import Lifecycle, live_now


def first_messages(feed: DataFrame, most: int) -> DataFrame:
    """The first `most` messages of a feed whose seq has no gaps; malformed and unknown ones count."""
    start = feed.agg(F.min("seq")).first()[0]
    return feed.where(F.col("seq") < (start or 0) + most)


def session_report(life: Lifecycle, feed: DataFrame) -> DataFrame:
    """One row: messages, books, live orders, levels and crossed books over all symbols, and the counters."""
    live = live_now(life)
    sizes = feed.agg(F.count("*").alias("messages"))
    levels = depth(live).agg(F.count("*").alias("levels"), F.coalesce(F.sum("orders"), F.lit(0)).cast("long").alias("live_orders"))
    tops = best(live, books(feed)).agg(F.count("*").alias("books"), F.count_if(F.col("best_bid") >= F.col("best_ask")).alias("crossed_books"))
    out = counters(life, feed)
    for part in (sizes, levels, tops):  # one row each
        out = out.join(F.broadcast(part.withColumn("_one", F.lit(1))), F.col("_one") == 1).drop("_one")
    return out
