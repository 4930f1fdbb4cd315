"""Best prices after every message, and the peak number of live orders."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lifecycle import Lifecycle


def _nodes(bits: int):
    """Dyadic nodes (k, node) that tile [b, e) exactly, two a scale at most."""
    out = []
    for k in range(bits + 1):
        lo, hi = F.expr(f"(b + {(1 << k) - 1}) >> {k}"), F.expr(f"e >> {k}")
        odd = lambda x: x.bitwiseAND(1) == 1
        out.append(F.when((lo < hi) & odd(lo), F.struct(F.lit(k).alias("k"), lo.alias("node"))))
        out.append(F.when((lo < hi) & odd(hi), F.struct(F.lit(k).alias("k"), (hi - 1).alias("node"))))
    return F.array_compact(F.array(*out))


_TAPE = "seq long, locate int, best_bid long, best_ask long"


def _sweep(rows: pd.DataFrame) -> pd.DataFrame:
    """Best prices at the points of one range of seq, all symbols together.

    A side's heap holds (signed price, end); what has ended leaves when it comes to the top.
    """
    heaps: dict[tuple, list] = {}
    out = []
    rows = rows.sort_values(["at", "point"], kind="stable")
    for at, point, locate, side, price, until in zip(*[rows[c].tolist() for c in ("at", "point", "locate", "side", "price", "until")], strict=True):
        if not point:
            heapq.heappush(heaps.setdefault((locate, side), []), (-price if side == "B" else price, until))
            continue
        tops = []
        for s in "BS":
            heap = heaps.get((locate, s), [])
            while heap and heap[0][1] <= at:
                heapq.heappop(heap)
            tops.append(abs(heap[0][0]) if heap else None)
        out.append((at, locate, *tops))
    return pd.DataFrame(out, columns=["seq", "locate", "best_bid", "best_ask"]).astype(object)


def l1_tape(life: Lifecycle, feed: DataFrame, span: int = 1 << 18) -> DataFrame:
    """(seq, locate, best_bid, best_ask) after each message that names an order.

    The feed is cut into ranges of `span` message numbers, each swept by one task: at most `span`
    messages, as many orders born in it, as many that die in it, and one carried price for each
    side of a symbol that has messages there. That is the best of the orders that live through the
    whole range: their lives are cut into dyadic ranges of ranges, which active symbols look up
    by equi-joins. No task grows with the feed, nor with how busy a symbol is.
    """
    points = feed.where(F.col("type").isin("A", "F", "E", "C", "X", "D", "U")).select("seq", "locate")
    top = feed.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
    lives = life.orders.select("locate", "side", "price", F.col("birth_seq").alias("b"), F.coalesce("death_seq", F.lit(top)).alias("e")).where("e > b and price is not null")
    lives = lives.withColumns({"first": F.expr(f"b div {span}"), "last": F.expr(f"(e - 1) div {span}")})
    cut_at = lambda n: F.least("e", (F.col("first") + 1) * span) if n == "first" else F.col("e")
    head = F.struct(F.col("first").alias("range"), F.col("b").alias("at"), cut_at("first").alias("until"))
    tail = F.when(F.col("last") > F.col("first"), F.struct(F.col("last").alias("range"), (F.col("last") * span).alias("at"), cut_at("last").alias("until")))
    ends = lives.withColumn("x", F.explode(F.array_compact(F.array(head, tail)))).select("x.range", "x.at", F.lit(False).alias("point"), "locate", "side", "price", "x.until")
    asked = points.select(F.expr(f"seq div {span}").alias("range"), F.col("seq").alias("at"), F.lit(True).alias("point"), "locate", F.lit("").alias("side"), F.lit(0).cast("long").alias("price"), F.lit(0).cast("long").alias("until"))
    rows = ends.select(*asked.columns).unionByName(asked)
    if top > 2 * span:  # else no order lives through a range and on both sides of it
        bits = int(top // span).bit_length()
        signed = F.when(F.col("side") == "B", F.col("price")).otherwise(-F.col("price"))
        through = lives.where("last > first + 1").select("locate", "side", signed.alias("p"), (F.col("first") + 1).alias("b"), F.col("last").alias("e"))
        best = through.withColumn("t", F.explode(_nodes(bits))).groupBy("locate", F.col("t.k").alias("k"), F.col("t.node").alias("node"), "side").agg(F.max("p").alias("p"))
        active = asked.select("locate", "range").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("node", F.expr("shiftright(range, k)"))
        carried = active.join(best, ["locate", "k", "node"]).groupBy("locate", "range", "side").agg(F.max("p").alias("p"))
        carried = carried.select("range", (F.col("range") * span).alias("at"), F.lit(False).alias("point"), "locate", "side", F.abs("p").alias("price"), ((F.col("range") + 1) * span).alias("until"))
        rows = rows.unionByName(carried)
    return rows.groupBy("range").applyInPandas(_sweep, _TAPE)


def peak_live(life: Lifecycle, buckets: int = 4096) -> DataFrame:
    """The greatest number of orders live at once, over all symbols.

    Births and deaths are summed in `buckets` ranges of seq; a range's own running sum starts at
    the sum of those before it, so no window spans the whole feed.
    """
    changes = life.orders.select(F.col("birth_seq").alias("seq"), F.lit(1).alias("d")).union(life.orders.where("death_seq is not null").select("death_seq", F.lit(-1)))
    span = changes.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] // buckets + 1
    c = changes.withColumn("bucket", F.expr(f"seq div {span}"))
    per_seq = c.groupBy("bucket", "seq").agg(F.sum("d").alias("d"))
    run = F.sum("d").over(W.partitionBy("bucket").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    each = per_seq.withColumn("run", run).groupBy("bucket").agg(F.max("run").alias("top"), F.sum("d").alias("net"))
    before = F.coalesce(F.sum("net").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # `buckets` rows at most
    return each.withColumn("before", before).agg(F.coalesce(F.max(F.col("top") + F.col("before")), F.lit(0)).cast("long").alias("peak_live"))
