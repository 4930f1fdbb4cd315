"""Order lifecycles: what every message did to the order it names.

In a day's feed an order's fate depends on its own messages alone, so one window per
(locate, ref) gives what each reduction applied, and replace chains are resolved by pointer
doubling over the replaced orders. Locates in which a reference is born twice or an order has no
shares (the `hostile` ones) go through an ordered fold, one locate at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut

REDUCING = ("E", "C", "X", "D", "U")
ORDERS = "locate int, ref long, side string, price long, shares long, birth_seq long, death_seq long, remaining long, parent long"
OPS = "seq long, type string, locate int, ref long, new_ref long, qty long, printable boolean, exec_price long, side string, price long, birth_seq long, applied long, removes boolean, outcome string"


class Lifecycle:
    """orders (those that existed) and ops (every message that names an order), as tables."""

    def __init__(self, orders: DataFrame, ops: DataFrame):
        self.orders, self.ops = orders, ops


def _births(feed: DataFrame) -> DataFrame:
    u = F.col("type") == "U"
    return feed.where(F.col("type").isin("A", "F", "U")).select(
        "seq", "type", "locate", F.when(u, F.col("new_ref")).otherwise(F.col("ref")).alias("ref"), F.lit(True).alias("born"), F.col("shares").alias("qty"), "price", F.when(~u, F.col("side")).alias("side"),
        F.when(u, F.col("ref")).alias("parent"), F.lit(None).cast("long").alias("new_ref"), F.lit(None).cast("boolean").alias("printable"),
    )


def _reductions(feed: DataFrame) -> DataFrame:
    none = F.lit(None)
    return feed.where(F.col("type").isin(*REDUCING)).select("seq", "type", "locate", "ref", F.lit(False).alias("born"), F.col("shares").alias("qty"), "price", none.cast("string").alias("side"), none.cast("long").alias("parent"), "new_ref", "printable")


def hostile_locates(feed: DataFrame) -> DataFrame:
    """Locates in which a reference is born more than once, or an order without shares."""
    born = _births(feed).groupBy("locate", "ref").agg(F.count("*").alias("n"), F.min("qty").alias("least"))
    return born.where("n > 1 or least <= 0").select("locate").distinct()


def _speculate(feed: DataFrame) -> DataFrame:
    """Every birth and reduction with what it did if the order it names existed."""
    rows = _births(feed).unionByName(_reductions(feed))
    by = W.partitionBy("locate", "ref").orderBy("seq", "born")
    past = by.rowsBetween(W.unboundedPreceding, -1)
    birth = F.max(F.when(F.col("born"), F.struct("seq", "qty", F.col("price").alias("price"), "side"))).over(past)
    rows = rows.withColumn("b", birth)
    alive = ~F.col("born") & F.col("b").isNotNull()
    took = F.when(alive & F.col("type").isin("E", "C", "X"), F.col("qty")).otherwise(0)
    gone = F.when(alive & F.col("type").isin("D", "U"), 1).otherwise(0)
    rem = F.when(alive & (F.coalesce(F.max(gone).over(past), F.lit(0)) == 0), F.greatest(F.lit(0), F.col("b.qty") - F.coalesce(F.sum(took).over(past), F.lit(0)))).otherwise(0)
    rows = rows.withColumn("rem", rem)
    applied = F.when(F.col("type").isin("D", "U"), F.col("rem")).otherwise(F.least("qty", "rem"))
    rows = rows.withColumn("applied", F.when(F.col("rem") > 0, applied).otherwise(0))
    removes = ~F.col("born") & (F.col("rem") > 0) & (F.col("applied") == F.col("rem"))
    whole = W.partitionBy("locate", "ref")
    return rows.withColumn("removes", removes).withColumn("death_seq", F.max(F.when(F.col("removes"), F.col("seq"))).over(whole)).withColumn("taken", F.sum(F.when(~F.col("born"), F.col("applied")).otherwise(0)).over(whole))


def _counted(links: DataFrame) -> tuple[DataFrame, int]:
    """links written, and how many point further up: counted while they are written."""
    seen = Observation()
    out = cut(links.observe(seen, F.count_if(F.col("up").isNotNull()).alias("n")), "chain")
    return out, seen.get.get("n", 0)  # nothing is observed where no row is left


def resolve_chains(born: DataFrame) -> DataFrame:
    """(locate, ref, side, ok) of replacing orders; born: all births with parent_live.

    Each round follows a pointer twice as far, so a chain of n replaces takes about log2(n).
    """
    links = born.where("parent is not null").select("locate", "ref", F.when(F.col("parent_live"), F.col("parent")).alias("up"), F.col("parent_live").alias("ok"))
    roots = born.where("parent is null").select("locate", F.col("ref").alias("up"), F.col("side").alias("root_side"))
    now = links.join(roots, ["locate", "up"], "left").select("locate", "ref", F.when(F.col("root_side").isNull(), F.col("up")).alias("up"), "ok", F.col("root_side").alias("side"))
    now, unresolved = _counted(now)
    while unresolved:
        far = now.select("locate", F.col("ref").alias("up"), F.col("up").alias("next"), F.col("ok").alias("next_ok"), F.col("side").alias("next_side"))
        step = now.where("up is not null").join(far, ["locate", "up"], "left")
        step = step.select("locate", "ref", F.when(F.coalesce("next_ok", F.lit(False)), F.col("next")).alias("up"), F.coalesce("next_ok", F.lit(False)).alias("ok"), F.col("next_side").alias("side"))
        now, unresolved = _counted(now.where("up is null").unionByName(step.select(*now.columns)))
    return now.select("locate", "ref", F.when(F.col("ok"), F.col("side")).alias("side"), (F.col("ok") & F.col("side").isNotNull()).alias("ok"))


def _fast(feed: DataFrame) -> Lifecycle:
    rows = cut(_speculate(feed), "fates")  # its shuffle and window run once for chains, orders and ops
    live_u = rows.where("type = 'U' and not born and rem > 0").select("locate", F.col("new_ref").alias("ref"), F.lit(True).alias("live"))
    born = rows.where("born").select("locate", "ref", "parent", "side").join(live_u, ["locate", "ref"], "left").withColumn("parent_live", F.coalesce("live", F.lit(False)))
    chains = resolve_chains(born).withColumnRenamed("side", "chain_side")
    full = rows.join(chains, ["locate", "ref"], "left")
    u_born = F.col("ok").isNotNull()
    existed = F.when(F.col("born"), F.when(u_born, F.col("ok")).otherwise(True)).otherwise(F.col("b").isNotNull() & F.when(u_born, F.col("ok")).otherwise(True))
    full = full.withColumn("existed", existed).withColumn("own_side", F.when(u_born, F.col("chain_side")).otherwise(F.coalesce("side", F.col("b.side"))))
    orders = full.where("born and existed").select("locate", "ref", F.col("own_side").alias("side"), "price", F.col("qty").alias("shares"), F.col("seq").alias("birth_seq"), "death_seq", (F.col("qty") - F.col("taken")).alias("remaining"), "parent")
    hit = F.col("existed") & (F.col("rem") > 0)
    over = hit & ~F.col("type").isin("D", "U") & (F.col("qty") > F.col("rem"))
    outcome = F.when(~hit, "unknown").when(over, "clamped").otherwise("applied")
    keep = lambda c: F.when(hit, c)
    ops = full.where("not born").select(
        "seq", "type", "locate", "ref", "new_ref", "qty", "printable", F.col("price").alias("exec_price"), keep(F.col("own_side")).alias("side"), keep(F.col("b.price")).alias("price"), keep(F.col("b.seq")).alias("birth_seq"),
        F.when(hit, F.col("applied")).otherwise(0).alias("applied"), (hit & F.col("removes")).alias("removes"), outcome.alias("outcome"),
    )
    return Lifecycle(orders, ops)


def fold_locate(rows: pd.DataFrame) -> tuple[list[tuple], list[tuple]]:
    """Orders and ops of one locate, message by message; handles reused references and zero shares."""
    live: dict[int, list] = {}
    orders, ops = [], []

    def none(x):
        return None if x is None or x != x else x

    def add(ref, side, price, shares, seq, locate, parent=None) -> None:
        row = [locate, ref, side, price, shares, seq, None, shares, parent]
        live[ref] = row
        orders.append(row)

    for m in rows.sort_values("seq").itertuples(index=False):
        seq, kind, locate = int(m.seq), m.type, int(m.locate)
        ref, qty, price = int(m.ref), none(m.shares), none(m.price)
        if kind in ("A", "F"):
            if ref in live:
                ops.append((seq, kind, locate, ref, None, qty, None, None, None, None, None, 0, False, "duplicate"))
            else:
                add(ref, m.side, int(price), int(qty), seq, locate)
            continue
        new = none(m.new_ref)
        new = None if new is None else int(new)
        base = (seq, kind, locate, ref, new, None if qty is None else int(qty), none(m.printable), None if price is None else int(price))
        own = live.get(ref)
        if own is None:
            ops.append((*base, None, None, None, 0, False, "unknown"))
            continue
        side, at, birth, rem = own[2], own[3], own[5], own[7]
        if kind == "U" and new in live:
            ops.append((*base, side, at, birth, 0, False, "duplicate"))
            continue
        applied = rem if kind in ("D", "U") else min(int(qty), rem)
        clamped = kind not in ("D", "U") and qty > rem
        removes = applied == rem
        own[7] = rem - applied
        if removes:
            own[6] = seq
            del live[ref]
        ops.append((*base, side, at, birth, applied, removes, "clamped" if clamped else "applied"))
        if kind == "U":
            add(new, side, int(price), int(qty), seq, locate, ref)
    return [tuple(o) for o in orders], ops


def _slow(feed: DataFrame) -> Lifecycle:
    rows = feed.where(F.col("type").isin("A", "F", *REDUCING)).select("seq", "type", "locate", "ref", "new_ref", "side", "shares", "price", "printable")
    names = [c.split()[0] for c in ORDERS.split(", ")], [c.split()[0] for c in OPS.split(", ")]
    as_orders = rows.groupBy("locate").applyInPandas(lambda g: pd.DataFrame(fold_locate(g.astype(object))[0], columns=names[0]).astype(object), ORDERS)
    as_ops = rows.groupBy("locate").applyInPandas(lambda g: pd.DataFrame(fold_locate(g.astype(object))[1], columns=names[1]).astype(object), OPS)
    return Lifecycle(as_orders, as_ops)


def lifecycle(feed: DataFrame, careful: bool = True) -> Lifecycle:
    """The feed's orders and ops. With careful=False no locate is taken to be hostile."""
    if not careful:
        return _fast(feed)
    bad = cut(hostile_locates(feed), "hostile")
    if bad.isEmpty():
        return _fast(feed)
    fast, slow = _fast(feed.join(bad, "locate", "left_anti")), _slow(feed.join(bad, "locate", "left_semi"))
    order, op = ([F.col(c.split()[0]).cast(c.split()[1]) for c in s.split(", ")] for s in (ORDERS, OPS))
    return Lifecycle(fast.orders.select(*order).unionByName(slow.orders), fast.ops.select(*op).unionByName(slow.ops))


def as_of(life: Lifecycle, seq: int) -> DataFrame:
    """Orders live after message `seq`, with what remained of each then."""
    taken = life.ops.where((F.col("seq") <= seq) & (F.col("applied") > 0)).groupBy("locate", "ref", "birth_seq").agg(F.sum("applied").alias("taken"))
    born = life.orders.where((F.col("birth_seq") <= seq) & (F.col("death_seq").isNull() | (F.col("death_seq") > seq)))
    return born.join(taken, ["locate", "ref", "birth_seq"], "left").withColumn("remaining", F.col("shares") - F.coalesce("taken", F.lit(0))).drop("taken")


def live_now(life: Lifecycle) -> DataFrame:
    return life.orders.where("death_seq is null")
