"""Queries over the feed derived from `events`, named by the inventory's identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_dir
from ..functions.wire import clock_ns, opposite
from ..operators import audit, counters, histogram, l1, levels, matching, state, transport
from ..operators.lifecycle import Lifecycle, as_of, lifecycle, live_now
from ..sources.derived import derived_feed, system_events
from ..sources.feed import parse, slice_until, type_counts, with_payload

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _life(spark: SparkSession, sf_dir: str) -> tuple[Lifecycle, DataFrame]:
    """The derived feed has each reference born once and no empty orders, by construction."""
    feed = cut(derived_feed(spark, sf_dir), "feed")  # derived once, read by each of a query's parts
    return lifecycle(feed, careful=False), feed


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_now(_life(spark, sf_dir)[0])


@query
def p1_feed(spark, sf_dir):
    return derived_feed(spark, sf_dir)


@query
def d6_decode_round_trip(spark, sf_dir):
    feed = derived_feed(spark, sf_dir)
    raw = with_payload(feed.withColumn("side", F.when(F.col("type") == "P", "B").otherwise(F.col("side"))))
    out = parse(raw.select("seq", "payload", F.lit(None).cast("string").alias("end")))
    return out.select("seq", "status", "type", "locate", F.when(F.col("type") != "P", F.col("ref")).alias("ref"), "new_ref", F.when(F.col("type") == "A", F.col("side")).alias("side"), F.coalesce("shares", F.col("cross_shares").cast("long")).alias("shares"), "price", "printable", F.when(F.col("type") == "H", F.col("code")).alias("code"))


@query
def d7_parser_stats(spark, sf_dir):
    """Every seventh message is cut short by a byte, every eleventh has an unknown type."""
    from ..sources.feed import parser_stats

    raw = with_payload(derived_feed(spark, sf_dir)).select("seq", "payload", F.lit(None).cast("string").alias("end"))
    n = F.length("payload")
    bent = raw.withColumn("payload", F.when(F.col("seq") % 11 == 0, F.concat(F.encode(F.lit("z"), "UTF-8"), F.expr("substring(payload, 2)"))).when(F.col("seq") % 7 == 0, F.substring("payload", F.lit(1), n - 1)).otherwise(F.col("payload")))
    return parser_stats(bent)


@query
def d8_opposite_side(spark, sf_dir):
    return derived_feed(spark, sf_dir).where("type = 'A'").groupBy(opposite(F.col("side")).alias("side")).agg(F.count("*").alias("n"))


@query
def d12_event_time_scaling(spark, sf_dir):
    """Due times of a replay at 50 times speed, in nanoseconds of the message number."""
    feed = derived_feed(spark, sf_dir).select("seq", (34_200_000_000_000 + F.col("seq") * 1_000_003).alias("ts_ns"))
    return feed.select("seq", F.expr("(ts_ns - 34200000000000) div 50").alias("due_ns"))


@query
def s9_slice_until(spark, sf_dir):
    """The prefix up to the first message after the cutoff; times run backwards at each 97th."""
    feed = derived_feed(spark, sf_dir).withColumn("ts_ns", 34_200_000_000_000 + F.col("seq") * 60_000_000 + F.when(F.col("seq") % 97 == 96, 6_000_000_000).otherwise(0))
    return slice_until(feed, 34_220_000_000_000).select("seq", "type", "ts_ns")


@query
def d14_clock(spark, sf_dir):
    return derived_feed(spark, sf_dir).select("seq", clock_ns(F.concat_ws(":", (F.col("seq") % 30).cast("string"), (F.col("seq") % 70).cast("string"))).alias("ns"))


@query
def a1_type_counts(spark, sf_dir):
    return type_counts(derived_feed(spark, sf_dir).withColumn("status", F.lit("ok")))


@query
def a2_adds_per_locate(spark, sf_dir):
    return levels.adds_per_locate(derived_feed(spark, sf_dir))


@query
def a3_top_symbols(spark, sf_dir):
    return levels.top_symbols(derived_feed(spark, sf_dir), 5)


def _report(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """The golden report of the five busiest symbols; only their orders are followed, as no other symbol's reach it."""
    feed = cut(derived_feed(spark, sf_dir), "feed")
    own = feed.join(F.broadcast(levels.top_symbols(feed, 5).select("locate")), "locate", "left_semi")
    return levels.checkpoint_depth(lifecycle(own, careful=False), feed, every, 5, 3)


@query
def a4_checkpoint_depth(spark, sf_dir):
    return _report(spark, sf_dir, 1000)


@query
def s11_golden_lines(spark, sf_dir):
    return levels.golden_lines(cut(_report(spark, sf_dir, 2500), "golden"))


@query
def a5_top_depth(spark, sf_dir):
    return levels.top_depth(_live(spark, sf_dir), 10)


@query
def b20_counters(spark, sf_dir):
    return counters.counters(*_life(spark, sf_dir))


@query
def b20_counters_by_locate(spark, sf_dir):
    return counters.counters(*_life(spark, sf_dir), by=["locate"])


@query
def a7_shard_merge(spark, sf_dir):
    """Counters of four shards, added up: equal to those of the whole."""
    life, feed = _life(spark, sf_dir)
    own = lambda df: df.withColumn("shard", F.col("locate") % 4)
    parts = counters.counters(Lifecycle(life.orders, life.ops), feed, by=["locate"])
    return counters.merge_shards(own(parts).groupBy("shard").agg(*[F.sum(n).alias(n) for n in counters.NAMES]))


@query
def b7_volumes(spark, sf_dir):
    return counters.volumes(derived_feed(spark, sf_dir))


@query
def j1_operations(spark, sf_dir):
    life, _ = _life(spark, sf_dir)
    return life.ops.select("seq", "type", "locate", "ref", "side", "price", "applied", "removes", "outcome")


@query
def j2_replace_chains(spark, sf_dir):
    life, _ = _life(spark, sf_dir)
    return life.orders.where("parent is not null").select("locate", "ref", "parent", "side", "price", "shares", "birth_seq")


@query
def b1_orders(spark, sf_dir):
    life, _ = _life(spark, sf_dir)
    return life.orders.select("locate", "ref", "side", "price", "shares", "birth_seq", "death_seq", "remaining")


@query
def b12_best_prices(spark, sf_dir):
    life, feed = _life(spark, sf_dir)
    return levels.best(live_now(life), levels.books(feed))


@query
def b13_l2_depth(spark, sf_dir):
    return levels.depth(_live(spark, sf_dir)).drop("level")


@query
def b14_level_fifo(spark, sf_dir):
    return levels.queue_positions(_live(spark, sf_dir)).select("locate", "side", "price", "position", "ref", "remaining")


@query
def b14_level_queues(spark, sf_dir):
    """The queue of each level as one text."""
    return levels.fifo(_live(spark, sf_dir)).select("locate", "side", "price", F.concat_ws(" ", "refs").alias("refs"))


@query
def b15_front_orders(spark, sf_dir):
    return levels.front(_live(spark, sf_dir))


@query
def b16_order_snapshots(spark, sf_dir):
    """Each order of locate 1 whose reference is a multiple of ten."""
    return _live(spark, sf_dir).where("locate = 1 and ref % 10 = 0").select("ref", "side", "price", "remaining")


@query
def b16_all_order_snapshots(spark, sf_dir):
    """Every live order of every locate; b16_order_snapshots is a point filter on the same rows."""
    return _live(spark, sf_dir).select("locate", "ref", "side", "price", "remaining")


@query
def b17_live_orders(spark, sf_dir):
    life, feed = _life(spark, sf_dir)
    return levels.live_orders(live_now(life), levels.books(feed))


@query
def b18_violations(spark, sf_dir):
    return levels.violations(_live(spark, sf_dir))


@query
def b19_listener_tape(spark, sf_dir):
    return levels.listener_tape(_life(spark, sf_dir)[0])


@query
def w3_level_series(spark, sf_dir):
    return levels.level_series(_life(spark, sf_dir)[0])


@query
def p10_books(spark, sf_dir):
    return levels.books(derived_feed(spark, sf_dir))


@query
def j4_trading_state(spark, sf_dir):
    feed = derived_feed(spark, sf_dir)
    rows = audit.with_state(feed.where("type = 'A'").select("seq", "locate"), feed)
    return rows.withColumn("rejects", audit.halted_for_matching(F.col("state")))


@query
def j5_market_phase(spark, sf_dir):
    feed = derived_feed(spark, sf_dir)
    return audit.with_phase(feed.select("seq", "locate"), system_events(feed))


@query
def w1_front_audit(spark, sf_dir):
    life, feed = _life(spark, sf_dir)
    return audit.front_audit(life, feed, system_events(feed))


@query
def w2_audit_counts(spark, sf_dir):
    life, feed = _life(spark, sf_dir)
    return audit.audit_counts(audit.front_audit(life, feed, system_events(feed)))


@query
def w4_l1_tape(spark, sf_dir):
    life, feed = _life(spark, sf_dir)
    return l1.l1_tape(life, feed)


@query
def w4_crossed_books(spark, sf_dir):
    life, feed = _life(spark, sf_dir)
    return levels.crossed(l1.l1_tape(life, feed)).select("seq", "locate")


@query
def a9_peak_live(spark, sf_dir):
    return l1.peak_live(_life(spark, sf_dir)[0])


@query
def m10_static_sweep(spark, sf_dir):
    live = _live(spark, sf_dir)
    sides = F.explode(F.array(F.lit("B"), F.lit("S")))
    takers = derived_feed(spark, sf_dir).select("locate").distinct().withColumn("taker_side", sides).select("locate", "taker_side", F.when(F.col("taker_side") == "B", 10_030).otherwise(10_010).cast("long").alias("limit"), (1000 * F.col("locate")).cast("long").alias("qty"))
    return matching.sweep(live, takers)


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds as submits (every fourth immediate-or-cancel), with the feed's cancels, replaces, states."""
    f = derived_feed(spark, sf_dir)
    kind = F.when(F.col("type") == "A", "submit").when(F.col("type") == "X", "cancel").when(F.col("type") == "D", "delete").when(F.col("type") == "U", "replace").when(F.col("type") == "H", "state")
    return f.withColumn("kind", kind).where("kind is not null").select("seq", "kind", "locate", "ref", "new_ref", "side", F.col("price").alias("limit"), F.col("shares").alias("qty"), F.when(F.col("seq") % 4 == 0, "ioc").otherwise("limit").alias("tif"), "code")


@query
def m1_match_fold(spark, sf_dir):
    return matching.match(match_events(spark, sf_dir))


def packet_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message numbers in packets of eight on two feeds, a fifth of the packets lost on each and some on both."""
    seqs = derived_feed(spark, sf_dir).select((F.col("seq") + 1).alias("msg_seq"), F.expr("seq div 8").alias("n"))
    both = seqs.withColumn("feed", F.explode(F.array(F.lit(0), F.lit(1))))
    return transport.lose(both, 22).select(F.lit("S1").alias("session"), (F.col("n") + 3 * F.col("feed")).alias("arrival"), "feed", "msg_seq", "n")


@query
def t5_applied_messages(spark, sf_dir):
    return transport.applied(packet_messages(spark, sf_dir)).select("msg_seq", "arrival", "feed")


@query
def t6_gaps(spark, sf_dir):
    return transport.gaps(packet_messages(spark, sf_dir)).select("first_missing", "last_missing")


@query
def t8_session_complete(spark, sf_dir):
    m = packet_messages(spark, sf_dir)
    end = m.agg((F.max("msg_seq") + 1).alias("eos_seq")).select(F.lit("S1").alias("session"), "eos_seq")
    return transport.complete(m, end)


@query
def t10_lost_packets(spark, sf_dir):
    packets = derived_feed(spark, sf_dir).select(F.expr("seq div 8").alias("n")).distinct().withColumn("feed", F.explode(F.array(F.lit(0), F.lit(1))))
    return transport.lose(packets, 22)


@query
def t4_rewinder_lookup(spark, sf_dir):
    """For each gap, the sent packets that a sender with the last 500 of them can repeat."""
    sent = derived_feed(spark, sf_dir).select(F.expr("seq div 8").alias("n")).groupBy("n").agg(F.count("*").alias("count")).select((F.col("n") * 8 + 1).alias("first_seq"), "count")
    holes = transport.gaps(packet_messages(spark, sf_dir)).select(F.col("first_missing").alias("want"), (F.col("last_missing") - F.col("first_missing") + 1).alias("want_count"))
    return transport.lookup(sent, holes, 500).select("want", "want_count", "first_seq", "count")


def wire_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived feed as packets of at most 1,200 bytes on two lossy feeds, in arrival order."""
    msgs = with_payload(derived_feed(spark, sf_dir)).select("seq", "payload")
    packed = cut(transport.packetize(msgs, "S1", 1200, chunk=256), "packets").withColumn("n", F.expr("first_seq div 16"))
    both = packed.withColumn("feed", F.explode(F.array(F.lit(0), F.lit(1))))
    return transport.lose(both, 22).select(F.lit("S1").alias("stream"), (2 * (F.col("first_seq") + 40 * F.col("feed")) + F.col("feed")).alias("arrival"), "feed", "first_seq", "count", "packet")


@query
def t1_packet_headers(spark, sf_dir):
    return wire_packets(spark, sf_dir).select("arrival", *[e.alias(f"h_{n}") for n, e in transport.header().items()])


@query
def t2_blocks(spark, sf_dir):
    return transport.deduplicated(transport.explode_blocks(wire_packets(spark, sf_dir)))


@query
def t7_arbitration(spark, sf_dir):
    out = transport.arbitrate(wire_packets(spark, sf_dir).select("stream", "arrival", "packet"))
    return out.where("row <> 'counters'").select("row", "arrival", "msg_seq", "count")


@query
def t13_sharding(spark, sf_dir):
    feed = derived_feed(spark, sf_dir)
    rows = feed.select("seq", "locate", "type").unionByName(system_events(feed).select("seq", F.lit(0).alias("locate"), F.lit("S").alias("type")))
    return counters.shard(rows, 4).groupBy("shard").agg(F.count("*").alias("messages"), F.count_if(F.col("type") == "S").alias("session_events"))


def _cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"), "l_returnflag")


@query
def a10_histogram(spark, sf_dir):
    return histogram.record(_cents(spark, sf_dir), "v").select("bucket", "n", F.col("total").cast("long").alias("total"), "least", "most")


@query
def a11_quantiles(spark, sf_dir):
    return histogram.quantiles(histogram.record(_cents(spark, sf_dir), "v"), [0.0, 0.5, 0.9, 0.99, 0.999, 1.0])


@query
def a12_histogram_merge(spark, sf_dir):
    parts = histogram.record(_cents(spark, sf_dir), "v", ["l_returnflag"])
    return histogram.summary(histogram.merge(parts.drop("l_returnflag")))


@query
def k3_resume(spark, sf_dir):
    """Orders live at the end of a run that was saved half way: equal to a straight run's."""
    import uuid

    feed = derived_feed(spark, sf_dir)
    half = feed.agg(F.max("seq")).first()[0] // 2
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    state.save_state(feed, half, path)
    return live_now(state.resume(spark, path, feed)).select("locate", "ref", "side", "price", "remaining", "birth_seq")


@query
def k1_as_of(spark, sf_dir):
    life, feed = _life(spark, sf_dir)
    half = feed.agg(F.max("seq")).first()[0] // 2
    return as_of(life, half).select("locate", "ref", "side", "price", "remaining", "birth_seq")


@query
def j9_difference(spark, sf_dir):
    """The fast way against the ordered fold: no rows."""
    from ..operators.lifecycle import _slow

    feed = derived_feed(spark, sf_dir)
    cols = ["locate", "ref", "side", "price", "shares", "birth_seq", "death_seq", "remaining"]
    return state.difference(lifecycle(feed, careful=False).orders.select(*cols), _slow(feed).orders.select(*cols)).select("locate", "ref", "only_in")
