"""Queries on matching, saved state, reports and broken input, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_dir
from ..operators import audit, levels, matching, reports, state, transport
from ..sources.derived import derived_feed, system_events
from .market import _life, _live, packet_messages
from .market_sql import _COUNTS, FEED, LIFE

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def one_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds as submits at one price, the trading states, and reductions of orders that never were."""
    f = derived_feed(spark, sf_dir).where("type in ('A', 'H') or (type in ('X', 'U') and ref >= 1000000000)")
    kind = F.when(F.col("type") == "A", "submit").when(F.col("type") == "H", "state").when(F.col("type") == "X", "cancel").otherwise("replace")
    return f.select("seq", kind.alias("kind"), "locate", "ref", "new_ref", "side", F.lit(10_000).cast("long").alias("limit"), F.col("shares").alias("qty"), F.lit("limit").alias("tif"), "code")


@query
def m8_one_price_fills(spark, sf_dir):
    return matching.match(one_price(spark, sf_dir)).where("row = 'fill'").select("locate", F.col("ref").alias("taker"), "maker", "qty")


@query
def m8_match_counters(spark, sf_dir):
    return matching.match_counters(one_price(spark, sf_dir), ["locate"])


@query
def m9_rest_events(spark, sf_dir):
    """What rests: the level first, then the add."""
    tape = matching.match_tape(one_price(spark, sf_dir)).where("event in ('level', 'add') and maker is null")
    return tape.select("seq", (F.col("step") % 2).cast("int").alias("sub_seq"), "event", "locate", "ref", "side", "qty")


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived feed with a directory row in place of every 250th message."""
    f = derived_feed(spark, sf_dir)
    named = F.col("seq") % 250 == 0
    return f.select("seq", F.when(named, "R").otherwise(F.col("type")).alias("type"), F.when(named, F.expr("cast((seq div 250) % 16 + 1 as int)")).otherwise(F.col("locate")).alias("locate"), *[F.when(~named, F.col(c)).alias(c) for c in f.columns if c not in ("seq", "type", "locate")], F.when(named, F.rpad(F.concat(F.lit("S"), (F.col("seq") % 7).cast("string")), 8, " ")).alias("stock"))


@query
def j3_symbol_adds(spark, sf_dir):
    f = directory(spark, sf_dir)
    return levels.books(f).join(audit.symbols(f), "locate", "left")


@query
def p11_message_cap(spark, sf_dir):
    return reports.first_messages(derived_feed(spark, sf_dir), 5000).groupBy("type").agg(F.count("*").alias("messages"))


@query
def s13_session_report(spark, sf_dir):
    life, feed = _life(spark, sf_dir)
    return reports.session_report(life, feed)


def _saved(spark: SparkSession, feed: DataFrame, system: DataFrame | None = None) -> str:
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    state.save_state(feed, feed.agg(F.max("seq")).first()[0] // 2, path, system)
    return path


@query
def k3_resume_counters(spark, sf_dir):
    """Counters of a run that was saved half way: equal to a straight run's."""
    feed = derived_feed(spark, sf_dir)
    return state.resumed_counters(spark, _saved(spark, feed), feed)


@query
def k2_resumed_session(spark, sf_dir):
    """Books, symbols and the phases at the save and at the end of a run that was saved half way."""
    feed, system = directory(spark, sf_dir), system_events(derived_feed(spark, sf_dir))
    path = _saved(spark, feed, system)
    out = state.resumed_books(spark, path, feed).join(state.resumed_symbols(spark, path, feed), "locate", "left")
    saved = spark.read.parquet(f"{path}/meta").first()["phase"]
    return out.withColumn("saved_phase", F.lit(saved)).withColumn("phase", F.lit(state.resumed_phase(spark, path, system, 2**62)))


@query
def b18_broken_levels(spark, sf_dir):
    """Levels of a state in which every fiftieth live order has lost its shares."""
    return levels.violations(_live(spark, sf_dir).withColumn("remaining", F.when(F.col("ref") % 50 == 0, 0).otherwise(F.col("remaining")).cast("long")))


@query
def j9_changed_orders(spark, sf_dir):
    """Live orders against a result that lacks some and has some with a share more."""
    live = _live(spark, sf_dir).select("locate", "ref", "remaining")
    other = live.where("ref % 20 <> 0").withColumn("remaining", F.col("remaining") + (F.col("ref") % 30 == 1).cast("long"))
    return state.difference(live, other)


@query
def t8_complete_sessions(spark, sf_dir):
    """One session with gaps, one that is whole, one whose end lies beyond what came."""
    lossy = packet_messages(spark, sf_dir).select("session", "arrival", "feed", "msg_seq")
    whole = derived_feed(spark, sf_dir).select(F.explode(F.array(F.lit("S2"), F.lit("S3"))).alias("session"), F.col("seq").alias("arrival"), F.lit(0).alias("feed"), (F.col("seq") + 1).alias("msg_seq"))
    n = derived_feed(spark, sf_dir).agg(F.max("seq")).first()[0]
    ends = spark.createDataFrame([("S1", n + 2), ("S2", n + 2), ("S3", n + 3)], "session string, eos_seq long")
    return transport.complete(lossy.unionByName(whole), ends)


_ONE_PRICE = LIFE + """, taken AS (SELECT f.seq, f.locate, f.side, f.shares FROM feed f JOIN states s ON s.seq = f.seq WHERE f.type = 'A' AND s.state NOT IN ('H', 'P')),
 units AS (SELECT *, CAST(sum(shares) OVER (PARTITION BY locate, side ORDER BY seq) AS BIGINT) AS hi FROM taken),
 pairs AS (SELECT b.locate, greatest(b.seq, s.seq) AS taker, least(b.seq, s.seq) AS maker, CAST(least(b.hi, s.hi) - greatest(b.hi - b.shares, s.hi - s.shares) AS BIGINT) AS qty
  FROM units b JOIN units s ON b.locate = s.locate AND b.side = 'B' AND s.side = 'S' AND b.hi - b.shares < s.hi AND s.hi - s.shares < b.hi),
 net AS (SELECT seq, locate, side, shares, CAST(sum(CASE WHEN side = 'B' THEN shares ELSE -shares END) OVER (PARTITION BY locate ORDER BY seq) AS BIGINT) AS v FROM taken),
 rests AS (SELECT seq, locate, side, CASE WHEN side = 'B' THEN v ELSE -v END AS total, shares FROM net WHERE CASE WHEN side = 'B' THEN v ELSE -v END > 0) """
_BOOKED = FEED + ", named AS (SELECT seq, CAST((seq // 250) % 16 + 1 AS INT) AS locate, 'S' || (seq % 7) AS symbol FROM feed WHERE seq % 250 = 0), symbols AS (SELECT locate, arg_max(symbol, seq) AS symbol FROM named GROUP BY locate), booked AS (SELECT DISTINCT locate FROM feed WHERE seq % 250 <> 0 AND type IN ('A','F','E','C','X','D','U')) "

SQL = {
    "m8_one_price_fills": _ONE_PRICE + "SELECT * FROM pairs",
    "m8_match_counters": _ONE_PRICE + """SELECT locate, CAST(coalesce((SELECT sum(qty) FROM pairs p WHERE p.locate = l.locate), 0) AS BIGINT) AS volume_matched,
 (SELECT count(*) FROM feed f JOIN states s ON s.seq = f.seq WHERE f.type = 'A' AND s.state IN ('H', 'P') AND f.locate = l.locate) AS rejected_halted,
 (SELECT count(*) FROM feed f WHERE f.type IN ('X', 'U') AND f.ref >= 1000000000 AND f.locate = l.locate) AS unknown_ref
 FROM (SELECT DISTINCT locate FROM feed WHERE type IN ('A', 'H') OR (type IN ('X', 'U') AND ref >= 1000000000)) l""",
    "m9_rest_events": _ONE_PRICE + "SELECT seq, 0 AS sub_seq, 'level' AS event, locate, CAST(NULL AS BIGINT) AS ref, side, total AS qty FROM rests UNION ALL SELECT seq, 1, 'add', locate, seq, side, CAST(least(total, shares) AS BIGINT) FROM rests",
    "j3_symbol_adds": _BOOKED + "SELECT locate, symbol FROM booked LEFT JOIN symbols USING (locate)",
    "p11_message_cap": FEED + "SELECT type, count(*) AS messages FROM (SELECT * FROM feed ORDER BY seq LIMIT 5000) GROUP BY type",
    "s13_session_report": LIFE + ", tops AS (SELECT locate, max(price) FILTER (side = 'B') AS bid, min(price) FILTER (side = 'S') AS ask FROM live GROUP BY locate) SELECT c.*, (SELECT count(*) FROM feed) AS messages, (SELECT count(*) FROM (SELECT DISTINCT locate, side, price FROM live)) AS levels, (SELECT count(*) FROM live) AS live_orders, (SELECT count(*) FROM books) AS books, (SELECT count(*) FROM tops WHERE bid >= ask) AS crossed_books FROM (SELECT " + _COUNTS + ") c",
    "k3_resume_counters": LIFE + "SELECT " + _COUNTS,
    "k2_resumed_session": _BOOKED + "SELECT locate, symbol, 'open' AS saved_phase, 'closed' AS phase FROM booked LEFT JOIN symbols USING (locate)",
    "b18_broken_levels": LIFE + "SELECT DISTINCT locate, side, price FROM live WHERE ref % 50 = 0",
    "j9_changed_orders": LIFE + "SELECT locate, ref, remaining, 'a' AS only_in FROM live WHERE ref % 20 = 0 OR ref % 30 = 1 UNION ALL SELECT locate, ref, remaining + 1, 'b' FROM live WHERE ref % 20 <> 0 AND ref % 30 = 1",
    "t8_complete_sessions": "SELECT session, session = 'S2' AS complete FROM (VALUES ('S1'), ('S2'), ('S3')) v(session)",
}
