"""As-of market phase and trading state, and the audit of executions at the queue's front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lifecycle import Lifecycle

OPEN, CLOSED, BEFORE = "open", "closed", "pre_open"


def phases(system: DataFrame) -> DataFrame:
    """(phase, start, stop): the S rows that matter as ranges of seq; a handful of rows a day."""
    rows = sorted((r["seq"], r["code"]) for r in system.where(F.col("code").isin("Q", "M")).select("seq", "code").collect())
    spans, at, phase = [], -1, BEFORE
    for seq, code in rows:
        spans.append((phase, at, seq))
        at, phase = seq, OPEN if code == "Q" else CLOSED
    spans.append((phase, at, 2**62))
    return system.sparkSession.createDataFrame(spans, "phase string, start long, stop long")


def with_phase(rows: DataFrame, system: DataFrame) -> DataFrame:
    """rows with the market phase at their seq."""
    spans = F.broadcast(phases(system))
    return rows.join(spans, (F.col("seq") >= F.col("start")) & (F.col("seq") < F.col("stop")), "left").drop("start", "stop")


def state_spans(feed: DataFrame) -> DataFrame:
    """(locate, state, start, stop) from the H rows."""
    by = W.partitionBy("locate").orderBy("seq")
    return feed.where("type = 'H'").select("locate", F.col("code").alias("state"), F.col("seq").alias("start"), F.coalesce(F.lead("seq").over(by), F.lit(2**62)).alias("stop"))


def with_state(rows: DataFrame, feed: DataFrame) -> DataFrame:
    """rows with the trading state of their locate at their seq; 'T' before the first H."""
    h = state_spans(feed).withColumnRenamed("locate", "h_locate")
    j = rows.join(h, (F.col("locate") == F.col("h_locate")) & (F.col("seq") >= F.col("start")) & (F.col("seq") < F.col("stop")), "left")
    return j.withColumn("state", F.coalesce("state", F.lit("T"))).drop("h_locate", "start", "stop")


def halted_for_matching(state: Column) -> Column:
    return state.isin("H", "P")


def symbols(feed: DataFrame) -> DataFrame:
    """The latest directory binding of each locate."""
    last = F.max(F.struct("seq", "stock"))
    return feed.where("type = 'R'").groupBy("locate").agg(last.alias("r")).select("locate", F.rtrim("r.stock").alias("symbol"))


def front_audit(life: Lifecycle, feed: DataFrame, system: DataFrame) -> DataFrame:
    """Each execution with its verdict: phase, halted, unknown, front or behind.

    An order is at the front when all older orders of its level died before the execution.
    """
    older = W.partitionBy("locate", "side", "price").orderBy("birth_seq").rowsBetween(W.unboundedPreceding, -1)
    lasting = F.max(F.coalesce("death_seq", F.lit(2**62))).over(older)
    ahead = life.orders.select("locate", "ref", "birth_seq", lasting.alias("ahead_until"))
    execs = life.ops.where("type in ('E', 'C')").select("seq", "type", "locate", "ref", "birth_seq")
    rows = with_state(with_phase(execs, system), feed).join(ahead, ["locate", "ref", "birth_seq"], "left")
    front = F.col("ahead_until").isNull() | (F.col("ahead_until") < F.col("seq"))
    verdict = F.when(F.col("phase") != OPEN, "phase").when(F.col("state") != "T", "halted").when(F.col("birth_seq").isNull(), "unknown").when(front, "front").otherwise("behind")
    return rows.select("seq", "type", "locate", "ref", verdict.alias("verdict"))


def audit_counts(audit: DataFrame) -> DataFrame:
    """Skips by reason, checks and hits of E and C, and pass rates (0 when nothing was checked)."""
    v, t = F.col("verdict"), F.col("type")
    checked = v.isin("front", "behind")
    n = lambda c: F.count_if(c)
    rate = lambda hit, all_: F.coalesce(F.try_divide(n(hit), n(all_)), F.lit(0.0))
    return audit.agg(
        n(v == "phase").alias("skipped_phase"), n(v == "halted").alias("skipped_halted"), n(v == "unknown").alias("skipped_unknown"),
        n(checked & (t == "E")).alias("e_checked"), n((v == "front") & (t == "E")).alias("e_front"), n(checked & (t == "C")).alias("c_checked"), n((v == "front") & (t == "C")).alias("c_front"),
        rate((v == "front") & (t == "E"), checked & (t == "E")).alias("e_rate"), rate((v == "front") & (t == "C"), checked & (t == "C")).alias("c_rate"), rate(v == "front", checked).alias("rate"),
    )
