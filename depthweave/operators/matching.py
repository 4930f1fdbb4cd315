"""Price-time matching: an ordered fold per symbol, and the sweep of a frozen book as a window."""

from __future__ import annotations

import heapq
from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import ordered_fold

RESULT = "seq long, locate int, row string, step int, status string, ref long, maker long, side string, price long, qty long, filled long, resting long, cancelled long"


class MatchBook:
    """One symbol's resting orders: a queue per price, and a heap of prices per side."""

    def __init__(self):
        self.levels: dict[str, dict[int, OrderedDict]] = {"B": {}, "S": {}}
        self.heaps: dict[str, list[int]] = {"B": [], "S": []}
        self.orders: dict[int, tuple[str, int]] = {}
        self.totals: dict[tuple[str, int], int] = {}

    def best(self, side: str) -> int | None:
        heap, sign = self.heaps[side], -1 if side == "B" else 1
        while heap and sign * heap[0] not in self.levels[side]:
            heapq.heappop(heap)
        return sign * heap[0] if heap else None

    def rest(self, ref: int, side: str, price: int, qty: int) -> None:
        if price not in self.levels[side]:
            self.levels[side][price] = OrderedDict()
            heapq.heappush(self.heaps[side], -price if side == "B" else price)
        self.levels[side][price][ref] = qty
        self.orders[ref] = side, price
        self.totals[side, price] = self.totals.get((side, price), 0) + qty

    def reduce(self, ref: int, qty: int) -> int:
        """Take qty (or all that is left) from a resting order; what was taken."""
        side, price = self.orders[ref]
        queue = self.levels[side][price]
        taken = min(qty, queue[ref])
        queue[ref] -= taken
        self.totals[side, price] -= taken
        if not queue[ref]:
            del queue[ref], self.orders[ref]
            if not queue:
                del self.levels[side][price], self.totals[side, price]
        return taken

    def submit(self, ref: int, side: str, limit: int, qty: int, ioc: bool):
        """(status, filled, resting, cancelled, fills) of a new order."""
        if qty == 0:
            return "rejected_invalid", 0, 0, 0, []
        if ref in self.orders:
            return "rejected_duplicate", 0, 0, 0, []
        other, left, fills = ("S" if side == "B" else "B"), qty, []
        while left:
            price = self.best(other)
            if price is None or (price > limit if side == "B" else price < limit):
                break
            maker = next(iter(self.levels[other][price]))
            taken = self.reduce(maker, left)
            fills.append((maker, other, price, taken, self.totals.get((other, price), 0)))
            left -= taken
        if not left:
            return "filled", qty, 0, 0, fills
        if ioc:
            return "ioc_cancelled", qty - left, 0, left, fills
        self.rest(ref, side, limit, left)
        return ("partial_rested" if fills else "rested"), qty - left, left, 0, fills


class MatchFold:
    """One symbol's events in order of seq, as dicts, to rows of RESULT.

    Each event gives its fills and a result. On the tape, a fill is an exec and the level after it;
    what rests is the level and then the add; a cancel is followed by its level. The end gives what
    still rests and the counters.
    """

    def __init__(self, locate: int):
        self.locate, self.book, self.halted = locate, MatchBook(), False
        self.counts = {"volume_matched": 0, "rejected_halted": 0, "unknown_ref": 0}

    def _row(self, seq, row, step, status=None, ref=None, maker=None, side=None, price=None, qty=None, filled=None, resting=None, cancelled=None) -> tuple:
        return seq, self.locate, row, step, status, ref, maker, side, price, qty, filled, resting, cancelled

    def _result(self, seq, ref, status, filled=0, resting=0, cancelled=0, fills=(), side=None, limit=None) -> list[tuple]:
        out, step = [], 0
        for i, (maker, at, price, qty, after) in enumerate(fills):
            out.append(self._row(seq, "fill", i, None, ref, maker, at, price, qty))
            out.append(self._row(seq, "exec", step, None, ref, maker, at, price, qty))
            out.append(self._row(seq, "level", step + 1, None, None, maker, at, price, after))
            self.counts["volume_matched"] += qty
            step += 2
        if resting:
            out.append(self._row(seq, "level", step, None, None, None, side, limit, self.book.totals[side, limit]))
            out.append(self._row(seq, "add", step + 1, None, ref, None, side, limit, resting))
        self.counts["rejected_halted"] += status == "rejected_halted"
        return [*out, self._row(seq, "result", len(fills), status, ref, None, side, limit, None, filled, resting, cancelled)]

    def _taken(self, seq: int, ref: int, most: int) -> list[tuple]:
        """A cancel of at most so many shares, or a delete."""
        at, price = self.book.orders[ref]
        taken = self.book.reduce(ref, most)
        left = self.book.totals.get((at, price), 0)
        tape = [self._row(seq, "cancel", 0, None, ref, None, at, price, taken), self._row(seq, "level", 1, None, None, ref, at, price, left)]
        return tape + self._result(seq, ref, "cancelled", cancelled=taken)

    def step(self, e: dict) -> list[tuple]:
        kind, seq, ref = e["kind"], e["seq"], e["ref"]
        if kind == "state":
            self.halted = e["code"] in ("H", "P")
            return []
        if kind != "submit" and ref not in self.book.orders:
            self.counts["unknown_ref"] += 1
            return self._result(seq, e["new_ref"], "rejected_invalid") if kind == "replace" else self._result(seq, ref, "unknown")
        if kind in ("cancel", "delete"):
            return self._taken(seq, ref, e["qty"] if kind == "cancel" else 1 << 62)
        side, taker, limit = e["side"], ref, e["limit"]
        if kind == "replace":
            side, taker = self.book.orders[ref][0], e["new_ref"]
            self.book.reduce(ref, 1 << 62)  # the old order is gone whatever becomes of the new one
        if self.halted:
            return self._result(seq, taker, "rejected_halted", side=side, limit=limit)
        return self._result(seq, taker, *self.book.submit(taker, side, limit, e["qty"], e["tif"] == "ioc"), side=side, limit=limit)

    def end(self) -> list[tuple]:
        queues = [(side, price, queue) for side in ("B", "S") for price, queue in self.book.levels[side].items()]
        rest = [self._row(None, "resting", i, None, ref, None, side, price, qty) for side, price, queue in queues for i, (ref, qty) in enumerate(queue.items())]
        return rest + [self._row(None, "counter", 0, name, qty=n) for name, n in self.counts.items()]


def fold(events: pd.DataFrame) -> pd.DataFrame:
    """The rows of one symbol's events, without Spark."""
    rows = events.sort_values("seq").to_dict("records")
    own = MatchFold(rows[0]["locate"])
    out = [r for e in rows for r in own.step(e)] + own.end()
    return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype(object)


def match(events: DataFrame) -> DataFrame:
    """Fills, results and final resting orders of (seq, kind, locate, ref, new_ref, side, limit, qty, tif, code).

    kind: submit, cancel, delete, replace, state. A symbol's matching is one sequential fold; its
    task holds the symbol's resting orders, not its events.
    """
    return _folded(events).where(F.col("row").isin("fill", "result", "resting"))


def _folded(events: DataFrame) -> DataFrame:
    return ordered_fold(events, "locate", ["seq"], MatchFold, RESULT)


def match_tape(events: DataFrame) -> DataFrame:
    """(seq, step, event, locate, ref, maker, side, price, qty): what a listener hears while matching."""
    return _folded(events).where(F.col("row").isin("exec", "level", "add", "cancel")).select("seq", "step", F.col("row").alias("event"), "locate", "ref", "maker", "side", "price", "qty")


def match_counters(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """volume_matched, rejected_halted and unknown_ref of all symbols, or by `locate`."""
    rows = _folded(events).where("row = 'counter'")
    names = ("volume_matched", "rejected_halted", "unknown_ref")
    return rows.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(F.when(F.col("status") == n, F.col("qty"))), F.lit(0)).cast("long").alias(n) for n in names])


def sweep(live: DataFrame, takers: DataFrame) -> DataFrame:
    """Fills of one taker per (locate, taker_side) against a frozen book: no fold is needed.

    takers: locate, taker_side, limit, qty. A maker gets what the better-placed ones left.
    """
    makers = live.select("locate", "ref", "side", "price", "remaining", "birth_seq")
    t = takers.withColumn("side", F.when(F.col("taker_side") == "B", "S").otherwise("B"))
    crosses = F.when(F.col("taker_side") == "B", F.col("price") <= F.col("limit")).otherwise(F.col("price") >= F.col("limit"))
    j = makers.join(t, ["locate", "side"]).where(crosses)
    better = F.when(F.col("taker_side") == "B", F.col("price")).otherwise(-F.col("price"))
    ahead = F.coalesce(F.sum("remaining").over(W.partitionBy("locate", "taker_side").orderBy(better, "birth_seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return j.withColumn("fill", F.least("remaining", F.greatest(F.lit(0), F.col("qty") - ahead)).cast("long")).where("fill > 0").select("locate", "taker_side", F.col("ref").alias("maker"), "price", "fill")
