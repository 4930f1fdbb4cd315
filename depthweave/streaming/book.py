"""Incremental books: the fold of one symbol's messages as a stateful streaming operator.

Messages come in any micro-batches as long as a later batch has later messages; within a batch
each symbol's rows are sorted by seq. State is the symbol's live orders and goes as they die, so
it needs no watermark. Session events are dealt to every shard by `counters.shard`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEVELS = "seq long, locate int, side string, price long, qty_after long, outcome string"


def _step(live: dict, totals: dict, m, out: list) -> None:
    """Apply one message to a symbol's live orders {ref: [side, price, remaining]} and level totals."""
    seq, locate, kind, ref = int(m.seq), int(m.locate), m.type, str(int(m.ref))

    def level(side, price, change, outcome):
        totals[side, price] = totals.get((side, price), 0) + change
        out.append((seq, locate, side, price, totals[side, price], outcome))

    def missed(outcome):
        out.append((seq, locate, None, None, None, outcome))

    if kind in ("A", "F"):
        if ref in live:
            missed("duplicate")
        else:
            live[ref] = [m.side, int(m.price), int(m.shares)]
            level(m.side, int(m.price), int(m.shares), "add")
        return
    own = live.get(ref)
    if own is None:
        missed("unknown")
        return
    side, price, left = own
    if kind == "U" and str(int(m.new_ref)) in live:
        missed("duplicate")
        return
    taken = left if kind in ("D", "U") else min(int(m.shares), left)
    clamped = kind not in ("D", "U") and m.shares > left
    if taken == left:
        del live[ref]
    else:
        own[2] = left - taken
    level(side, price, -taken, "clamped" if clamped else "applied")
    if kind == "U":
        live[str(int(m.new_ref))] = [side, int(m.price), int(m.shares)]
        level(side, int(m.price), int(m.shares), "add")


def fold_batch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    live = json.loads(state.get[0]) if state.exists else {}
    totals: dict = {}
    for side, price, left in live.values():
        totals[side, price] = totals.get((side, price), 0) + left
    rows = pd.concat(list(batches)).sort_values("seq")
    out: list = []
    for m in rows.itertuples(index=False):
        _step(live, totals, m, out)
    if live:
        state.update((json.dumps(live),))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=[c.split()[0] for c in LEVELS.split(", ")]).astype(object)


def stream_levels(feed: DataFrame) -> DataFrame:
    """A streaming feed to the level changes and outcomes of its messages."""
    orders = feed.where("type in ('A','F','E','C','X','D','U')").select("seq", "locate", "type", "ref", "new_ref", "side", "shares", "price")
    return orders.groupBy("locate").applyInPandasWithState(fold_batch, LEVELS, "live string", "append", GroupStateTimeout.NoTimeout)


def stream_applied(messages: DataFrame) -> DataFrame:
    """The first copy of each message of a redundant packet stream, whichever feed it came by.

    Without a watermark a session's message numbers stay in state for as long as it runs.
    """
    return messages.dropDuplicates(["session", "msg_seq"])
