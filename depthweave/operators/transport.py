"""Sequenced packets over redundant feeds: de-duplication, gaps, arbitration, retransmission."""

from __future__ import annotations

import heapq
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.wire import be, chars, to_be
from .folds import ordered_fold

HEADER, END_OF_SESSION, MOST_REQUESTED, REQUEST_EVERY = 20, 0xFFFF, 0xFFFE, 256
SPREAD = 4096  # message numbers a range of the overlap join


def header(packet: str = "packet") -> dict:
    """session, seq and count of a packet; NULL where it is too short."""
    p = F.col(packet)
    long_enough = F.length(p) >= HEADER
    return {"session": F.when(long_enough, chars(p, 0, 10)), "first_seq": F.when(long_enough, be(p, 10, 8)), "count": F.when(long_enough, be(p, 18, 2))}


def encode_header(session, first_seq, count):
    return F.concat(F.encode(F.rpad(session, 10, " "), "ISO-8859-1"), to_be(first_seq, 8), to_be(count, 2))


def walk_blocks(payload: bytes, count: int) -> tuple[list[bytes], bool]:
    """The blocks up to the first bad one, and whether count blocks fill the payload exactly."""
    out, at = [], 0
    for _ in range(count):
        if at + 2 > len(payload):
            return out, False
        n = struct.unpack_from(">H", payload, at)[0]
        if n == 0 or at + 2 + n > len(payload):
            return out, False
        out.append(payload[at + 2 : at + 2 + n])
        at += 2 + n
    return out, at == len(payload)


def packetize(messages: DataFrame, session: str, mtu: int, key: str = "seq", chunk: int = 4096) -> DataFrame:
    """(first_seq, count, packet) of messages (key, payload), in order, of at most mtu bytes.

    Packets are filled greedily within ranges of `chunk` message numbers; keys are dense from 0.
    A message that fits no packet is left out, as its number then shows.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, held, size, first = [], [], HEADER, None

        def made():
            head = session.ljust(10).encode("latin-1")[:10] + struct.pack(">QH", first, len(held))
            rows.append((first, len(held), head + b"".join(struct.pack(">H", len(x)) + x for x in held)))

        for seq, x in zip(group[key], group["payload"], strict=True):
            if HEADER + 2 + len(x) > mtu:
                if held:
                    made()
                held, size, first = [], HEADER, None
                continue
            if held and size + 2 + len(x) > mtu:
                made()
                held, size, first = [], HEADER, None
            first = int(seq) + 1 if first is None else first
            held.append(x)
            size += 2 + len(x)
        if held:
            made()
        return pd.DataFrame(rows, columns=["first_seq", "count", "packet"])

    numbered = messages.withColumn("_chunk", F.expr(f"{key} div {chunk}"))
    return numbered.groupBy("_chunk").applyInPandas(lambda g: run(g.sort_values(key)), "first_seq long, count long, packet binary")


def explode_blocks(packets: DataFrame) -> DataFrame:
    """(arrival, feed, session, msg_seq, payload) of packets (arrival, feed, packet)."""

    def run(batches):
        for b in batches:
            rows = []
            for i, p in enumerate(b.column("packet").to_pylist()):
                if p is not None and len(p) >= HEADER:
                    seq, n = struct.unpack_from(">QH", p, 10)
                    if n != END_OF_SESSION:
                        rows += [(i, p[:10].decode("latin-1"), seq + k, x) for k, x in enumerate(walk_blocks(p[HEADER:], n)[0])]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("arrival").take(at), b.column("feed").take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names=["arrival", "feed", "session", "msg_seq", "payload"])

    return packets.select("arrival", "feed", "packet").mapInArrow(run, "arrival long, feed int, session string, msg_seq long, payload binary")


def applied(messages: DataFrame) -> DataFrame:
    """The first arrival of each message of each session."""
    first = F.row_number().over(W.partitionBy("session", "msg_seq").orderBy("arrival", "feed"))
    return messages.withColumn("_n", first).where("_n = 1").drop("_n")


def deduplicated(messages: DataFrame) -> DataFrame:
    """The applied message numbers, where it doesn't matter which copy came first."""
    return messages.select("session", "msg_seq").distinct()


def gaps(messages: DataFrame, span: int = 1 << 20) -> DataFrame:
    """(session, first_missing, last_missing): holes between the message numbers received.

    Numbers are looked at in ranges of `span`; the ends of neighbouring ranges are compared after.
    """
    seen = deduplicated(messages).withColumn("_part", F.expr(f"msg_seq div {span}"))
    nxt = F.lead("msg_seq").over(W.partitionBy("session", "_part").orderBy("msg_seq"))
    inner = seen.withColumn("nxt", nxt).where("nxt > msg_seq + 1").select("session", (F.col("msg_seq") + 1).alias("first_missing"), (F.col("nxt") - 1).alias("last_missing"))
    ends = seen.groupBy("session", "_part").agg(F.min("msg_seq").alias("lo"), F.max("msg_seq").alias("hi"))
    after = F.lead("lo").over(W.partitionBy("session").orderBy("_part"))
    outer = ends.withColumn("nxt", after).where("nxt > hi + 1").select("session", (F.col("hi") + 1).alias("first_missing"), (F.col("nxt") - 1).alias("last_missing"))
    return inner.union(outer)


def complete(messages: DataFrame, ends: DataFrame) -> DataFrame:
    """(session, complete): the end (session, eos_seq) was seen and nothing before it is missing."""
    n = deduplicated(messages).groupBy("session").agg(F.count("*").alias("n"), F.min("msg_seq").alias("lo"), F.max("msg_seq").alias("hi"))
    whole = (F.col("hi") - F.col("lo") + 1 == F.col("n")) & (F.col("hi") + 1 >= F.col("eos_seq"))
    return ends.join(n, "session", "left").select("session", F.coalesce(whole, F.lit(False)).alias("complete"))


def lose(packets: DataFrame, percent: int) -> DataFrame:
    """Packets (packet number n, feed) without those a feed drops by rule."""
    return packets.where((F.col("n") * 31 + F.col("feed") * 17) % 100 >= percent)


def lookup(sent: DataFrame, requests: DataFrame, last: int | None = None) -> DataFrame:
    """The sent packets (first_seq, count, ...) that overlap requests (want, want_count).

    last: only so many of the latest packets are still held.
    """
    if last is not None:
        sent = sent.orderBy(F.desc("first_seq")).limit(last)
    def spread(df: DataFrame, first: str, count: str, name: str) -> DataFrame:
        lo, hi = F.expr(f"{first} div {SPREAD}"), F.expr(f"({first} + greatest({count}, 1) - 1) div {SPREAD}")
        return df.withColumn(name, lo).withColumn("_range", F.explode(F.sequence(lo, hi)))

    both = spread(sent, "first_seq", "count", "_a").join(spread(requests, "want", "want_count", "_b"), "_range")
    once = F.col("_range") == F.greatest("_a", "_b")  # a pair meets in each range both are in
    overlap = (F.col("first_seq") < F.col("want") + F.col("want_count")) & (F.col("first_seq") + F.col("count") > F.col("want"))
    return both.where(once & overlap).drop("_range", "_a", "_b")


class Arbiter:
    """One receiver's view of a stream: which blocks of which packet go through, and when.

    It sees headers only. `tag` is whatever names a packet to the caller.
    """

    def __init__(self, most_held: int = 1024):
        self.most_held, self.next, self.eos, self.complete = most_held, None, None, False
        self.waiting: dict[int, tuple] = {}  # first number -> (tag, count, good, whole)
        self.order: list[int] = []  # a heap of the numbers in `waiting`
        self.quiet: int | None = None  # packets ahead since the last request, None without a hole
        self.n = dict.fromkeys(("packets", "applied", "duplicates", "overlaps", "gaps", "requests", "dropped", "malformed"), 0)

    def _ahead(self, first: int) -> tuple[int, int] | None:
        """The request for the hole before `first`, if it is time for one."""
        self.n["gaps"] += self.quiet is None
        self.quiet = REQUEST_EVERY if self.quiet is None else self.quiet + 1
        if self.quiet < REQUEST_EVERY:
            return None
        self.quiet = 0
        self.n["requests"] += 1
        return self.next, min(first - self.next, MOST_REQUESTED)

    def _through(self, first: int, tag, count: int, good: int, whole: bool) -> tuple:
        """(tag, first, from, to): the blocks of a packet that starts at the next number or before."""
        skip = self.next - first
        self.n["overlaps"] += skip > 0
        self.n["applied"] += max(0, good - skip)
        if whole:
            self.next, self.quiet = first + count, None
        else:
            self.n["malformed"] += 1
            self.next = max(self.next, first + good)  # never backwards
        return tag, first, skip, good

    def offer(self, tag, first: int | None, count: int, good: int, whole: bool) -> tuple[list[tuple], tuple[int, int] | None]:
        """Blocks that a packet lets through, its own and held ones, and the request it causes.

        first: None for a packet without a header; good: its blocks before the first bad one;
        whole: whether `count` blocks fill it.
        """
        if first is None:
            self.n["malformed"] += 1
            return [], None
        self.n["packets"] += 1
        self.next = first if self.next is None else self.next
        ask, out = None, []
        if count == END_OF_SESSION:
            self.eos = first
        elif first > self.next:
            if count and len(self.waiting) >= self.most_held:
                self.n["dropped"] += 1
            elif count and first not in self.waiting:
                self.waiting[first] = tag, count, good, whole
                heapq.heappush(self.order, first)
            ask = self._ahead(first)
        elif count and first + count <= self.next:
            self.n["duplicates"] += 1
        elif count:
            out.append(self._through(first, tag, count, good, whole))
        while self.order and self.order[0] <= self.next:
            at = heapq.heappop(self.order)
            item = self.waiting.pop(at)
            if at + item[1] > self.next:
                out.append(self._through(at, *item))
        self.complete = self.complete or (self.eos is not None and self.next >= self.eos)
        return out, ask

    def packet(self, p: bytes) -> tuple[list[tuple[int, bytes]], tuple[int, int] | None]:
        """Messages that the packet lets through, and the request it causes."""
        if len(p) < HEADER:
            return self.offer(None, None, 0, 0, False)
        first, count = struct.unpack_from(">QH", p, 10)
        blocks, whole = ([], True) if count == END_OF_SESSION else walk_blocks(p[HEADER:], count)
        out, ask = self.offer(blocks, first, count, len(blocks), whole)
        return [(at + i, own[i]) for own, at, skip, good in out for i in range(skip, good)], ask

    def counters(self) -> dict[str, int]:
        return {k: int(v) for k, v in {**self.n, "next_seq": self.next or 0, "complete": self.complete}.items()}


ARBITRATED = "stream string, row string, arrival long, msg_seq long, count long, payload binary, counters map<string,long>"
_HEADS = "id long, stream string, arrival long, first long, count long, good long, whole boolean"
_VERDICTS = "stream string, row string, arrival long, msg_seq long, count long, id long, skip long, counters map<string,long>"


class _Heads:
    """The fold of one stream's headers."""

    def __init__(self, stream: str, most_held: int):
        self.stream, self.arbiter = stream, Arbiter(most_held)

    def step(self, r: dict) -> list[tuple]:
        out, ask = self.arbiter.offer(r["id"], r["first"], r["count"] or 0, r["good"] or 0, bool(r["whole"]))
        rows = [(self.stream, "message", r["arrival"], first, good, tag, skip, None) for tag, first, skip, good in out if good > skip]
        return rows + ([(self.stream, "request", r["arrival"], *ask, None, None, None)] if ask else [])

    def end(self) -> list[tuple]:
        return [(self.stream, "counters", None, None, None, None, None, self.arbiter.counters())]


def _head_rows(batches):
    """Packets without their payloads."""
    for b in batches:
        rows = []
        for p in b.column("packet").to_pylist():
            if p is None or len(p) < HEADER:
                rows.append((None, None, None, None))
                continue
            first, count = struct.unpack_from(">QH", p, 10)
            blocks, whole = ([], True) if count == END_OF_SESSION else walk_blocks(p[HEADER:], count)
            rows.append((first, count, len(blocks), whole))
        parts = [pa.array([r[i] for r in rows], pa.bool_() if i == 3 else pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("stream"), b.column("arrival"), *parts], names=[c.split()[0] for c in _HEADS.split(", ")])


def arbitrate(packets: DataFrame, most_held: int = 1024) -> DataFrame:
    """Messages, re-requests and a last row of counters for each stream of packets.

    packets: stream, arrival, packet. The counters depend on arrival order, so a stream is a fold,
    of headers only; payloads are joined to the blocks that went through by the packet's number,
    so a busy stream sends no payload to one task.
    """
    own = cut(packets.select("stream", "arrival", "packet").withColumn("id", F.monotonically_increasing_id()), "packets")
    heads = own.select("id", "stream", "arrival", "packet").mapInArrow(_head_rows, _HEADS)
    verdicts = cut(ordered_fold(heads, "stream", ["arrival", "id"], lambda s: _Heads(s, most_held), _VERDICTS), "verdicts")

    def blocks(batches):
        for b in batches:
            rows = []
            for i, (p, first, skip, good) in enumerate(zip(*[b.column(c).to_pylist() for c in ("packet", "msg_seq", "skip", "count")], strict=True)):
                rows += [(i, first + k, x) for k, x in enumerate(walk_blocks(p[HEADER:], good)[0]) if k >= skip]
            at = pa.array([r[0] for r in rows], pa.int64())
            n, numbers, payloads = len(rows), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("stream").take(at), pa.array(["message"] * n, pa.string()), b.column("arrival").take(at), numbers, pa.array([1] * n, pa.int64()), payloads, pa.nulls(n, pa.map_(pa.string(), pa.int64()))],
                names=[c.split()[0] for c in ARBITRATED.split(", ")],
            )

    through = verdicts.where("row = 'message'").select("id", "stream", "arrival", "msg_seq", "skip", "count").join(own.select("id", "packet"), "id").mapInArrow(blocks, ARBITRATED)
    rest = verdicts.where("row <> 'message'").select("stream", "row", "arrival", "msg_seq", "count", F.lit(None).cast("binary").alias("payload"), "counters")
    return through.unionByName(rest)
