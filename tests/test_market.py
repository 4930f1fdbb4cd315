"""The market operators against small cases and a message-by-message fold."""

import random
import socket
import struct
import threading
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from depthweave.functions.wire import SIZES, decode
from depthweave.operators import audit, counters, histogram, l1, levels, matching, state, transport
from depthweave.operators.lifecycle import as_of, fold_locate, hostile_locates, lifecycle, live_now
from depthweave.sources.feed import frames, parse, parser_stats, read_frames, read_frames_anywhere, slice_until
from depthweave.sources.packets import UdpReader, bound, endpoint, is_multicast
from depthweave.sources.receiver import receive_file
from depthweave.sources.synthetic import SCHEMA, hostile_rows, write_framed

KEYS = "seq type locate ref new_ref side shares price printable code".split()


def feed_of(spark, *rows):
    full = [tuple({"locate": 1, "seq": i, **r}.get(k) for k in KEYS) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def add(ref, side, shares, price, **k):
    return dict(type="A", ref=ref, side=side, shares=shares, price=price, **k)


def test_execution_volume_and_hidden_prints(spark):
    feed = feed_of(
        spark, add(1, "B", 100, 10000), add(2, "S", 80, 10010), dict(type="E", ref=1, shares=40), dict(type="C", ref=2, shares=30, price=10005, printable=False), dict(type="C", ref=2, shares=20, price=10005, printable=True),
        dict(type="P", shares=500, price=1), dict(type="Q", shares=5_000_000_000, price=1), dict(type="X", ref=1, shares=500), dict(type="D", ref=44),
    )
    life = lifecycle(feed)
    row = counters.counters(life, feed).first().asDict()
    assert row == {"unknown_ref": 1, "duplicate_ref": 0, "clamped": 1, "volume_lit": 60, "volume_hidden": 500, "volume_cross": 5_000_000_000, "nonprintable_execs": 1}
    assert [tuple(r) for r in levels.depth(live_now(life)).select("side", "price", "qty", "orders").collect()] == [("S", 10010, 30, 1)]


def test_replace_inherits_side_and_loses_its_place(spark):
    feed = feed_of(spark, add(1, "B", 100, 10000), add(2, "B", 50, 10000), dict(type="U", ref=1, new_ref=10, shares=100, price=10000), dict(type="U", ref=99, new_ref=3, shares=1, price=1), dict(type="D", ref=3))
    life = lifecycle(feed)
    assert levels.fifo(live_now(life)).first()["refs"] == [2, 10]
    assert counters.counters(life, feed).first()["unknown_ref"] == 2


def test_reused_references_and_empty_orders_take_the_fold(spark):
    feed = feed_of(spark, add(1, "B", 100, 5), add(1, "S", 7, 9), dict(type="D", ref=1), add(1, "S", 30, 9), add(2, "B", 0, 4), dict(type="X", ref=2, shares=5), add(3, "B", 10, 4), dict(type="U", ref=3, new_ref=3, shares=5, price=4))
    assert hostile_locates(feed).count() == 1
    life = lifecycle(feed)
    assert sorted((r.ref, r.side, r.remaining) for r in live_now(life).collect()) == [(1, "S", 30), (3, "B", 10)]
    c = counters.counters(life, feed).first()
    assert (c["duplicate_ref"], c["clamped"]) == (2, 1)


def test_audit_reasons(spark):
    feed = feed_of(spark, add(1, "B", 100, 5), dict(type="E", ref=1, shares=1), add(2, "B", 50, 5), dict(type="E", ref=2, shares=50), dict(type="E", ref=42, shares=1), dict(type="E", ref=1, shares=1), dict(type="H", code="Q"), dict(type="E", ref=1, shares=1))
    system = spark.createDataFrame([(2, "Q")], "seq long, code string")
    out = {r.seq: r.verdict for r in audit.front_audit(lifecycle(feed), feed, system).collect()}
    assert out == {1: "phase", 3: "behind", 4: "unknown", 5: "front", 7: "halted"}


@pytest.mark.parametrize(("seed", "reuse"), [(1, False), (2, False), (3, True)])
def test_hostile_streams_equal_the_fold(spark, seed, reuse):
    rows = hostile_rows(1200, seed, reuse=reuse)
    feed = spark.createDataFrame(rows, SCHEMA)
    life = lifecycle(feed)
    got = {(r.locate, r.ref, r.birth_seq): (r.side, r.price, r.shares, r.death_seq, r.remaining) for r in life.orders.collect()}
    ops = {r.seq: (r.applied, r.removes, r.outcome) for r in life.ops.collect()}
    want, want_ops = {}, {}
    pdf = pd.DataFrame(rows, columns=KEYS).astype(object)
    for _, g in pdf[pdf["type"].isin(list("AECXDU"))].groupby("locate"):
        orders, done = fold_locate(g)
        want |= {(o[0], o[1], o[5]): (o[2], o[3], o[4], o[6], o[7]) for o in orders}
        want_ops |= {o[0]: (o[11], o[12], o[13]) for o in done}
    assert got == want
    assert ops == want_ops


def test_state_resumes_to_the_same_orders(spark, tmp_path):
    feed = spark.createDataFrame(hostile_rows(600, 9), SCHEMA)
    path = f"file://{tmp_path}/state"
    state.save_state(feed, 300, path)
    cols = ["locate", "ref", "side", "price", "remaining", "birth_seq"]
    straight, resumed = live_now(lifecycle(feed)).select(*cols), live_now(state.resume(spark, path, feed)).select(*cols)
    assert state.difference(straight, resumed).count() == 0
    assert as_of(lifecycle(feed), 10**6).count() == straight.count()
    spark.createDataFrame([("other", 1, 1)], "format string, at long, messages long").write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError):
        state.load_state(spark, path)


def test_framed_files(spark, tmp_path):
    feed = spark.createDataFrame(hostile_rows(200, 4), SCHEMA)
    path = str(tmp_path / "day.bin")
    write_framed(feed, path)
    for raw in (read_frames(spark, path, 1000), read_frames_anywhere(spark, path)):
        back = parse(raw)
        assert parser_stats(raw).first().asDict() == {"messages": 200, "unknown": 0, "malformed": 0, "truncated": False}
        assert [r.type for r in back.orderBy("offset").collect()] == [r.type for r in feed.orderBy("seq").collect()]
    with open(path, "ab") as f:
        f.write(struct.pack(">H", 36) + b"A" * 35)
    assert parser_stats(read_frames(spark, path)).first()["truncated"]
    (tmp_path / "empty.bin").write_bytes(b"")
    assert parser_stats(read_frames(spark, str(tmp_path / "empty.bin"))).first()["messages"] == 0


def test_malformed_and_unknown_messages(spark):
    bad_side = b"A" + bytes(18) + b"x" + bytes(16)
    rows = [(b"z",), (b"D" + bytes(3),), (bad_side,), (b"D" + bytes(18),)]
    df = spark.createDataFrame(rows, "payload binary").select(*[e.alias(n) for n, e in decode(F.col("payload")).items()])
    assert [r.status for r in df.collect()] == ["unknown", "malformed", "malformed", "ok"]
    assert SIZES["A"] == len(bad_side)


def test_slice_is_a_prefix(spark):
    df = spark.createDataFrame([(0, 5), (1, 20), (2, 6)], "seq long, ts_ns long")
    assert [r.seq for r in slice_until(df, 10).collect()] == [0]
    assert slice_until(df, 30).count() == 3
    with pytest.raises(ValueError):
        slice_until(df, 0)


def submits(*rows):
    keys = "seq kind locate ref new_ref side limit qty tif code".split()
    base = {"kind": "submit", "locate": 1, "tif": "limit"}
    return pd.DataFrame([{**base, "seq": i, **r} for i, r in enumerate(rows)], columns=keys).astype(object)


def results(*rows):
    out = matching.fold(submits(*rows))
    fills = [(r.ref, r.maker, r.price, r.qty) for r in out[out.row == "fill"].itertuples()]
    return [(r.status, r.filled, r.resting, r.cancelled) for r in out[out.row == "result"].itertuples()], fills


def test_matching_cases():
    s = lambda ref, side, limit, qty, **k: dict(ref=ref, side=side, limit=limit, qty=qty, **k)
    r, f = results(s(1, "S", 10010, 100), s(2, "B", 10020, 60))
    assert r[1] == ("filled", 60, 0, 0) and f == [(2, 1, 10010, 60)]
    r, f = results(s(1, "S", 10010, 50), s(2, "S", 10010, 50), s(3, "S", 10020, 50), s(10, "B", 10020, 120))
    assert [x[1] for x in f] == [1, 2, 3] and f[-1][3] == 20
    assert results(s(1, "S", 10010, 30), s(2, "B", 10010, 100))[0][1] == ("partial_rested", 30, 70, 0)
    assert results(s(1, "S", 10010, 30), s(2, "B", 10015, 100, tif="ioc"))[0][1] == ("ioc_cancelled", 30, 0, 70)
    assert [x[0] for x in results(s(1, "B", 1, 5), s(1, "B", 1, 5), s(2, "B", 1, 0))[0]] == ["rested", "rejected_duplicate", "rejected_invalid"]
    assert [x[0] for x in results(dict(kind="state", code="H"), s(1, "B", 1, 5), dict(kind="state", code="T"), s(1, "B", 1, 5))[0]] == ["rejected_halted", "rested"]
    r, _ = results(s(1, "S", 10010, 50), s(2, "B", 10000, 80), dict(kind="replace", ref=2, new_ref=3, limit=10010, qty=80))
    assert r[2] == ("partial_rested", 50, 30, 0)


def test_sweep_equals_the_fold(spark):
    rows = [(1, i, "S", 100 + i % 3, 10 * (1 + i % 4), i) for i in range(1, 12)]
    live = spark.createDataFrame(rows, "locate int, ref long, side string, price long, remaining long, birth_seq long")
    taker = spark.createDataFrame([(1, "B", 101, 95)], "locate int, taker_side string, limit long, qty long")
    got = sorted((r.maker, r.fill) for r in matching.sweep(live, taker).collect())
    _, fills = results(*[dict(ref=r[1], side="S", limit=r[3], qty=r[4]) for r in rows], dict(ref=99, side="B", limit=101, qty=95))
    assert got == sorted((f[1], f[3]) for f in fills)


def packet(seq, count, blocks=None, session=b"S".ljust(10)):
    body = b"".join(struct.pack(">H", len(x)) + x for x in (blocks if blocks is not None else [b"m%d" % (seq + i) for i in range(count)] if count != 0xFFFF else []))
    return session + struct.pack(">QH", seq, count) + body


def arbitrated(*packets, **k):
    a, asked, got = transport.Arbiter(**k), [], []
    for p in packets:
        out, ask = a.packet(p)
        got += out
        asked += [ask] if ask else []
    return a, asked, got


def test_arbitration_cases():
    a, asked, got = arbitrated(packet(1, 3), packet(4, 2))
    assert (len(got), a.next, asked) == (5, 6, [])
    a, _, got = arbitrated(packet(1, 3), packet(1, 3), packet(4, 1), packet(4, 1))
    assert (len(got), a.n["duplicates"]) == (4, 2)
    a, asked, got = arbitrated(packet(1, 2), packet(6, 2), packet(3, 3))
    assert (asked, len(got), a.next, a.n["gaps"]) == ([(3, 3)], 7, 8, 1)
    a, _, got = arbitrated(packet(1, 3), packet(2, 4))
    assert (len(got), a.n["overlaps"]) == (5, 1)
    first = [packet(1, 2), packet(6, 0), packet(6, 0xFFFF)]
    a, asked, _ = arbitrated(*first)
    assert asked == [(3, 3)] and not a.complete
    assert arbitrated(*first, packet(3, 3))[0].complete
    a, asked, _ = arbitrated(packet(500, 2))
    assert (a.next, asked) == (502, [])
    a, _, got = arbitrated(b"0123456789", packet(1, 2, [b"ok", b""]), packet(1, 3))
    assert a.n["malformed"] == 2 and [x for _, x in got][0] == b"ok"


def test_gaps_and_lookup(spark):
    seen = spark.createDataFrame([("s", x) for x in (1, 2, 5, 9, 10, 40)], "session string, msg_seq long")
    want = [(3, 4), (6, 8), (11, 39)]
    for span in (4, 1 << 20):
        assert sorted((r.first_missing, r.last_missing) for r in transport.gaps(seen, span).collect()) == want
    sent = spark.createDataFrame([(1, 2), (3, 2), (5, 2)], "first_seq long, count long")
    ask = lambda a, n: spark.createDataFrame([(a, n)], "want long, want_count long")
    assert transport.lookup(sent, ask(1, 2), 2).count() == 0
    assert transport.lookup(sent, ask(4, 3), 2).count() == 2


def test_histogram_quantiles(spark):
    values = spark.range(32).select(F.col("id").alias("v"))
    assert histogram.quantiles(histogram.record(values, "v"), [0.5]).first()["value"] == 16
    none = histogram.record(values.where("v < 0"), "v")
    assert histogram.quantiles(none, [0.5]).first()["value"] == 0
    assert histogram.summary(none).first()["n"] == 0
    big = spark.range(2000).select((F.col("id") * 977).alias("v"))
    row = big.select("v", histogram.upper_edge(histogram.bucket(F.col("v"))).alias("u")).where("u < v or u > v * 1.033 + 1").count()
    assert row == 0


def test_endpoints():
    assert endpoint("127.0.0.1:6001") == ("127.0.0.1", 6001)
    assert [endpoint(x) for x in ("a:1", "1.2.3.4:0", "1.2.3.4:65536", "1.2.3.4", "1.2.3.400:5")] == [None] * 5
    assert is_multicast("233.1.2.3") and not is_multicast("10.0.0.1")


def test_snapshots_cover_every_live_order(spark):
    duckdb = pytest.importorskip("duckdb")
    from depthweave.plans import registry

    folder, con = Path("/root/testdata/sf0.001"), duckdb.connect()
    if not folder.exists():
        pytest.skip("no test data")
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = sorted(map(tuple, registry.QUERIES["b16_all_order_snapshots"](spark, str(folder)).collect()))
    assert len({x[0] for x in got}) > 1
    assert got == sorted(con.execute(registry.SQL["b16_all_order_snapshots"]).fetchall())


HEAD = struct.pack(">HH", 7, 513) + (34_200_000_000_000).to_bytes(6, "big")
WIRE = [
    (b"S" + HEAD + b"Q", {"type": "S", "code": "Q"}),
    (b"R" + HEAD + b"ABC     " + b"QN" + struct.pack(">I", 100) + b"\0" * 14, {"type": "R", "stock": "ABC     ", "market_category": "Q", "financial_status": "N", "round_lot": 100}),
    (b"H" + HEAD + b"ABC     " + b"H" + b"\0" + b"T12 ", {"type": "H", "stock": "ABC     ", "code": "H", "reason": "T12 "}),
    (b"A" + HEAD + struct.pack(">Q", 2**40 + 3) + b"B" + struct.pack(">I", 300) + b"ABC     " + struct.pack(">I", 4_000_000_000), {"type": "A", "ref": 2**40 + 3, "side": "B", "shares": 300, "price": 4_000_000_000}),
    (b"F" + HEAD + struct.pack(">Q", 5) + b"S" + struct.pack(">I", 1) + b"ABC     " + struct.pack(">I", 2) + b"MPID", {"type": "F", "ref": 5, "side": "S", "shares": 1, "price": 2, "mpid": "MPID"}),
    (b"E" + HEAD + struct.pack(">QIQ", 9, 40, 77), {"type": "E", "ref": 9, "shares": 40, "match": 77}),
    (b"C" + HEAD + struct.pack(">QIQ", 9, 40, 78) + b"N" + struct.pack(">I", 10_005), {"type": "C", "ref": 9, "shares": 40, "match": 78, "printable": False, "price": 10_005}),
    (b"X" + HEAD + struct.pack(">QI", 9, 11), {"type": "X", "ref": 9, "shares": 11}),
    (b"D" + HEAD + struct.pack(">Q", 9), {"type": "D", "ref": 9}),
    (b"U" + HEAD + struct.pack(">QQII", 9, 10, 70, 10_020), {"type": "U", "ref": 9, "new_ref": 10, "shares": 70, "price": 10_020}),
    (b"P" + HEAD + struct.pack(">Q", 0) + b"B" + struct.pack(">I", 500) + b"ABC     " + struct.pack(">IQ", 10_001, 79), {"type": "P", "shares": 500, "price": 10_001, "match": 79}),
    (b"Q" + HEAD + struct.pack(">Q", 5_000_000_000) + b"ABC     " + struct.pack(">IQ", 10_002, 80) + b"O", {"type": "Q", "cross_shares": 5_000_000_000, "price": 10_002, "match": 80, "code": "O"}),
]


def test_decoding_equals_the_published_layout(spark):
    """Bytes packed here field by field, not by our own encoder."""
    bad = [b"z" + HEAD, WIRE[4][0][:-1], WIRE[3][0][:19] + b"?" + WIRE[3][0][20:]]
    raw = spark.createDataFrame([(i, p, None) for i, p in enumerate([w for w, _ in WIRE] + bad)], "seq long, payload binary, end string")
    rows = sorted(parse(raw).collect(), key=lambda r: r.seq)
    for row, (_, want) in zip(rows, WIRE, strict=False):
        assert (row.status, row.locate, row.tracking, row.ts_ns) == ("ok", 7, 513, 34_200_000_000_000)
        assert {k: row[k] for k in want} == want
    assert [r.status for r in rows[len(WIRE) :]] == ["unknown", "malformed", "malformed"]


def test_matching_conserves_shares_and_never_crosses():
    rng, rows, live = random.Random(11), [], []
    for seq in range(3000):
        luck = rng.random()
        if luck < 0.7 or not live:
            rows.append({"ref": seq, "side": rng.choice("BS"), "limit": 1000 + rng.randint(-6, 6), "qty": rng.randint(1, 90), "tif": rng.choice(["limit", "limit", "ioc"])})
            live.append(seq)
        else:
            rows.append({"kind": "cancel", "ref": rng.choice(live), "qty": rng.randint(1, 60)})
    out = matching.fold(submits(*rows))
    of = {i: r for i, r in enumerate(rows)}
    filled: dict = {}
    for f in out[out.row == "fill"].itertuples():
        taker, maker = of[f.ref], of[f.maker]
        assert taker["side"] != maker["side"] and f.price == maker["limit"] and f.maker < f.ref
        assert f.price <= taker["limit"] if taker["side"] == "B" else f.price >= taker["limit"]
        for ref in (f.ref, f.maker):
            filled[ref] = filled.get(ref, 0) + f.qty
    gone: dict = {}
    for r in out[out.row == "result"].itertuples():
        gone[r.ref] = gone.get(r.ref, 0) + (r.cancelled or 0)
    resting = {r.ref: r for r in out[out.row == "resting"].itertuples()}
    for ref, row in of.items():
        if "side" in row:
            assert row["qty"] == filled.get(ref, 0) + gone.get(ref, 0) + (resting[ref].qty if ref in resting else 0)
    bids, asks = ([r.price for r in resting.values() if r.side == x] for x in "BS")
    assert bids and asks and max(bids) < min(asks)
    counts = {r.status: r.qty for r in out[out.row == "counter"].itertuples()}
    assert counts["volume_matched"] == sum(out[out.row == "fill"].qty) > 0 and counts["unknown_ref"] > 0
    last: dict = {}
    for r in out[out.row == "level"].itertuples():
        last[r.side, r.price] = r.qty
    sums: dict = {}
    for r in resting.values():
        sums[r.side, r.price] = sums.get((r.side, r.price), 0) + r.qty
    assert {k: v for k, v in last.items() if v} == sums


def test_what_rests_changes_its_level_before_it_is_added():
    out = matching.fold(submits({"ref": 1, "side": "S", "limit": 10, "qty": 30}, {"ref": 2, "side": "B", "limit": 10, "qty": 50}, {"kind": "cancel", "ref": 2, "qty": 5}))
    tape = [(r.seq, r.row, r.side, r.qty) for r in out.itertuples() if r.row in ("exec", "level", "add", "cancel")]
    assert tape == [(0, "level", "S", 30), (0, "add", "S", 30), (1, "exec", "S", 30), (1, "level", "S", 0), (1, "level", "B", 20), (1, "add", "B", 20), (2, "cancel", "B", 5), (2, "level", "B", 15)]


def test_resumed_counters_books_and_phase(spark, tmp_path):
    feed = spark.createDataFrame(hostile_rows(600, 3, reuse=True), SCHEMA)
    system = spark.createDataFrame([(100, "Q"), (500, "M")], "seq long, code string")
    state.save_state(feed, 300, str(tmp_path), system)
    assert spark.read.parquet(f"{tmp_path}/meta").first()["phase"] == "open" and state.resumed_phase(spark, str(tmp_path), system, 600) == "closed"
    whole = counters.counters(lifecycle(feed), feed).first()
    assert state.resumed_counters(spark, str(tmp_path), feed).first() == whole and whole["duplicate_ref"] > 0
    assert {r.locate for r in state.resumed_books(spark, str(tmp_path), feed).collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("span", [16, 1 << 18])
def test_best_prices_equal_the_fold(spark, span):
    """Best prices after each message, with ranges shorter and longer than most lives."""
    rows = hostile_rows(700, 11)
    feed = spark.createDataFrame(rows, SCHEMA)
    life = lifecycle(feed)
    lives = [(o.locate, o.side, o.price, o.birth_seq, o.death_seq) for o in life.orders.collect()]
    got = {(r.seq, r.locate): (r.best_bid, r.best_ask) for r in l1.l1_tape(life, feed, span).collect()}
    want = {}
    for m in (dict(zip(KEYS, r, strict=True)) for r in rows):
        if m["type"] in "AFECXDU":
            at = lambda side, m=m: [p for loc, s, p, b, d in lives if loc == m["locate"] and s == side and b <= m["seq"] and (d is None or d > m["seq"])]
            want[m["seq"], m["locate"]] = max(at("B"), default=None), min(at("S"), default=None)
    assert got == want


def test_arbitration_of_tables_equals_the_receiver(spark):
    """The header fold with payloads joined back gives what one receiver gets packet by packet."""
    rng = random.Random(5)
    packets = []
    for n in range(1, 160, 4):
        for feed in (0, 1):
            if rng.random() > 0.25:
                packets.append((n + rng.randrange(12) + feed, packet(n, 4)))
    packets += [(200, b"short"), (201, packet(164, 3, [b"x", b""])), (202, packet(170, 0)), (203, packet(400, 0xFFFF))]
    rows = [("one", i, p) for i, (_, p) in enumerate(sorted(packets, key=lambda x: x[0]))] + [("two", 0, packet(9, 2))]
    out = transport.arbitrate(spark.createDataFrame(rows, "stream string, arrival long, packet binary")).collect()
    for stream in ("one", "two"):
        a, asked, got = arbitrated(*[p for s, _, p in rows if s == stream])
        mine = [r for r in out if r.stream == stream]
        assert sorted((r.msg_seq, r.payload) for r in mine if r.row == "message") == sorted((n, x) for n, x in got)
        assert sorted((r.msg_seq, r["count"]) for r in mine if r.row == "request") == sorted(asked)
        assert [r.counters for r in mine if r.row == "counters"] == [a.counters()]


def test_matching_in_batches_equals_the_fold(spark):
    """References beyond 2^53 stay exact, and a symbol's events may come in many batches."""
    rng, big = random.Random(3), 1 << 62
    rows = [dict(seq=i, kind=rng.choice(["submit"] * 4 + ["cancel", "delete", "replace"]), locate=i % 2 + 1, ref=big + rng.randrange(60), new_ref=big + 100 + i, side=rng.choice("BS"), limit=100 + rng.randrange(5), qty=rng.randrange(1, 30), tif="limit", code=None) for i in range(400)]
    schema = "seq long, kind string, locate int, ref long, new_ref long, side string, limit long, qty long, tif string, code string"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(str, (tuple(r) for r in matching.match(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for locate in (1, 2):
        own = matching.MatchFold(locate)
        made = [x for r in rows if r["locate"] == locate for x in own.step(r)] + own.end()
        want += [str(x) for x in made if x[2] in ("fill", "result", "resting")]
    assert got == sorted(want)


def test_byte_ranges_equal_one_pass(spark, tmp_path):
    """Ranges of any size give each message once, with unknown types, long messages and an early end mark."""
    rng = random.Random(8)
    sized = [(t, n) for t, n in SIZES.items()]
    body = b""
    for i in range(1500):
        kind, n = rng.choice(sized) if rng.random() < 0.9 else ("z", rng.choice((3, 700, 5000)))
        # bodies full of bytes that look like lengths and types
        body += struct.pack(">H", n) + kind.encode() + bytes(rng.choice(b"\x00\x13\x24ADX") for _ in range(n - 1))
    (tmp_path / "a.bin").write_bytes(body)
    (tmp_path / "b.bin").write_bytes(body + bytes(2) + body)
    (tmp_path / "c.bin").write_bytes(body[:-7])
    want = [(p.name, o, None if x is None else bytes(x), e) for p in sorted(tmp_path.iterdir()) for o, x, e in frames(p.read_bytes())]
    for split in (900, 4096, 1 << 20):
        got = [(r.file.rpartition("/")[2], r.offset, None if r.payload is None else bytes(r.payload), r.end) for r in read_frames(spark, str(tmp_path), split).collect()]
        assert sorted(got, key=lambda r: (r[0], r[1])) == want


def test_logged_packets_come_again_and_a_receiver_heals_gaps(tmp_path):
    at = ("127.0.0.1", 47_311)
    reader, out = UdpReader(at, 0.3, str(tmp_path / "log")), socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    reader._bound()
    for i in range(5):
        out.sendto(b"p%d" % i, at)
    rows, end = reader.read({"arrival": 0})
    rows = list(rows)
    assert [p for _, p in rows] == [b"p%d" % i for i in range(5)] and end == {"arrival": 5}
    reader.socket.close()
    again = UdpReader(at, 0.1, str(tmp_path / "log"))
    assert list(again.readBetweenOffsets({"arrival": 0}, {"arrival": 5})) == rows
    with pytest.raises(ValueError):
        again.readBetweenOffsets({"arrival": 0}, {"arrival": 6})
    again.commit({"arrival": 5})
    assert not list((tmp_path / "log").iterdir())

    feeds, rewinder = [("127.0.0.1", 47_312), ("127.0.0.1", 47_313)], bound(("127.0.0.1", 47_314))
    rewinder.settimeout(10)

    def answer():
        ask, who = rewinder.recvfrom(100)
        first, n = struct.unpack_from(">QH", ask, 10)
        rewinder.sendto(packet(first, n), who)

    def send():
        time.sleep(0.5)  # until the receiver is bound
        for n in (1, 3, 9, 11):
            out.sendto(packet(n, 2), feeds[n % 4 // 2])
        out.sendto(packet(13, 0xFFFF), feeds[0])

    for f in (answer, send):
        threading.Thread(target=f, daemon=True).start()
    path = str(tmp_path / "session.bin")
    n = receive_file(path, feeds, rewinder.getsockname(), "S", idle_seconds=5)
    rewinder.close()
    out.close()
    assert (n["applied"], n["complete"], n["next_seq"]) == (12, 1, 13)
    got = [(x, e) for _, x, e in frames(Path(path).read_bytes())]
    assert got == [(b"m%d" % i, None) for i in range(1, 13)] + [(None, "mark")]


def _records_shuffled(spark) -> int:
    jvm, gw = spark._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gw.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_checkpoint_report_equals_a_book_kept_by_hand(spark):
    """Orders live through most of 600 checkpoints; rows go by messages and report, not by orders and checkpoints."""
    r, rows, want = random.Random(5), [], set()
    book: dict[int, list] = {}

    def shown(kind, messages):
        levels_: dict[tuple, list] = {}
        for locate, side, price, left in book.values():
            at = levels_.setdefault((locate, side, price), [0, 0])
            at[0], at[1] = at[0] + left, at[1] + 1
        for locate in (1, 2):
            for side in "BS":
                prices = sorted((p for x, s, p in levels_ if (x, s) == (locate, side)), reverse=side == "B")
                want.update((kind, messages, locate, side, p, *levels_[locate, side, p], i + 1) for i, p in enumerate(prices[:3]))

    for i in range(1200):
        x = r.random()
        if x < 0.75 or not book or 300 < i < 400:
            locate = 3 if 300 < i < 400 or i % 9 == 0 else 1 + i % 2  # for 100 messages the report's symbols are quiet
            if 300 < i < 400 and i % 2:
                rows.append(dict(type="H", locate=locate, code="T"))
            else:
                rows.append(add(i + 1, r.choice("BS"), 100 * r.randrange(1, 5), r.randrange(90, 110), locate=locate))
                book[i + 1] = [locate, rows[-1]["side"], rows[-1]["price"], rows[-1]["shares"]]
        else:
            ref = r.choice(list(book))
            own = book[ref]
            if x < 0.9:
                rows.append(dict(type="X", locate=own[0], ref=ref, shares=150))
                own[3] -= min(150, own[3])
            elif x < 0.95:
                rows.append(dict(type="D", locate=own[0], ref=ref))
                own[3] = 0
            else:
                rows.append(dict(type="U", locate=own[0], ref=ref, new_ref=i + 1, shares=200, price=r.randrange(90, 110)))
                own[3] = 0
                book[i + 1] = [own[0], own[1], rows[-1]["price"], 200]
            if not own[3]:
                del book[ref]
        if (i + 1) % 2 == 0:
            shown("checkpoint", i + 1)
    shown("end", 1200)
    feed = feed_of(spark, *rows)
    before = _records_shuffled(spark)
    got = levels.checkpoint_depth(lifecycle(feed, careful=False), feed, 2, 2, 3).select("kind", "messages", "locate", "side", "price", "qty", "orders", "level").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert _records_shuffled(spark) - before < 20 * len(rows)
    assert levels.checkpoint_depth(lifecycle(feed.limit(0)), feed.limit(0), 2, 2, 3).count() == 0


def test_golden_lines_of_many_checkpoints(spark):
    """1,000 orders that live on through 1,000 checkpoints: a header and two levels each, and no row for each order at each."""
    feed = feed_of(spark, *[add(i + 1, "BS"[i % 2], 100, 90 + i % 2) for i in range(1000)])
    before = _records_shuffled(spark)
    got = [tuple(x) for x in levels.golden_lines(levels.checkpoint_depth(lifecycle(feed, careful=False), feed, 1, 5, 3)).select("messages", "part", "side", "line").collect()]
    want = [(n, part, s, f"1 {s} {90 + j} {100 * ((n + 1 - j) // 2)} {(n + 1 - j) // 2}") for n, part in [*[(n, 0) for n in range(1, 1001)], (1000, 1)] for j, s in enumerate("BS") if n > j]
    want += [(n, 0, "", f"checkpoint {n}") for n in range(1, 1001)] + [(1000, 1, "", "end 1000")]
    assert sorted(got) == sorted(want)
    assert _records_shuffled(spark) - before < 50_000


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    """Both queries write tables in turn; what their shuffles left stayed until the driver collected its garbage."""
    from depthweave.functions.lineage import cut

    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = set(local.rglob("shuffle_*.data"))
    out = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids")), "wide")
    assert set(local.rglob("shuffle_*.data")) <= before
    assert out.count() == 7


def test_report_follows_the_busiest_symbols_only(spark, tmp_path):
    """Twenty thousand events of 16 symbols: the fates that are written are those of five."""
    from depthweave.functions.lineage import shared_dir
    from depthweave.plans.market import QUERIES

    events = spark.range(20_000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 1499).alias("user_id"), F.element_at(F.array(*map(F.lit, ["view", "click", "purchase", "error"])), (F.col("id") * 13 % 4 + 1).cast("int")).alias("event_type"), F.format_string('{"k": %d}', F.col("id") * 31 % 100).alias("props"))
    events.write.parquet(f"{tmp_path}/in/events.parquet")
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("fates-*"))
    lines = QUERIES["s11_golden_lines"](spark, f"{tmp_path}/in").where("part = 1 and locate > 0").collect()
    fates = spark.read.parquet(*map(str, set(shared.glob("fates-*")) - before))
    assert fates.select("locate").distinct().count() == 5 == len({x.locate for x in lines})
    assert len(lines) == 30
