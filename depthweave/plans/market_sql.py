"""DuckDB SQL for the market queries: births joined to operations, chains by recursion."""

from __future__ import annotations

FEED = """
WITH RECURSIVE e AS (SELECT event_id AS seq, CAST(user_id % 16 + 1 AS INT) AS locate, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
t AS (SELECT *, CASE WHEN k = 96 THEN 'Q' WHEN k = 97 THEN 'P' WHEN k >= 98 THEN 'H' WHEN event_type IN ('signup', 'view', 'click') THEN 'A'
  WHEN event_type = 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'C' ELSE 'E' END WHEN k % 3 = 0 THEN 'X' WHEN k % 3 = 1 THEN 'D' ELSE 'U' END AS type FROM e),
m AS (SELECT *, CAST(count(*) FILTER (type IN ('A', 'U')) OVER (PARTITION BY locate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS m FROM t),
nth AS (SELECT locate AS bl, m AS ordinal, seq AS bref FROM m WHERE type IN ('A', 'U')),
feed AS (SELECT seq, locate, type,
  CASE WHEN type = 'A' THEN seq WHEN type IN ('E','C','X','D','U') THEN coalesce(bref, seq + 1000000000) END AS ref,
  CASE WHEN type = 'U' THEN seq END AS new_ref,
  CASE WHEN type = 'A' THEN CASE WHEN seq % 2 = 0 THEN 'B' ELSE 'S' END END AS side,
  CASE WHEN type IN ('A','U','P','Q') THEN 100 * (1 + k % 9) WHEN type IN ('E','C','X') THEN 50 * (1 + k % 8) END AS shares,
  CASE WHEN type IN ('A','U') THEN 10000 + (seq * 7919) % 41 WHEN type IN ('C','P','Q') THEN 10000 + (seq * 104729) % 41 END AS price,
  CASE WHEN type = 'C' THEN k % 2 = 0 END AS printable,
  CASE WHEN type = 'H' THEN CASE WHEN k = 98 THEN 'H' ELSE 'T' END END AS code
  FROM m LEFT JOIN nth ON locate = bl AND type IN ('E','C','X','D','U') AND m > 0 AND ordinal = m - 1 - (seq * 31) % greatest(1, least(m, 40)))
"""

LIFE = FEED + """,
births AS (SELECT locate, coalesce(new_ref, ref) AS ref, seq AS birth_seq, price, shares, side AS s0, CASE WHEN type = 'U' THEN ref END AS parent FROM feed WHERE type IN ('A', 'U')),
named AS (SELECT f.seq, f.type, f.locate, f.ref, f.new_ref, f.shares AS qty, f.printable, f.price AS exec_price, b.birth_seq, b.shares AS size, b.price
  FROM feed f LEFT JOIN births b ON f.locate = b.locate AND f.ref = b.ref AND b.birth_seq < f.seq WHERE f.type IN ('E','C','X','D','U')),
run AS (SELECT *, CASE WHEN birth_seq IS NULL OR coalesce(max(CASE WHEN type IN ('D','U') THEN 1 ELSE 0 END) OVER w, 0) = 1 THEN 0
    ELSE greatest(0, size - coalesce(sum(CASE WHEN type IN ('E','C','X') THEN qty ELSE 0 END) OVER w, 0)) END AS rem
  FROM named WINDOW w AS (PARTITION BY locate, ref ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chain(locate, ref, side) AS (SELECT locate, ref, s0 FROM births WHERE parent IS NULL
  UNION ALL SELECT r.locate, r.new_ref, c.side FROM chain c JOIN run r ON r.type = 'U' AND r.rem > 0 AND r.locate = c.locate AND r.ref = c.ref),
ops AS (SELECT r.seq, r.type, r.locate, r.ref, r.new_ref, r.qty, r.printable, r.exec_price,
    CASE WHEN hit THEN r.side END AS side, CASE WHEN hit THEN r.price END AS price, CASE WHEN hit THEN r.birth_seq END AS birth_seq,
    CAST(CASE WHEN NOT hit THEN 0 WHEN type IN ('D','U') THEN rem ELSE least(qty, rem) END AS BIGINT) AS applied,
    hit AND (type IN ('D','U') OR qty >= rem) AS removes,
    CASE WHEN NOT hit THEN 'unknown' WHEN type NOT IN ('D','U') AND qty > rem THEN 'clamped' ELSE 'applied' END AS outcome
  FROM (SELECT run.*, chain.side, chain.side IS NOT NULL AND rem > 0 AS hit FROM run LEFT JOIN chain ON run.locate = chain.locate AND run.ref = chain.ref AND run.birth_seq IS NOT NULL) r),
orders AS (SELECT b.locate, b.ref, c.side, b.price, b.shares, b.birth_seq, d.death_seq, CAST(b.shares - coalesce(d.taken, 0) AS BIGINT) AS remaining, b.parent
  FROM births b JOIN chain c ON b.locate = c.locate AND b.ref = c.ref
  LEFT JOIN (SELECT locate, ref, max(CASE WHEN removes THEN seq END) AS death_seq, sum(applied) AS taken FROM ops GROUP BY locate, ref) d ON d.locate = b.locate AND d.ref = b.ref),
live AS (SELECT * FROM orders WHERE death_seq IS NULL),
books AS (SELECT DISTINCT locate FROM feed WHERE type IN ('A','F','E','C','X','D','U')),
fx AS (SELECT birth_seq AS seq, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS sub_seq, 'add' AS event, locate, ref, side, price, shares AS qty, shares AS dqty, 1 AS dcount, CAST(NULL AS BIGINT) AS tape, CAST(NULL AS BOOLEAN) AS prints FROM orders
  UNION ALL SELECT seq, 0, CASE WHEN type IN ('E','C') THEN 'exec' ELSE 'cancel' END, locate, ref, side, price, applied, -applied, CASE WHEN removes THEN -1 ELSE 0 END,
    CASE WHEN type = 'C' THEN exec_price END, CASE WHEN type = 'C' THEN printable WHEN type = 'E' THEN true END FROM ops WHERE birth_seq IS NOT NULL),
series AS (SELECT seq, sub_seq, locate, side, price, CAST(sum(dqty) OVER w AS BIGINT) AS qty_after, CAST(sum(dcount) OVER w AS BIGINT) AS orders_after FROM fx WINDOW w AS (PARTITION BY locate, side, price ORDER BY seq, sub_seq ROWS UNBOUNDED PRECEDING)),
size_ AS (SELECT count(*) AS n, max(seq) AS last FROM feed),
states AS (SELECT f.seq, f.locate, coalesce((SELECT h.code FROM feed h WHERE h.type = 'H' AND h.locate = f.locate AND h.seq <= f.seq ORDER BY h.seq DESC LIMIT 1), 'T') AS state FROM feed f WHERE f.type IN ('A','E','C')),
audit AS (SELECT o.seq, o.type, o.locate, o.ref, CASE WHEN 4 * o.seq < n OR 10 * o.seq >= 9 * n THEN 'phase' WHEN s.state <> 'T' THEN 'halted' WHEN o.birth_seq IS NULL THEN 'unknown'
    WHEN EXISTS (SELECT 1 FROM orders a WHERE a.locate = o.locate AND a.side = o.side AND a.price = o.price AND a.birth_seq < o.birth_seq AND (a.death_seq IS NULL OR a.death_seq >= o.seq)) THEN 'behind' ELSE 'front' END AS verdict
  FROM ops o JOIN states s ON s.seq = o.seq, size_ WHERE o.type IN ('E','C')),
events_seq AS (SELECT event_id AS seq FROM events),
msgs AS (SELECT seq + 1 AS msg_seq, seq // 8 AS n, f.feed, seq // 8 + 3 * f.feed AS arrival FROM events_seq, (VALUES (0), (1)) f(feed) WHERE (seq // 8 * 31 + f.feed * 17) % 100 >= 22),
seen AS (SELECT DISTINCT msg_seq FROM msgs),
holes AS (SELECT msg_seq + 1 AS first_missing, nxt - 1 AS last_missing FROM (SELECT msg_seq, lead(msg_seq) OVER (ORDER BY msg_seq) AS nxt FROM seen) WHERE nxt > msg_seq + 1)
"""

_COUNTS = """CAST(coalesce(sum(unknown_ref), 0) AS BIGINT) AS unknown_ref, CAST(coalesce(sum(duplicate_ref), 0) AS BIGINT) AS duplicate_ref, CAST(coalesce(sum(clamped), 0) AS BIGINT) AS clamped,
 CAST(coalesce(sum(volume_lit), 0) AS BIGINT) AS volume_lit, CAST(coalesce(sum(volume_hidden), 0) AS BIGINT) AS volume_hidden, CAST(coalesce(sum(volume_cross), 0) AS BIGINT) AS volume_cross,
 CAST(coalesce(sum(nonprintable_execs), 0) AS BIGINT) AS nonprintable_execs FROM (
 SELECT locate, (outcome = 'unknown')::INT AS unknown_ref, 0 AS duplicate_ref, (outcome = 'clamped')::INT AS clamped, CASE WHEN type = 'E' OR printable THEN applied ELSE 0 END AS volume_lit, 0 AS volume_hidden, 0 AS volume_cross,
   (type = 'C' AND NOT printable AND outcome <> 'unknown')::INT AS nonprintable_execs FROM ops
 UNION ALL SELECT locate, 0, 0, 0, 0, CASE WHEN type = 'P' THEN shares ELSE 0 END, CASE WHEN type = 'Q' THEN shares ELSE 0 END, 0 FROM feed WHERE type IN ('P', 'Q'))"""
_RANK = "CASE WHEN side = 'B' THEN -price ELSE price END"


def _checkpoint(every: int) -> str:
    return f""",
marks AS (SELECT 'checkpoint' AS kind, (seq + 1) AS messages, seq AS cp FROM feed WHERE (seq + 1) % {every} = 0 UNION ALL SELECT 'end', n, last FROM size_),
active AS (SELECT locate FROM feed WHERE type = 'A' GROUP BY locate ORDER BY count(*) DESC, locate LIMIT 5),
at_cp AS (SELECT kind, messages, locate, side, price, shares - coalesce((SELECT sum(applied) FROM ops p WHERE p.locate = o.locate AND p.ref = o.ref AND p.seq <= cp), 0) AS remaining
  FROM orders o JOIN marks ON birth_seq <= cp AND (death_seq IS NULL OR death_seq > cp) WHERE locate IN (SELECT locate FROM active)),
report AS (SELECT * FROM (SELECT kind, messages, locate, side, price, CAST(sum(remaining) AS BIGINT) AS qty, count(*) AS orders, row_number() OVER (PARTITION BY kind, messages, locate, side ORDER BY {_RANK}) AS level FROM at_cp GROUP BY kind, messages, locate, side, price) WHERE level <= 3)
"""


_BUCKET = "CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 6)) + (length(bin(v)) - 6) * 32 END"
_HIST = f"WITH c AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem), h AS (SELECT CAST({_BUCKET} AS INT) AS bucket, v FROM c)"
_QUANTILE = """, n AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi FROM c), o AS (SELECT bucket, row_number() OVER (ORDER BY v) - 1 AS r FROM h)
SELECT q, CASE WHEN q <= 0 THEN lo ELSE least(hi, CASE WHEN bucket < 32 THEN bucket ELSE ((bucket % 32 + 33)::BIGINT << (bucket // 32 - 1)) - 1 END) END AS value
FROM (VALUES (0.0::DOUBLE), (0.5), (0.9), (0.99), (0.999), (1.0)) w(q), n JOIN o ON o.r = least(n.n - 1, floor(q * n.n))"""

SQL = {
    "p1_feed": FEED + "SELECT * FROM feed",
    "d6_decode_round_trip": FEED + "SELECT seq, 'ok' AS status, type, locate, ref, new_ref, side, shares, price, printable, code FROM feed",
    "d7_parser_stats": FEED + "SELECT count(*) AS messages, count(*) FILTER (seq % 11 = 0) AS unknown, count(*) FILTER (seq % 11 <> 0 AND seq % 7 = 0) AS malformed, false AS truncated FROM feed",
    "d8_opposite_side": FEED + "SELECT CASE side WHEN 'B' THEN 'S' ELSE 'B' END AS side, count(*) AS n FROM feed WHERE type = 'A' GROUP BY 1",
    "d12_event_time_scaling": "SELECT event_id AS seq, (event_id * 1000003) // 50 AS due_ns FROM events",
    "s9_slice_until": FEED + ", z AS (SELECT seq, type, 34200000000000 + seq * 60000000 + CASE WHEN seq % 97 = 96 THEN 6000000000 ELSE 0 END AS ts_ns FROM feed) SELECT * FROM z WHERE seq < coalesce((SELECT min(seq) FROM z WHERE ts_ns > 34220000000000), 9000000000000000)",
    "d14_clock": "SELECT event_id AS seq, CASE WHEN event_id % 30 < 24 AND event_id % 70 < 60 THEN (event_id % 30 * 60 + event_id % 70) * 60000000000 END AS ns FROM events",
    "a1_type_counts": FEED + "SELECT type, count(*) AS messages FROM feed GROUP BY type",
    "a2_adds_per_locate": FEED + "SELECT locate, count(*) AS adds FROM feed WHERE type = 'A' GROUP BY locate",
    "a3_top_symbols": FEED + "SELECT locate, count(*) AS adds FROM feed WHERE type = 'A' GROUP BY locate ORDER BY adds DESC, locate LIMIT 5",
    "a4_checkpoint_depth": LIFE + _checkpoint(1000) + "SELECT * FROM report",
    "s11_golden_lines": LIFE + _checkpoint(2500) + "SELECT messages, (kind = 'end')::INT AS part, locate, side, CAST(level AS INT) AS level, concat_ws(' ', locate, side, price, qty, orders) AS line FROM report UNION ALL SELECT DISTINCT messages, (kind = 'end')::INT, -1, '', 0, concat_ws(' ', kind, messages) FROM report",
    "a5_top_depth": LIFE + f"SELECT * FROM (SELECT locate, side, price, CAST(sum(remaining) AS BIGINT) AS qty, count(*) AS orders, CAST(row_number() OVER (PARTITION BY locate, side ORDER BY {_RANK}) AS INT) AS level FROM live GROUP BY locate, side, price) WHERE level <= 10",
    "b20_counters": LIFE + "SELECT " + _COUNTS,
    "b20_counters_by_locate": LIFE + "SELECT locate, " + _COUNTS + " GROUP BY locate",
    "a7_shard_merge": LIFE + "SELECT " + _COUNTS,
    "b7_volumes": FEED + "SELECT CAST(coalesce(sum(shares) FILTER (type = 'P'), 0) AS BIGINT) AS volume_hidden, CAST(coalesce(sum(shares) FILTER (type = 'Q'), 0) AS BIGINT) AS volume_cross FROM feed",
    "j1_operations": LIFE + "SELECT seq, type, locate, ref, side, price, applied, removes, outcome FROM ops",
    "j2_replace_chains": LIFE + "SELECT locate, ref, parent, side, price, shares, birth_seq FROM orders WHERE parent IS NOT NULL",
    "b1_orders": LIFE + "SELECT locate, ref, side, price, shares, birth_seq, death_seq, remaining FROM orders",
    "b12_best_prices": LIFE + "SELECT locate, (SELECT max(price) FROM live l WHERE l.locate = books.locate AND side = 'B') AS best_bid, (SELECT min(price) FROM live l WHERE l.locate = books.locate AND side = 'S') AS best_ask FROM books",
    "b13_l2_depth": LIFE + "SELECT locate, side, price, CAST(sum(remaining) AS BIGINT) AS qty, count(*) AS orders FROM live GROUP BY locate, side, price",
    "b14_level_fifo": LIFE + "SELECT locate, side, price, CAST((SELECT count(*) FROM live b WHERE b.locate = a.locate AND b.side = a.side AND b.price = a.price AND b.birth_seq <= a.birth_seq) AS INT) AS position, ref, remaining FROM live a",
    "b14_level_queues": LIFE + "SELECT locate, side, price, string_agg(ref, ' ' ORDER BY birth_seq) AS refs FROM live GROUP BY locate, side, price",
    "b15_front_orders": LIFE + "SELECT locate, side, price, arg_min(ref, birth_seq) AS ref, arg_min(remaining, birth_seq) AS remaining FROM live GROUP BY locate, side, price",
    "b16_order_snapshots": LIFE + "SELECT ref, side, price, remaining FROM live WHERE locate = 1 AND ref % 10 = 0",
    "b16_all_order_snapshots": LIFE + "SELECT locate, ref, side, price, remaining FROM live",
    "b17_live_orders": LIFE + "SELECT locate, (SELECT count(*) FROM live l WHERE l.locate = books.locate) AS live_orders FROM books",
    "b18_violations": LIFE + "SELECT locate, side, price FROM live GROUP BY locate, side, price HAVING min(remaining) <= 0",
    "b19_listener_tape": LIFE + "SELECT seq, 2 * sub_seq AS sub_seq, event, locate, ref, side, coalesce(tape, price) AS price, qty, prints FROM fx UNION ALL SELECT seq, 2 * sub_seq + 1, 'level', locate, NULL, side, price, qty_after, NULL FROM series",
    "w3_level_series": LIFE + "SELECT * FROM series",
    "p10_books": LIFE + "SELECT * FROM books",
    "j4_trading_state": LIFE + "SELECT s.seq, s.locate, state, state IN ('H', 'P') AS rejects FROM states s JOIN feed f ON f.seq = s.seq WHERE f.type = 'A'",
    "j5_market_phase": FEED + "SELECT seq, locate, CASE WHEN 4 * seq < (SELECT count(*) FROM feed) THEN 'pre_open' WHEN 10 * seq < 9 * (SELECT count(*) FROM feed) THEN 'open' ELSE 'closed' END AS phase FROM feed",
    "w1_front_audit": LIFE + "SELECT * FROM audit",
    "w2_audit_counts": LIFE + """SELECT count(*) FILTER (verdict = 'phase') AS skipped_phase, count(*) FILTER (verdict = 'halted') AS skipped_halted, count(*) FILTER (verdict = 'unknown') AS skipped_unknown,
 count(*) FILTER (c AND type = 'E') AS e_checked, count(*) FILTER (f AND type = 'E') AS e_front, count(*) FILTER (c AND type = 'C') AS c_checked, count(*) FILTER (f AND type = 'C') AS c_front,
 coalesce(count(*) FILTER (f AND type = 'E') / nullif(count(*) FILTER (c AND type = 'E'), 0), 0.0::DOUBLE) AS e_rate, coalesce(count(*) FILTER (f AND type = 'C') / nullif(count(*) FILTER (c AND type = 'C'), 0), 0.0::DOUBLE) AS c_rate,
 coalesce(count(*) FILTER (f) / nullif(count(*) FILTER (c), 0), 0.0::DOUBLE) AS rate FROM (SELECT *, verdict IN ('front', 'behind') AS c, verdict = 'front' AS f FROM audit)""",
    "w4_l1_tape": LIFE + "SELECT f.seq, f.locate, max(CASE WHEN o.side = 'B' THEN o.price END) AS best_bid, min(CASE WHEN o.side = 'S' THEN o.price END) AS best_ask FROM feed f LEFT JOIN orders o ON o.locate = f.locate AND o.birth_seq <= f.seq AND (o.death_seq IS NULL OR o.death_seq > f.seq) WHERE f.type IN ('A','E','C','X','D','U') GROUP BY f.seq, f.locate",
    "w4_crossed_books": LIFE + "SELECT f.seq, f.locate FROM feed f JOIN orders o ON o.locate = f.locate AND o.birth_seq <= f.seq AND (o.death_seq IS NULL OR o.death_seq > f.seq) WHERE f.type IN ('A','E','C','X','D','U') GROUP BY f.seq, f.locate HAVING max(CASE WHEN o.side = 'B' THEN o.price END) >= min(CASE WHEN o.side = 'S' THEN o.price END)",
    "a9_peak_live": LIFE + "SELECT CAST(max(n) AS BIGINT) AS peak_live FROM (SELECT sum(d) OVER (ORDER BY seq) AS n FROM (SELECT birth_seq AS seq, 1 AS d FROM orders UNION ALL SELECT death_seq, -1 FROM orders WHERE death_seq IS NOT NULL))",
    "m10_static_sweep": LIFE + """, takers AS (SELECT locate, s AS taker_side, CASE s WHEN 'B' THEN 'S' ELSE 'B' END AS side, CASE s WHEN 'B' THEN 10030 ELSE 10010 END AS lim, 1000 * locate AS q FROM (SELECT DISTINCT locate FROM feed), (VALUES ('B'), ('S')) v(s)),
 inside AS (SELECT l.*, taker_side, q, CASE taker_side WHEN 'B' THEN price ELSE -price END AS rank FROM live l JOIN takers t ON l.locate = t.locate AND l.side = t.side WHERE CASE taker_side WHEN 'B' THEN price <= lim ELSE price >= lim END)
 SELECT locate, taker_side, maker, price, CAST(fill AS BIGINT) AS fill FROM (SELECT locate, taker_side, ref AS maker, price, least(remaining, q - coalesce((SELECT sum(b.remaining) FROM inside b WHERE b.locate = a.locate AND b.taker_side = a.taker_side AND (b.rank < a.rank OR (b.rank = a.rank AND b.birth_seq < a.birth_seq))), 0)) AS fill FROM inside a) WHERE fill > 0""",
    "t5_applied_messages": LIFE + "SELECT msg_seq, min(arrival) AS arrival, CAST(arg_min(feed, arrival * 2 + feed) AS INT) AS feed FROM msgs GROUP BY msg_seq",
    "t6_gaps": LIFE + "SELECT * FROM holes",
    "t8_session_complete": LIFE + "SELECT 'S1' AS session, (SELECT count(*) FROM holes) = 0 AS complete",
    "t10_lost_packets": LIFE + "SELECT DISTINCT n, CAST(feed AS INT) AS feed FROM msgs",
    "t4_rewinder_lookup": LIFE + ", sent AS (SELECT seq // 8 * 8 + 1 AS first_seq, count(*) AS count FROM events_seq GROUP BY 1 ORDER BY 1 DESC LIMIT 500) SELECT first_missing AS want, last_missing - first_missing + 1 AS want_count, first_seq, count FROM holes JOIN sent ON first_seq <= last_missing AND first_seq + count > first_missing",
    "t13_sharding": FEED + "SELECT CAST(locate % 4 AS INT) AS shard, count(*) + 2 AS messages, CAST(2 AS BIGINT) AS session_events FROM feed GROUP BY 1",
    "a10_histogram": _HIST + " SELECT bucket, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most FROM h GROUP BY bucket",
    "a11_quantiles": _HIST + _QUANTILE,
    "a12_histogram_merge": _HIST + " SELECT count(*) AS n, min(v) AS least, max(v) AS most, sum(v) / count(*) AS mean FROM h",
    "k3_resume": LIFE + "SELECT locate, ref, side, price, remaining, birth_seq FROM live",
    "k1_as_of": LIFE + "SELECT locate, ref, side, price, CAST(shares - coalesce((SELECT sum(applied) FROM ops p WHERE p.locate = o.locate AND p.ref = o.ref AND p.seq <= last // 2), 0) AS BIGINT) AS remaining, birth_seq FROM orders o, size_ WHERE birth_seq <= last // 2 AND (death_seq IS NULL OR death_seq > last // 2)",
    "j9_difference": FEED + "SELECT locate, ref, 'a' AS only_in FROM feed WHERE false",
}
