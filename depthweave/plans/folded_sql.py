"""SQL of queries that depend on order: matching one event a round, packets and arbitration by sets."""

from __future__ import annotations

from .market_sql import FEED

_MATCH = FEED + """,
ev AS (SELECT *, row_number() OVER (PARTITION BY locate ORDER BY seq) AS k FROM (
  SELECT seq, locate, CASE type WHEN 'A' THEN 'submit' WHEN 'X' THEN 'cancel' WHEN 'D' THEN 'delete' WHEN 'U' THEN 'replace' ELSE 'state' END AS kind,
    ref, new_ref, side, price AS lim, shares AS qty, seq % 4 = 0 AS ioc, code FROM feed WHERE type IN ('A','X','D','U','H'))),
book(locate, k, seq, halted, rest, status, taker, side, lim, filled, resting, cancelled, fills) AS (
  SELECT DISTINCT locate, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST([] AS STRUCT(pri BIGINT, ref BIGINT, side VARCHAR, price BIGINT, qty BIGINT)[]),
    CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
    CAST([] AS STRUCT(maker BIGINT, side VARCHAR, price BIGINT, qty BIGINT)[]) FROM ev
  UNION ALL
  SELECT locate, k, seq, halted,
    CASE WHEN takes THEN list_filter(list_transform(base, lambda x: struct_pack(pri := x.pri, ref := x.ref, side := x.side, price := x.price,
        qty := x.qty - coalesce(list_sum(list_transform(list_filter(hits, lambda h: h.maker = x.ref), lambda h: h.qty)), 0)::BIGINT)), lambda x: x.qty > 0)
        || CASE WHEN qty > got AND NOT ioc THEN [struct_pack(pri := k, ref := r, side := s, price := lim, qty := (qty - got)::BIGINT)] ELSE [] END
      ELSE base END,
    CASE WHEN NOT takes THEN verdict WHEN got = qty THEN 'filled' WHEN ioc THEN 'ioc_cancelled' WHEN got > 0 THEN 'partial_rested' ELSE 'rested' END,
    r, s, CASE WHEN s IS NOT NULL THEN lim END, CASE WHEN takes THEN got ELSE 0 END, CASE WHEN takes AND got < qty AND NOT ioc THEN qty - got ELSE 0 END,
    CASE WHEN takes THEN CASE WHEN ioc THEN qty - got ELSE 0 END WHEN verdict = 'cancelled' THEN cut ELSE 0 END, CASE WHEN takes THEN hits ELSE [] END
  FROM (SELECT *, coalesce(list_sum(list_transform(hits, lambda h: h.qty)), 0)::BIGINT AS got FROM (
    SELECT *, list_filter(list_transform(queue, lambda x, i: struct_pack(maker := x.ref, side := x.side, price := x.price,
        qty := least(x.qty, qty - coalesce(list_sum(list_transform(queue[1:i - 1], lambda y: y.qty)), 0))::BIGINT)), lambda h: h.qty > 0) AS hits FROM (
      SELECT *, verdict IS NULL AND kind <> 'state' AS takes,
        list_sort(list_transform(list_filter(base, lambda x: x.side <> s AND CASE s WHEN 'B' THEN x.price <= lim ELSE x.price >= lim END),
          lambda x: struct_pack(rank := CASE s WHEN 'B' THEN x.price ELSE -x.price END, pri := x.pri, ref := x.ref, side := x.side, price := x.price, qty := x.qty))) AS queue FROM (
        SELECT *, CASE WHEN kind = 'state' THEN NULL
            WHEN kind IN ('cancel', 'delete') THEN CASE WHEN own IS NULL THEN 'unknown' ELSE 'cancelled' END
            WHEN kind = 'replace' AND own IS NULL THEN 'rejected_invalid' WHEN halted THEN 'rejected_halted' WHEN qty = 0 THEN 'rejected_invalid'
            WHEN len(list_filter(base, lambda x: x.ref = r)) > 0 THEN 'rejected_duplicate' END AS verdict FROM (
          SELECT *, CASE WHEN own IS NULL OR kind = 'submit' THEN rest WHEN kind = 'cancel' THEN list_filter(list_transform(rest, lambda x: struct_pack(pri := x.pri, ref := x.ref, side := x.side, price := x.price,
              qty := CASE WHEN x.ref = ref THEN x.qty - cut ELSE x.qty END)), lambda x: x.qty > 0) WHEN kind = 'state' THEN rest ELSE list_filter(rest, lambda x: x.ref <> ref) END AS base,
            CASE kind WHEN 'submit' THEN side WHEN 'replace' THEN own.side END AS s, CASE WHEN kind = 'replace' THEN new_ref ELSE ref END AS r FROM (
            SELECT *, CASE WHEN kind = 'cancel' THEN least(qty, own.qty) ELSE own.qty END AS cut FROM (
              SELECT ev.locate, ev.k, ev.seq, ev.kind, ev.ref, ev.new_ref, ev.side, ev.lim, ev.qty, ev.ioc, b.rest,
                CASE WHEN ev.kind = 'state' THEN ev.code IN ('H', 'P') ELSE b.halted END AS halted, list_filter(b.rest, lambda x: x.ref = ev.ref)[1] AS own
              FROM book b JOIN ev ON ev.locate = b.locate AND ev.k = b.k + 1))))))))
,
told AS (SELECT seq, locate, fills, status, taker, side, lim, filled, resting, cancelled FROM book WHERE seq IS NOT NULL AND status IS NOT NULL),
ended AS (SELECT locate, unnest(rest) AS o FROM (SELECT locate, arg_max(rest, k) AS rest FROM book GROUP BY locate))
SELECT seq, locate, 'result' AS row, CAST(len(fills) AS INT) AS step, status, taker AS ref, CAST(NULL AS BIGINT) AS maker, side, lim AS price, CAST(NULL AS BIGINT) AS qty, filled, resting, cancelled FROM told
UNION ALL SELECT seq, locate, 'fill', CAST(i - 1 AS INT), NULL, taker, fills[i].maker, fills[i].side, fills[i].price, fills[i].qty, NULL, NULL, NULL FROM (SELECT *, unnest(range(1, len(fills) + 1)) AS i FROM told)
UNION ALL SELECT NULL, locate, 'resting', CAST(row_number() OVER (PARTITION BY locate, o.side, o.price ORDER BY o.pri) - 1 AS INT), NULL, o.ref, NULL, o.side, o.price, o.qty, NULL, NULL, NULL FROM ended"""

_PACKETS = FEED + """,
msgs AS (SELECT seq, seq // 256 AS chunk, sum(2 + CASE type WHEN 'A' THEN 36 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 WHEN 'D' THEN 19 WHEN 'U' THEN 35 WHEN 'P' THEN 44 WHEN 'Q' THEN 40 ELSE 25 END)
  OVER (PARTITION BY seq // 256 ORDER BY seq) AS upto FROM feed),
cuts(chunk, first, used, n) AS (SELECT chunk, min(seq) - 1, CAST(0 AS HUGEINT), CAST(0 AS BIGINT) FROM msgs GROUP BY chunk
  UNION ALL SELECT c.chunk, c.first + c.n, max(m.upto), count(*) FROM cuts c JOIN msgs m ON m.chunk = c.chunk AND m.seq > c.first + c.n AND m.upto - c.used <= 1180 GROUP BY ALL),
sent AS (SELECT first + 2 AS first_seq, n AS count FROM cuts WHERE n > 0),
got AS (SELECT first_seq, count, 2 * (first_seq + 40 * feed) + feed AS arrival FROM sent, (VALUES (0), (1)) v(feed) WHERE (first_seq // 16 * 31 + feed * 17) % 100 >= 22)
"""

_ARBITRATED = _PACKETS + """,
firsts AS (SELECT first_seq, count, min(arrival) AS came FROM got GROUP BY ALL),
start AS (SELECT arg_min(first_seq, arrival) AS began FROM got),
ranked AS (SELECT *, sum(count) OVER (ORDER BY first_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(came) OVER (ORDER BY first_seq) AS through FROM firsts, start WHERE first_seq >= began),
released AS (SELECT first_seq, count, through FROM ranked WHERE first_seq = began + coalesce(before, 0)),
placed AS (SELECT g.arrival, g.first_seq, coalesce((SELECT max(r.first_seq + r.count) FROM released r WHERE r.through < g.arrival), (SELECT began FROM start)) AS nxt FROM got g),
ahead AS (SELECT *, row_number() OVER (PARTITION BY nxt ORDER BY arrival) - 1 AS i FROM placed WHERE first_seq > nxt)
SELECT 'message' AS row, through AS arrival, first_seq + j AS msg_seq, CAST(1 AS BIGINT) AS count FROM (SELECT *, unnest(range(count)) AS j FROM released)
UNION ALL SELECT 'request', arrival, nxt, least(first_seq - nxt, 65534) FROM ahead WHERE i % 256 = 0"""

SQL = {
    "m1_match_fold": _MATCH,
    "t1_packet_headers": _PACKETS + "SELECT arrival, 'S1        ' AS h_session, first_seq AS h_first_seq, count AS h_count FROM got",
    "t2_blocks": _PACKETS + "SELECT DISTINCT 'S1        ' AS session, first_seq + j AS msg_seq FROM (SELECT first_seq, unnest(range(count)) AS j FROM got)",
    "t7_arbitration": _ARBITRATED,
}
