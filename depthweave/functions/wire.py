"""Big-endian integers, text and message layout of the binary feed, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the wire format: message type, exact size in bytes.
SIZES = {"S": 12, "R": 39, "H": 25, "A": 36, "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35, "P": 44, "Q": 40}


def be(payload: Column, offset: int, n: int) -> Column:
    """Unsigned big-endian integer of n bytes as BIGINT; 8-byte values keep their 64 bits."""
    return F.conv(F.hex(F.substring(payload, offset + 1, n)), 16, -10 if n == 8 else 10).cast("bigint")


def be_decimal(payload: Column, offset: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(payload, offset + 1, n)), 16, 10).cast("decimal(20,0)")


def chars(payload: Column, offset: int, n: int) -> Column:
    return F.decode(F.substring(payload, offset + 1, n), "ISO-8859-1")


def to_be(value: Column, n: int) -> Column:
    """The inverse of be(), as BINARY of n bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * n, "0"))


def to_chars(value: Column, n: int) -> Column:
    return F.encode(F.rpad(value, n, " "), "ISO-8859-1")


def decode(payload: Column) -> dict[str, Column]:
    """Column name to expression over one message's bytes; `status` is ok, unknown or malformed."""
    kind = chars(payload, 0, 1)
    sizes = F.create_map(*[F.lit(x) for p in SIZES.items() for x in p])
    size = F.try_element_at(sizes, kind)
    raw_side = chars(payload, 19, 1)
    sided = kind.isin("A", "F", "P")
    status = F.when(size.isNull(), "unknown").when(F.length(payload) != size, "malformed").when(sided & ~raw_side.isin("B", "S"), "malformed").otherwise("ok")
    ok = status == "ok"

    def of(types: str, value: Column) -> Column:
        return F.when(ok & kind.isin(*types), value)

    return {
        "status": status,
        "type": kind,
        "locate": F.when(ok, be(payload, 1, 2)).cast("int"),
        "tracking": F.when(ok, be(payload, 3, 2)).cast("int"),
        "ts_ns": F.when(F.length(payload) >= 11, be(payload, 5, 6)),
        "ref": of("AFECXDUP", be(payload, 11, 8)),
        "new_ref": of("U", be(payload, 19, 8)),
        "side": of("AFP", raw_side),
        "shares": F.coalesce(of("AFP", be(payload, 20, 4)), of("ECX", be(payload, 19, 4)), of("U", be(payload, 27, 4))),
        "price": F.coalesce(of("AFCP", be(payload, 32, 4)), of("U", be(payload, 31, 4)), of("Q", be(payload, 27, 4))),
        "stock": F.coalesce(of("RH", chars(payload, 11, 8)), of("AFP", chars(payload, 24, 8)), of("Q", chars(payload, 19, 8))),
        "match": F.coalesce(of("EC", be(payload, 23, 8)), of("P", be(payload, 36, 8)), of("Q", be(payload, 31, 8))),
        "cross_shares": of("Q", be_decimal(payload, 11, 8)),
        "printable": of("C", chars(payload, 31, 1) == "Y"),
        "code": F.coalesce(of("S", chars(payload, 11, 1)), of("H", chars(payload, 19, 1)), of("Q", chars(payload, 39, 1))),
        "market_category": of("R", chars(payload, 19, 1)),
        "financial_status": of("R", chars(payload, 20, 1)),
        "round_lot": of("R", be(payload, 21, 4)),
        "reason": of("H", chars(payload, 21, 4)),
        "mpid": of("F", chars(payload, 36, 4)),
    }


def encode() -> Column:
    """The wire bytes of a feed row (columns of the feed schema; absent fields are zero)."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    num = lambda name, n: to_be(c(name, 0), n)
    txt = lambda name, n, default=" ": to_chars(c(name, default), n)
    head = [F.encode(F.col("type"), "ISO-8859-1"), num("locate", 2), to_be(F.lit(0), 2), num("ts_ns", 6)]
    yes = F.encode(F.when(F.col("printable"), "Y").otherwise("N"), "ISO-8859-1")
    body = {
        "S": [txt("code", 1)],
        "R": [txt("stock", 8), txt("market_category", 1), txt("financial_status", 1), num("round_lot", 4), to_be(F.lit(0), 8), to_be(F.lit(0), 6)],
        "H": [txt("stock", 8), txt("code", 1), txt("reason", 1), txt("reason", 4)],
        "A": [num("ref", 8), txt("side", 1), num("shares", 4), txt("stock", 8), num("price", 4)],
        "F": [num("ref", 8), txt("side", 1), num("shares", 4), txt("stock", 8), num("price", 4), txt("mpid", 4)],
        "E": [num("ref", 8), num("shares", 4), num("match", 8)],
        "C": [num("ref", 8), num("shares", 4), num("match", 8), yes, num("price", 4)],
        "X": [num("ref", 8), num("shares", 4)],
        "D": [num("ref", 8)],
        "U": [num("ref", 8), num("new_ref", 8), num("shares", 4), num("price", 4)],
        "P": [num("ref", 8), txt("side", 1, "B"), num("shares", 4), txt("stock", 8), num("price", 4), num("match", 8)],
        "Q": [to_be(F.coalesce(F.col("cross_shares").cast("bigint"), F.col("shares"), F.lit(0)), 8), txt("stock", 8), num("price", 4), num("match", 8), txt("code", 1, "O")],
    }
    out = F.lit(None).cast("binary")
    for kind, fields in body.items():
        out = F.when(F.col("type") == kind, F.concat(*head, *fields)).otherwise(out)
    return out


def opposite(side: Column) -> Column:
    return F.when(side == "B", "S").when(side == "S", "B")


def clock_ns(text: Column) -> Column:
    """HH:MM as nanoseconds since midnight; NULL unless both parts are in range."""
    h, m = (F.regexp_extract(text, r"^(\d{1,2}):(\d{1,2})$", i).try_cast("bigint") for i in (1, 2))
    return F.when((h < 24) & (m < 60), (h * 60 + m) * 60_000_000_000)
