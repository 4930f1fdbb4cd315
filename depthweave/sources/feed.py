"""Feed sources: binary files of framed messages, and their accounting."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.wire import SIZES, decode, encode

_FRAME = "file string, offset long, payload binary, end string"


_CHAIN = 24  # messages that must follow one another where a range is entered
_PIECE = 16 << 20  # bytes a task reads at once


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, last: bool):
        self.path, self.start, self.stop, self.last = path, start, stop, last


def frames(data: bytes, base: int = 0) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, message, end): every whole message, then one row that says how the data ended.

    Fewer than two bytes left is a clean end, a zero length is the end mark, and a body cut short
    is `truncated`.
    """
    at, n = 0, len(data)
    while n - at >= 2:
        size = struct.unpack_from(">H", data, at)[0]
        if size == 0:
            yield base + at, None, "mark"
            return
        if at + 2 + size > n:
            yield base + at, None, "truncated"
            return
        yield base + at, data[at + 2 : at + 2 + size], None
        at += 2 + size
    yield base + at, None, "clean"


def _files(path: str) -> list[Path]:
    p = Path(path.removeprefix("file://"))
    return sorted(x for x in p.iterdir() if x.is_file()) if p.is_dir() else [p]


def _hop(data: bytes, base: int, at: int, stop: int, size: int) -> tuple[int, bool]:
    """Where the first message at or after `stop` begins, and whether the feed ends before it."""
    while at < stop:
        if at + 2 > size:
            return at, True
        n = struct.unpack_from(">H", data, at - base)[0]
        if n == 0 or at + 2 + n > size:
            return at, True
        at += 2 + n
    return at, at + 2 > size


def _entry(data: bytes, base: int, start: int) -> int | None:
    """The first offset from `start` at which messages of known types and sizes follow one another."""
    for c in range(start, min(start + (1 << 16) + 2, base + len(data) - 2)):
        at, known, unknown = c - base, 0, 0
        while known + unknown < _CHAIN and at + 3 <= len(data):
            n = struct.unpack_from(">H", data, at)[0]
            size = SIZES.get(chr(data[at + 2]))
            if n == 0 or (size is not None and size != n):
                break
            known, unknown, at = known + (size == n), unknown + (size is None), at + 2 + n
        else:
            if known > 2 * unknown:
                return c
    return None


def _read(path: str, start: int, stop: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(start)
        return f.read(stop - start)


def _passages(batches):
    """(path, start, entry, exit, ended) of byte ranges: where messages seem to begin, and lead to."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            data = _read(r["path"], r["start"], r["stop"] + 1)
            at = 0 if r["start"] == 0 else _entry(data, r["start"], r["start"])
            out = (at, True) if at is None else _hop(data, r["start"], at, r["stop"], r["size"])
            rows.append({"path": r["path"], "start": r["start"], "entry": at, "exit": out[0], "ended": out[1]})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("start", pa.int64()), ("entry", pa.int64()), ("exit", pa.int64()), ("ended", pa.bool_())]))


def message_ranges(spark: SparkSession, path: str, split: int) -> list[tuple[str, int, int, bool]]:
    """(path, start, stop, last): byte ranges of about `split` bytes that begin and end with messages.

    Tasks look for a message in each range and follow the lengths from there to the next range.
    The driver only strings the ranges together; a range that wasn't entered where the one before
    it left off is followed again from there, so a wrong guess costs time and nothing else.
    """
    sizes = [(str(p), p.stat().st_size) for p in _files(path)]
    cuts = [(p, at, min(at + split, size), size) for p, size in sizes if size > split for at in range(0, size, split)]
    found = {}
    if cuts:
        ranges = spark.createDataFrame(cuts, "path string, start long, stop long, size long").repartition(min(len(cuts), 10_000), "path", "start")
        found = {(r.path, r.start): r for r in ranges.mapInArrow(_passages, "path string, start long, entry long, exit long, ended boolean").collect()}
    out = []
    for p, size in sizes:
        if size <= split:
            out.append((p, 0, size, True))
            continue
        at = 0
        for start in range(0, size, split):
            stop = min(start + split, size)
            if at >= stop:
                continue  # one message covers it
            r = found[p, start]
            after, ended = (r.exit, r.ended) if r.entry == at else _hop(_read(p, at, stop + 1), at, at, stop, size)
            out.append((p, at, size if ended else after, ended))
            at = after
            if ended:
                break
    return out


class FramedReader(DataSourceReader):
    def __init__(self, path: str, ranges: str | None):
        self.path, self.ranges = path, ranges

    def partitions(self) -> list[InputPartition]:
        """The given ranges, else a file each."""
        rows = json.loads(self.ranges) if self.ranges is not None else [(str(p), 0, p.stat().st_size, True) for p in _files(self.path)]
        return [_Range(*r) for r in rows]

    def read(self, partition: _Range):
        """The range's messages; the last range of a file says how the file ended."""
        held, base, left = b"", partition.start, partition.stop - partition.start
        with open(partition.path, "rb") as f:
            f.seek(base)
            while True:
                piece = f.read(min(_PIECE, left))
                left -= len(piece)
                data, at, done = held + piece, base, left == 0 or not piece
                for offset, payload, end in frames(data, base):
                    if payload is not None:
                        yield partition.path, offset, payload, None
                        at = offset + 2 + len(payload)
                    elif end == "mark" or done:
                        if partition.last:
                            yield partition.path, offset, None, end
                        return
                held, base = data[at - base :], at


class FramedSource(DataSource):
    """spark.read.format("framed_feed").load(path): posix files, one task a file; see read_frames."""

    @classmethod
    def name(cls) -> str:
        return "framed_feed"

    def schema(self) -> str:
        return _FRAME

    def reader(self, schema) -> DataSourceReader:
        return FramedReader(self.options["path"], self.options.get("ranges"))


def read_frames(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Frames of posix files that all executors see; files over split_bytes are read by many tasks."""
    spark.dataSource.register(FramedSource)
    return spark.read.format("framed_feed").option("ranges", json.dumps(message_ranges(spark, path, split_bytes))).load(path)


def read_frames_anywhere(spark: SparkSession, path: str) -> DataFrame:
    """The same rows through Spark's own file reader, for stores that only Spark reads."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = list(frames(data))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], names=["file", "offset", "payload", "end"])

    return files.mapInArrow(run, _FRAME)


def parse(raw: DataFrame) -> DataFrame:
    """Typed feed rows of raw frames; `seq` orders them as file and offset do."""
    return raw.where("end is null").select(*[c for c in raw.columns if c not in ("payload", "end")], *[e.alias(n) for n, e in decode(F.col("payload")).items()])


def parser_stats(raw: DataFrame) -> DataFrame:
    """messages, unknown, malformed, truncated."""
    status = decode(F.col("payload"))["status"]
    body = F.col("payload").isNotNull()
    return raw.agg(*[F.count_if(body & (status == s) if s else body).alias(n) for n, s in (("messages", None), ("unknown", "unknown"), ("malformed", "malformed"))], F.coalesce(F.bool_or(F.col("end") == "truncated"), F.lit(False)).alias("truncated"))


def type_counts(parsed: DataFrame) -> DataFrame:
    """Messages by type; malformed ones are in no type's row."""
    return parsed.where("status <> 'malformed'").groupBy("type").agg(F.count("*").alias("messages"))


def with_payload(feed: DataFrame) -> DataFrame:
    """Feed rows as wire bytes, missing feed columns taken as absent."""
    have = set(feed.columns)
    kinds = {"ts_ns": "long", "stock": "string", "match": "long", "cross_shares": "decimal(20,0)", "market_category": "string", "financial_status": "string", "round_lot": "long", "reason": "string", "mpid": "string", "printable": "boolean", "code": "string", "new_ref": "long"}
    full = feed.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in have})
    return full.withColumn("payload", encode()).select(*feed.columns, "payload")


def slice_until(feed: DataFrame, cutoff_ns: int) -> DataFrame:
    """The rows before the first one later than the cutoff (a prefix, not a filter)."""
    if cutoff_ns <= 0:
        raise ValueError("the cutoff must be after midnight")
    first = feed.where(F.col("ts_ns") > cutoff_ns).agg(F.min("seq").alias("stop"))  # one row
    return feed.join(F.broadcast(first), F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).drop("stop")
