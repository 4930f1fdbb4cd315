"""Packets from a UDP socket as a streaming source, and endpoint parsing."""

from __future__ import annotations

import re
import socket
import struct
import time
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

_SCHEMA = "arrival long, packet binary"


def endpoint(text: str) -> tuple[str, int] | None:
    """HOST:PORT with an IPv4 host and a port from 1 to 65535, else None."""
    m = re.fullmatch(r"(\d{1,3}(?:\.\d{1,3}){3}):(\d{1,5})", text)
    if not m or any(int(x) > 255 for x in m[1].split(".")) or not 1 <= int(m[2]) <= 65535:
        return None
    return m[1], int(m[2])


def is_multicast(host: str) -> bool:
    return 224 <= int(host.split(".")[0]) <= 239


def bound(at: tuple[str, int], buffer: int = 4 << 20) -> socket.socket:
    """A UDP socket that receives at an endpoint; a multicast address is joined."""
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
    s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, buffer)
    s.bind(("" if is_multicast(at[0]) else at[0], at[1]))
    if is_multicast(at[0]):
        s.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, struct.pack("4s4s", socket.inet_aton(at[0]), socket.inet_aton("0.0.0.0")))
    return s


class UdpReader(SimpleDataSourceStreamReader):
    """One receiver on the driver: packets are few and small beside what follows from them.

    A socket delivers once, so each batch is written to the folder `log` before it is handed on,
    and read from there when a query restarts; a batch leaves the log when it is committed.
    """

    def __init__(self, at: tuple[str, int], seconds: float, log: str):
        self.at, self.seconds, self.log, self.socket = at, seconds, Path(log.removeprefix("file://")), None

    def _bound(self) -> socket.socket:
        if self.socket is None:
            self.socket = bound(self.at)
        return self.socket

    def _batches(self) -> list[tuple[int, int, Path]]:
        """(first, end, file) of the logged batches, in order."""
        names = [(p.stem.split("-"), p) for p in self.log.glob("*.parquet")]
        return sorted((int(x[0]), int(x[1]), p) for x, p in names)

    def initialOffset(self) -> dict:
        return {"arrival": 0}

    def read(self, start: dict):
        s, out, n, stop = self._bound(), [], start["arrival"], time.time() + self.seconds
        while (left := stop - time.time()) > 0:
            s.settimeout(left)
            try:
                out.append((n, s.recv(65535)))
                n += 1
            except TimeoutError:
                break
        if out:
            self.log.mkdir(parents=True, exist_ok=True)
            own = self.log / f"{start['arrival']}-{n}.parquet"
            part = own.with_suffix(".part")
            pq.write_table(pa.table({"arrival": [x[0] for x in out], "packet": pa.array([x[1] for x in out], pa.binary())}), part)
            part.rename(own)  # a batch is in the log whole or not at all
        return iter(out), {"arrival": n}

    def readBetweenOffsets(self, start: dict, end: dict):
        rows = [r for first, stop, p in self._batches() if first < end["arrival"] and stop > start["arrival"] for r in pq.read_table(p).to_pylist()]
        rows = [(r["arrival"], r["packet"]) for r in rows if start["arrival"] <= r["arrival"] < end["arrival"]]
        if len(rows) != end["arrival"] - start["arrival"]:
            raise ValueError(f"packets {start['arrival']} to {end['arrival']} are not all in {self.log}")
        return iter(rows)

    def commit(self, end: dict) -> None:
        for _, stop, p in self._batches():
            if stop <= end["arrival"]:
                p.unlink()


class UdpSource(DataSource):
    """spark.readStream.format("udp_packets").option("endpoint", "127.0.0.1:6001").option("log", folder).load()"""

    @classmethod
    def name(cls) -> str:
        return "udp_packets"

    def schema(self) -> str:
        return _SCHEMA

    def simpleStreamReader(self, schema) -> UdpReader:
        at = endpoint(self.options.get("endpoint", ""))
        if at is None:
            raise ValueError("endpoint must be HOST:PORT")
        if not self.options.get("log"):
            raise ValueError("log must name the folder that keeps packets until they are committed")
        return UdpReader(at, float(self.options.get("seconds", 0.2)), self.options["log"])
