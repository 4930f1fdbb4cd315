"""A live receiver: redundant feeds in, one framed file out, holes asked for again."""

from __future__ import annotations

import select
import socket
import struct
import time
from collections.abc import Callable
from pathlib import Path

from ..operators.transport import Arbiter
from .packets import bound


def receive(feeds: list[tuple[str, int]], rewinder: tuple[str, int] | None, apply: Callable[[int, bytes], None], session: str, idle_seconds: float = 5.0, most_held: int = 1 << 14) -> dict[str, int]:
    """Messages of all feeds, each once and in order, to apply(number, message); the counters.

    It ends when the session is complete, or after idle_seconds without a packet. Requests go to
    the rewinder, whose answers come back to the socket that asked.
    """
    arbiter, name = Arbiter(most_held), session.ljust(10).encode("latin-1")[:10]
    asking = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    sockets = [*(bound(at) for at in feeds), asking]
    heard = time.monotonic()
    try:
        while not arbiter.complete and (left := heard + idle_seconds - time.monotonic()) > 0:
            for s in select.select(sockets, [], [], left)[0]:
                messages, ask = arbiter.packet(s.recv(65535))
                heard = time.monotonic()
                for number, message in messages:
                    apply(number, message)
                if ask and rewinder:
                    asking.sendto(name + struct.pack(">QH", *ask), rewinder)
    finally:
        for s in sockets:
            s.close()
    return arbiter.counters()


def receive_file(path: str, feeds: list[tuple[str, int]], rewinder: tuple[str, int] | None, session: str, **limits) -> dict[str, int]:
    """The same into a framed file, which read_frames reads; a zero length marks a complete session."""
    with Path(path).open("wb") as f:
        out = receive(feeds, rewinder, lambda _, m: f.write(struct.pack(">H", len(m)) + m), session, **limits)
        if out["complete"]:
            f.write(bytes(2))
    return out
