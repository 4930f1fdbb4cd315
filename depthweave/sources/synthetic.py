"""A seeded synthetic feed for tests, written as rows or framed bytes.

Each symbol's price walks by itself; the thicker a symbol's book, the less likely a message adds
to it. A share of the reductions names orders that never were, or another symbol's.
"""

from __future__ import annotations

import random
import struct
from itertools import count
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feed import with_payload

SCHEMA = "seq long, type string, locate int, ref long, new_ref long, side string, shares long, price long, printable boolean, code string"


def hostile_rows(n: int, seed: int, locates: int = 4, reuse: bool = False) -> list[tuple]:
    """n messages; with reuse, references come again (live ones, too) and some orders have no shares."""
    rng = random.Random(seed)
    centre = {k: rng.randrange(200, 900_000) for k in range(1, locates + 1)}
    known: dict[int, list[int]] = {k: [] for k in centre}
    numbers, rows = count(1), []

    def reference() -> int:
        return rng.randrange(1, len(rows) + 2) if reuse and rng.random() < 0.12 else next(numbers)

    def size() -> int:
        return 0 if reuse and rng.random() < 0.05 else 25 * rng.randrange(1, 40)

    for seq in range(n):
        k = rng.choice(list(centre))
        centre[k] = max(50, centre[k] + rng.choice((-3, -1, 0, 1, 3)))
        side = rng.choice("BS")
        away = int(rng.expovariate(0.25)) - 1
        price = max(1, centre[k] + (away if side == "S" else -away))
        if rng.random() < 12 / (12 + len(known[k])):
            ref = reference()
            known[k].append(ref)
            rows.append((seq, "A", k, ref, None, side, size(), price, None, None))
            continue
        luck = rng.random()
        owner = k if luck < 0.94 else rng.choice(list(centre))
        ref = 10**9 + seq if luck > 0.97 or not known[owner] else rng.choice(known[owner][-25:])
        kind = rng.choice("EECCXXDDU")
        if kind == "U":
            new = reference()
            known[k].append(new)
            rows.append((seq, kind, k, ref, new, None, size(), price, None, None))
        elif kind == "D":
            rows.append((seq, kind, k, ref, None, None, None, None, None, None))
            known[owner] = [x for x in known[owner] if x != ref] or known[owner]
        else:
            rows.append((seq, kind, k, ref, None, None, 25 * rng.randrange(1, 25), price if kind == "C" else None, rng.random() < 0.6 if kind == "C" else None, None))
    return rows


def write_framed(feed: DataFrame, path: str) -> None:
    """A framed file of a small feed, for fixtures: rows come to the driver in order."""
    with Path(path).open("wb") as f:
        for row in with_payload(feed).where(F.col("seq").isNotNull()).orderBy("seq").toLocalIterator():
            f.write(struct.pack(">H", len(row["payload"])) + bytes(row["payload"]))
