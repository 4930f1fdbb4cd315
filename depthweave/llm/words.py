"""Vectorised word splitting and 64-bit word hashing over Arrow string columns.

A byte table maps separators to 0x20 (and upper to lower case where wanted); words are the
maximal runs of other bytes. As all separators are ASCII this equals matching the UTF-8 text
with a negated ASCII class. Hashes are polynomial over random per-byte constants, then mixed;
equal words hash alike on every machine, and unequal ones collide with odds near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes(range(256)).lower()


def blank_table(lower: bool) -> bytes:
    """Words are runs of anything but ASCII white space (0x20, 0x09-0x0D)."""
    base = bytearray(_LOWER if lower else bytes(range(256)))
    for b in BLANKS:
        base[b] = 0x20
    return bytes(base)


def alnum_table() -> bytes:
    """Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return bytes(x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else 0x20 for x in _LOWER)


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 2**63, dtype=np.uint64)) | 1
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """hashes, byte starts and ends of all words; words of text i are ptr[i]:ptr[i+1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    raw: bytes


def text_bytes(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of a string array back to back, and n+1 offsets; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if len(texts) == 0:
        return memoryview(b""), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    view = memoryview(data)[ends[0] : ends[-1]] if data is not None else memoryview(b"")
    return view, ends - ends[0]


def split(texts: pa.Array, table: bytes, step: int = 1 << 18) -> Words:
    view, at = text_bytes(texts)
    raw = view.tobytes().translate(table)
    a = np.frombuffer(raw, np.uint8)
    n = len(a)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64), raw)
    solid = a != 0x20
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = at[at < n]
    first[edge] |= solid[edge]
    edge = at[at > 0] - 1
    last[edge] |= solid[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + step)))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        terms = _BYTE[a[lo:hi]]
        terms *= up[: hi - lo]
        np.cumsum(terms, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        hashes[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return Words(hashes, starts, ends, np.searchsorted(starts, at), raw)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k-1 positions are left out."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _GRAM[j % len(_GRAM)] + np.uint64(j)
        if j % len(_GRAM) == len(_GRAM) - 1:
            out = mix(out)
    return mix(out + np.uint64(k))


def doc_of(ptr: np.ndarray) -> np.ndarray:
    """The number of the text that each word is in."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text comes alone."""
    for batch in batches:
        _, at = text_bytes(batch.column(column))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
