"""Context-mixing range coder for token ids, over many blocks in step.

A frame counts, once, which id follows each order-1 context (the id before) and each order-2
context (a hash of the two before) most often, and how often it does; the predictions with their
confidences, and counts of the ids that were missed, go at the frame's head. A block is up to
BLOCK ids. For each id the confidences of the contexts are mixed with the block's running hit
rate, by weights trained as it goes, into the chance that the order-2 prediction holds; that flag
is range coded. A missed id is coded by its order-0 count. A coder passes 32 bits on as soon as
its range is below 2 ** 32, where need be cut at the carry; that leaves 2 ** 32 at least, of which
an id takes 24 bits at most, so a step passes one word at most. All blocks of a frame advance
together, one id per step, as array operations; each has its own coder and weights, so with the
frame's head any block can be decoded alone. Arithmetic is on integers, equal on every machine.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK, _SLAB = 1024, 512
_CONTEXTS, _TOTAL = 1 << 16, 17  # of each order; the missed ids' counts add up to 2 ** _TOTAL
_WORD, _BELOW = np.uint64(1 << 32), np.uint64((1 << 32) - 1)
_S12, _S32, _ST = np.uint64(12), np.uint64(32), np.uint64(_TOTAL)
_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int32)
_CONF = np.array([round(256 * math.log((c + 0.5) / (255.5 - c))) for c in range(256)], np.int16)
_APART = np.int16(-300)  # what order 1 says for order 2's prediction where its own is another
_SQUASH = np.clip(np.array([round(4096 / (1 + math.exp(-x / 256))) for x in range(-2200, 2201)], np.int32), 48, 4048)
_HEAVIEST = 300_000  # times three inputs below 2308, within 32 bits
_MAGIC = b"DWI3"


def _order2(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """The order-2 context of ids after x2, x1."""
    return ((x1 * 2654435761 + x2 * 2246822519) >> 13) & (_CONTEXTS - 1)


def _followers(context: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every context: the id that follows it most often, and how often of 255 times."""
    guess, conf = np.zeros(_CONTEXTS, np.uint16), np.zeros(_CONTEXTS, np.uint8)
    pairs = context.astype(np.uint32)
    pairs <<= np.uint32(16)
    pairs |= x
    pairs.sort()
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    times = np.diff(first, append=len(pairs))
    own = pairs[first].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], own[1:] >> 16 != own[:-1] >> 16]))
    most = np.maximum.reduceat((times << 16) | (own & 0xFFFF), at)
    of = own[at] >> 16
    guess[of], conf[of] = most & 0xFFFF, (most >> 16) * 255 // np.add.reduceat(times, at)
    return guess, conf


def _shares(missed: np.ndarray) -> np.ndarray:
    """Counts of the missed ids, each of them 1 at least, that add up to 2 ** _TOTAL."""
    n = np.bincount(missed, minlength=_CONTEXTS).astype(np.int64)
    some = n > 0
    if not some.any():
        n[0], some[0] = 1, True
    share = some + n * ((1 << _TOTAL) - int(some.sum())) // n.sum()
    share[n.argmax()] += (1 << _TOTAL) - share.sum()
    return share.astype(np.uint32)


class _Mixer:
    """Each block's weights of the inputs: order 2, order 1, the block's hit rate."""

    def __init__(self, lanes: int):
        self.rate = np.full(lanes, 1024, np.int32)
        self.weight = np.tile(np.array([[40000], [16000], [16000]], np.int32), (1, lanes))
        self.inputs, self.product = np.zeros((3, lanes), np.int32), np.zeros((3, lanes), np.int32)

    def chance(self, n: int, by2: np.ndarray, by1: np.ndarray) -> np.ndarray:
        """For the first n blocks: the chance of 4096 that the prediction holds."""
        inputs, product = self.inputs[:, :n], self.product[:, :n]
        inputs[0], inputs[1] = by2, by1
        _STRETCH.take(self.rate[:n], out=inputs[2], mode="clip")
        np.multiply(inputs, self.weight[:, :n], out=product)
        dot = product[0] + product[1]
        dot += product[2]
        dot >>= 16
        dot += 2200
        self.p = _SQUASH.take(dot, mode="clip")
        return self.p

    def train(self, n: int, hit: np.ndarray) -> None:
        product, weight, rate = self.product[:, :n], self.weight[:, :n], self.rate[:n]
        held = hit.astype(np.int32)
        np.multiply(self.inputs[:, :n], (held << 12) - self.p, out=product)
        product >>= 14
        weight += product
        np.minimum(weight, _HEAVIEST, out=weight)
        np.maximum(weight, -_HEAVIEST, out=weight)
        held *= 4095
        held -= rate
        held >>= 5
        rate += held


def _lanes(n: int) -> tuple[int, int]:
    """Blocks of n ids, and the ids in the last one."""
    k = -(-n // BLOCK)
    return k, n - (k - 1) * BLOCK


def _narrowed(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """The ranges up to where the word that is passed on would change."""
    return np.minimum(rng, _WORD - (low & _BELOW))


def encode_frame(ids: np.ndarray) -> bytes:
    """The ids (below 65536) as one self-contained byte string of checksummed blocks."""
    n = len(ids)
    k, last = _lanes(n) if n else (0, 0)
    crcs = [zlib.crc32(np.ascontiguousarray(ids[i * BLOCK : (i + 1) * BLOCK], "<u4").tobytes()) for i in range(k)]
    if not n:
        return struct.pack("<4sQII", _MAGIC, 0, 0, 0)
    x = ids.astype(np.uint16)
    x1, x2 = np.zeros(n, np.uint16), np.zeros(n, np.uint16)
    x1[1:], x2[2:] = x[:-1], x[:-2]
    x1[::BLOCK], x2[::BLOCK], x2[1::BLOCK] = 0, 0, 0
    slabs = [slice(i, i + _SLAB * BLOCK) for i in range(0, n, _SLAB * BLOCK)]  # so that indices of 64 bits are few at once
    context, held = np.empty(n, np.uint16), np.empty(n, bool)
    for at in slabs:
        context[at] = _order2(x1[at].astype(np.int64), x2[at].astype(np.int64))
    guess1, conf1 = _followers(x1, x)
    guess2, conf2 = _followers(context, x)
    say1, say2 = _CONF[conf1], _CONF[conf2]
    by1, by2, grid, hits = (np.zeros((BLOCK, k), kind) for kind in (np.int16, np.int16, np.uint16, bool))  # a row for each step
    for at in slabs:
        c, c1 = context[at].astype(np.int64), x1[at].astype(np.int64)
        guess = guess2[c]
        held[at] = guess == x[at]
        of1 = np.where(guess1[c1] == guess, say1[c1], _APART)
        for to, part in ((by1, of1), (by2, say2[c]), (grid, x[at]), (hits, held[at])):
            first, full = at.start // BLOCK, len(part) // BLOCK
            to[:, first : first + full] = part[: full * BLOCK].reshape(full, BLOCK).T
            to[: len(part) - full * BLOCK, first + full : first + full + 1] = part[full * BLOCK :, None]
    share = _shares(x[~held])
    first, share_of = (np.cumsum(share, dtype=np.int64) - share).astype(np.uint64), share.astype(np.uint64)
    del x, x1, x2, context, held
    out, at = np.zeros((BLOCK + 2, k), np.uint32), np.zeros(k, np.int64)  # blocks are about as far, so what is written lies close
    lows, rngs = np.zeros(k, np.uint64), np.full(k, 2**64 - 1, np.uint64)
    m = _Mixer(k)
    for t in range(BLOCK if k > 1 else last):
        a = k if t < last else k - 1
        low, rng, hit = lows[:a], rngs[:a], hits[t, :a]
        p = m.chance(a, by2[t, :a], by1[t, :a]).astype(np.uint64)
        rng >>= _S12
        missed = np.flatnonzero(~hit)
        rest = rng[missed] << _S12
        rng *= p
        s, bound = grid[t, missed], rng[missed]
        r = (rest - bound) >> _ST
        low[missed] += bound + r * first[s]
        rng[missed] = r * share_of[s]
        m.train(a, hit)
        live = np.flatnonzero(rng < _WORD)
        lo, own = low[live], at[live]
        out[own, live] = lo >> _S32
        at[live] = own + 1
        rng[live] = _narrowed(lo, rng[live]) << _S32
        low[live] = lo << _S32
    for _ in range(2):
        out[at, np.arange(k)] = lows >> _S32
        at += 1
        lows <<= _S32
    out = np.ascontiguousarray(out[: at.max()].T, "<u4")
    model = zlib.compress(guess1.astype("<u2").tobytes() + conf1.tobytes() + guess2.astype("<u2").tobytes() + conf2.tobytes() + share.astype("<u4").tobytes(), 1)
    head = struct.pack("<4sQII", _MAGIC, n, k, len(model)) + np.array(at, "<u4").tobytes() + np.array(crcs, "<u4").tobytes()
    return head + model + b"".join(out[i, : at[i]].tobytes() for i in range(k))


def _model(packed: bytes) -> list[np.ndarray]:
    try:
        data = zlib.decompress(packed)
    except zlib.error as e:
        raise ValueError("the frame's head is damaged") from e
    out, at = [], 0
    for kind in ("<u2", "u1", "<u2", "u1", "<u4"):
        out.append(np.frombuffer(data, kind, _CONTEXTS, at).astype(np.int64))
        at += out[-1].size * np.dtype(kind).itemsize
    return out


def decode_frame(data: bytes) -> np.ndarray:
    """The ids of a frame; ValueError where a block's checksum differs."""
    magic, n, k, size = struct.unpack_from("<4sQII", data)
    if magic != _MAGIC:
        raise ValueError("not a frame of token ids")
    if not n:
        return np.zeros(0, np.uint32)
    last, body = n - (k - 1) * BLOCK, 20 + 8 * k
    sizes = np.frombuffer(data, "<u4", k, 20).astype(np.int64)
    crcs = np.frombuffer(data, "<u4", k, 20 + 4 * k)
    guess1, conf1, guess2, conf2, share = _model(data[body : body + size])
    say1, say2 = _CONF[conf1], _CONF[conf2]
    first, share_of = (np.cumsum(share) - share).astype(np.uint64), share.astype(np.uint64)
    symbol = np.repeat(np.arange(_CONTEXTS, dtype=np.uint16), share)
    words = np.frombuffer(data, "<u4", int(sizes.sum()), body + size)
    words = np.concatenate([words, np.zeros(2, "<u4")])
    at = np.cumsum(sizes) - sizes
    codes = np.zeros(k, np.uint64)
    for _ in range(2):
        codes = (codes << _S32) | words[at]
        at += 1
    end = len(words) - 1
    lows, rngs = np.zeros(k, np.uint64), np.full(k, 2**64 - 1, np.uint64)
    grid = np.zeros((BLOCK, k), np.uint16)
    x1, x2 = np.zeros(k, np.int64), np.zeros(k, np.int64)
    m, most = _Mixer(k), np.uint64((1 << _TOTAL) - 1)
    for t in range(BLOCK if k > 1 else last):
        a = k if t < last else k - 1
        low, rng, code, x1, x2 = lows[:a], rngs[:a], codes[:a], x1[:a], x2[:a]
        context = _order2(x1, x2)
        x = guess2[context]
        p = m.chance(a, say2[context], np.where(guess1[x1] == x, say1[x1], _APART)).astype(np.uint64)
        rng >>= _S12
        bound = rng * p
        hit = code - low < bound
        missed = np.flatnonzero(~hit)
        below = bound[missed]
        lo, r = low[missed] + below, ((rng[missed] << _S12) - below) >> _ST
        rng[:] = bound
        s = symbol[np.minimum((code[missed] - lo) // r, most).astype(np.int64)]
        low[missed] = lo + r * first[s]
        rng[missed] = r * share_of[s]
        x[missed] = s
        grid[t, :a] = x
        x2, x1 = x1, x
        m.train(a, hit)
        live = np.flatnonzero(rng < _WORD)
        lo, own = low[live], at[live]
        code[live] = (code[live] << _S32) | words[np.minimum(own, end)]
        at[live] = own + 1
        rng[live] = _narrowed(lo, rng[live]) << _S32
        low[live] = lo << _S32
    ids = grid.T.astype("<u4").reshape(-1)[:n]
    if k == 1:
        ids = grid[:last, 0].astype("<u4")
    for i in range(k):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].tobytes()) != crcs[i]:
            raise ValueError(f"block {i} is damaged")
    return ids
