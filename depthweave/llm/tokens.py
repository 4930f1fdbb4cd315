"""Token ids by the tokenizers library, with the ids of repeated words kept.

A single space between two characters that aren't white space always begins a pre-token of the
byte-level pattern, so a text's ids are those of its space-led chunks one after the other; so
does a mark after a letter or digit, and a line end after either, so chunks are cut there too:
a word needn't be learnt anew with each mark and line that follows it. Each worker encodes parts
it doesn't know, those with a space before them many at a time (their ids are told apart by the
tokens' byte lengths, which must meet the parts' ends exactly), and keeps them in a bounded memory,
as flat arrays: an Arrow column of parts and a pool of ids, a tenth of what Python objects take.
Texts with other spacing, or with a special token's opening, are encoded whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import text_bytes

_WHOLE = re.compile(r" \s|\s |<\|")
_ASCII = [chr(i) for i in range(128)]
_ALNUM = np.array([c.isalnum() for c in _ASCII] + [False] * 128)
_MARK = np.array(["!" <= c <= "~" and not c.isalnum() for c in _ASCII] + [False] * 128)
_CUT = _MARK & (np.arange(256) != ord("'"))  # an apostrophe may begin a contraction


def _cuts(a: np.ndarray) -> np.ndarray:
    """Whether the pattern ends a pre-token before each byte of UTF-8, whatever stands around; not all such places."""
    out = np.zeros(len(a), bool)
    before, here = a[:-1], a[1:]
    word = _ALNUM[before]
    word[1:] |= (a[:-2] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)  # U+00C0 to U+00FF are letters but two
    out[1:] = word & _CUT[here]
    out[1:] |= (here == 0x0A) & (word | _MARK[before])
    return out


def _whole(t: str) -> bool:
    """Whether _WHOLE occurs; texts whose only white space is spaces and line ends, as most, are told without it."""
    if t.replace("\n", "").isprintable():
        return "  " in t or " \n" in t or "\n " in t or "<|" in t
    return _WHOLE.search(t) is not None


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of lens[0] places, then those of starts[1], and so on."""
    ends = np.cumsum(lens)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, int(starts.max(initial=0))) < 2**31 else np.int64
    out = np.repeat((starts - (ends - lens)).astype(kind), lens)
    out += np.arange(n, dtype=kind)
    return out


class Encoder:
    """most: parts that are kept when twice as many are known, those met last."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)
        self.most, self.turn = most, 0
        self.chunks = pa.array([], pa.large_string())
        self.pool, self.lens, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _met(self, ids: np.ndarray, want: np.ndarray) -> np.ndarray | None:
        """The last id of each chunk of so many bytes, if the ids meet every chunk's end."""
        ends, want = np.cumsum(self.sizes[ids]), np.cumsum(want)
        at = np.searchsorted(ends, want)
        return at if len(ends) and at[-1] == len(ends) - 1 and (ends[at] == want).all() else None

    def _learn(self, parts: pa.Array, spaced: int) -> None:
        """Keep the ids of each part; so many, with a space before them, come first."""
        pool, lens = [self.pool], [self.lens]
        for i in range(0, spaced, 20_000):
            part = parts[i : min(i + 20_000, spaced)]
            group = part.to_pylist()
            coded = self._ids(["".join(group[j : j + 500]) for j in range(0, len(group), 500)])
            want = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
            at = self._met(np.concatenate(coded), want)
            if at is not None:
                pool += coded
                lens.append(np.diff(at + 1, prepend=0))
                continue
            for j, ids in zip(range(0, len(group), 500), coded, strict=True):
                at = self._met(ids, want[j : j + 500])
                if at is not None:
                    pool.append(ids)
                    lens.append(np.diff(at + 1, prepend=0))
                else:
                    each = self._ids(group[j : j + 500])
                    pool += each
                    lens.append(np.array([len(x) for x in each], np.int64))
        each = self._ids(parts[spaced:].to_pylist())
        self.pool = np.concatenate([*pool, *each])
        self.lens = np.concatenate([*lens, np.array([len(x) for x in each], np.int64)])
        self.met = np.concatenate([self.met, np.full(len(parts), self.turn)])
        self.chunks = pa.concat_arrays([self.chunks, parts])

    def _forget_oldest(self) -> None:
        stay = np.sort(np.argsort(-self.met, kind="stable")[: self.most])
        starts = np.cumsum(self.lens) - self.lens
        self.pool = self.pool[_ragged(starts[stay], self.lens[stay])]
        self.lens, self.met, self.chunks = self.lens[stay], self.met[stay], self.chunks.take(pa.array(stay))

    def _known(self, parts: pa.Array) -> np.ndarray:
        """Where each of the different parts is among those known; the others are learnt."""
        if len(self.chunks) > 2 * self.most:
            self._forget_oldest()
        self.turn += 1
        at = pc.index_in(parts, value_set=self.chunks).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            led = pc.starts_with(parts.take(pa.array(new)), " ").to_numpy(zero_copy_only=False)
            new = np.concatenate([new[led], new[~led]])
            at[new] = len(self.chunks) + np.arange(len(new))
            self._learn(parts.take(pa.array(new)), int(led.sum()))
        self.met[at] = self.turn
        return at

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each chunk with a space before it, back to back, and how many they are."""
        data, at = text_bytes(pc.binary_replace_slice(chunks.cast(pa.large_binary()), 0, 0, b" ").cast(pa.large_string()))
        begins = _cuts(np.frombuffer(data, np.uint8))
        begins[at[:-1]] = True
        begins = np.flatnonzero(begins)
        ptr = np.searchsorted(begins, at)
        parts = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, at[-1])), pa.py_buffer(data)).dictionary_encode()
        place = self._known(parts.dictionary)[parts.indices.to_numpy()]
        lens = self.lens[place]
        pool = self.pool[_ragged((np.cumsum(self.lens) - self.lens)[place], lens)]
        return pool, np.diff(np.concatenate([[0], np.cumsum(lens)])[ptr])

    def _joined(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that fall into chunks at their spaces."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ptr = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        codes, some = coded.indices.to_numpy(), len(coded.dictionary)
        first = codes[ptr[:-1]]  # these have no space before them
        heads = self._ids(coded.dictionary.take(pa.array(first)).to_pylist())
        own = np.bincount(codes, minlength=some) > np.bincount(first, minlength=some)
        pool, lens = self._chunk_ids(coded.dictionary.filter(pa.array(own)))
        n = np.array([len(x) for x in heads], np.int64)
        place = np.cumsum(own) - 1
        entry = place[codes]
        entry[ptr[:-1]] = len(lens) + np.arange(len(heads))
        lens, pool = np.concatenate([lens, n]), np.concatenate([pool, *heads])
        ids = pool[_ragged((np.cumsum(lens) - lens)[entry], lens[entry])].tobytes()
        ends = np.concatenate([[0], np.cumsum(lens[entry])])[ptr] * 4
        return [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text is empty."""
        out: list = [b""] * len(texts)
        parts, whole = [], []
        for i, t in enumerate(texts):
            if t:
                (whole if _whole(t) else parts).append(i)
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids.tobytes()
        for i, ids in zip(parts, self._joined([texts[i] for i in parts]) if parts else [], strict=True):
            out[i] = ids
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = 300_000) -> Encoder:
    """This worker's encoder of the tokenizer file."""
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]


def forget() -> None:
    """Give back what encoders hold in this worker: workers outlive the stage that used them."""
    _encoders.clear()
    trim()


def trim() -> None:
    """Give back memory that is free; what encoders know stays."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
