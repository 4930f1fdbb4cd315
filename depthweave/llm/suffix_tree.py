"""Probabilistic suffix tree over words: variable-length contexts, divergence tests, scoring.

Symbols are words (runs without ASCII white space, A-Z lower-cased) and an end. Contexts are the
words before a symbol, up to `depth` of them; with no depth given, the bound grows with the log of
the training tokens (one word more for a hundred times as many), and lengths end where none has a
state. A context is a candidate when it occurs `least_count` times or more in the training
texts, whatever their size (and has the share `least_share`, where one is asked for), and a
state of the tree when its next-symbol distribution differs from its parent state's by `gain`
nats a token or more, measured with each occurrence left out of its own estimate. A state's
distribution is smoothed by an absolute discount toward its longest retained suffix, down to
discounted single-word frequencies whose held-back mass is the unknown word's. A text's score
is the sum over its tokens of log10 of their chance after the longest state that fits.

Counts go by packed exchange: texts are held as blocks of local word numbers; a block sends each
bucket of the key space its distinct keys with local counts, the bucket adds equal keys and
answers each block in order. Keys are 64-bit hashes of words and word sequences, and a block sends
a key once. A context's next symbols go to the context's own bucket, which judges it and answers
with its number of next symbols where it is a state; so no task holds the tree. A context with more
than an eighth of a bucket's tokens is dealt over several buckets, and its sums are added by the
driver and sent to all tasks; there are at most eight such contexts a bucket and length.

After contexts of REDUCED words a block is written anew: the sums of each text, and of its tokens
only those that a longer candidate context precedes, which are few.

A null or wordless text has the end only. Texts of any length are scored whole; ties don't matter,
as no order among equals is used; other columns aren't read. A null identifier counts as training. Repeated rows
count and score each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, shared_dir, written
from .words import blank_table, mix, pieces, split

_TABLE = blank_table(lower=True)
END = np.uint64(0x9D39247E33776D41)
_LOW = np.uint64(0xFFFFFFFF)
_ROW = "bucket int, block long, kind int, data binary"
DISCOUNT = 0.75
REDUCED = 2  # after contexts of so many words, a block keeps only tokens that longer ones may have


@dataclass
class Tree:
    """What all tasks know: sizes, limits, and the contexts too frequent for one bucket."""

    buckets: int
    least: float
    gain: float
    hot: int  # tokens of a context from which its next symbols are dealt over several buckets
    tokens: int = 0
    words: int = 0
    discount: float = 0.5
    keys: list = field(default_factory=list)  # per length, sorted hot contexts
    kinds: list = field(default_factory=list)  # per length, their distinct next symbols, 0 if no state


def held_out(doc_id, folds: int = 7, fold: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def pack(x: np.ndarray) -> bytes:
    """An array's bytes, like ones together, compressed."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def joined(parts: list[np.ndarray]) -> bytes:
    packed = [pack(np.ascontiguousarray(x)) for x in parts]
    return b"".join(len(x).to_bytes(4, "little") + x for x in packed)


def parted(data: bytes, kinds) -> list[np.ndarray]:
    """The arrays of joined(), as far as there are some."""
    out, at = [], 0
    for kind in kinds:
        if at < len(data):
            n = int.from_bytes(data[at : at + 4], "little")
            out.append(unpack(data[at + 4 : at + 4 + n], kind))
            at += 4 + n
    return out


def longer(ctx: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Hashes of contexts with one word more."""
    return mix(mix(ctx) + low * np.uint64(0x9E3779B97F4A7C15))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In order of the distinct values: where one stands, and the number of each entry's value."""
    at = np.argsort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[at[1:]] != x[at[:-1]]
    which = np.empty(len(x), np.int64)
    which[at] = np.cumsum(new) - 1
    return at[new], which


def _ids_bytes(parts: list[pa.Array]) -> bytes:
    """Identifiers of any type, nulls included, as bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", parts[0].type)])) as out:
        for x in parts:
            out.write_batch(pa.record_batch([x], names=["id"]))
    return sink.getvalue().to_pybytes()


def make_blocks(docs: DataFrame, limit: int = 3 << 20) -> DataFrame:
    """Blocks of about `limit` bytes of text: identifiers, token counts, word numbers, words."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, rows in enumerate(_gather(pieces(batches, "text", limit), limit)):
            hashes, lens = [], []
            for b in rows:
                w = split(b.column("text"), _TABLE)
                lens.append(np.diff(w.ptr) + 1)
                hashes.append(np.insert(w.hashes, w.ptr[1:], END))
            keys, tok, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            keys, tok = keys[order], rank[tok]
            ids = [x for b in rows for x in b.column("doc_id").to_pylist()]
            n = np.concatenate(lens)
            out = [held_out(x) for x in ids]
            train = int(n[~np.array(out, bool)].sum())
            cols = [pa.array([(part << 32) + number], pa.int64()), *(pa.array([x], pa.binary()) for x in (_ids_bytes([b.column("doc_id") for b in rows]), bytes(out), pack(n.astype(np.int64)), pack(tok.astype(np.uint32)), pack(keys))), pa.array([len(tok)], pa.int64()), pa.array([train], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "ids", "out", "lens", "tok", "keys", "n", "train"])

    return docs.mapInArrow(run, "block long, ids binary, out binary, lens binary, tok binary, keys binary, n long, train long")


def _gather(batches, limit):
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column("text").nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


class Events(NamedTuple):
    """Tokens after contexts of one length, and their distinct pairs of context and token.

    Pairs are in the order in which they are sent: by bucket, then context.
    """

    at: np.ndarray  # the tokens
    total: np.ndarray  # how often their contexts occur
    seq: np.ndarray  # hashes of context and token
    which: np.ndarray  # of each token, its pair
    first: np.ndarray  # of each pair, one of the tokens; the following are of pairs, too
    ctx: np.ndarray
    low: np.ndarray
    hot: np.ndarray
    where: np.ndarray
    new: np.ndarray  # does a context begin here?


def grouped(key: np.ndarray, seq: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """An order by key in which equal seq stand together; equal ones have equal keys."""
    by = np.argsort(key)
    k, s = key[by], seq[by]
    same = k[1:] == k[:-1]
    mixed = np.flatnonzero(same & (s[1:] != s[:-1]))
    if len(mixed):  # runs of one key that hold several sequences
        run = np.concatenate([[0], np.cumsum(~same)])
        bad = np.zeros(run[-1] + 1, bool)
        bad[run[mixed]] = True
        m = np.flatnonzero(bad[run])
        own = by[m]
        by[m] = own[np.lexsort((seq[own], ctx[own], k[m]))]
    return by


class Block:
    """One block with the answers it has had, and what follows from them."""

    def __init__(self, row, answers: dict, tree: Tree):
        self.tree, self.answers, self.ids, self.done = tree, answers, row["ids"], 0
        self.lens = unpack(row["lens"], np.int64)
        self.out = np.frombuffer(row["out"], np.uint8).astype(bool)
        if row.get("state"):
            self._resume(row["state"])
            return
        self.keys, self.tok = unpack(row["keys"], np.uint64), unpack(row["tok"], np.uint32)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.train = ~self.out[self.doc]
        first = np.cumsum(self.lens) - self.lens
        self.place = np.arange(len(self.tok)) - first[self.doc]

    def reduced(self, d: int) -> dict:
        """This block after length d: sums of each text, and the tokens that a longer context may have."""
        self._up_to(d)
        at = np.flatnonzero(self.place > d)
        at = at[self.seen[at - 1] >= self.tree.least]
        live = np.zeros(len(self.tok), bool)
        live[at] = True
        size = len(self.lens)
        base = np.log10((self.count + 1) / (self.tree.tokens + self.tree.words + 1))
        sums = [np.bincount(self.doc, weights=x, minlength=size) for x in (self.count > 0, base, np.where(live, 0.0, np.log10(self.chance)))]
        follows = np.zeros(len(at), bool)
        follows[1:] = at[1:] == at[:-1] + 1
        parts = [np.array([d], np.int64), *sums, np.bincount(self.doc[at], minlength=size), self.seen[at - 1].astype(np.uint32), self.seq[at - 1], self.low[at].astype(np.uint32), self.chance[at].astype(np.float32), follows.astype(np.uint8)]
        return {"lens": pack(self.lens), "state": joined(parts)}

    def _resume(self, state: bytes) -> None:
        """Read what reduced() wrote; before a run of tokens stands a place for its first context."""
        kinds = (np.int64, np.float64, np.float64, np.float64, np.int64, np.uint32, np.uint64, np.uint32, np.float32, np.uint8)
        done, *self.sums, per, seen, seq, low, chance, follows = parted(state, kinds)
        self.done = int(done[0])
        at = np.arange(len(low)) + np.cumsum(follows == 0)
        size = len(low) + int((follows == 0).sum())
        doc = np.repeat(np.arange(len(per)), per)

        def spread(x, kind, empty):
            out = np.full(size, empty, kind)
            out[at] = x
            return out

        self.place, self.low, self.chance = spread(2**40, np.int64, 0), spread(low, np.uint64, 0), spread(chance, np.float64, 1.0)
        self.doc, self.train = spread(doc, np.int64, 0), spread(~self.out[doc], bool, False)
        self.seen, self.seq = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.seen[at - 1], self.seq[at - 1] = seen, seq

    def _up_to(self, d: int) -> None:
        """Fold in all answers to contexts of up to d words."""
        if not self.done:
            self.words()
        for k in range(self.done + 1, d + 1):
            self.extend(k, self.events(k))

    def word_request(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys, np.bincount(self.tok[self.train], minlength=len(self.keys))

    def _bucket(self, keys) -> np.ndarray:
        return ((mix(keys) >> np.uint64(20)) % np.uint64(self.tree.buckets)).astype(np.int64)

    def send_words(self):
        """Rows of (bucket, kind, data)."""
        keys, count = self.word_request()
        where = self._bucket(keys)
        order = np.lexsort((keys, where))
        for at in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else []:
            yield int(where[at[0]]), 0, joined([keys[at], count[at].astype(np.uint32)])

    def answered(self, kind: int) -> list[list[np.ndarray]]:
        """The answers of a round by bucket, each a list of arrays."""
        return [parted(d, (np.uint32, np.uint32)) for _, d in sorted(self.answers.get(kind, []))]

    def words(self) -> None:
        """Each token's word count and its chance without context."""
        got = self.answered(0)
        count = np.zeros(len(self.keys), np.int64)
        count[np.lexsort((self.keys, self._bucket(self.keys)))] = np.concatenate([x[0] for x in got]) if got else []
        t = self.tree
        chance = np.where(count > 0, (count - t.discount) / max(t.tokens, 1), max(t.discount * t.words, 0.5) / max(t.tokens, 1))
        self.count, self.chance = count[self.tok], chance[self.tok]
        self.seen, self.seq = self.count, self.keys[self.tok]  # of the words that end at a token: how often, and their hash
        self.low = self.seq & _LOW

    def events(self, d: int) -> Events:
        """Where a candidate context of length d stands before a token.

        Contexts tell next words apart by 32 bits of their hashes.
        """
        t = self.tree
        at = np.flatnonzero(self.place >= d)
        at = at[self.seen[at - 1] >= t.least]
        total, ctx, low = self.seen[at - 1], self.seq[at - 1], self.low[at]
        seq, where = longer(ctx, low), self._bucket(ctx)
        often = np.flatnonzero(total > t.hot)
        if len(often):
            share = low[often] % (-(-total[often] // t.hot)).astype(np.uint64)
            where[often] = self._bucket(ctx[often] + share * np.uint64(0x9E3779B97F4A7C15))
        bits = max(1, (t.buckets - 1).bit_length())
        key = (where.astype(np.uint64) << np.uint64(64 - bits)) | (((ctx & ~_LOW) | low) >> np.uint64(bits))
        by = grouped(key, seq, ctx)
        s = seq[by]
        begins = np.ones(len(s), bool)
        begins[1:] = s[1:] != s[:-1]
        first = by[begins]
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(begins) - 1
        own, dealt = ctx[first], where[first]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (dealt[1:] != dealt[:-1])
        return Events(at, total, seq, which, first, own, low[first], total[first] > t.hot, dealt, new)

    def extend(self, d: int, e: Events) -> None:
        """Fold the states of length d into each token's chance."""
        got, n, kinds = self.answered(d), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(e.first):
            n = np.concatenate([x[0] for x in got]).astype(np.int64)
            kinds = np.concatenate([x[1] for x in got]).astype(np.int64)[np.cumsum(e.new) - 1]
            keys = self.tree.keys[d - 1]
            if len(keys):
                place = np.minimum(np.searchsorted(keys, e.ctx), len(keys) - 1)
                kinds = np.where(e.hot, np.where(keys[place] == e.ctx, self.tree.kinds[d - 1][place], 0), kinds)
        n, kinds = n[e.which], kinds[e.which]
        use = np.flatnonzero(kinds)
        i = e.at[use]
        self.chance[i] = (np.maximum(n[use] - DISCOUNT, 0) + DISCOUNT * kinds[use] * self.chance[i]) / e.total[use]
        seen, seq = np.zeros(len(self.low), np.int64), np.zeros(len(self.low), np.uint64)
        seen[e.at], seq[e.at] = n, e.seq
        self.seen, self.seq = seen, seq

    def request(self, d: int):
        """The rows that ask for the counts of contexts of length d with their next symbols."""
        self._up_to(d - 1)
        e = self.events(d)
        count = np.bincount(e.which[self.train[e.at]], minlength=len(e.first))
        chance = self.chance[e.at[e.first]].astype(np.float32)
        for at in np.split(np.arange(len(e.first)), np.flatnonzero(np.diff(e.where)) + 1) if len(e.first) else []:
            head = at[e.new[at]]
            runs = np.diff(np.append(head, at[-1] + 1))
            yield int(e.where[at[0]]), d, joined([e.ctx[head], runs.astype(np.uint32), e.hot[head].astype(np.uint8), e.low[at].astype(np.uint32), count[at].astype(np.uint32), chance[at]])

    def scores(self) -> pd.DataFrame:
        self._up_to(len(self.tree.keys))
        t, size = self.tree, len(self.lens)
        logs = np.bincount(self.doc, weights=np.log10(self.chance), minlength=size)
        if self.done:
            known, base, score = self.sums[0], self.sums[1], self.sums[2] + logs
        else:
            known, base = (np.bincount(self.doc, weights=x, minlength=size) for x in (self.count > 0, np.log10((self.count + 1) / (t.tokens + t.words + 1))))
            score = logs
        ids = pa.ipc.open_stream(self.ids).read_all().column("id").to_pylist()
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "held_out": self.out, "n_tokens": self.lens, "n_known": known.astype(np.int64), "train_tokens": t.tokens, "base_score": base, "score": score})


def _judged(sums: np.ndarray, gain: float) -> np.ndarray:
    """The divergence test of contexts by their sums: the next symbols of the states, else 0."""
    n, kinds, ones, more, logs = sums
    safe = np.maximum(n, 1)
    left_out = logs - more * np.log(safe) + ones * np.log(np.maximum(DISCOUNT * kinds, 1e-9) / safe)
    return np.where((n > 0) & (left_out >= gain * n), kinds, 0).astype(np.int64)


def _sum_words(rows) -> tuple[list[bytes], list]:
    parts = [parted(d, (np.uint64, np.uint32)) for d in rows]
    key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, which = np.unique(key, return_inverse=True)
    n = np.bincount(which, weights=count).astype(np.int64)
    cut = np.cumsum([len(p[0]) for p in parts])[:-1]
    sums = np.array([(n > 0).sum(), (n == 1).sum(), (n == 2).sum()], np.int64)
    return [joined([x.astype(np.uint32)]) for x in np.split(n[which], cut)], [(-1, sums.tobytes())]


def _sum_contexts(rows, tree: Tree) -> tuple[list[bytes], list]:
    parts = [parted(d, (np.uint64, np.uint32, np.uint8, np.uint32, np.uint32, np.float32)) for d in rows]
    keys, runs, hot, low, count, chance = (np.concatenate(x) for x in zip(*parts, strict=True))
    one, place = distinct(keys)
    own = keys[one]
    ctx = np.repeat(place, runs)
    first, which = distinct(longer(own[ctx], low.astype(np.uint64)))
    n = np.bincount(which, weights=count).astype(np.int64)
    live = n > 0
    c, m, p = ctx[first][live], n[live], chance[first][live].astype(np.float64)
    more = m >= 2
    logs = np.where(more, m * np.log(np.maximum(m - 1 - DISCOUNT, 1e-9) / p), 0.0)
    sums = np.stack([np.bincount(c, weights=w, minlength=len(own)) for w in (m, np.ones(len(m)), ~more, np.where(more, m, 0), logs)])
    shared = np.zeros(len(own), bool)
    shared[place[hot > 0]] = True
    kinds = np.where(shared, 0, _judged(sums, tree.gain))
    counts = np.split(n[which], np.cumsum([len(p[3]) for p in parts])[:-1])
    states = np.split(kinds[place], np.cumsum([len(p[0]) for p in parts])[:-1])
    stats = [(-1, np.array([(kinds > 0).sum()], np.int64).tobytes()), (-2, joined([own[shared], sums[:, shared].T.reshape(-1)]))]
    return [joined([x.astype(np.uint32), y.astype(np.uint32)]) for x, y in zip(counts, states, strict=True)], stats


def _sum_bucket(group: pd.DataFrame, tree: Tree) -> pd.DataFrame:
    """Add up equal keys of a bucket; answers to its blocks, and its part of the statistics."""
    kind, bucket = int(group["kind"].iloc[0]), int(group["bucket"].iloc[0])
    answers, stats = _sum_contexts(group["data"], tree) if kind else _sum_words(group["data"])
    blocks = [*group["block"].tolist(), *(s[0] for s in stats)]
    return pd.DataFrame({"bucket": bucket, "block": blocks, "kind": kind, "data": [*answers, *(s[1] for s in stats)]})


def _exchange(requests: DataFrame, tree: Tree) -> DataFrame:
    limits = Tree(tree.buckets, tree.least, tree.gain, tree.hot)
    return written(requests.groupBy("bucket").applyInPandas(lambda g: _sum_bucket(g, limits), _ROW), "answers")


def _bucketed(rows: DataFrame, n: int) -> DataFrame:
    """A table in the shared folder, bucketed by block, so that answers come to the blocks."""
    spark = rows.sparkSession
    name, path = f"blocks_{uuid.uuid4().hex}", f"{shared_dir(spark)}/bucketed-{uuid.uuid4().hex}"
    rows.write.bucketBy(n, "block").sortBy("block").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved: the catalog's entry can go, the files stay
    spark.sql(f"DROP TABLE {name}")
    out.scratch_path = path
    return out


def _stored(blocks: DataFrame) -> tuple[DataFrame, int]:
    """The blocks written once, and their number of buckets."""
    plain = written(blocks, "blocks")
    n = max(8, plain.count())
    out = _bucketed(plain.repartition(n, "block"), n)
    discard(plain)
    return out, n


def _with_answers(blocks: DataFrame, answers: list[DataFrame], f, schema: str) -> DataFrame:
    got = blocks.select(F.lit(0).alias("bucket"), "block", F.lit(0).alias("kind"), F.lit(b"").alias("data")).limit(0)
    for a in answers:
        got = got.union(a)
    got = got.where("block >= 0").groupBy("block")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, list] = {}
        for kind, bucket, data in zip(right["kind"], right["bucket"], right["data"], strict=True):
            by.setdefault(kind, []).append((bucket, data))
        return f(left.iloc[0], by)

    return blocks.groupBy("block").cogroup(got).applyInPandas(run, schema)


def _note_words(tree: Tree, answers: DataFrame) -> None:
    sums = np.zeros(3, np.int64)
    for (data,) in answers.where("block = -1").select("data").toLocalIterator():
        sums += np.frombuffer(data, np.int64)
    tree.words = int(sums[0])
    tree.discount = float(np.clip(sums[1] / max(1, sums[1] + 2 * sums[2]), 0.1, 0.95))


def _note_contexts(tree: Tree, answers: DataFrame) -> int:
    """The states of this length; the sums of hot contexts over all buckets are judged here."""
    states, keys, sums = 0, [np.zeros(0, np.uint64)], [np.zeros((0, 5))]
    for block, data in answers.where("block < 0").select("block", "data").toLocalIterator():
        if block == -1:
            states += int(np.frombuffer(data, np.int64)[0])
        else:
            own, part = parted(data, (np.uint64, np.float64))
            keys.append(own)
            sums.append(part.reshape(-1, 5))
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    whole = np.zeros((len(own), 5))
    np.add.at(whole, at, np.concatenate(sums))
    tree.keys.append(own)
    tree.kinds.append(_judged(whole.T, tree.gain))
    return states + int((tree.kinds[-1] > 0).sum())


def longest(tokens: int) -> int:
    """The depth of a tree over so many training tokens: half their digits, 2 at least."""
    return max(2, len(str(tokens)) // 2)


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int | None = 2, least_share: float = 0.0, gain: float = 0.002, bucket_tokens: int = 2_000_000, least_count: int = 4) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks, parts = _stored(make_blocks(docs))
    n, train = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    tree = Tree(buckets=max(4, math.ceil(n / bucket_tokens)), least=max(float(least_count), least_share * train), gain=gain, hot=max(1, bucket_tokens // 8), tokens=train)
    schema = ", ".join(f"{c} {t}" for c, t in (("doc_id", kind), ("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")))

    def ask_words(batches):
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                block = Block(row, {}, tree)
                rows = list(block.send_words())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([row["block"]] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "block", "kind", "data"])

    answers = [_exchange(blocks.mapInArrow(ask_words, _ROW), tree)]
    _note_words(tree, answers[0])
    deepest = longest(train) if depth is None else depth
    for d in range(1, deepest + 1):
        shared = docs.sparkSession.sparkContext.broadcast(tree)

        def ask(row, got, d=d, shared=shared):
            rows = list(Block(row, got, shared.value).request(d))
            return pd.DataFrame({"bucket": [r[0] for r in rows], "block": row["block"], "kind": [r[1] for r in rows], "data": [r[2] for r in rows]})

        def reduce(row, got, d=d, shared=shared):
            return pd.DataFrame({c: [x] for c, x in ({c: row[c] for c in ("block", "ids", "out")} | Block(row, got, shared.value).reduced(d - 1)).items()})

        if d == REDUCED + 1:
            after = _bucketed(_with_answers(blocks, answers, reduce, "block long, ids binary, out binary, lens binary, state binary"), parts)
            for x in (blocks, *answers):
                discard(x)
            blocks, answers = after, []
        answers.append(_exchange(_with_answers(blocks, answers, ask, _ROW), tree))
        if not _note_contexts(tree, answers[-1]) and depth is None:
            break
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    return _with_answers(blocks, answers, lambda row, got: Block(row, got, shared.value).scores(), schema)


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), depth=None)


QUERIES = {"op1_suffix_tree_scores": op1_suffix_tree_scores}
SQL: dict[str, str] = {}
