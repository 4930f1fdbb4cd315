"""N-gram Jaccard join by rare-first prefix filtering, and the groups its links form.

A document's set is its distinct k-word shingles (one whole-sequence shingle where it has fewer
words). Equal sets are one class from the start. Shingles are ordered by how many documents have
them, then by hash, so any two sets that reach the threshold share a shingle within their
prefixes. The counts are exact, by packed exchange: a block of texts sends each bucket of the hash
space its shingles, and the bucket answers with those that another class has too. A shingle of one
class can't be met, so it holds its place at the front of the prefix and goes no further.

Classes meet on prefix shingles: in star rounds each with the most central class of the shingle
(the one with the smallest share of unshared shingles), then, of the shingles whose classes are
still in different groups, each with all of other groups and like length. A star round follows
another while some of the pairs it tries are links and some aren't: neither share under PRODUCTIVE,
and ROUNDS at most. In the last round a pair
is made where it first meets: a posting carries the BEFORE open shingles before it, and two that
have one of these in common have met there. Length and positional filters come first; a suffix
filter bounds the overlap by counts over RANGES ranges of the hash; then a pair is verified, once,
on its two texts, which are fetched once for all classes that can meet another. Pairs inside a
group that is already connected are not made: yet every link between different groups is found.

A null or wordless text has an empty set and is linked with nothing; its component is its own
identifier. Repeated rows get a row each. Texts of any length are taken whole: one longer than a
block is a block of its own. Ties of frequency go by hash, ties of identifiers by the least. Other
columns of the input aren't read. An empty table gives an empty result. The input is read more
than once; where its plan shuffles, so that its order may differ, it is written first.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import discard, written
from .tokens import forget
from .words import blank_table, grams, mix, pieces, split

_TABLE = blank_table(lower=True)
BLOOM = 1 << 25
RANGES = 128
BLOCK = 4 << 20  # bytes of text
PIECE = 1 << 20  # bytes of text hashed at once, if a text isn't longer; a block ends where it is nearest to BLOCK
CROWD = 64
CROWDED_KEY = 4096  # classes of a shingle that one task compares with all others
BEFORE = 16
PRODUCTIVE = 0.25
_CROWDED = np.uint32(2**32 - 1)
ROUNDS = 3


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = split(texts, _TABLE)
    g = grams(w.hashes, k)
    out = []
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(grams(w.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """A 64-bit digest of a set; equal sets have equal ones."""
    parts = np.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)), mix(np.array([len(s)], np.uint64)))
    return int(parts.sum(dtype=np.uint64).astype(np.int64))


def range_counts(sets: list[np.ndarray]) -> pa.Array:
    """For the suffix filter: members in each of RANGES equal ranges of the hash."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate([np.zeros(0, np.uint64), *sets])
    at = of * RANGES + (every >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)
    counts = np.bincount(at, minlength=len(sets) * RANGES).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * RANGES), pa.array(counts))


def prefix_length(n: int, num: int, den: int) -> int:
    """Shingles of a set of n that any set at the threshold must share one of."""
    return n - -(-n * num // den) + 1


def _pack(x: np.ndarray) -> bytes:
    """An array's bytes, like ones together, compressed."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def _parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _blocks(batches, k: int):
    """(block, cls, n, token, doc, rows) of blocks of texts; equal sets of a block count once.

    rows has the identifier, the size of the set and the class of every document of the block.
    """
    forget()  # a worker that tokenised before has some 130 MB of ids
    part, number, held, rows, size = TaskContext.get().partitionId(), 0, {}, [], 0

    def made():
        cls, sets = np.array(list(held), np.int64), [np.zeros(0, np.uint64), *held.values()]
        held.clear()
        n = np.array([len(s) for s in sets[1:]], np.int64)
        mark = int(mix(cls.view(np.uint64)).sum(dtype=np.uint64) >> np.uint64(40)) if len(cls) else 0
        return (part << 44) + (number << 24) + mark, cls, n, np.concatenate(sets), np.repeat(np.arange(len(n), dtype=np.uint32), n), rows

    for b in pieces(batches, "text", PIECE):
        sets = shingle_sets(b.column("text"), k)
        own = [class_of(s) for s in sets]
        held |= {c: s for c, s in zip(own, sets, strict=True) if len(s)}
        rows.append((b.column("doc_id").take(pa.array(np.arange(len(b)))), [len(s) for s in sets], own))  # a slice would hold its batch's texts
        size += b.column("text").nbytes
        del b, sets, own
        if size >= BLOCK - PIECE // 2:
            yield made()
            number, rows, size = number + 1, [], 0
    if rows:
        yield made()


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins."""
    return np.flatnonzero(np.append(np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))


def _local(token: np.ndarray, doc: np.ndarray):
    """Shingles in order, and which of them too many of the block's texts have."""
    by = np.argsort(token, kind="stable")
    token, doc = token[by], doc[by]
    del by
    start = _starts(token)
    size = np.diff(start, append=len(token)).astype(np.uint32)
    return token, doc, start, size, size > CROWD


_SENT = "kind int, key long, block long, data binary"


def _messages(block: int, cls: np.ndarray, token: np.ndarray, doc: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A block's message to each bucket, one put in order at a time."""
    token, doc, start, size, crowded = _local(token, doc)
    keep = ~np.repeat(crowded, size)
    first, many = token[start[crowded]], size[crowded]
    del start, size
    token, doc, count = np.append(token[keep], first), np.append(doc[keep], np.full(len(first), _CROWDED)), np.append(np.ones(keep.sum(), np.uint32), many)
    del keep
    low = (token & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    token >>= np.uint64(32)
    token %= np.uint64(buckets)
    where = token.astype(np.uint32)
    del token
    by = np.argsort(where, kind="stable")
    keys, sent = [], []
    for lo, hi in itertools.pairwise([*_starts(where[by]).tolist(), len(by)]):
        at = by[lo:hi]
        keys.append(int(where[at[0]]))
        at = at[np.lexsort((doc[at], low[at]))]
        there = np.unique(doc[at])
        sent.append(_joined([_pack(np.diff(low[at], prepend=np.uint32(0))), _pack(doc[at]), _pack(count[at]), _pack(there), _pack(cls[there[there != _CROWDED]])]))
    return pa.RecordBatch.from_arrays([pa.array([0] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array([block] * len(keys), pa.int64()), pa.array(sent, pa.binary())], names=["kind", "key", "block", "data"])


def _ask(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """To each bucket: a block's shingles (low 32 bits, in order), their texts, those texts' classes.

    A shingle that more than CROWD texts of the block have is sent once, with its count.
    """

    def run(batches):
        for block, cls, _, token, doc, _ in _blocks(batches, k):
            if len(token):
                yield _messages(block, cls, token, doc, buckets)
                del token, doc  # before the next block is made

    return docs.mapInArrow(run, _SENT)


def _own(docs: DataFrame, k: int) -> DataFrame:
    """What a block keeps: its documents, classes and set sizes, and who has its crowded shingles."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for block, cls, n, token, doc, rows in _blocks(batches, k):
            token, doc, _, size, crowded = _local(token, doc)
            own = np.repeat(crowded, size)
            ids = pa.concat_arrays([r[0] for r in rows])
            each = pa.StructArray.from_arrays([ids, *(pa.array([x for r in rows for x in r[i]], pa.int64()) for i in (1, 2))], names=["doc_id", "n", "cls"])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_joined([_pack(cls), _pack(n), _pack(token[own]), _pack(doc[own])])], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), each)], names=["block", "data", "docs"])

    return docs.mapInArrow(run, f"block long, data binary, docs array<struct<doc_id:{kind.simpleString()},n:long,cls:long>>")


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """To each block: which of its shingles more than one class has, and in how many texts.

    Columns are unpacked one after the other: a bucket has millions of shingles.
    """
    sent = [_parted(data) for data in group["data"]]

    def column(i: int) -> np.ndarray:
        return np.concatenate([_unpack(x[i], np.uint32) for x in sent])

    low = np.concatenate([np.cumsum(_unpack(x[0], np.uint32), dtype=np.uint32) for x in sent])
    by = np.argsort(low, kind="stable")
    low = low[by]
    start = _starts(low)
    del low
    doc = column(1)
    ends = np.cumsum([len(_unpack(x[1], np.uint32)) for x in sent])
    cls = np.empty(len(doc), np.int64)
    for x, lo, hi in zip(sent, np.append(0, ends).tolist(), ends.tolist(), strict=False):
        cls[lo:hi] = np.append(_unpack(x[4], np.int64), -1)[np.searchsorted(_unpack(x[3], np.uint32), doc[lo:hi])]  # the last: of a crowded shingle
    cls = cls[by]
    shared = np.append(False, cls[1:] != cls[:-1])
    del cls
    shared[start] = False
    shared |= (doc == _CROWDED)[by]
    del doc
    shared = np.logical_or.reduceat(shared, start)
    size = np.diff(start, append=len(by))
    seen = np.minimum(np.add.reduceat(column(2)[by], start, dtype=np.int64), 2**31).astype(np.uint32)
    del start
    keep = by[np.repeat(shared, size)]
    seen = np.repeat(seen[shared], size[shared])
    del by, size
    order = np.argsort(keep)
    keep, seen = keep[order], seen[order]
    del order
    bucket, rows = int(group["key"].iloc[0]), []
    for block, x, lo, hi in zip(group["block"], sent, np.append(0, ends).tolist(), ends.tolist(), strict=False):
        a, b = np.searchsorted(keep, [lo, hi])
        if a < b:
            at = keep[a:b] - lo
            low = np.cumsum(_unpack(x[0], np.uint32), dtype=np.uint32)
            rows.append((2, bucket, block, _joined([_pack(low[at]), _pack(_unpack(x[1], np.uint32)[at]), _pack(seen[a:b])])))
    return pd.DataFrame(rows, columns=["kind", "key", "block", "data"])


def _choose(group: pd.DataFrame, num: int, den: int, buckets: int) -> pd.DataFrame:
    """The postings of a block: of each set's prefix, the shingles that can be met."""
    kept = group[group["kind"] == 1]
    if len(kept) != 1:
        raise RuntimeError("a block was not read alike twice")
    cls, n, crowd_token, crowd_doc = _parted(kept["data"].iloc[0])
    cls, n, crowd_token, crowd_doc = _unpack(cls, np.int64), _unpack(n, np.int64), _unpack(crowd_token, np.uint64), _unpack(crowd_doc, np.uint32)
    token, doc, freq = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    crowded: dict[tuple[int, int], int] = {}
    for bucket, data in group.loc[group["kind"] == 2, ["key", "data"]].itertuples(index=False):
        low, d, f = _parted(data)
        low, d, f = _unpack(low, np.uint32), _unpack(d, np.uint32), _unpack(f, np.uint32)
        one = d != _CROWDED
        token.append(low[one].astype(np.int64) + (bucket << 32))
        doc.append(d[one])
        freq.append(f[one])
        crowded |= {(bucket, x): y for x, y in zip(low[~one].tolist(), f[~one].tolist(), strict=True)}
    if len(crowd_token):
        bucket = ((crowd_token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        low = (crowd_token & np.uint64(0xFFFFFFFF)).astype(np.int64)
        token.append(low + (bucket << 32))
        doc.append(crowd_doc)
        freq.append(np.array([crowded[x] for x in zip(bucket.tolist(), low.tolist(), strict=True)], np.uint32))
    token, doc, freq = np.concatenate(token), np.concatenate(doc).astype(np.int64), np.concatenate(freq)
    by = np.lexsort((token, freq, doc))
    token, doc = token[by], doc[by]
    m = np.bincount(doc, minlength=len(cls))
    alone = n - m
    place = alone[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m)
    ok = place < (n - (n * num + den - 1) // den + 1)[doc]
    d = doc[ok]
    return pd.DataFrame({"token": token[ok], "cls": cls[d], "n": n[d], "pos": place[ok], "alone": alone[d]})


def _postings(docs: DataFrame, own: DataFrame, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """(token, cls, n, pos, alone): prefix shingles of two classes or more, by exact frequency."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        return _choose(group, num, den, buckets)

    answers = _ask(docs, k, buckets).groupBy("key").applyInPandas(_answer, _SENT)
    kept = own.select(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("key"), "block", "data")
    return kept.unionByName(answers).groupBy("block").applyInPandas(choose, "token long, cls long, n long, pos long, alone long").dropDuplicates(["token", "cls"])


def _may_reach(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The suffix filter: pairs whose counts by hash range allow the overlap they need."""
    one = texts.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("ranges").alias("r_a"))
    two = texts.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("ranges").alias("r_b"))

    def run(batches):
        for b in batches:
            x, y = (b.column(c).flatten().to_numpy().reshape(-1, RANGES) for c in ("r_a", "r_b"))
            both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            ok = (den + num) * both >= num * (b.column("n_a").to_numpy() + b.column("n_b").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * |x & y| >= num * |x | y|, for sets that aren't empty."""
    need = num * (len(x) + len(y))
    return (den + num) * min(len(x), len(y)) >= need and (den + num) * len(np.intersect1d(x, y, assume_unique=True)) >= need


def _texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, n, ranges, text) of the wanted (cls, rep): one document of each class."""
    bits = _bloom(wanted.select(F.xxhash64("rep").alias("cls")))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def likely(batches):
        own = shared.value
        for b in batches:
            at = (mix(b.column("_key").to_numpy().view(np.uint64)) % BLOOM).astype(np.int64)
            yield from _with_sets(b.take(pa.array(np.flatnonzero((own[at >> 3] >> (at & 7)) & 1))))

    def _with_sets(rows):
        for b in pieces([rows], "text", PIECE):
            sets = shingle_sets(b.column("text"), k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), range_counts(sets), b.column("text")], names=["doc_id", "cls", "n", "ranges", "text"])

    found = docs.withColumn("_key", F.xxhash64("doc_id")).mapInArrow(likely, f"doc_id {dict(docs.dtypes)['doc_id']}, cls long, n long, ranges array<int>, text string")
    ours = wanted.select(F.col("cls").alias("_cls"), "rep")
    kept = found.join(ours, (F.col("cls") == F.col("_cls")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    return written(kept.dropDuplicates(["cls"]).select("cls", "n", "ranges", "text"), "texts")


def _verified(texts: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold."""
    one = texts.select(F.col("cls").alias("a"), F.col("text").alias("text"))
    two = texts.select(F.col("cls").alias("b"), F.col("text").alias("other"))

    def verify(batches):
        for b in pieces(batches, "text", PIECE):
            ok = [similar(x, y, num, den) for x, y in zip(shingle_sets(b.column("text"), k), shingle_sets(b.column("other"), k), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "text", "other").mapInArrow(verify, "a long, b long")


def _bloom(nodes: DataFrame) -> np.ndarray:
    """A bit array of fixed size (BLOOM bits) that has every class; it only saves moving texts."""

    def run(batches):
        bits = np.zeros(BLOOM, bool)
        for b in batches:
            bits[(mix(b.column("cls").to_numpy().view(np.uint64)) % BLOOM).astype(np.int64)] = True
        packed = np.packbits(bits, bitorder="little")
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(packed, 16)], pa.binary())], names=["chunk", "data"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(BLOOM // 128, np.uint8)
        for data in group["data"]:
            out |= np.frombuffer(zlib.decompress(data), np.uint8)
        return pd.DataFrame({"chunk": group["chunk"][:1], "data": [out.tobytes()]})

    out = np.zeros((16, BLOOM // 128), np.uint8)
    for i, data in nodes.select("cls").mapInArrow(run, "chunk int, data binary").groupBy("chunk").applyInPandas(join, "chunk int, data binary").collect():
        out[i] = np.frombuffer(data, np.uint8)
    return out.reshape(-1)


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); label: the least node it is connected to.

    Large-star and small-star steps alternate, as joins with the least neighbour of each node,
    until nothing changes; each step's edges are written to the shared folder.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(df: DataFrame):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        after = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(now)
        now, last, seen = after, seen, mark(after)
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v")).distinct()


def _stable(df: DataFrame) -> DataFrame:
    """df, or what is written of it where a shuffle could give its rows in another order."""
    return written(df, "input") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def _near(x: str, y: str, num: int, den: int, met):
    """The length filter, and the positional filter on a common shingle.

    met: how many shingles before it the two can have in common at most.
    """
    n, m, i, j = F.col(f"n{x}"), F.col(f"n{y}"), F.col(f"pos{x}"), F.col(f"pos{y}")
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((num + den) * (F.least(n - i, m - j) + met) >= num * (n + m))


def _star(open_: DataFrame, step: int, num: int, den: int) -> DataFrame:
    """Pairs of each class with the most central one of its shingle, or of one group there."""
    x = open_.select("token", *[F.col(c).alias(f"{c}_x") for c in ("cls", "n", "pos", "alone", "label")])
    order = F.struct(F.xxhash64("label", F.lit(step)).alias("h") if step else F.lit(0).alias("h"), (F.col("alone") / F.col("n")).alias("share"), F.col("cls").alias("cls_y"), F.col("n").alias("n_y"), F.col("pos").alias("pos_y"), F.col("alone").alias("alone_y"), F.col("label").alias("label_y"))
    hubs = open_.groupBy("token").agg(F.min(order).alias("hub")).select("token", "hub.*")
    met = F.least(F.col("pos_x") - F.col("alone_x"), F.col("pos_y") - F.col("alone_y"))
    return x.join(hubs, "token").where((F.col("label_x") != F.col("label_y")) & _near("_x", "_y", num, den, met))


def _all(open_: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes of different groups, each where it meets first.

    Keys are a shingle and a band of lengths; a shingle of very many classes is dealt over several.
    """
    by = Window.partitionBy("cls").orderBy("pos")
    placed = open_.withColumn("r", F.row_number().over(by) - 1).withColumn("before", F.collect_list("token").over(by.rowsBetween(-BEFORE, -1)))
    placed = written(placed, "open")
    band = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(max(den / num, 1.01))))
    parts = F.ceil(F.col("size") / CROWDED_KEY)
    columns = ("cls", "n", "pos", "label", "r", "before")
    least = F.ceil(num * F.col("n") / den)
    bands = F.explode(F.sequence(band(F.greatest(least, F.lit(1))), band(F.col("n"))))
    x = placed.select("token", *[F.col(c).alias(f"{c}_x") for c in columns], bands.alias("band"), "size")
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("size")
    y = placed.select("token", *[F.col(c).alias(f"{c}_y") for c in columns], band(F.col("n")).alias("band"), F.pmod(F.xxhash64("cls"), parts).alias("part"))
    left_out = F.greatest(F.lit(0), F.col("r_x") - BEFORE) + F.greatest(F.lit(0), F.col("r_y") - BEFORE)
    smaller = (F.col("n_y") < F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("cls_y") < F.col("cls_x")))
    return x.join(y, ["token", "band", "part"]).where((F.col("label_x") != F.col("label_y")) & smaller & _near("_x", "_y", num, den, F.least("r_x", "r_y", left_out)) & ~F.arrays_overlap("before_x", "before_y"))


def jaccard_groups(df: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of df.

    Two documents link when den * |intersection| >= num * |union| of their k-shingle sets.
    """
    docs = _stable(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    own = written(_own(docs, k), "own")
    classes = own.select(F.explode("docs").alias("doc")).select("doc.*")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    reps = written(classes.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep")), "reps")
    postings = written(_postings(docs, own, k, num, den, max(4, int(total) // 2_000_000)), "postings")
    meeting = postings.join(postings.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token"), "token")
    texts = _texts(docs, written(meeting.select("cls").distinct().join(reps, "cls"), "wanted"), k)

    tried = None
    links, labels = None, reps.select(F.col("cls").alias("node"), F.col("cls").alias("label")).limit(0)
    step, last = 0, False
    while True:
        marked = postings.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        apart = marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("token", "size")
        open_ = marked.select("token", "cls", "n", "pos", "alone", "label").join(apart, "token")
        if not last:
            open_ = written(open_, "open")
        pairs = (_all(open_, num, den) if last else _star(open_, step, num, den)).select(F.greatest("cls_x", "cls_y").alias("a"), F.least("cls_x", "cls_y").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = written(_verified(texts, written(_may_reach(pairs, texts, num, den), "likely"), k, num, den), "links")
        n = found.count()
        if n:
            links = found if links is None else links.union(found)
            labels = connected(links)
        if last:
            break
        step += 1
        last = step == ROUNDS or not PRODUCTIVE * (m := pairs.count()) < n < (1 - PRODUCTIVE) * m
    labelled = reps.select("cls", "rep").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = labelled.join(least, "label").select("cls", "component_id")
    out = classes.join(named, "cls", "left")
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_groups(docs, 4, 85, 100)


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
SQL: dict[str, str] = {}
