"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and non-ASCII
characters. Of every SPAN - K + 1 successive K-word hashes the least is kept (all equal leasts
are), so any SPAN shared words share a kept hash at the same place. Document fingerprints meet
benchmark fingerprints, and each meeting is extended along its diagonal over equal words; runs
of SPAN words or more are hits. Items of fewer words count as one window of their own length.

A benchmark of at most `limit` bytes (measured) is sent to all tasks as an index; a larger one
is joined by fingerprint, then pairs of document and item are extended row by row.

Null or wordless texts have no words and no hits; nulls among identifiers are kept as they are;
repeated documents get a row each; columns of docs with the names of results are replaced; of tied
hashes all are kept, and their meetings are paired a bounded number at a time, so texts of any
length and of one repeated word go through whole; items with equal identifiers count once; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .words import alnum_table, doc_of, grams, pieces, split

SPAN, K = 13, 7
PAIRS = 1 << 20
_TABLE = alnum_table()
_FAR = np.uint64(2**64 - 1)


def fingerprints(h: np.ndarray, ptr: np.ndarray, k: int = K, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that winnowing keeps, of texts whose words are ptr[i]:ptr[i+1]."""
    g, w = grams(h, k), span - k + 1
    n = len(g)
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.repeat(ptr[1:], np.diff(ptr)) - np.arange(len(h))  # words from here to the text's end
    least = g[: n - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, g[j : j + len(least)], out=least)
    least[left[: len(least)] < span] = 0
    wide = np.zeros(n + w - 1, np.uint64)  # greatest of the leasts of windows that hold a position
    for j in range(w):
        np.maximum(wide[j : j + len(least)], least, out=wide[j : j + len(least)])
    at = np.flatnonzero((wide[:n] == g) & (wide[:n] > 0))
    return at, g[at]


@dataclass
class Index:
    """A benchmark: its words, its sorted fingerprints and its short items by length."""

    ids: list
    h: np.ndarray
    ptr: np.ndarray
    keys: np.ndarray
    at: np.ndarray
    item: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def build_index(ids: list, texts: pa.Array) -> Index:
    w = split(texts, _TABLE)
    at, keys = fingerprints(w.hashes, w.ptr)
    order = np.argsort(keys, kind="stable")
    owner = doc_of(w.ptr)
    short = {}
    sizes = np.diff(w.ptr)
    for m in range(1, SPAN):
        own = np.flatnonzero(sizes == m)
        if len(own):
            g = grams(w.hashes, m)[w.ptr[own]]
            o = np.argsort(g, kind="stable")
            short[m] = (g[o], own[o])
    return Index(list(ids), w.hashes, w.ptr, keys[order], at[order], owner[at[order]], short)


def _meetings(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with wanted[i] == keys[j]; keys are sorted."""
    lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(wanted)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _lines(at: np.ndarray, keys: np.ndarray, text: np.ndarray, index: Index) -> np.ndarray:
    """The distinct (text, item, diagonal) on which fingerprints meet, at most PAIRS pairs at a time."""
    n = np.searchsorted(index.keys, keys, "right") - np.searchsorted(index.keys, keys, "left")
    part, out = np.cumsum(n) // PAIRS, [np.zeros((0, 3), np.int64)]
    for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
        i, j = _meetings(index.keys, keys[some])
        p = at[some[i]]
        met = np.stack([text[p], index.item[j], p - index.at[j]], 1)
        if len(met):
            met = met[np.lexsort(met.T)]
            out.append(met[np.concatenate([[True], (met[1:] != met[:-1]).any(axis=1)])])
    return np.unique(np.concatenate(out), axis=0)


def hits(h: np.ndarray, ptr: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hit runs in the texts: text, first word (within all words), end, item."""
    found: list[tuple[int, int, int, int]] = []
    text = doc_of(ptr)
    if len(index.keys):
        at, keys = fingerprints(h, ptr)
        near = np.searchsorted(index.keys, keys)
        near[near == len(index.keys)] = 0
        keep = np.flatnonzero(index.keys[near] == keys)
        for d, it, diagonal in _lines(at[keep], keys[keep], text, index).tolist():
            lo, hi = max(int(ptr[d]), int(index.ptr[it]) + diagonal), min(int(ptr[d + 1]), int(index.ptr[it + 1]) + diagonal)
            same = np.concatenate([[0], (h[lo:hi] == index.h[lo - diagonal : hi - diagonal]).view(np.int8), [0]])
            turn = np.diff(same)
            for s, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True):
                if e - s >= SPAN:
                    found.append((d, lo + s, lo + e, it))
    for m, (keys, item) in index.short.items():
        g = grams(h, m)
        if not len(g):
            continue
        near = np.searchsorted(keys, g)
        near[near == len(keys)] = 0
        at = np.flatnonzero((keys[near] == g) & (text[: len(g)] == text[m - 1 :][: len(g)]))
        i, j = _meetings(keys, g[at])
        found += zip(text[at[i]].tolist(), at[i].tolist(), (at[i] + m).tolist(), item[j].tolist(), strict=True)
    return tuple(np.array(found, np.int64).reshape(-1, 4).T)


def _covered(first: np.ndarray, end: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Words of each text within any of the runs."""
    total = int(ptr[-1])
    edge = np.bincount(first, minlength=total + 1)[: total + 1] - np.bincount(end, minlength=total + 1)[: total + 1]
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:total]) > 0)])
    return inside[ptr[1:]] - inside[ptr[:-1]]


def digest(ids: list) -> tuple[int, str]:
    names = sorted({str(x) for x in ids})
    return len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


_COUNTS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"


def _with_index(docs: DataFrame, text: str, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own = shared.value
        for b in pieces(batches, text):
            w = split(b.column(text), _TABLE)
            d, first, end, item = hits(w.hashes, w.ptr, own)
            n, hit = np.diff(w.ptr), _covered(first, end, w.ptr)
            by: dict[int, set] = {}
            for x, it in zip(d.tolist(), item.tolist(), strict=True):
                by.setdefault(x, set()).add(own.ids[it])
            empty = digest([])
            marks = [digest(by[i]) if i in by else empty for i in range(len(b))]
            cols = [n, hit, np.array([m[0] for m in marks], np.int64), pa.array([m[1] for m in marks], pa.string()), (hit > 0) & (20 * hit >= n), pa.array([sorted({str(x) for x in by.get(i, ())}) for i in range(len(b))], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, cols)], names=[*b.schema.names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + _COUNTS)


def _word_marks(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Rows (keep..., n_words, key) of the fingerprints and, for short items, whole-text hashes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)

    def run(batches):
        for b in pieces(batches, text):
            w = split(b.column(text), _TABLE)
            at, keys = fingerprints(w.hashes, w.ptr)
            owner, n = doc_of(w.ptr), np.diff(w.ptr)
            rows, sizes, marks = [owner[at]], [np.full(len(at), SPAN)], [keys]
            for m in range(1, SPAN):  # a document may hold a short item anywhere
                g = grams(w.hashes, m)
                ok = np.flatnonzero(owner[: len(g)] == owner[m - 1 :][: len(g)])
                rows, sizes, marks = [*rows, owner[ok]], [*sizes, np.full(len(ok), m)], [*marks, g[ok]]
            r = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(r)) for c in keep], pa.array(n[r]), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(marks).view(np.int64))], names=[*keep, "words", "size", "key"])

    return df.mapInArrow(run, schema + ", words long, size long, key long")


def _with_join(docs: DataFrame, text: str, bench: DataFrame) -> DataFrame:
    """The way for a benchmark of any size: fingerprints, then pairs, are joined."""
    docs = docs.withColumn("_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    texts = docs.select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"])
    items = bench.select(F.col("item_id").cast("string").alias("_item"), F.col("text").alias("_item_text"), F.xxhash64("item_id", "text").alias("_row"))
    item_marks = _word_marks(items, "_item_text", ["_row"]).where("size = least(words, 13)").select("_row", "size", "key").distinct()
    lengths = [r[0] for r in item_marks.select("size").distinct().collect()]  # 13 values at most
    doc_marks = _word_marks(texts, "_text", ["_key"]).where(F.col("size").isin(lengths or [0])).select("_key", "size", "key").distinct()
    pairs = doc_marks.join(item_marks, ["size", "key"]).select("_key", "_row").distinct()
    both = pairs.join(items, "_row").join(texts, "_key").select("_key", "_item", "_text", "_item_text")

    def extend(batches):
        for b in pieces(batches, "_text"):
            for i in range(len(b)):
                one = build_index([b.column("_item")[i].as_py()], b.column("_item_text").slice(i, 1))
                w = split(b.column("_text").slice(i, 1), _TABLE)
                _, first, end, _ = hits(w.hashes, w.ptr, one)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(c)[i].as_py()] * len(first), pa.string()) for c in ("_key", "_item")] + [pa.array(first), pa.array(end)], names=["_key", "_item", "first", "end"])

    runs = both.mapInArrow(extend, "_key string, _item string, first long, end long")
    before = W.partitionBy("_key").orderBy("first", "end", "_item").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("first", F.coalesce(F.max("end").over(before), F.lit(0))))
    found = runs.withColumn("_new", fresh).groupBy("_key").agg(F.sum("_new").alias("_hit"), F.array_sort(F.collect_set("_item")).alias("_items"))

    def count(batches):
        for b in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(np.diff(split(b.column("_text"), _TABLE).ptr))], names=["_key", "n_words"])

    sizes = texts.mapInArrow(count, "_key string, n_words long")
    out = docs.join(sizes, "_key", "left").join(found, "_key", "left")
    hit, ids = F.coalesce("_hit", F.lit(0)), F.coalesce("_items", F.array().cast("array<string>"))
    return out.select(*[c for c in docs.columns if c != "_key"], "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), ids.alias("item_ids"))


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", limit: int = 32 << 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and item_ids.

    bench has item_id and text. `limit` bounds the bytes of benchmark text sent to every task.
    """
    docs = docs.drop(*[c.split()[0] for c in _COUNTS.split(", ")])
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if size > limit:
        return _with_join(docs, text, bench)
    rows = bench.select("item_id", "text").collect()
    return _with_index(docs, text, build_index([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string())))


def op2_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {"op2_winnowing_decontamination": op2_winnowing_decontamination}
SQL: dict[str, str] = {}
