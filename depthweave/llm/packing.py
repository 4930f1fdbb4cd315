"""Best-fit packing of documents into sequences, improved by swap-based local search.

A document longer than a sequence is cut into whole sequences after a shorter first piece. The
pieces are dealt by hash into cells of about `cell` pieces, so no task grows with the corpus; a
cell is packed best-fit decreasing and, while it has more bins than its tokens need, the emptiest
bin is drained: items move to other underfull bins, or are exchanged one for one, two for one or
one for two, each step increasing the sum of squared fills, until bins empty. The search of a cell
ends when every underfull bin has been tried without success since the last one emptied. A cell leaves
about one bin in a few thousand that a packing over all cells might save.

A null or empty text has its end token only. Repeated rows and null identifiers are packed like
any others; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from .tokens import default_path, encoder, forget, trim
from .words import pieces

END = 2


def cut(n: int, size: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    first = n % size
    return ([first] if first else []) + [size] * (n // size) if n > size else [n]


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Bins of indices: best fit over the sizes in decreasing order."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(cap + 1)]
    open_spaces = 0  # bit s: a bin with s tokens of space
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        w = sizes[i]
        fits = open_spaces >> w
        if fits:
            space = w + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                open_spaces ^= 1 << space
        else:
            space, b = cap, len(bins)
            bins.append([])
        bins[b].append(i)
        by_space[space - w].append(b)
        open_spaces |= 1 << (space - w)
    return bins


def _drain(victim: int, bins: list[list[int]], fill: list[int], sizes: list[int], cap: int) -> bool:
    """Exchange until the victim is empty; False where no step helps."""
    others = [b for b in range(len(bins)) if b != victim and bins[b] and fill[b] < cap]

    def shift(out: list[int], b: int, back: list[int]) -> None:
        moved = sum(sizes[i] for i in out) - sum(sizes[i] for i in back)
        for i in out:
            bins[victim].remove(i)
            bins[b].append(i)
        for i in back:
            bins[b].remove(i)
            bins[victim].append(i)
        fill[victim] -= moved
        fill[b] += moved

    while bins[victim]:
        best: tuple = (0,)
        own = sorted(bins[victim], key=lambda i: -sizes[i])
        own = [i for k, i in enumerate(own) if k < 2 or sizes[own[k - 2]] != sizes[i]]  # a third of one size adds no pair
        pairs = sorted((sizes[a] + sizes[c], a, c) for k, a in enumerate(own) for c in own[k + 1 :])
        sums = [p[0] for p in pairs]
        for b in others:
            space = cap - fill[b]
            if not space or fill[b] < fill[victim]:
                continue
            for i in own:  # move
                if sizes[i] <= space:
                    best = max(best, (sizes[i] + cap, b, (i,), ()))  # a whole move before any exchange
                    break
            if best[0] > cap:
                continue
            inner = sorted(bins[b], key=lambda j: sizes[j])
            for j in inner:
                for i in own:  # one for one
                    if 0 < (gain := sizes[i] - sizes[j]) <= space:
                        best = max(best, (gain, b, (i,), (j,)))
                        break
                k = bisect_left(sums, sizes[j] + space + 1) - 1  # two for one
                if k >= 0 and sums[k] > sizes[j]:
                    best = max(best, (sums[k] - sizes[j], b, pairs[k][1:], (j,)))
            for i in own:  # one for two
                lo, hi = 0, len(inner) - 1
                while lo < hi:
                    gain = sizes[i] - sizes[inner[lo]] - sizes[inner[hi]]
                    if 0 < gain <= space:
                        best = max(best, (gain, b, (i,), (inner[lo], inner[hi])))
                    if gain > 0:
                        lo += 1
                    else:
                        hi -= 1
        if not best[0]:
            return False
        shift(list(best[2]), best[1], list(best[3]))
    return True


def pack(sizes: list[int], cap: int) -> list[list[int]]:
    """Bins of indices into sizes."""
    bins = best_fit(sizes, cap)
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(sizes) // cap)
    tried: set[int] = set()
    while True:
        live = [b for b in range(len(bins)) if bins[b]]
        open_ = [b for b in live if b not in tried and fill[b] < cap]
        if len(live) <= least or not open_:
            break
        victim = min(open_, key=fill.__getitem__)
        tried.add(victim)
        if _drain(victim, bins, fill, sizes, cap):
            tried.clear()
    return [b for b in bins if b]


def cut_documents(df: DataFrame, tokenizer: str, size: int, doc_id: str = "doc_id", text: str = "text", batch: int = 4 << 20, known: int = 300_000, keep: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of every document's pieces.

    batch: bytes of text encoded at once; known: chunks a worker keeps ids of; keep: from task to task.
    """

    def run(batches):
        own, end = encoder(tokenizer, known), np.array([END], np.uint32).tobytes()
        try:
            for b in pieces(batches, text, batch):
                rows: list[tuple] = []
                for i, ids in enumerate(own.encode(b.column(text).to_pylist())):
                    ids += end
                    start = 0
                    for k, n in enumerate(cut(len(ids) // 4, size)):
                        rows.append((i, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                        start += n
                of, k, start, n, crc = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(doc_id).take(of), k.cast(pa.int32()), start, n, crc], names=[doc_id, "piece", "start", "length", "ids_crc32"])
        finally:
            own = None  # what is still named here isn't given back
            trim() if keep else forget()  # else an idle worker keeps the ids while other stages run

    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {dict(df.dtypes)[doc_id]}, piece int, start long, length long, ids_crc32 long")


def pack_pieces(cuts: DataFrame, size: int, cell: int = 8192) -> DataFrame:
    """Any table with `length` with sequence_id and offset added."""
    stored = written(cuts.withColumn("_uid", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    short = stored.where(F.col("length") < size)
    cells = max(1, round(short.count() / cell))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["length"].tolist()
        seq, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, items in enumerate(pack(sizes, size)):
            at = 0
            for i in items:
                seq[i], offset[i] = b, at
                at += sizes[i]
        return group.assign(sequence_id=seq + group["_cell"].astype("int64") * 2**32, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    dealt = short.withColumn("_cell", F.pmod("_uid", F.lit(cells)))
    packed = dealt.groupBy("_cell").applyInPandas(run, schema + ", _cell long, sequence_id long, offset long").drop("_cell", "_uid")
    full = stored.where(F.col("length") >= size).drop("_uid").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def op7_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cuts = cut_documents(docs, default_path(), 1024, batch=16 << 20, known=600_000, keep=True)
    return pack_pieces(cuts, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op7_swap_packing": op7_swap_packing}
SQL: dict[str, str] = {}
