"""Token-id files in document order, by the context-mixing range coder.

Documents are range-partitioned and sorted by identifier (then text), encoded, and written as
frames of about `frame` ids, cut between documents. A frame row has its partition and number,
the identifiers and lengths of its documents, and the coded blocks; Spark's writer commits the
files, so lost tasks leave nothing behind. Reading decodes frames in any order, checks each
block, and adds the ids before a frame from per-partition sums (one row per partition) and a
running sum over the partition's frames.

A null text is empty (its end id only); null identifiers come first; repeated rows are written
each; an empty table makes an empty file set.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .id_codec import decode_frame, encode_frame
from .scratch import shared_dir
from .tokens import default_path, encoder, trim
from .words import pieces

END = 0


def write_ids(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", frame: int = 8 << 20) -> None:
    """Write the documents' ids, each followed by END, in ascending order of doc_id."""
    kind = df.schema[doc_id].dataType
    ordered = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("_tie", F.xxhash64("text")).repartitionByRange("id", "_tie").sortWithinPartitions("id", "_tie", "text").drop("_tie")

    def run(batches):
        own, end = encoder(tokenizer, 600_000), np.array([END], np.uint32).tobytes()
        part, number = TaskContext.get().partitionId(), 0
        names, coded, held, id_type = [], [], 0, None

        def made():
            ids = np.frombuffer(b"".join(coded), np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([names], pa.list_(id_type)), pa.array([[len(x) // 4 for x in coded]], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([encode_frame(ids)], pa.binary())], names=["part", "frame", "ids", "lengths", "n", "payload"])

        for b in pieces(batches, "text", 18 << 20):
            id_type = b.column("id").type
            for name, ids in zip(b.column("id").to_pylist(), own.encode(b.column("text").to_pylist()), strict=True):
                names.append(name)
                coded.append(ids + end)
                held += len(coded[-1]) // 4
                if held >= frame:
                    yield made()
                    names, coded, held, number = [], [], 0, number + 1
        if coded:
            yield made()
        trim()

    ordered.mapInArrow(run, f"part int, frame int, ids array<{kind.simpleString()}>, lengths array<long>, n long, payload binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, token_ids]) decoded from the files."""
    frames = spark.read.parquet(path)
    kind = frames.schema["ids"].dataType.elementType.simpleString()
    sums = frames.groupBy("part").agg(F.sum("n")).orderBy("part").collect()
    firsts = [0, *accumulate(r[1] for r in sums)]
    offsets = spark.createDataFrame([(r[0], n) for r, n in zip(sums, firsts, strict=False)], "part int, part_start long")
    before = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = frames.select("part", "frame", "n").withColumn("in_part", before).join(F.broadcast(offsets), "part").select("part", "frame", (F.col("part_start") + F.col("in_part")).alias("frame_start"))

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                data = decode_frame(b.column("payload")[i].as_py()).astype("<u4").tobytes()
                n = b.column("lengths")[i].as_py()
                at = [0, *accumulate(n)]
                parts = [data[4 * s : 4 * e] for s, e in zip(at, at[1:], strict=False)]
                cols = [pa.array([b.column(c)[i].as_py()] * len(n), pa.int32()) for c in ("part", "frame")]
                cols += [b.column("ids")[i].values, pa.array(at[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["part", "frame", "doc_id", "in_frame", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, np.uint32).tolist() for x in parts], pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = frames.select("part", "frame", "ids", "lengths", "payload").mapInArrow(run, f"part int, frame int, doc_id {kind}, in_frame long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids)
    out = docs.join(starts, ["part", "frame"]).withColumn("start", F.col("frame_start") + F.col("in_frame"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["token_ids"] * with_ids)


def op10_context_mixing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_path())
    return read_ids(spark, path)


QUERIES = {"op10_context_mixing_ids": op10_context_mixing_ids}
SQL: dict[str, str] = {}
