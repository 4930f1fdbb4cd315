"""Reproducible shuffle into shards by a keyed permutation of global row numbers.

Rows get gapless numbers 0..n-1 in order of identifier (then size, checksum), a Feistel
network over the next power of four, walked until it lands below n, permutes the numbers, and
shard and slot are the remainder and quotient of the permuted number. Both directions are
computable from (n, seed) alone: `place` says where a row goes, `row_at` which row a slot has.

Null identifiers sort first; null texts count as empty; repeated rows get numbers of their own;
an empty table gives an empty result. Law `rows`: shard sizes differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from .words import mix

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    return mix(np.uint64(seed) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _once(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    low, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & low
    for k in keys:
        left, right = right, left ^ (mix(right + k) & low)
    return (left << shift) | right


def _back(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    low, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & low
    for k in keys[::-1]:
        left, right = right ^ (mix(left + k) & low), left
    return (left << shift) | right


def _walk(x: np.ndarray, n: int, seed: int, step) -> np.ndarray:
    bits, keys = _half_bits(n), _keys(seed)
    out = step(x.astype(np.uint64), bits, keys)
    while len(wide := np.flatnonzero(out >= np.uint64(n))):
        out[wide] = step(out[wide], bits, keys)
    return out.astype(np.int64)


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1."""
    return _walk(np.asarray(x), n, seed, _once)


def unpermute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    return _walk(np.asarray(x), n, seed, _back)


def place(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Gapless global numbers from 0 in the given order, and the number of rows.

    Range partitions are sorted and counted; only one count per partition reaches the driver.
    Rows that are equal in all of `order` are numbered in any order among themselves.
    """
    spark = df.sparkSession
    tie = F.xxhash64(F.monotonically_increasing_id())
    ranged = df.withColumn("_tie", tie).repartitionByRange(*[F.col(c) for c in order], "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    at = F.monotonically_increasing_id()
    local = written(ranged.withColumn("_part", F.shiftright(at, 33)).withColumn("_local", at.bitwiseAND((1 << 33) - 1)), "numbered")
    counts = sorted((r[0], r[1]) for r in local.groupBy("_part").agg(F.count("*")).collect())
    firsts, total = [], 0
    for part, count in counts:
        firsts.append((part, total))
        total += count
    offsets = spark.createDataFrame(firsts, "_part long, _first long")
    joined = local.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_first") + F.col("_local")).drop("_part", "_local", "_first"), total


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int) -> DataFrame:
    """df with `shard` and `slot` by the permuted global row number."""
    numbered, n = number_rows(df, order)

    @F.pandas_udf("long")
    def moved(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    p = numbered.withColumn("_moved", moved("row_number"))
    return p.withColumn("shard", (F.col("_moved") % shards).cast("int")).withColumn("slot", F.expr(f"_moved div {shards}")).drop("_moved")


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_rows(docs, ["doc_id", "size", "text_crc32"], 24, 77)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_feistel_sharding": op3_feistel_sharding}
SQL: dict[str, str] = {}
