"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the same columns
(the last: packed pieces). Columns a stage adds for itself never clash with those of docs.
Null texts, null identifiers, repeated rows, empty tables and texts of any length go through as
their operators say; of tied near duplicates the least doc_id stays, and of rows that agree in
doc_id and text one. Secrets that overlap are cut as one span.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthweave.llm.decontamination import decontaminate
from depthweave.llm.jaccard_join import jaccard_groups
from depthweave.llm.packing import cut_documents, pack_pieces
from depthweave.llm.quality_rules import document_measures, host_verdicts
from depthweave.llm.scratch import written
from depthweave.llm.secret_scans import find_secrets, redact
from depthweave.llm.tokens import default_path

SEQUENCE = 1024
BATCH = "8m"  # of texts that pass to a Python worker at once: the JVM and the worker hold one of each task, 64 MB else


def _wrapped(docs: DataFrame, *out: str) -> DataFrame:
    """The given columns, and all others as one struct column `_row`."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in out]).alias("_row"), *out)


def _unwrapped(df: DataFrame, docs: DataFrame, *out: str) -> DataFrame:
    return df.select(*[F.col(c) if c in out else F.col("_row")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail by themselves nor come from a rejected host."""
    measured = document_measures(_wrapped(docs, "text", "source"), "text").select("_row", "text", "source", "base_failed")
    measured = written(measured, "quality")
    hosts = written(host_verdicts(measured, "source").where("host_rejected").select("_host"), "hosts")  # its size is known then: texts don't move while it is small
    good = measured.where("not base_failed")
    return _unwrapped(good.join(hosts, good["source"].eqNullSafe(hosts["_host"]), "left_anti"), docs, "text", "source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 of five-word shingles, the least doc_id's row."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    own = docs.select(F.struct("doc_id", key.alias("key")).alias("own"), "text")
    groups = jaccard_groups(own, 5, 4, 5, "own", "text")
    kept = groups.where(F.col("own") == F.col("component_id")).select(F.col("own.doc_id").alias("_id"), F.col("own.key").alias("_kept_key")).distinct()
    keyed = _wrapped(docs, "doc_id", "text").withColumn("_key", key)
    stay = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_kept_key")), "left_semi")
    return _unwrapped(stay.dropDuplicates(["doc_id", "_key"]), docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    marked = decontaminate(_wrapped(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unwrapped(marked.where("not contaminated"), docs, "text")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials replaced in their texts."""
    named = docs.select("doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repo"))
    live = F.filter("findings", lambda x: x["verdict"] == "live")
    cuts = F.transform(live, lambda x: F.struct(x["at"].alias("start"), x["end"].alias("end")))
    found = find_secrets(named).where(F.size(live) > 0).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_found_key"), cuts.alias("cuts"))
    found = written(found.dropDuplicates(["_id", "_found_key"]), "cuts")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else redact(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans, strict=True)], dtype=object)

    keyed = _wrapped(docs, "doc_id", "text").withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_found_key")), "left")
    out = _unwrapped(joined.withColumn("text", cut("text", "cuts")), docs, "doc_id", "text")
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most SEQUENCE tokens with their sequence and place in it."""
    return pack_pieces(cut_documents(docs, default_path(), SEQUENCE), SEQUENCE)


def _in_small_batches(stage):
    """The stage, with its session's Arrow batches of at most BATCH; a stage runs after it returns, so they stay so."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("best-fit packing", packing)]
STAGES = [(name, _in_small_batches(stage)) for name, stage in STAGES]

#: SQL can't express the tokenizer and the local search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
