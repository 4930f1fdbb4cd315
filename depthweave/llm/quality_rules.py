"""Quality rules per document and per host, in DataFrame expressions only.

Words are runs without ASCII white space. A document fails by itself when it has too few words
or too large a share of words in repeated five-word windows. Failures are summed by host, each
host's rate is shrunk toward the corpus by a beta prior fitted to all hosts by moments, and a
host whose shrunk rate exceeds `host_limit` by `sure` posterior standard deviations is rejected
with all its documents, so that a host of a few documents isn't judged by one failure.

Null texts count as empty (they fail); a null host is a host of its own; repeated documents
count each; an empty table gives an empty result; other columns are kept untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

_BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 5


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def counted(s: Column) -> Column:
        n = F.size(s)
        twins = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | ((i + 1 < n) & (F.get(s, i + 1)["h"] == e["h"])))
        places = F.sort_array(F.transform(twins, lambda e: e["i"]))
        return let(places, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(p, F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")), lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["at"])).alias("n")), lambda acc: acc["n"])))

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(pairs), counted))


def document_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, _BLANK), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))))
    each = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars")))
    out = df.withColumn("_w", each).withColumn("_g", windows)
    out = out.withColumn("n_words", F.col("_w.n_words")).withColumn("word_chars", F.col("_w.word_chars"))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"))
    out = out.withColumn("n_dup_lines", let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
    out = out.withColumn("n_repeat_words", let(F.col("_g"), _repeated).cast("long")).drop("_w", "_g")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_verdicts(marked: DataFrame, host: str, host_limit: float = 0.5, least_hosts: int = 3, sure: float = 2.0) -> DataFrame:
    """One row per host: n, failed, shrunk_rate and host_rejected.

    The prior's mean and strength come from the mean and variance of the hosts' rates; with fewer
    than `least_hosts` hosts or no variance beyond chance, the prior is the pooled rate with the
    strength of an average host.
    """
    hosts = marked.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(F.sum("failed").alias("f"), F.sum("n").alias("t"), F.count("*").alias("k"), F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(F.lit(1.0) / F.col("n")).alias("r")).first()  # one row
    if not prior["k"]:
        return hosts.withColumn("shrunk_rate", F.lit(0.0)).withColumn("host_rejected", F.lit(False))
    mean, chance = prior["m"], prior["m"] * (1 - prior["m"]) * prior["r"]
    spread = prior["v"] - chance
    if prior["k"] >= least_hosts and spread > 1e-12 and 0 < mean < 1:
        strength = max(1.0, mean * (1 - mean) / spread - 1)
    else:
        mean, strength = prior["f"] / prior["t"], prior["t"] / prior["k"]
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    spread_of = F.sqrt(F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / (F.col("n") + F.lit(strength + 1)))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_rejected", F.col("shrunk_rate") - sure * spread_of > host_limit)


def apply_rules(df: DataFrame, text: str = "text", host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """df without the text, with the measures, base_failed, shrunk_rate, host_rejected, kept."""
    marked = written(document_measures(df, text).drop(text), "quality")
    hosts = host_verdicts(marked, host, host_limit).select("_host", "shrunk_rate", "host_rejected")
    joined = marked.join(hosts, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def op4_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected", F.round("shrunk_rate", 6).alias("shrunk_rate"))


QUERIES = {"op4_host_quality_rules": op4_host_quality_rules}
