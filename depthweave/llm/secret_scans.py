"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every text; each candidate value is hashed, and the hashes are
counted over the corpus by distinct owners and repositories. A value held by `example_owners`
owners or more is a widely copied example; another one with enough entropy is live-looking; the
rest is weak. The three base kinds are always reported. The further kinds (provider-prefixed
keys, web tokens, private keys) are reported unless their value is an example. A private key spans
header, body and footer, or as many key lines as there are; its value is the body without breaks.

Null texts count as empty; null owners or repositories count as one owner or repository; equal
rows get equal results, a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from .words import pieces

_NAME = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
# Fixed patterns: kind, pattern, group that is the secret, least length of it.
BASE = (
    ("assign", rf"""({_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
MORE = (
    ("prefixed", r"(?:gh[pousr]_[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,})", 0, 16),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2})*+(?:(?:\s|\\[nr])++[A-Za-z0-9+/]{1,15}={1,2})?)", 0, 16),
)
_KINDS = [(kind, re.compile(pattern if kind != "hex" else "[0-9a-f]{32,}"), group, least, i < len(BASE)) for i, (kind, pattern, group, least) in enumerate((*BASE, *MORE))]
ORDER = {k[0]: i for i, k in enumerate(_KINDS)}
#: Matches any text in which one of the patterns can match; linear-time, to skip the others.
_MAYBE = rf"""(?:{_NAME})["']?\x20*[:=]|AKIA[A-Z0-9]{{12}}|[0-9a-f]{{32}}|gh[pousr]_|sk_live_|xox[abprs]-|AIza|eyJ|-----BEGIN """


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


_EDGES = re.compile(r"-----(?:BEGIN|END) [A-Z ]{0,20}PRIVATE KEY-----|\\[nr]|[^A-Za-z0-9+/=]")


def owned(kind: str, value: str) -> str:
    """What owners are counted by: of a private key its body, if it has one."""
    return _EDGES.sub("", value) or value if kind == "pem" else value


def candidates(text: str) -> list[dict]:
    """All candidate spans of a text by start, then kind in the listed order."""
    out = []
    for kind, pattern, group, least, base in _KINDS:
        for m in pattern.finditer(text):
            value = m[group]
            if len(value) >= least:
                value = owned(kind, value)
                out.append({"kind": kind, "start": m.start(), "end": m.end(), "at": m.start(group), "h": int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True), "bits": entropy(value), "base": base})
    return sorted(out, key=lambda x: (x["start"], ORDER[x["kind"]]))


def label(spans) -> str:
    return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans)


_CAND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("at", pa.int32()), ("h", pa.int64()), ("bits", pa.float64()), ("base", pa.bool_())]))
_CAND_SQL = "array<struct<kind:string,start:int,end:int,at:int,h:bigint,bits:double,base:boolean>>"


def scan(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep columns with n_assign, n_access, n_hex, base_sha256 and the candidates."""
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for b in pieces(batches, text):
            col = b.column(text).fill_null("")
            maybe = pc.match_substring_regex(col, _MAYBE)
            found = [candidates(t.as_py()) if m else [] for t, m in zip(col, maybe.to_pylist(), strict=True)]
            counts = [pa.array([sum(x["kind"] == k for x in f) for f in found], pa.int64()) for k in ("assign", "access", "hex")]
            sha = pa.array([hashlib.sha256(label(x for x in f if x["base"]).encode()).hexdigest() if f else nothing for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *counts, sha, pa.array(found, _CAND)], names=[*keep, "n_assign", "n_access", "n_hex", "base_sha256", "_cands"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return df.select(*keep, text).mapInArrow(run, f"{types}, n_assign long, n_access long, n_hex long, base_sha256 string, _cands {_CAND_SQL}")


def ownership(cands: DataFrame, owner: str, repo: str) -> DataFrame:
    """owners and repos of each candidate hash; rows of a hot hash shrink before they move."""
    return cands.select("h", owner, repo).distinct().groupBy("h", owner).agg(F.count("*").alias("r")).groupBy("h").agg(F.count("*").alias("owners"), F.sum("r").alias("repos"))


def find_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "owner", repo: str = "repo", example_owners: int = 3, least_bits: float = 2.5) -> DataFrame:
    """One row per row of df: doc_id, _key, counts, base_sha256, spans and findings.

    findings: array of (kind, start, end, at, h, base, owners, repos, verdict); `at` is where the
    secret value itself begins. _key tells rows of equal identifiers but other texts apart.
    """
    keyed = df.select(F.col(doc_id), F.col(owner).alias("_owner"), F.col(repo).alias("_repo"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key"), F.col(text))
    seen = written(scan(keyed, text, [doc_id, "_owner", "_repo", "_key"]), "secrets")
    cands = seen.where(F.size("_cands") > 0).select(doc_id, "_owner", "_repo", "_key", F.inline("_cands"))
    verdict = F.when(F.col("owners") >= example_owners, "example").when(F.col("bits") >= least_bits, "live").otherwise("weak")
    judged = cands.join(ownership(cands, "_owner", "_repo"), "h").withColumn("verdict", verdict).where("base or verdict != 'example'")
    rank = F.element_at(F.create_map(*[F.lit(x) for p in ORDER.items() for x in p]), F.col("kind"))
    one = judged.select(doc_id, "_key", F.struct("start", rank.alias("rank"), "kind", "end", "at", "h", "base", "owners", "repos", "verdict").alias("f")).groupBy(doc_id, "_key").agg(F.array_sort(F.collect_set("f")).alias("findings"))
    left, right = seen.drop("_cands").alias("l"), one.alias("r")
    joined = left.join(right, F.col(f"l.{doc_id}").eqNullSafe(F.col(f"r.{doc_id}")) & (F.col("l._key") == F.col("r._key")), "left")
    found = F.coalesce(F.col("findings"), F.array().cast(dict(one.dtypes)["findings"]))
    spans = F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    return joined.select(*[F.col(f"l.{c}") for c in (doc_id, "_key", "n_assign", "n_access", "n_hex", "base_sha256")], spans.alias("spans"), found.alias("findings"))


def redact(text: str, cuts: list[tuple[int, int]]) -> str:
    """text with the given spans replaced."""
    out, at = [], 0
    for start, end in sorted(cuts):
        if end > at:
            out += [text[at : max(at, start)], "[REDACTED]"]
            at = end
    return "".join(out) + text[at:]


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repo"))
    out = find_secrets(docs)
    many = [F.expr(f"cast(size(filter(findings, x -> x.verdict = '{v}')) as bigint)").alias(f"n_{v}") for v in ("live", "example")]
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *many)


QUERIES = {"op6_secret_ownership": op6_secret_ownership}
SQL: dict[str, str] = {}
