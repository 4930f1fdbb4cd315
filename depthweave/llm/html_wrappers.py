"""Main text of web pages by wrappers inferred per host, as union-free regular expressions.

A page is a stream of text blocks, each under a path of structural tags (name and class words).
A text that stands on many different pages of its host (an eighth of them, three at least) is a
token of its own, any other is a slot. Adjacent equal groups fold into repeated groups, of any
length, so a page becomes a short expression. The expressions of a host are aligned two at a time:
equal parts stay; where they differ, a fixed text against another text or slot of the same path
becomes a slot, and what only one side has becomes optional; the outcome is folded again.
Alignment goes in rounds over groups of bounded size, so no task takes all pages of a hot host.

A fixed text that the wrapper requires, or that is optional but all its path ever holds, is the
host's template; others are data, as an optional one among slots may be a passage that articles
share. The text of a page is the data in its article region, else in its main region, else in all its slots; a
region in which all is fixed is kept whole. Slots that vary but are no article (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) are told by the names of their tags
and classes, as nothing in their variation tells them from content.

A null page is empty; a null or odd url gives the host ''. Repeated pages get a row each and count
once in the inference; texts of any length are compared whole; ties don't matter. Other columns
pass through, but text and n_chars are replaced. An empty table gives an empty result; truncated
and unclosed markup is read as far as it goes.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, written
from .words import pieces

# HTML element names by role, and class or id words of page furniture.
RAW = "script style noscript template svg iframe textarea select option button object".split()
BLOCKS = "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
FURNITURE = "head title nav aside footer form menu dialog".split()
WORDS = "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login masthead menu modal nav navbar newsletter notice notices pager pagination popup promo promoted related replies reply share sharing sidebar signup skip social sponsored subscribe toolbar widget".split()
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "body": {"head", "title"}}
_P_ENDS = set(BLOCKS) - {"body", "html", "head", "title"}
READERS = "comment comments disqus related replies reply".split()
_BLOCK, _VOID, _FURNITURE, _WORDS, _READERS = set(BLOCKS), set(VOID), set(FURNITURE), set(WORDS), set(READERS)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


def blocks(page: str):
    """(path, text) of the blocks of a page in order; a path has the open structural tags."""
    stack: list[str] = []
    held: list[str] = []
    out: list[tuple[tuple[str, ...], str]] = []
    at = 0

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((tuple(stack), text))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
        if name not in _BLOCK:
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].split(".", 1)[0] == name:
                    del stack[i:]
                    break
            continue
        ends = _CLOSES.get(name, set()) | ({"p"} if name in _P_ENDS else set())
        while stack and stack[-1].split(".", 1)[0] in ends:
            stack.pop()
        if name not in _VOID:
            words = sorted({w for a in _ATTR.findall(m[4]) for w in re.split(r"[^a-z0-9]+", "".join(a).lower()) if w in _WORDS})
            stack.append(".".join([name, *words]))
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


# An expression is a list of items: ["c", path, hash] a fixed text, ["s", path] a slot, ["+", items]
# a repeated group and ["?", items] an optional one.


def key(item: list):
    """What an item matches, but for how often."""
    kind, own, *more = item
    if kind in "+?":
        return key(own[0]) if len(own) == 1 else ("+", *map(key, own))
    return (kind, own, *more)


def _strip(item: list, kind: str) -> list:
    return item[1][0] if item[0] == kind and len(item[1]) == 1 else item


def _both(x: list, y: list) -> list:
    """One item for two of the same key: optional or repeated where either is."""
    optional = x[0] == "?" or y[0] == "?"
    x, y = _strip(x, "?"), _strip(y, "?")
    best = x if x[0] == "+" else y
    return ["?", [best]] if optional else best


def _repeated(copies: list[list]) -> list:
    """One item for several copies of a group."""
    if len(copies[0]) == 1:
        inner = ["+", [_strip(_strip(copies[0][0], "?"), "+")]]
        return ["?", [inner]] if all(c[0][0] == "?" for c in copies) else inner
    group = copies[0]
    for c in copies[1:]:
        group = [_both(x, y) for x, y in zip(group, c, strict=True)]
    return ["+", group]


def fold(items: list) -> list:
    """Adjacent equal groups become repeated groups, shortest first, until none is left."""
    size = 1
    while 2 * size <= len(items):
        number: dict = {}
        ids = np.array([number.setdefault(key(x), len(number)) for x in items])
        same = ids[size:] == ids[:-size]
        ends = np.append(np.flatnonzero(~same), len(same))
        run = ends[np.searchsorted(ends, np.arange(len(same)))] - np.arange(len(same))
        if not (run >= size).any():
            size += 1
            continue
        out, i = [], 0
        while i < len(items):
            more = int(run[i]) // size if i < len(run) else 0
            out.append(_repeated([items[i + k * size : i + (k + 1) * size] for k in range(more + 1)]) if more else items[i])
            i += (more + 1) * size if more else 1
        items, size = out, 1
    return items


def _leaves(items: list):
    for x in items:
        if x[0] in "+?":
            yield from _leaves(x[1])
        else:
            yield x


def _opened(items: list, other: list) -> list:
    """Fixed texts become slots where the other side has something else of their path."""
    there: dict[str, set] = {}
    for kind, path, *text in _leaves(other):
        there.setdefault(path, set()).add(text[0] if kind == "c" else None)
    turn = lambda x: [x[0], fold([turn(y) for y in x[1]])] if x[0] in "+?" else (["s", x[1]] if x[0] == "c" and there.get(x[1], set()) - {x[2]} else x)
    return [turn(x) for x in items]


def _grouped(items: list, other: list) -> list:
    """Items that stand once where the other side repeats them become a repeated group, too."""
    for kind, own, *_ in (_strip(x, "?") for x in other):
        if kind == "+" and len(own) > 1:
            want, out, i = [key(x) for x in own], [], 0
            while i < len(items):
                found = [key(x) for x in items[i : i + len(want)]] == want
                out.append(["+", items[i : i + len(want)]] if found else items[i])
                i += len(want) if found else 1
            items = out
    return items


def align(a: list, b: list) -> list:
    """One expression that matches what either matches."""
    maybe = lambda items: [x if x[0] == "?" else ["?", [x]] for x in items]
    out = []
    for op, i, j, k, m in SequenceMatcher(None, [key(x) for x in a], [key(x) for x in b], autojunk=False).get_opcodes():
        x, y = a[i:j], b[k:m]
        if op == "equal":
            out += [_both(p, q) for p, q in zip(x, y, strict=True)]
            continue
        p, q = _grouped(x, y), _grouped(y, x)
        if p == x and q == y:
            p, q = fold(_opened(x, y)), fold(_opened(y, x))
        out += align(p, q) if p != x or q != y else maybe(x) + maybe(y)
    return fold(out)


def induce(page: str, fixed: set[int] = frozenset()) -> list:
    """The expression of one page; fixed has the hashes of texts that are tokens."""
    items = []
    for path, text in blocks(page):
        path = "/".join(path)
        h = _hash(path + "\0" + text)
        items.append(["c", path, h] if h in fixed else ["s", path])
    return fold(items)


def merge(x: list, y: list) -> list:
    return x if x == y else align(x, y)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def furniture(path: list[str]) -> int:
    """Is a slot page furniture? 0: no, 1: by the layout around it only, 2: yes.

    The page's own elements are not judged; those around an article or main region count as layout
    unless they are for navigation or readers, and so does a form around content.
    """
    steps = [s.split(".") for s in path if s.split(".")[0] not in ("html", "body")]
    region = next((i for i, s in enumerate(steps) if s[0] in ("article", "main")), None)
    worst = 0
    for i, (name, *words) in enumerate(steps):
        around = region is not None and i < region
        if name in ("article", "main"):
            hard = bool(_READERS & set(words))
        else:
            hard = (name in _FURNITURE and name != "form") or (name == "header" and (region is None or around)) or bool(words and (not around or _READERS & set(words))) or (name == "form" and region is not None and not around)
        worst = max(worst, 2 if hard else int(name == "form" or (around and bool(words))))
    return worst


def content(wrapper: list) -> tuple[dict[str, int], set[int]]:
    """Of a wrapper: its paths that can be content, with their verdicts, and its template texts."""
    held: dict[str, set] = {}
    required: set[int] = set()

    def visit(items, optional: bool) -> None:
        for kind, own, *text in items:
            if kind in "+?":
                visit(own, optional or kind == "?")
            else:
                held.setdefault(own, set()).add(text[0] if text else None)
                required.update(() if optional else text)

    visit(wrapper, False)
    judged = {path: furniture(path.split("/")) for path in held}
    alone = {x for own in held.values() if len(own) == 1 for x in own if x is not None}
    return {p: v for p, v in judged.items() if v < 2}, required | alone


def extract(page: str, paths: dict[str, int], fixed: set[int]) -> str:
    """The text of a page by its host's paths and fixed texts."""
    own = [(path, text, paths[p]) for path, text in blocks(page) if (p := "/".join(path)) in paths]
    varies = lambda found: [x for x in found if _hash("/".join(x[0]) + "\0" + x[1]) not in fixed]
    inside = lambda path, region: any(step.split(".")[0] == region for step in path)
    for layout in (0, 1):
        for region in ("article", "main"):
            if found := [x for x in own if x[2] <= layout and inside(x[0], region)]:
                return "\n\n".join(x[1] for x in varies(found) or found)
    rest = [x for x in own if not x[2]] or own
    return "\n\n".join(x[1] for x in varies(rest))


def frequent_texts(pages: DataFrame, least: int = 3, share: int = 8) -> DataFrame:
    """(_host, _fixed): hashes of the texts on `least` different pages of a host and 1/share of them.

    Pages are told apart by their hashes. A host has at most `share` times as many of these texts
    as one of its pages has blocks.
    """

    def run(batches):
        for b in pieces(batches, "_html"):
            hosts, at, rows = b.column("_host"), [], []
            for i, page in enumerate(b.column("_html").to_pylist()):
                one = _hash(page)
                mine = {_hash("/".join(p) + "\0" + t) for p, t in blocks(page)} | {None}
                at += [i] * len(mine)
                rows += [(h, one) for h in mine]
            cols = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([hosts.take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=["_host", "_text", "_page"])

    rows = pages.mapInArrow(run, "_host string, _text long, _page long").distinct()
    counts = written(rows.groupBy("_host", "_text").agg(F.count("*").alias("n")).where(F.col("n") >= least), "texts")
    whole = counts.where("_text is null").select("_host", F.col("n").alias("pages"))
    often = counts.where("_text is not null").join(whole, "_host").where(share * F.col("n") >= F.col("pages"))
    return written(often.groupBy("_host").agg(F.array_sort(F.collect_set("_text")).alias("_fixed")), "fixed")


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def infer_wrappers(pages: DataFrame, fixed: DataFrame, most: int = 64) -> DataFrame:
    """(host, wrapper) with the wrapper as JSON; pages has _host and _html, fixed _host and _fixed."""

    def first(batches):
        for b in pieces(batches, "_html"):
            by: dict[str, list] = {}
            known: dict[str, set] = {}
            for i, (host, page) in enumerate(zip(b.column("_host").to_pylist(), b.column("_html").to_pylist(), strict=True)):
                if host not in known:
                    known[host] = set(b.column("_fixed")[i].as_py() or ())
                one = induce(page, known[host])
                by[host] = merge(by[host], one) if host in by else one
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([json.dumps(w) for w in by.values()], pa.string())], names=["host", "wrapper"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for w in sorted(set(group["wrapper"])):
            whole = merge(whole, json.loads(w)) if whole else json.loads(w)
        return pd.DataFrame({"host": group["host"][:1], "wrapper": [json.dumps(whole)]})

    now = written(pages.join(fixed, "_host", "left").select("_host", "_html", "_fixed").mapInArrow(first, "host string, wrapper string"), "wrappers")
    while True:
        sizes = now.groupBy("host").agg(F.count("*").alias("n"))
        largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if largest <= 1:
            return now
        dealt = now.join(sizes, "host").withColumn("_part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / most)) if largest > most else F.lit(0))
        before, now = now, written(dealt.groupBy("host", "_part").applyInPandas(join, "host string, wrapper string"), "wrappers")
        discard(before)


def main_texts(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """df without the page, with text and n_chars."""
    keep = [c for c in df.columns if c not in (page, "text", "n_chars")]
    host = F.coalesce(F.regexp_extract(F.lower(url), _HOST, 1), F.lit(""))
    pages = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), host.alias("_host"), F.coalesce(page, F.lit("")).alias("_html"))
    fixed = frequent_texts(pages.select("_host", "_html"))
    wrappers = infer_wrappers(pages.select("_host", "_html"), fixed)

    def choose(batches):
        for b in batches:
            told = [content(json.loads(w)) for w in b.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([json.dumps([x, sorted(y)]) for x, y in told], pa.string())], names=["_host", "_told"])

    chosen = written(wrappers.mapInArrow(choose, "_host string, _told string"), "chosen")  # its size is known then: no page moves while it is small

    def run(batches):
        known: dict[str, tuple] = {}
        for b in pieces(batches, "_html"):
            texts = []
            for told, t in zip(b.column("_told").to_pylist(), b.column("_html").to_pylist(), strict=True):
                if told not in known:
                    known.clear() if len(known) > 1000 else None
                    paths, own = json.loads(told)
                    known[told] = paths, set(own)
                texts.append(extract(t, *known[told]))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["_row", "text", "n_chars"])

    row = pages.schema["_row"].dataType.simpleString()
    out = pages.join(chosen, "_host").select("_row", "_html", "_told").mapInArrow(run, f"_row {row}, text string, n_chars long")
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], "text", "n_chars")


def op8_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op8_wrapper_extraction": op8_wrapper_extraction}
SQL: dict[str, str] = {}
