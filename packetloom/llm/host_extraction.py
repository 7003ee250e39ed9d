"""Main text of web pages: markup tells what is article and what is not, and a suffix array per host finds boilerplate elsewhere."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import WordHashes, batches_of, signed, stage, windows

#: Tokens of a run that counts as repeated, at least.
RUN = 6
#: Tokens gathered for one suffix array; bounds a task's memory.
STREAM = 1_000_000

RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "template", "iframe", "noembed", "noframes", "svg", "math", "object", "canvas", "audio", "video"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "input", "ins", "head", "datalist", "search"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s",
          "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source", "ins"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class and id names that mark what is not the article.
MARKED = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adsbygoogle", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
          "notification", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead", "footer", "comment", "comments", "commentlist",
          "disqus", "respond", "replies", "share", "sharing", "social", "newsletter", "subscribe", "signup", "promo", "promotion", "sponsor", "sponsored", "related",
          "popup", "modal", "overlay", "toolbar", "widget", "login", "pagination", "pager", "topbar"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
_LEAVES = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "related", "sidebar", "aside"}
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']+|"[^"]*"|'[^']*')*)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|\Z)""", re.I)
ARTICLE = {"article", "main"}
_ENDED_BY_P = INLINE | {"p"}


def _not_article(name: str, attributes: str, in_article: bool) -> str:
    """Why an element is not part of an article; empty if it is."""
    if name in BOILERPLATE:
        return name
    if name == "header" and not in_article:
        return name
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id"):
            words = set(re.split(r"[^a-z]+", value))
            if words & MARKED and name not in ("body", "html", "main"):
                return min(words & MARKED, key=lambda w: (w not in _LEAVES, w))
            if "header" in words and not in_article and name in ("div", "section", "table", "ul"):
                return "header"
        elif key == "role" and value in ROLES:
            return value
        elif key == "hidden" and value in ("", "hidden") or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return "hidden"
    return ""


def blocks(page: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of every block with text: article, marked (boilerplate by its markup) or other."""
    open_: list[tuple[str, str]] = []
    marked = articles = 0
    text: list[str] = []
    kind = "other"

    def close() -> str:
        joined = "".join(text)
        text.clear()
        return " ".join((html.unescape(joined) if "&" in joined else joined).split())

    at = 0
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        closing, name, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not name:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        why = "" if closing else _not_article(name, attributes, articles > 0)
        if closing:
            k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), len(open_))
            gone = open_[k:]
        else:
            k, gone = len(open_), []
            if name == "p":
                while k and open_[k - 1][0] in _ENDED_BY_P and not open_[k - 1][1]:
                    k -= 1
                gone = open_[k:]
        if (name not in INLINE or why or any(w for _, w in gone)) and text and (joined := close()):
            yield kind, joined
        if gone:
            del open_[k:]
            marked -= sum(1 for _, w in gone if w)
            articles -= sum(1 for n, _ in gone if n in ARTICLE)
        if not closing and name not in VOID:
            if name in ARTICLE:
                if not why and marked and not any(w in _LEAVES for _, w in open_):
                    open_ = [(n, "") for n, _ in open_]  # what was left open ends where an article begins
                    marked = 0
                articles += 1
            marked += bool(why)
            open_.append((name, why))
        kind = "marked" if marked else "article" if articles else "other"
    text.append(page[at:])
    if joined := close():
        yield kind, joined


_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("at", pa.int64()), ("decided", pa.bool_()), ("text", pa.string()),
                     ("others", pa.list_(pa.struct([("marked", pa.bool_()), ("text", pa.string())])))])


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", url or "", re.I)
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for page_id, url, page, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(blocks(page or ""))
                decided = any(k == "article" for k, _ in found)
                yield {"page_id": page_id, "url": url, "host": _host(url), "at": at, "decided": decided, "text": "\n".join(t for k, t in found if k == "article"),
                       "others": [{"marked": k == "marked", "text": t} for k, t in found if k != "article"]}

    yield from batches_of(_PARSED, rows())


def suffix_classes(tokens: np.ndarray, stream: np.ndarray, length: int) -> np.ndarray:
    """Suffix array of concatenated token streams to a depth of `length`: the class of each position's first `length` tokens.

    Ranks double their depth each round, by sorting pairs of ranks; positions whose tokens would reach into the next stream get -1.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < length:
        step = min(depth, length - depth)
        ahead = np.full(n, -1, np.int64)
        ahead[:n - step] = rank[step:]
        pair = rank * (n + 1) + ahead + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        depth += step
    whole = np.zeros(n, bool)
    whole[:max(0, n - length + 1)] = stream[:max(0, n - length + 1)] == stream[length - 1:] if n >= length else False
    return np.where(whole, rank, -1)


_RUNS = pa.schema([("host", pa.string()), ("run", pa.int64()), ("least", pa.int64()), ("most", pa.int64())])


def _streams(batches: Iterator[pa.RecordBatch], most: int = STREAM):
    """(hosts, page names, tokens, the page of each token) of as many pages as make up a stream."""
    hashes = WordHashes()
    hosts, names, tokens = [], [], []
    size = 0
    for batch in batches:
        for host, at, others in zip(*(batch.column(n).to_pylist() for n in ("host", "at", "others")), strict=True):
            words = [w for x in others for w in x["text"].encode().split()]
            hosts.append(host)
            names.append(at)
            tokens.append(hashes.of(words))
            size += len(words)
            if size >= most:
                yield hosts, names, tokens
                hosts, names, tokens, size = [], [], [], 0
    if hosts:
        yield hosts, names, tokens


def _local_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of RUN tokens of a host once per stream, with the least and the largest page that has it."""
    for hosts, names, tokens in _streams(batches):
        n = np.array([len(t) for t in tokens])
        flat = np.concatenate(tokens)
        page = np.repeat(np.arange(len(n)), n)
        classes = suffix_classes(flat, page, RUN)
        at = np.flatnonzero(classes >= 0)
        if not len(at):
            continue
        code = np.unique(np.array(hosts, object).astype(str), return_inverse=True)[1]
        run = signed(windows(flat, RUN))[at]
        key = code[page[at]]
        order = np.lexsort((classes[at], key))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(classes[at][order]) != 0)]))
        of = np.array(names, np.int64)[page[at]][order]
        yield pa.RecordBatch.from_arrays([pa.array([hosts[p] for p in page[at][order][first]]), pa.array(run[order][first]), pa.array(np.minimum.reduceat(of, first)),
                                          pa.array(np.maximum.reduceat(of, first))], schema=_RUNS)


_PLACES = pa.schema([("host", pa.string()), ("run", pa.int64()), ("page_id", pa.int64()), ("at", pa.int64()), ("place", pa.int32())])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for page_id, host, at, others in zip(*(batch.column(n).to_pylist() for n in ("page_id", "host", "at", "others")), strict=True):
            run = signed(windows(hashes.of([w for x in others for w in x["text"].encode().split()]), RUN))
            if len(run):
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(run)), pa.array(run), pa.array([page_id] * len(run), pa.int64()), pa.array([at] * len(run), pa.int64()),
                                                  pa.array(range(len(run)), pa.int32())], schema=_PLACES)


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_removed", pa.int64())])

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                covered = {p + i for p in row["places"] or () for i in range(RUN)}
                place, kept, gone = 0, [], 0
                for block in row["others"]:
                    words = block["text"].split()
                    # The stream has words parted at ASCII white space; longer blanks inside a word would shift places.
                    n = len(block["text"].encode().split())
                    stay = [w for i, w in enumerate(words) if place + i not in covered] if n == len(words) else words
                    if not block["marked"]:
                        gone += len(words) - len(stay)
                        if stay:
                            kept.append(" ".join(stay))
                    place += n
                yield {"page_id": row["page_id"], "url": row["url"], "text": "\n".join(kept), "n_removed": gone}

    yield from batches_of(schema, rows())


def repeated_runs(parsed: DataFrame) -> DataFrame:
    """(host, run) of every run of RUN tokens that distinct pages of a host share, outside their articles.

    Suffix arrays over bounded streams find the runs and merge equal ones before the shuffle; sums over streams settle which recur,
    so a host of any size is never gathered. Pages with equal html are one page.
    """
    local = parsed.select("host", "at", "others").mapInArrow(_local_runs, "host string, run bigint, least bigint, most bigint")
    return local.groupBy("host", "run").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("host", "run")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_removed of every page, one row per row.

    Where a page marks its article (article or main element), that is its text, without what elements, roles, classes or ids mark as
    something else; repeated passages inside it stay, since a contract asks for the whole article. Elsewhere the blocks that are not
    marked lose every run of RUN or more tokens that another page of the host has too, and the unique runs stay, joined per block;
    n_removed counts the words so removed. Null and empty pages have an empty text. Repeated rows each get a row. Pages without a
    host share one. Only the three columns named are read. An empty table gives an empty one.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("page"), F.xxhash64(page).alias("at"))
    parsed = stage(rows.mapInArrow(_parse, "page_id bigint, url string, host string, at bigint, decided boolean, text string, others array<struct<marked: boolean, text: string>>"))
    runs = repeated_runs(parsed)
    marked = parsed.where("decided").select("page_id", "url", "text", F.lit(0).cast("bigint").alias("n_removed"))
    unmarked = parsed.where("not decided")
    places = unmarked.select("page_id", "host", "at", "others").mapInArrow(_places, "host string, run bigint, page_id bigint, at bigint, place int")
    places = places.join(runs, ["host", "run"], "left_semi").groupBy("page_id", "at").agg(F.collect_set("place").alias("places"))
    places = places.select(F.col("page_id").alias("_p"), F.col("at").alias("_at"), "places")
    joined = unmarked.join(places, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("at") == F.col("_at")), "left").select("page_id", "url", "others", "places")
    return marked.unionByName(joined.mapInArrow(_unique_runs, "page_id bigint, url string, text string, n_removed bigint"))
