"""Operator 9: main text of web pages by consensus paths of their hosts.

Every container of a page (article, div, section, ..) is scored by its own text, links and paragraphs.
A container's path generalises its ancestry to tags and classes with digits masked. Pages vote for
paths with their containers' shares of the page's score; votes are summed per host in Spark, and the
host's winning paths are what every page of the host is then extracted by.

Reading a page takes time and memory in proportion to its length, however it nests: no '<' is looked beyond the next
one, and a path names at most its last DEEP steps, behind a hash of those above, and each step at most LONG
characters. A tag with a '<' within its attributes is text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, saved

SHARE = 0.5
DEEP = 48
LONG = 200
_BROADCAST_BYTES = 32 << 20
_CONTAINERS = frozenset("html body main article section div td th ul ol dl nav header footer aside form table blockquote figure pre center".split())
_DULL = frozenset("nav header footer aside form".split())
_BREAKS = frozenset("p br h1 h2 h3 h4 h5 h6 li tr dt dd hr".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(script|style|noscript|template|title)\b[^<>]*>.*?(?:</\1\s*+>|$)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+)>""", re.S | re.I)
_CLASS = re.compile(r"""\bclass\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


class Container:
    __slots__ = ("step", "above", "tag", "parts", "links", "breaks", "dull", "parent")

    def __init__(self, step: str, tag: str, dull: bool, parent: Container | None = None) -> None:
        self.step, self.tag, self.dull, self.parent = step if len(step) <= LONG else f"{tag}.{_hash(step)}", tag, dull, parent
        self.above = _hash(f"{parent.above}>{self.step}") if parent is not None else ""  # of the whole ancestry
        self.parts: list[str | Container] = []
        self.links = self.breaks = 0

    @property
    def path(self) -> str:
        steps, at = [], self
        while at.parent is not None and len(steps) < DEEP:
            steps.append(at.step)
            at = at.parent
        return ">".join([*([f"#{at.above}"] if at.parent is not None else []), *reversed(steps)])

    def text(self) -> str:
        """Text of the container and of those within it, in document order, without menus and the like."""
        flat, rest = [], [iter(self.parts)]
        while rest:
            p = next(rest[-1], None)
            if p is None:
                rest.pop()
                flat.append("\n")
            elif isinstance(p, str):
                flat.append(p)
            elif not p.dull or self.dull:
                flat.append("\n")
                rest.append(iter(p.parts))
        whole = _BLANK.sub(" ", html.unescape("".join(flat)))
        return _LINES.sub("\n", whole).strip()

    def score(self) -> float:
        """Characters of its own text, less twice those in links, plus 20 for each break; nothing for menus and the like."""
        size = sum(len(p.strip()) for p in self.parts if isinstance(p, str))
        return 0.0 if self.dull or not size else max(0.0, size - 2.0 * self.links + 20.0 * min(self.breaks, size // 20))


def containers(page: str) -> list[Container]:
    """Containers with text of their own, in the order they open. End tags without a start are ignored, open
    elements end with their container, and text outside all containers belongs to a root of path ''."""
    root = Container("", "", False)
    out, stack, opened = [root], [root], Counter()
    at = anchor = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            stack[-1].parts.append(piece)
            if anchor:
                stack[-1].links += len(piece.strip())
        at = m.end()
        tag = (m[3] or "").lower()
        if tag in _CONTAINERS:
            anchor = 0
            if m[2]:
                while opened[tag]:
                    last = stack.pop().tag
                    opened[last] -= 1
                    if last == tag:
                        break
            else:
                found = _CLASS.search(m[4])
                names = sorted({_DIGITS.sub("#", c.lower()) for c in (found[1] or found[2] or found[3] or "").split()}) if found else []
                step = ".".join([tag, *names])
                own = Container(step, tag, stack[-1].dull or tag in _DULL, stack[-1])
                stack[-1].parts.append(own)
                if not m[4].rstrip().endswith("/"):
                    stack.append(own)
                    opened[tag] += 1
                out.append(own)
        elif tag == "a":
            anchor = 0 if m[2] else 1
        elif tag in _BREAKS:
            anchor = 0
            stack[-1].parts.append("\n")
            stack[-1].breaks += not m[2]
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return out


def _votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for host, page in zip(f["host"], f["html"]):
            if not page:
                continue
            by_path: Counter[str] = Counter()
            for c in containers(page):
                if (s := c.score()) > 0:
                    by_path[c.path] += s
            total = sum(by_path.values())
            rows += [(host, path, round(s / total * 1_000_000)) for path, s in by_path.items()]
        yield pd.DataFrame(rows, columns=["host", "path", "vote"])


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts, paths, agreed = [], [], []
        for page, winners in zip(f["html"], f["paths"]):
            found = containers(page) if page else []
            wanted = set(winners) if winners is not None else set()
            inside: set[int] = set()  # containers on a winning path, and all within them
            outer = []
            for c in found:
                if id(c.parent) in inside and not (c.dull and not c.parent.dull):
                    inside.add(id(c))
                elif wanted and c.path in wanted:
                    inside.add(id(c))
                    outer.append(c)
            chosen = [(c, t) for c in outer if (t := c.text())]
            agreed.append(bool(chosen))
            if not chosen:
                best = max(found, key=lambda c: c.score(), default=None)
                chosen = [(best, best.text())] if best is not None and best.score() > 0 else []
            texts.append(None if page is None else "\n".join(t for _, t in chosen))
            paths.append("|".join(dict.fromkeys(c.path for c, _ in chosen)))
        yield pd.DataFrame({"page_id": f["page_id"], "host": f["host"], "path": paths, "agreed": agreed, "text": texts})


def hosts(pages: DataFrame) -> DataFrame:
    """(page_id, host, html): the host is in lower case, without user and port, and '' where the url has none."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))


def winning_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the path with most votes on the host, of equals all, and those with at least `share` of its votes.

    pages is (page_id, url, html). Votes are summed per host and path before they are shuffled, so a host that holds
    most pages is as cheap as any. Null, empty and textless pages don't vote; pages without a usable url vote as
    host ''; repeated rows vote each; an empty table gives an empty table; other columns don't matter.
    """
    votes = hosts(pages).select("host", "html").mapInPandas(lean(_votes), "host string, path string, vote long").groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    best = votes.groupBy("host").agg(F.max("votes").alias("best"))
    return votes.join(best, "host").where(F.col("votes") >= F.col("best") * share).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def extracted(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(page_id, host, path, agreed, text) for every row of pages (page_id, url, html).

    text joins the page's containers on winning paths of its host, each with all that it holds but menus and the
    like, one block to a line; a page without any
    uses its own best container, of equals the first, and agreed is false. Null html gives null text, empty or textless html an
    empty text. Pages without a usable url vote together as host ''. Repeated rows vote and are extracted
    each; other columns don't matter; an empty table gives an empty table.
    """
    won = saved(winning_paths(pages, share))
    size = won.agg(F.sum(F.length("host") + F.aggregate("paths", F.lit(0), lambda a, p: a + F.length(p)))).first()[0] or 0
    small = F.broadcast(won) if size < _BROADCAST_BYTES else won  # few hosts: no page is shuffled; else by host, which AQE splits where one host has many pages
    return hosts(pages).join(small, "host", "left").select("page_id", "host", "html", "paths").mapInPandas(lean(_extract), "page_id long, host string, path string, agreed boolean, text string")
