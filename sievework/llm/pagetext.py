"""Main text of pages, by differencing a page with its neighbours by URL.

Pages of a host that stand next to each other by path are made from the same
template. Their text lines are aligned by longest common subsequence, and what
they share is the template's, not the article's. Markup takes part: elements
that say what they are (nav, footer, aside, form, hidden ones, names like
`cookie-notice`) are no article, and where the publisher names the article
(article, main), nothing outside of it is.

Shared lines are deleted, with two safeguards, since articles are copied and
quoted too. A neighbour that shares a page's longest line is a copy of it and
says nothing about the template, unless no other is near and enough remains.
Inside of a named article a line goes only if WITNESSES neighbours, all that
are compared, share it.

Only hashes of lines are sorted and compared. Pages get a global rank by host
and path, and neighbours meet in blocks of ranks that overlap by as many ranks
as a page looks at. So no host is gathered, however large.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_member, membership, saved, slices, small_batches
from .sharding import prefix_sums
from .urlrules import host_of, path_of

#: Ranks on either side among which a page looks for neighbours, and pages of a block of ranks.
AROUND, BLOCK = 10, 256
#: Neighbours that are compared, copies aside; all must share a line of a named article that goes.
WITNESSES = 8
#: Share of the text that must remain where only likely copies are near.
REMAINS = 0.1

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("head script style template noscript iframe svg canvas object audio video select textarea button title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements, roles and words of class and id that are never the article, and those that are not unless it is inside of them.
NEVER_TAGS, MAYBE_TAGS = frozenset("nav footer aside menu dialog".split()), frozenset("form header".split())
NEVER_ROLES = frozenset("navigation contentinfo complementary search menu menubar toolbar alert alertdialog dialog".split())
MAYBE_ROLES = frozenset("banner form".split())
NEVER_WORDS = frozenset("comment comments disqus reply replies respond related recommended recommendations teaser teasers outbrain taboola".split())
MAYBE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social widget"
    " widgets login search pagination pager skip copyright".split()
)
#: Where a block stands: in the article, of the page's frame, and in neither.
ARTICLE, FRAME, OUTSIDE = 0, 1, 2


@lru_cache(4096)
def _words(names: str) -> frozenset[str]:
    return frozenset(w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", names))


def _frame_of(tag: str, attrs: dict[str, str | None], inside: bool) -> int:
    """2: never the article, 1: not unless it is inside, 0: nothing says so."""
    style = (attrs.get("style") or "").replace(" ", "").lower()
    if tag in NEVER_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return 2
    role = (attrs.get("role") or "").lower()
    words = _words(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")
    if role in NEVER_ROLES or words & NEVER_WORDS:
        return 2
    if tag in ("html", "body", "main", "article"):
        return 0
    if role in MAYBE_ROLES or words & MAYBE_WORDS or tag == "form":
        return 1
    return int(not inside and (tag == "header" or "header" in words))


class _Reader(HTMLParser):
    """Blocks of a page: [text, frame, in article, in main]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool, bool, bool]] = []
        self.open: list[tuple[str, int, bool, bool, bool]] = []  # tag, frame, article, main, silent
        self.count: Counter[str] = Counter()
        self.now = ("", 0, False, False, False)
        self.kept: list[str] = []
        self.framed: list[str] = []

    def flush(self) -> None:
        for parts, frame in ((self.kept, False), (self.framed, True)):
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((text, frame, self.now[2], self.now[3]))
                parts.clear()

    def _pop(self, tag: str) -> None:
        while self.open:
            gone = self.open.pop()[0]
            self.count[gone] -= 1
            if gone == tag:
                break
        self.now = self.open[-1] if self.open else ("", 0, False, False, False)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
            if self.count["p"] and not self.now[4]:  # a block ends an open paragraph
                for at in reversed(self.open):
                    if at[0] == "p":
                        self._pop("p")
                        break
                    if at[0] in BLOCKS:
                        break
            if tag in ("li", "dt", "dd", "td", "th", "tr", "option") and self.now[0] == tag:
                self._pop(tag)
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        _, frame, article, main, silent = self.now
        named = tag == "article"
        body = tag == "main" or ("role", "main") in attrs
        if (named or body) and frame == 1:
            frame = 0
        frame = max(frame, _frame_of(tag, dict(attrs), article or main)) if attrs or tag in NEVER_TAGS or tag in MAYBE_TAGS else frame
        self.now = (tag, frame, article or named, main or body, silent or tag in SILENT)
        self.open.append(self.now)
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "iframe", "canvas", "object"):  # HTML ignores the slash elsewhere
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.count[tag]:
            self._pop(tag)

    def handle_data(self, data: str) -> None:
        if not self.now[4]:
            (self.framed if self.now[1] else self.kept).append(data)

    def unknown_decl(self, data: str) -> None:
        """A marked section holds no text of the page."""


_MARKED = re.compile(r"<!\[(?!CDATA\[)[^>]*>?")


def page_lines(html: str | None) -> tuple[list[str], list[int], bool]:
    """Text lines of a page in order, where each stands (ARTICLE, FRAME, OUTSIDE), and whether the publisher names the article."""
    reader = _Reader()
    reader.feed(_MARKED.sub("", html or ""))
    reader.close()
    reader.flush()
    blocks = reader.blocks
    column = next((c for c in (2, 3) if any(b[c] and not b[1] for b in blocks)), 0)  # articles, else main, else all
    place = [FRAME if b[1] else OUTSIDE if column and not b[column] else ARTICLE for b in blocks]
    return [b[0] for b in blocks], place, column > 0


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and b[:j], for each j.

    Bits of one integer hold a row of the table: a zero at j says that the
    length grows there, and a row follows from the one before by one addition.
    """
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = where.get(x, 0)
        row = (row + (row & hit) | row & ~hit) & full
    bits = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64))])


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Positions of a in a longest common subsequence with b, by halving a, so that memory stays linear."""
    both = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in both]
    todo, out = [(places, [y for y in b if y in both])], []
    while todo:
        at, ys = todo.pop()
        if not at or not ys:
            continue
        if len(at) == 1:
            if a[at[0]] in ys:
                out.append(at[0])
            continue
        xs, mid = [a[i] for i in at], len(at) // 2
        cut = int(np.argmax(_lengths(xs[:mid], ys) + _lengths(xs[mid:][::-1], ys[::-1])[::-1]))
        todo += [(at[:mid], ys[:cut]), (at[mid:], ys[cut:])]
    return sorted(out)


def shared_lines(page: dict, near: list[dict]) -> list[int]:
    """Positions of the lines that are the template's, given the page's neighbours on its host, nearest first."""
    lines, sizes, place = page["lines"], page["sizes"], page["place"]
    own = [i for i, p in enumerate(place) if p == ARTICLE]
    longest = max(own, key=lambda i: (sizes[i], -i), default=None)
    total = sum(sizes[i] for i in own)
    partner, copies, votes, witnesses = None, [], Counter(), 0
    for other in near:
        if witnesses == (WITNESSES if page["named"] else 1):
            break
        same = aligned(lines, other["lines"])
        if longest in same:
            copies.append((sum(sizes[i] for i in same if place[i] == ARTICLE), len(copies), same))
            continue
        partner = same if partner is None else partner
        witnesses += 1
        votes.update(same)
    if page["named"]:
        gone = {i for i in votes if votes[i] == WITNESSES}
        return sorted(gone | {i for i in partner or () if place[i] != ARTICLE})
    if partner is None and copies and total - min(copies)[0] >= REMAINS * total:
        partner = min(copies)[2]
    return partner or []


MEASURES = "key string, host string, path string, lines array<long>, sizes array<int>, place array<tinyint>, named boolean"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        rows = [page_lines(h) for h in batch.column("html").to_pylist()]
        hashes = [[xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t in r[0]] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("key", "host", "path")),
                pa.array(hashes, pa.list_(pa.int64())),
                pa.array([[len(t) for t in r[0]] for r in rows], pa.list_(pa.int32())),
                pa.array([r[1] for r in rows], pa.list_(pa.int8())),
                pa.array([r[2] for r in rows]),
            ],
            ["key", "host", "path", "lines", "sizes", "place", "named"],
        )


def _same_start(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gone) of each page that is at home in its block; rows come by block and rank."""

    def block(pages: list[dict]) -> pa.RecordBatch:
        out = []
        for i, page in enumerate(pages):
            if page["home"]:
                near = [j for j in range(max(0, i - AROUND), min(len(pages), i + AROUND + 1)) if pages[j]["key"] != page["key"] and pages[j]["host"] == page["host"]]
                near.sort(key=lambda j: (-_same_start(page["path"], pages[j]["path"]), abs(i - j), j))
                gone = shared_lines(page, [pages[j] for j in near])
                if gone:
                    out.append((page["key"], gone))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([g for _, g in out], pa.list_(pa.int32()))], ["key", "gone"])

    held: list[dict] = []
    for batch in batches:
        for row in (r for k in range(0, batch.num_rows, BLOCK) for r in batch.slice(k, BLOCK).to_pylist()):
            if held and held[0]["block"] != row["block"]:
                yield block(held)
                held = []
            held.append(row)
    if held:
        yield block(held)


def template_lines(pages: DataFrame) -> DataFrame:
    """(key, gone): positions of template lines, of pages (key, host, path, html)
    with a host; a page that is there several times is compared once."""
    measured = pages.where("host != ''").mapInArrow(_measured, MEASURES).dropDuplicates(["key"]).withColumn("one", F.lit(1))
    ranked = prefix_sums(measured, ["host", "path", "key"], "one")
    own = F.floor(F.col("number") / BLOCK)
    at, last = F.col("number") % BLOCK, F.floor((F.col("n_rows") - 1) / BLOCK)
    blocks = F.array_compact(F.array(own, F.when((at < AROUND) & (own > 0), own - 1), F.when((at >= BLOCK - AROUND) & (own < last), own + 1)))
    dealt = ranked.withColumn("own", own).withColumn("block", F.explode(blocks)).withColumn("home", F.col("block") == F.col("own"))
    dealt = dealt.select("key", "host", "path", "lines", "sizes", "place", "named", "number", "block", "home")
    return dealt.repartition("block").sortWithinPartitions("block", "number").mapInArrow(_differenced, "key string, gone array<int>")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "text", "n_chars", "n_lines", "n_frame", "n_outside", "n_shared"]
    for batch in slices(batches, "html"):
        columns: list[list] = [[] for _ in names[1:]]
        for html, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines, place, _ = page_lines(html)
            shared = set(gone or ())
            text = "\n".join(t for i, t in enumerate(lines) if place[i] == ARTICLE and i not in shared)
            for column, value in zip(columns, (text, len(text), len(lines), place.count(FRAME), place.count(OUTSIDE), len(shared)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names)


def _mark(key: Column) -> Column:
    return F.xxhash64(key)


def _sieved(words: np.ndarray, kept: bool):
    """Rows whose mark may be in a membership filter, or those whose is not."""

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_member(words, batch.column("mark").to_numpy().view(np.uint64)) == kept))

    return sieve


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_frame, n_outside, n_shared, a row a page.

    n_lines are the lines of the whole page; n_frame and n_outside those that
    markup leaves out, n_shared those that neighbours share and that are left
    out for it. Null and empty html have an empty text; a url that is null or
    has no host has no neighbours, so that markup alone decides. Repeated rows
    each get their text; an empty table gives an empty table.
    """
    small_batches(pages.sparkSession)
    key = F.concat(*[F.hex(F.xxhash64(F.lit(k), "page_id", "url", "html")) for k in (1, 2)])  # 128 bits
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    keyed = pages.select("page_id", "url", "html", key.alias("key"), host.alias("host"), path.alias("path"))
    gone = saved(template_lines(keyed.select("key", "host", "path", "html")))
    # few pages share lines that markup left: those alone are moved to be joined, found by a filter of bounded size
    words = membership(gone.select(_mark(F.col("key")).alias("mark")), "mark")
    given = keyed.select(F.struct("page_id", "url").alias("row"), "html", "key", _mark(F.col("key")).alias("mark"))
    some = given.mapInArrow(_sieved(words, True), given.schema).join(gone, "key", "left").select("row", "html", "gone")
    others = given.mapInArrow(_sieved(words, False), given.schema).select("row", "html", F.lit(None).cast("array<int>").alias("gone"))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    schema = f"row struct<page_id:{kinds['page_id']},url:{kinds['url']}>, text string, n_chars long, n_lines long, n_frame long, n_outside long, n_shared long"
    return others.unionByName(some).mapInArrow(_written, schema).select("row.*", "text", "n_chars", "n_lines", "n_frame", "n_outside", "n_shared")
