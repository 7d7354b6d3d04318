"""A small HTML tree with CSS selectors, for use inside Spark tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import SparkSession

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag that ends an open one of these first.
ENDS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
BARRIERS = frozenset("ul ol table body article section div nav".split())
SILENT = frozenset(("script", "style"))


def small_batches(spark: SparkSession) -> None:
    """Sends pages to Python in batches of 4 MB where the session keeps the
    default of 64 MB, so that a worker holds few pages at a time, however many
    a task has. Plans run after they are made, so that the setting stays for the session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, "4m")


class Node:
    """An element; children are elements and strings in document order."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order, without recursion."""
        todo = self.elements[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(node.elements[::-1])

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None and node.tag != "#document":
            yield node
            node = node.parent

    def text(self) -> str:
        """Stripped pieces of text, put together without a separator."""
        out, todo = [], self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c.strip())
            elif c.tag not in SILENT:
                todo.extend(c.children[::-1])
        return "".join(out)

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def select(self, selector: str) -> list[Node]:
        return [n for n in self.walk() if matches(n, selector)]

    def first(self, selector: str) -> Node | None:
        return next((n for n in self.walk() if matches(n, selector)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = self.at
        while tag in ENDS and node.parent is not None and node.tag not in BARRIERS:
            if node.tag in ENDS[tag]:
                self.at = node.parent
            node = node.parent
        child = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; what cannot be read is left out, never an error."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"\*|[A-Za-z][\w-]*|\.[\w-]+|#[\w-]+|\[\s*[\w:-]+\s*(?:[~^$*|]?=\s*(?:\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]")
_ATTRIBUTE = re.compile(r"\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]")
_CACHE: dict[str, list] = {}


def compiled(selector: str) -> list[list[tuple[str, list[str]]]]:
    """Alternatives, each a list of (combinator, simple selectors); raises ValueError on what is not supported."""
    if selector not in _CACHE:
        if len(_CACHE) > 1000:
            _CACHE.clear()
        out = []
        for part in re.split(r",(?![^\[]*\])", selector):
            steps: list[tuple[str, list[str]]] = []
            combinator = " "
            for word in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", part.strip()):
                if word == ">":
                    combinator = ">"
                    continue
                simple = _SIMPLE.findall(word)
                if "".join(simple) != word:
                    raise ValueError(f"selector not supported: {selector!r}")
                steps.append((combinator, simple))
                combinator = " "
            if not steps or combinator == ">":
                raise ValueError(f"selector not supported: {selector!r}")
            out.append(steps)
        _CACHE[selector] = out
    return _CACHE[selector]


def _fits(node: Node, simple: list[str]) -> bool:
    for s in simple:
        if s[0] == ".":
            ok = s[1:] in node.attrs.get("class", "").split()
        elif s[0] == "#":
            ok = node.attrs.get("id") == s[1:]
        elif s[0] == "[":
            name, op, value = _ATTRIBUTE.fullmatch(s).groups()
            have, value = node.attrs.get(name), (value or "").strip("\"'")
            ok = have is not None and (
                not op or op == "=" and have == value or op == "^=" and have.startswith(value) or op == "$=" and have.endswith(value)
                or op == "*=" and value in have or op == "~=" and value in have.split() or op == "|=" and (have == value or have.startswith(f"{value}-"))
            )
        else:
            ok = s == "*" or node.tag == s.lower()
        if not ok:
            return False
    return True


def matches(node: Node, selector: str) -> bool:
    return any(_ends(node, steps) for steps in compiled(selector))


def _ends(node: Node, steps: list) -> bool:
    combinator, simple = steps[-1]
    if not _fits(node, simple):
        return False
    if len(steps) == 1:
        return True
    if combinator == ">":
        up = node.parent
        return up is not None and up.tag != "#document" and _ends(up, steps[:-1])
    return any(_ends(up, steps[:-1]) for up in node.above())
