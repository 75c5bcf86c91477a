"""HTML as a tree: a table of its nodes, and questions scraped by their place in it.

The tree is built with a stack from ``html.parser`` events in one pass over a page, in Arrow
batches.  Nodes are numbered in document order, so a node's descendants are the numbers
up to its ``last``: every rule below is a comparison of numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without an end tag, and those whose content is no text of the page.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
NO_TEXT = frozenset({"script", "style", "template"})
NODES = "page_id long, node int, parent int, last int, depth int, tag string, classes array<string>, href string, text string"
QUESTIONS = "page_id long, pos int, question string, link string, options array<string>, correct_option string, correct_index int, submitted_by string"
#: Ancestors that are searched for the block of a title, before the next block in the page counts.
CLIMB = 6
_OPTION = re.compile(r"[A-D][.)]\s*")


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class Tree(HTMLParser):
    """Columns of the nodes of a page; a text is a node of tag ``#text``.

    An end tag closes the nearest open element of its name and all inside it; one that
    closes nothing is ignored; what is open at the end closes there.
    """

    def __init__(self, html: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.depth: list[int] = []
        self.classes: list[list[str]] = []
        self.href: list[str | None] = []
        self.text: list[str | None] = []
        self.open: list[int] = []
        self.names: dict[str, int] = {}  # open elements of each name
        self.feed(html or "")
        self.close()
        while self.open:
            self._shut()

    def _add(self, tag: str, classes: list[str], href: str | None, text: str | None) -> None:
        self.parent.append(self.open[-1] if self.open else -1)
        self.depth.append(len(self.open))
        self.last.append(len(self.tag))
        self.tag.append(tag)
        self.classes.append(classes)
        self.href.append(href)
        self.text.append(text)

    def _shut(self) -> None:
        node = self.open.pop()
        self.last[node] = len(self.tag) - 1
        self.names[self.tag[node]] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = dict(attrs)
        self._add(tag, (found.get("class") or "").split(), found["href"] or "" if "href" in found else None, None)
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)
            self.names[tag] = self.names.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.names.get(tag):
            while self.tag[self.open[-1]] != tag:
                self._shut()
            self._shut()

    def handle_data(self, data: str) -> None:
        if not (self.open and self.tag[self.open[-1]] in NO_TEXT):
            self._add("#text", [], None, data)

    def inside(self, node: int, tag: str, cls: str | None = None) -> Iterator[int]:
        """Descendants of a tag (and class), in order."""
        return (n for n in range(node + 1, self.last[node] + 1) if self.tag[n] == tag and (cls is None or cls in self.classes[n]))

    def texts(self, node: int) -> list[str]:
        return [t for n in range(node, self.last[node] + 1) if (t := (self.text[n] or "").strip())]

    def questions(self, title: str = "is-title", block: str = "excerpt") -> Iterator[tuple]:
        """(question, link, options, correct_option, correct_index, submitted_by) of each
        ``h2`` of class ``title`` with a link and a block of options."""
        blocks = [n for n, t in enumerate(self.tag) if t == "div" and block in self.classes[n]]
        for n, tag in enumerate(self.tag):
            if tag != "h2" or title not in self.classes[n]:
                continue
            a = next((x for x in self.inside(n, "a") if self.href[x] is not None), None)
            found = None if a is None else self._block_of(n, blocks)
            if found is None:
                continue
            question, options, right, by = _clean(" ".join(self.texts(a))), [], None, None
            for line in (x for t in self.texts(found) for x in map(_clean, t.split("\n")) if x):
                if m := _OPTION.match(line):
                    options.append(line[m.end() :].strip())
                elif line.lower().startswith("submitted by:"):
                    by = _clean(line.split(":", 1)[1])
            for s in self.inside(found, "strong"):
                bold = _clean(" ".join(self.texts(s)))
                if (m := _OPTION.match(bold)) and bold[m.end() :].strip() in options:
                    right = bold[m.end() :].strip()
                    break
            if question and options:
                yield question, self.href[a], options, right, None if right is None else options.index(right), by

    def _block_of(self, node: int, blocks: list[int]) -> int | None:
        """The first block inside the nearest of ``CLIMB`` ancestors that has one, else the
        next one in the page."""
        up = self.parent[node]
        for _ in range(CLIMB):
            if up < 0:
                up = None
            lo = 0 if up is None else bisect_right(blocks, up)
            if lo < len(blocks) and (up is None or blocks[lo] <= self.last[up]):
                return blocks[lo]
            if up is None:
                break
            up = self.parent[up]
        at = bisect_right(blocks, node)
        return blocks[at] if at < len(blocks) else None


def _mapped(pages: DataFrame, schema: str, rows: Iterable) -> DataFrame:
    names = [f.split(" ", 1)[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[f.split(" ", 1)[1]] for f in schema.split(", ")]
        for batch in batches:
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(rows(Tree(html)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([page_id] * len(found), pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds[1:], strict=True))], names)

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, schema)


def nodes(pages: DataFrame) -> DataFrame:
    """The nodes (``NODES``) of each page, numbered from 0 in document order.

    ``parent`` of a topmost node is -1; ``last`` is its last descendant's number (its own if
    it has none).  Scripts, styles and comments give no text.  A null or empty page has no
    node; repeated rows give repeated results.  A page is held by one task.
    """
    return _mapped(pages, NODES, lambda t: zip(range(len(t.tag)), t.parent, t.last, t.depth, t.tag, t.classes, t.href, t.text, strict=True))


def titled_questions(pages: DataFrame, title: str = "is-title", block: str = "excerpt") -> DataFrame:
    """Questions (``QUESTIONS``) of pages that give each as a linked title and a block.

    The block is the first ``div`` of class ``block`` in the nearest ancestor of the title
    that has one, else the next one in the page.  Its lines ``A.`` to ``D.`` (or with a
    bracket) are the options, the first bold one is the answer, ``Submitted by:`` names the
    author.  Titles without a link, a block or an option give no row.
    """
    return _mapped(pages, QUESTIONS, lambda t: ((i, *q) for i, q in enumerate(t.questions(title, block))))
