"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, and a block renderer.

One pass over a page's source builds a tree; a second one over the tree writes its text with the spacing of blocks,
list markers and tables whose columns are aligned. Both walk with a stack of their own, so depth costs memory only,
and both take time in proportion to the page. Pages are independent, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object video audio canvas svg math datalist area map".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure fieldset".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body div article section header footer nav aside main address form li dt dd hr details summary dialog figcaption legend center tr caption optgroup option search".split())
#: Opening the first closes an open one of the second, unless one of the third is in between.
_CELLS = frozenset("table template".split())
_SCOPE = frozenset("table td th caption button template".split())
IMPLIED = {
    **{t: (frozenset(["p"]), _SCOPE) for t in BLOCKS - {"html", "body", "tr", "caption", "option", "optgroup", "li", "dt", "dd"}},
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu table".split())),
    "dt": (frozenset("dt dd p".split()), frozenset("dl table".split())), "dd": (frozenset("dt dd p".split()), frozenset("dl table".split())),
    "tr": (frozenset("tr td th caption colgroup p".split()), _CELLS), "td": (frozenset("td th caption p".split()), _CELLS | {"tr"}),
    "th": (frozenset("td th caption p".split()), _CELLS | {"tr"}),
    **{t: (frozenset("thead tbody tfoot tr td th caption colgroup p".split()), _CELLS) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WIDEST = 60  # cells wider than this do not widen their column
NESTED = 6  # tables inside tables beyond this depth are written as plain blocks
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s=/>][^\s=/>]*+)(?:\s*+(=)\s*+)?")
_BARE = re.compile(r"[^\s>]*+")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)


class Node:
    """An element; ``parts`` are texts and elements in order."""

    __slots__ = ("tag", "attributes", "parts")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.parts = tag, attributes or {}, []

    def hidden(self) -> bool:
        known = self.attributes
        return (
            self.tag in UNSEEN or "hidden" in known or bool(known.get("style") and _HIDDEN.search(known["style"]))
            or self.tag == "dialog" and "open" not in known or self.tag == "input" and known.get("type", "text").lower() not in ("submit", "button", "reset"))


class _Builder:
    def __init__(self, source: str):
        self.source, self.root = source, Node("#root")
        self.stack, self.open = [self.root], {}
        self.no_quote: set[str] = set()  # quotes of which none is left

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Those of a tag, and where the tag ends."""
        source, found = self.source, {}
        while True:
            match = _ATTRIBUTE.match(source, at)
            if not match:
                break
            name, at, value = match[1].lower(), match.end(), ""
            if match[2]:
                quote = source[at:at + 1]
                end = source.find(quote, at + 1) if quote in ("'", '"') and quote not in self.no_quote else -1
                if end >= 0:
                    value, at = source[at + 1:end], end + 1
                else:
                    if quote in ("'", '"'):
                        self.no_quote.add(quote)
                    bare = _BARE.match(source, at)
                    value, at = bare[0], bare.end()
            found.setdefault(name, html.unescape(value))
        end = source.find(">", at)
        return found, len(source) if end < 0 else end + 1

    def push(self, node: Node) -> None:
        self.stack[-1].parts.append(node)
        self.stack.append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def pop(self, size: int) -> None:
        while len(self.stack) > max(size, 1):
            self.open[self.stack.pop().tag] -= 1

    def close_implied(self, tag: str) -> None:
        closed, scope = IMPLIED.get(tag, (frozenset(), frozenset()))
        left, cut = sum(self.open.get(t, 0) for t in closed), None
        for place in range(len(self.stack) - 1, 0, -1):
            if not left or self.stack[place].tag in scope:
                break
            if self.stack[place].tag in closed:
                cut, left = place, left - 1
        if cut is not None:
            self.pop(cut)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self.close_implied(tag)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop(len(self.stack) - 1)
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.push(Node("tr"))
        if tag in VOID:
            self.stack[-1].parts.append(Node(tag, attributes))
        else:
            self.push(Node(tag, attributes))

    def end(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].parts.append(Node("br"))
        elif tag == "p" and not self.open.get("p"):
            self.stack[-1].parts.append(Node("p"))
        elif self.open.get(tag) and tag not in ("html", "body"):
            barrier = () if tag in ("table", "template") else ("table", "template") if tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else _SCOPE
            for place in range(len(self.stack) - 1, 0, -1):
                if self.stack[place].tag == tag:
                    self.pop(place)
                    return
                if self.stack[place].tag in barrier:
                    return

    def build(self) -> Node:
        source, at = self.source, 0
        while at < len(source):
            tag_at = source.find("<", at)
            if tag_at < 0:
                tag_at = len(source)
            if tag_at > at:
                self.stack[-1].parts.append(html.unescape(source[at:tag_at]))
            at = tag_at
            if at >= len(source):
                break
            closing = source.startswith("</", at)
            name = _NAME.match(source, at + 1 + closing)
            if name:
                tag = name[0].lower()
                known, at = self.attributes(name.end())
                if closing:
                    self.end(tag)
                    continue
                self.start(tag, known)
                if tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at) if tag != "plaintext" else None
                    stop = close.start() if close else len(source)
                    text = source[at:stop]
                    self.stack[-1].parts.append(html.unescape(text) if tag in ("textarea", "title") else text)
                    self.pop(len(self.stack) - 1)
                    at = len(source) if not close else self.attributes(close.end())[1]
            elif source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                at = len(source) if end < 0 else end + 3
            elif closing or source[at + 1:at + 2] in ("!", "?"):
                end = source.find(">", at)
                at = len(source) if end < 0 else end + 1
            else:
                self.stack[-1].parts.append("<")
                at += 1
        return self.root


class _Page:
    """Lines as they are written: inline text flows, blocks ask for a new line or an empty one."""

    def __init__(self):
        self.lines, self.now, self.gap, self.indent, self.marker = [], [], 0, 0, ""
        self.space = self.any = False

    def text(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        if not words:
            return
        self.begin()
        if self.space and self.now and self.any:
            self.now.append(" ")
        self.space = words.endswith(" ")
        self.now.append(words[:-1] if self.space else words)
        self.any = True

    def begin(self) -> None:
        if self.now:
            return
        if self.lines and self.gap > 1:
            self.lines.append("")
        self.gap = 0
        lead = " " * self.indent
        if self.marker:
            lead, self.marker = lead[:max(0, self.indent - len(self.marker))] + self.marker, ""
        self.now.append(lead)
        self.any = False

    def line(self, gap: int = 1) -> None:
        """End the line; the next one comes after ``gap`` - 1 empty lines."""
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.gap, self.space = max(self.gap, gap), False

    def literal(self, text: str) -> None:
        for place, part in enumerate(text.split("\n")):
            if place:
                if self.now:
                    self.line()
                else:
                    self.lines.append("")
            if part:
                self.begin()
                self.now.append(part.rstrip("\r"))
                self.any = True

    def done(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def _table(table: Node, depth: int) -> list[str]:
    """The rows of a table, its cells aligned in columns."""
    rows, captions, todo = [], [], [*reversed(table.parts)]
    while todo:
        part = todo.pop()
        if isinstance(part, Node) and not part.hidden():
            if part.tag == "tr":
                rows.append([c for c in part.parts if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden()])
                stray = [c for c in part.parts if not (isinstance(c, Node) and c.tag in ("td", "th"))]
            elif part.tag in ("thead", "tbody", "tfoot"):
                todo += reversed(part.parts)
                continue
            else:
                stray = [part]
        else:
            stray = [part] if isinstance(part, str) else []
        if stray:  # captions, and what does not belong into a table, stand above it
            holder = Node("#root")
            holder.parts = stray
            captions += [x for x in render(holder, depth).split("\n") if x]
    grid, widths, taken = [], [], {}
    for r, row in enumerate(rows):
        column, line = 0, []
        for cell in row:
            while taken.get(column, 0) > r:
                column += 1
            span, down = (max(1, min(int(v), 1000)) if (v := cell.attributes.get(k, "")).isdecimal() and len(v) < 6 else 1 for k in ("colspan", "rowspan"))
            content = render(cell, depth).split("\n")
            line.append((column, content))
            widths += [0] * (column + 1 - len(widths))
            if span == 1:
                widths[column] = max([widths[column], *(len(x) for x in content if len(x) <= WIDEST)])
            for c in range(column, column + span):
                taken[c] = r + down
            column += span
        grid.append(line)
    starts = [0]
    for width in widths:
        starts.append(starts[-1] + width + 2)
    made = []
    for line in grid:
        for place in range(max((len(content) for _, content in line), default=0)):
            text = ""
            for column, content in line:
                if place < len(content) and content[place]:
                    text = text.ljust(max(starts[column], len(text) + 2 if text else 0)) + content[place]
            made.append(text.rstrip())
    return [*captions, *(x for x in made if x)]


def render(root: Node, depth: int = 0) -> str:
    """The visible text below ``root``."""
    page, lists = _Page(), []
    todo: list[tuple[str, object]] = [("in", p) for p in reversed(root.parts)]
    pre = 1 if root.tag in ("pre", "textarea") else 0
    while todo:
        what, part = todo.pop()
        if what == "out":
            node: Node = part  # type: ignore[assignment]
            if node.tag in ("ul", "ol", "menu") and lists:
                lists.pop()
            if node.tag in ("li", "dd", "blockquote"):
                page.line()
                page.indent -= 3 if node.tag == "li" else 2
                page.marker = ""
            if node.tag in ("pre", "textarea"):
                pre -= 1
            if node.tag in BLOCKS:
                page.line(1 if node.tag not in PARAGRAPHS or (lists and node.tag in ("ul", "ol", "menu")) else 2)
            if node.tag == "button" or node.tag in ("td", "th"):
                page.text(" ")
            continue
        if isinstance(part, str):
            page.literal(part) if pre else page.text(part)
            continue
        node = part
        if node.hidden():
            continue
        tag = node.tag
        if tag == "br":
            page.begin()
            page.line()
            continue
        if tag == "hr":
            page.line(2)
            continue
        if tag == "input":
            page.text(f" {node.attributes.get('value', '')} ")
            continue
        if tag == "table" and depth < NESTED:
            page.line(2)
            for text in _table(node, depth + 1):
                page.begin()
                page.now.append(text)
                page.line()
            page.line(2)
            continue
        if tag in BLOCKS:
            page.line(1 if tag not in PARAGRAPHS or (lists and tag in ("ul", "ol", "menu")) else 2)
        if tag in ("ul", "ol", "menu"):
            start = node.attributes.get("start", "1")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif tag == "li":
            page.indent += 3
            numbered = lists and lists[-1][0]
            page.marker = f"{lists[-1][1]}. " if numbered else "-  "
            if numbered:
                lists[-1][1] += 1
        elif tag in ("dd", "blockquote"):
            page.indent += 2
        elif tag in ("pre", "textarea"):
            pre += 1
            if node.parts and isinstance(node.parts[0], str):
                node.parts[0] = node.parts[0].removeprefix("\n")
        elif tag in ("button", "td", "th"):
            page.text(" ")
        todo.append(("out", node))
        todo += [("in", p) for p in reversed(node.parts)]
    return page.done()


def html_text(source: str | None) -> str:
    """The visible text of one page; of null or empty source, empty."""
    return render(_Builder((source or "").replace("\r\n", "\n").replace("\x00", "�")).build())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sources = batch.column("source")
        texts = [html_text(sources[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "text": pa.array(texts, pa.string())})


def extract_text(pages: DataFrame, source: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id and text of every row. Null and empty sources give empty texts; repeated rows and null identifiers are
    extracted like any other, an empty table gives no rows, and other columns are not looked at."""
    return pages.select(F.col(page_id).alias("page_id"), F.col(source).alias("source")).mapInArrow(
        _extract, f"page_id {dict(pages.dtypes)[page_id]}, text string")
