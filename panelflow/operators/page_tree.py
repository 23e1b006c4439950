"""Image-bearing elements of pages, walked as a tree.

One pass over a page's tags keeps the stack of open elements with what they hand down: a hidden or transparent ancestor,
inert content, the style rules in force. Only rows with raw attributes leave the walk; addresses are resolved by
column expressions (:mod:`panelflow.operators.pages`). A page is one row and is walked by one task in time proportional to its tags.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame

NAMES = ("src", "data-src", "data-original", "data-lazy-src", "srcset", "data-srcset", "width", "height")
# a tag ends at the first > outside a quoted value, else with the page; possessive, so that no character is read twice
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-z][a-z0-9-]*+)(?P<rest>(?:[\s/](?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|[="'])*+)?+)(?P<stop>>|\Z)""",
    re.I | re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DECLARATION = re.compile(r"""([\w-]+)\s*:\s*((?:"[^"]*"|'[^']*'|\([^)]*\)|[^;"'(])*)""")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_SELECTOR = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)(?:::?(before|after))?", re.I)
_STYLED = re.compile(r"<!--.*?(?:-->|\Z)|<template\b[^>]*>|<(script|style|textarea|title|noscript)\b[^>]*>", re.I | re.S)
_TEMPLATE = re.compile(r"<(/?)template\b[^>]*>", re.I)
# Fixed values of the markup language: elements without content, with plain text inside, and those that end others left open.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, **{b: {"p"} for b in _BLOCKS}}


@dataclass(frozen=True)
class Rule:
    """A compound selector (no combinators) and its declarations."""

    name: str
    marks: frozenset[str]
    pseudo: str
    weight: tuple[int, int, int]
    style: dict[str, str]

    def fits(self, name: str, marks: set[str]) -> bool:
        return self.name in ("", "*", name) and self.marks <= marks


def declarations(css: str) -> dict[str, str]:
    """Property -> value, the last of each; ``background`` also sets the picture."""
    found = {}
    for name, value in _DECLARATION.findall(css):
        found["background-image" if name.lower() == "background" else name.lower()] = value.strip()
    return found


def _blocks(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, body) of the rules outside at-rules, which are left out with all they hold."""
    at, css = 0, _COMMENT.sub("", css)
    while (opened := css.find("{", at)) >= 0:
        head = css[at:opened]
        head = head[head.rfind(";") + 1:].strip()
        depth, close = 1, opened + 1
        for brace in re.finditer(r"[{}]", css[opened + 1:]):
            depth += 1 if brace.group() == "{" else -1
            if not depth:
                close = opened + 1 + brace.start()
                break
        else:
            close = len(css)
        if not head.startswith("@"):
            yield head, css[opened + 1:close]
        at = close + 1


def rules(css: str) -> list[Rule]:
    """Rules with tag, class and id selectors; other selectors fit nothing here."""
    found = []
    for heads, body in _blocks(css):
        style = declarations(body)
        for head in heads.split(","):
            match = _SELECTOR.fullmatch(head.strip())
            if match and head.strip():
                name, marks = (match[1] or "").lower(), re.findall(r"[.#][\w-]+", match[2])
                ids = sum(m[0] == "#" for m in marks)
                found.append(Rule(name, frozenset(marks), (match[3] or "").lower(), (ids, len(marks) - ids, int(name not in ("", "*"))), style))
    return found


class Sheet:
    """The rules of one root, found by the id, class or tag that an element must have for them."""

    def __init__(self, found: Iterable[Rule] = ()):
        self.by_mark: dict[str, list[tuple[int, Rule]]] = {}
        for order, rule in enumerate(sorted(found, key=lambda r: r.weight)):  # later ones of equal weight stay behind
            self.by_mark.setdefault(min(rule.marks, default=rule.name or "*"), []).append((order, rule))

    def styles(self, name: str, given: dict[str, str]) -> tuple[dict, dict, dict]:
        """The declarations in force for an element, and for what is put before and after it."""
        found: dict[str, dict] = {"": {}, "before": {}, "after": {}}
        if self.by_mark:
            marks = {f".{c}" for c in given.get("class", "").split()} | ({f"#{given['id']}"} if given.get("id") else set())
            near = [r for mark in (*marks, name, "*") for r in self.by_mark.get(mark, ())]
            for _, rule in sorted(near, key=lambda r: r[0]):
                if rule.fits(name, marks):
                    found[rule.pseudo] |= rule.style
        if given.get("style"):
            found[""] |= declarations(given["style"])
        return found[""], found["before"], found["after"]


@dataclass(frozen=True)
class Open:
    """What an open element hands down."""

    name: str
    gone: bool = False
    visibility: str = "visible"
    opacity: float = 1.0
    inert: bool = False
    vector: bool = False
    sheet: Sheet = field(default_factory=Sheet)  # of its root


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def _share(text: str | None) -> float:
    match = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)(%?)\s*", text or "")
    return min(1.0, float(match[1]) / (100 if match[2] else 1)) if match else 1.0


def elements(page: str) -> Iterator[dict]:
    """Every element with a picture: element, place, attributes, background, display, visibility, opacity."""
    stack, open_names, at, place = [Open("", sheet=_sheet(page))], Counter(), 0, -1

    def close() -> str:
        name = stack.pop().name
        open_names[name] -= 1
        return name

    while match := _TOKEN.search(page, at):
        at = match.end()
        if not match["name"]:
            continue
        if not match["stop"]:
            break  # the page ends inside a tag, which then is none
        name = match["name"].lower()
        if match["end"]:
            while open_names[name] and close() != name:
                pass
            continue
        place += 1
        while stack[-1].name in ENDS.get(name, ()):
            close()
        if name in RAW:
            closed = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = closed.end() if closed else len(page)
            continue
        above, given = stack[-1], _attributes(match["rest"])
        own, before, after = above.sheet.styles(name, given)
        gone = above.gone or "hidden" in given or own.get("display", "").lower() == "none"
        visibility = own.get("visibility", above.visibility).lower()
        opacity = above.opacity * _share(own.get("opacity"))
        background = next((s["background-image"] for s in (own, before, after) if "url(" in s.get("background-image", "").lower()), None)
        if not above.inert and not above.vector and (name in ("img", "canvas", "svg") or background and name not in ("html", "body")):
            yield {"position": place, "element": name, **{n: given.get(n) for n in NAMES}, "background": background,
                   "visibility": visibility, "display": "none" if gone else own.get("display", "inline").lower(), "opacity": opacity}
        vector = above.vector or name == "svg"
        if name in VOID or vector and match["rest"].endswith("/"):
            continue
        made = replace(above, name=name, gone=gone, visibility=visibility, opacity=opacity, vector=vector)
        if name == "template":
            shadow = "shadowrootmode" in given and not above.inert  # a root of its own: the page's rules end here, its own begin
            made = replace(made, inert=not shadow, sheet=_sheet(page[at:_closing(page, at)]) if shadow else Sheet())
        stack.append(made)
        open_names[name] += 1


def _closing(page: str, at: int) -> int:
    """Where the template that was opened before ``at`` ends."""
    depth = 1
    for match in _TEMPLATE.finditer(page, at):
        depth += -1 if match[1] else 1
        if not depth:
            return match.start()
    return len(page)


def _sheet(page: str) -> Sheet:
    """The rules of all style elements of this root, those of templates inside left out."""
    found, at = [], 0
    while match := _STYLED.search(page, at):
        at = match.end()
        if match[0].lower().startswith("<template"):
            at = _closing(page, at)
        elif match[1]:
            closed = re.compile(rf"</{match[1]}\s*>", re.I).search(page, at)
            if match[1].lower() == "style":
                found += rules(page[at:closed.start() if closed else len(page)])
            at = closed.end() if closed else len(page)
    return Sheet(found)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"position": pa.int64(), "opacity": pa.float64()}
    names = ("position", "element", *NAMES, "background", "visibility", "display", "opacity")
    for batch in batches:
        for row in range(batch.num_rows):
            found = list(elements(batch.column("html")[row].as_py() or ""))
            if found:
                at = pa.array([row] * len(found))
                yield pa.RecordBatch.from_pydict({n: batch.column(n).take(at) for n in ("page_id", "url")} | {
                    n.replace("-", "_"): pa.array([f[n] for f in found], kinds.get(n, pa.string())) for n in names})


def page_elements(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> one row per image-bearing element with its raw attributes and what it is shown with.

    Elements are img, canvas, svg and anything but html and body with a background picture, by its own style, the page's rules
    (tag, class and id selectors, also for what is put before or after an element). Comments, scripts, form texts and
    templates hold no elements; a template that declares a shadow root does, under its own rules. ``display`` is none inside a
    hidden element, ``visibility`` comes from the nearest element that sets it, ``opacity`` is the product of all above.
    """
    raw = ", ".join(f"{n.replace('-', '_')} string" for n in NAMES)
    return pages.select("page_id", "url", "html").mapInArrow(
        _walk, f"page_id {dict(pages.dtypes)['page_id']}, url string, position bigint, element string, {raw}, background string, "
        "visibility string, display string, opacity double")
