"""Fields of HTML pages by cascades of CSS selectors, in one Arrow pass over a table.

A page is read once as a stream of tags, text and comments. A stack holds the open elements, and each of them the places that
every selector has reached when its steps are read as an automaton from the outside in: a tag moves its parent's places on,
and where a last step is reached, the element is a match. No tree is built. What a selector collects is the text of its
first match, of all its matches, or an attribute of the first.

End tags close all open elements inside the one they name, and are passed over where none is open; void elements hold nothing;
the page's end closes the rest. Text of script and style elements, and of comments, belongs to no element.
"""

from __future__ import annotations

import re
from contextlib import suppress
from dataclasses import dataclass
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without an end tag (fixed values).
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
#: Elements that are no content of a page (fixed values).
NOISE = ["script", "style", "noscript", "svg", "iframe", "form", "nav", "footer", "header", "aside"]
#: Elements whose text is no text of the page.
SILENT = ["script", "style", "template"]
#: The selector of the whole page.
PAGE = ":page"
#: Where a page's main content is, the first that is there (fixed values).
MAIN = ["main", "article", "section", "div[role=main]", "body", PAGE]
_REFERENCE = re.compile(r"&(?:#\d+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?")
_STEP = re.compile(r"""\s*(>?)\s*([\w*-]+)?((?:\#[\w-]+|\.[\w-]+|\[[^\]]*\])*)""")
_PART = re.compile(r"""\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~]?=)\s*["']?([^"'\]]*)["']?\s*)?\]""")


@dataclass(frozen=True)
class Field:
    """name; selectors in the order they are tried; kind; attribute: which one; separator: stands between pieces of text.

    text is the first match's of the first selector where that isn't empty, element the same even if it is empty, texts those of
    all matches of the first selector that has some, attribute the first match's, where it isn't empty.
    """

    name: str
    selectors: tuple[str, ...]
    kind: str = "text"
    attribute: str = ""
    separator: str = ""


def compile_selector(selector: str) -> list[tuple]:
    """Steps (child of the step before, tag or None, conditions) of a selector: tag, #id, .class, [attribute], also with = *=
    ^= $= and ~=, one inside another or directly in it (>). PAGE, the whole page, has no steps."""
    steps, at = [], 0
    selector = selector.strip()
    if selector == PAGE:
        return []
    while at < len(selector):
        m = _STEP.match(selector, at)
        if m.end() == at or not (m[2] or m[3]):
            raise ValueError(f"unknown selector: {selector}")
        tests = [("id", "=", p[1]) if p[1] else ("class", "~=", p[2]) if p[2] else (p[3].lower(), p[4] or "", p[5] or "") for p in _PART.finditer(m[3])]
        steps.append((bool(m[1]), None if m[2] in (None, "*") else m[2].lower(), tests))
        at = m.end()
    if not steps:
        raise ValueError("empty selector")
    return steps


def fits(step: tuple, tag: str, attributes: dict) -> bool:
    _, wanted, tests = step
    if wanted is not None and wanted != tag:
        return False
    for name, how, value in tests:
        have = attributes.get(name)
        if have is None:
            return False
        if not {"": True, "=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value), "~=": value in have.split()}[how]:
            return False
    return True


class _Reader(HTMLParser):
    """Matches of the selectors of one page: per selector a list of [attributes, pieces of text], in the order of their tags."""

    def __init__(self, automata: list[list[tuple]], firsts: list[bool], skipped: frozenset):
        super().__init__(convert_charrefs=True)
        self.automata, self.firsts, self.skipped = automata, firsts, skipped
        self.matches: list[list] = [[] if steps else [[{}, []]] for steps in automata]
        # An open element: its tag, and for each selector the steps reached at it, and at it or above; its matches; whether
        # it is skipped, or its text is none.
        self.open: list[tuple] = [("", [({0}, {0}) for _ in automata], [], False)]
        self.collecting: list[list] = [m for found in self.matches for m in found]
        self.muted = 0
        self.text: list[str] = []

    def flush(self) -> None:
        piece, self.text = "".join(self.text).strip(), []
        if piece and not self.muted:
            for match in self.collecting:
                match[1].append(piece)

    def handle_starttag(self, tag, attrs):
        self.flush()
        attributes = {name: value or "" for name, value in attrs}
        above, places, own = self.open[-1][1], [], []
        skipped = tag in self.skipped or above is None
        if not skipped:
            for k, steps in enumerate(self.automata):
                here, over = above[k]
                reached = {i + 1 for i in over if i < len(steps) and (i in here or not steps[i][0]) and fits(steps[i], tag, attributes)}
                if steps and len(steps) in reached and not (self.firsts[k] and self.matches[k]):
                    own.append([attributes, []])
                    self.matches[k].append(own[-1])
                places.append((reached, over | reached))
        if tag not in VOID:
            mute = skipped or tag in SILENT
            self.open.append((tag, None if skipped else places, own, mute))
            self.collecting += own
            self.muted += mute

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if not any(tag == e[0] for e in self.open[1:]):
            return
        while True:
            closed, _, own, mute = self.open.pop()
            self.muted -= mute
            del self.collecting[len(self.collecting) - len(own) :]  # those of the innermost element are the last
            if closed == tag:
                return

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def with_ended_references(page: str) -> str:
    """A page whose ampersands that begin no known reference ended by a semicolon stand for themselves."""
    return _REFERENCE.sub(lambda m: m[0] if m[0] != "&" and (m[1] is None or m[1] in html5) else "&amp;" + m[0][1:], page)


class Extractor:
    """The fields' values of one page after another."""

    def __init__(self, fields: list[Field], skipped: list[str] = (), ended: bool = False):
        self.fields, self.ended = fields, ended
        self.plan, self.automata, self.firsts = [], [], []
        for f in fields:
            self.plan.append(range(len(self.automata), len(self.automata) + len(f.selectors)))
            self.automata += [compile_selector(s) for s in f.selectors]
            self.firsts += [f.kind != "texts"] * len(f.selectors)
        self.skipped = frozenset(skipped)

    def __call__(self, page: str | None) -> list:
        reader = _Reader(self.automata, self.firsts, self.skipped)
        with suppress(AssertionError):  # a broken marked section: what stands before it counts
            reader.feed(with_ended_references(page or "") if self.ended else page or "")
            reader.close()
        reader.flush()
        return [self.value(f, [reader.matches[k] for k in at]) for f, at in zip(self.fields, self.plan, strict=True)]

    @staticmethod
    def value(field: Field, cascade: list[list]):
        for matches in cascade:
            if field.kind == "texts":
                if matches:
                    return [t for m in matches if (t := field.separator.join(m[1]))]
            elif field.kind == "element":
                if matches:
                    return field.separator.join(matches[0][1])
            elif matches and (found := matches[0][0].get(field.attribute, "") if field.kind == "attribute" else field.separator.join(matches[0][1])):
                return found
        return [] if field.kind == "texts" else ""


def extract_fields(pages: DataFrame, fields: list[Field], html: str = "html", skipped: list[str] = (), ended: bool = False) -> DataFrame:
    """pages without html, and a column for each field: a string, or an array of strings for texts; "" or [] where no selector matches.

    Text is stripped and joined by the field's separator. Nothing inside the elements skipped is seen. Null pages are empty.
    ended: only references that a semicolon ends stand for their signs, so that "&amp" of a cut text stays as it is; else those
    that HTML knows without one, too.
    """
    kept = [f for f in pages.schema.fields if f.name != html and f.name not in {x.name for x in fields}]
    kinds = {f.name: T.ArrayType(T.StringType()) if f.kind == "texts" else T.StringType() for f in fields}
    arrow = [pa.list_(pa.string()) if f.kind == "texts" else pa.string() for f in fields]

    def extracted(batches):
        extractor = Extractor(fields, skipped, ended)
        for batch in batches:
            values = [extractor(p) for p in batch.column(len(kept)).to_pylist()]
            columns = zip(*values, strict=True) if values else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c, k) for c, k in zip(columns, arrow, strict=True))], [*(f.name for f in kept), *kinds])

    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in kinds.items())])
    return pages.select(*[f.name for f in kept], F.col(html).alias("_html")).mapInArrow(extracted, schema)


def main_text(pages: DataFrame, html: str = "html", out: str = "text", ended: bool = False) -> DataFrame:
    """pages with the text of the main element instead of html, a line for each piece, without noise elements; ended as above."""
    found = extract_fields(pages, [Field(out, tuple(MAIN), "element", separator="\n")], html, NOISE, ended)
    return found.withColumn(out, F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n"))


def page_title(pages: DataFrame, html: str = "html", out: str = "title") -> DataFrame:
    """pages with the title instead of html: that of the title element, else the first heading."""
    return extract_fields(pages, [Field(out, ("title", "h1"))], html)
