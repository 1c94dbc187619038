"""Selectors over a stream of tags, against a plain tree of the page."""

import os
import random
from html.parser import HTMLParser

import pytest

from millrace.functions import html as H

PAGES = os.path.join(os.environ.get("MILLRACE_SF", "/root/testdata/sf0.001"), "pages.parquet")


class Tree(HTMLParser):
    """Nodes [tag, attributes, children, parent]; text is a string, a comment None."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = ["", {}, [], None]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, [], self.at]
        self.at[2].append(node)
        if tag not in H.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in H.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        node[2].append(None)  # text before and after is not one piece, whether the tag is open or not
        while node[3] is not None and node[0] != tag:
            node = node[3]
        if node[3] is not None:
            self.at = node[3]

    def handle_data(self, data):
        node = self.at
        while node is not None:
            if node[0] in H.SILENT:
                return
            node = node[3]
        if self.at[2] and isinstance(self.at[2][-1], str):
            self.at[2][-1] += data
        else:
            self.at[2].append(data)

    def handle_comment(self, data):
        self.at[2].append(None)

    handle_decl = handle_pi = unknown_decl = handle_comment


def nodes(node, skipped=()):
    for child in node[2]:
        if isinstance(child, list) and child[0] not in skipped:
            yield child
            yield from nodes(child, skipped)


def pieces(node, skipped=()):
    for child in node[2]:
        if isinstance(child, str):
            if child.strip():
                yield child.strip()
        elif child is not None and child[0] not in skipped:
            yield from pieces(child, skipped)


def selected(root, selector, skipped=()):
    """Nodes in order, by looking at each node's ancestors."""
    if selector == H.PAGE:
        return [root]
    steps = H.compile_selector(selector)

    def holds(node, k):
        if not H.fits(steps[k], node[0], node[1]):
            return False
        if k == 0:
            return not steps[0][0] or node[3][3] is None
        above = node[3]
        while above[3] is not None:
            if holds(above, k - 1):
                return True
            if steps[k][0]:
                return False
            above = above[3]
        return False

    return [n for n in nodes(root, skipped) if holds(n, len(steps) - 1)]


def expected(page, field, skipped=()):
    root = Tree(page or "").root
    for s in field.selectors:
        found = selected(root, s, skipped)
        if field.kind == "texts":
            if found:
                return [t for n in found if (t := field.separator.join(pieces(n, skipped)))]
        elif field.kind == "element":
            if found:
                return field.separator.join(pieces(found[0], skipped))
        elif found and (value := found[0][1].get(field.attribute, "") if field.kind == "attribute" else field.separator.join(pieces(found[0], skipped))):
            return value
    return [] if field.kind == "texts" else ""


FIELDS = [
    H.Field("title", ("title", "h1")),
    H.Field("main", tuple(H.MAIN), "element", separator="\n"),
    H.Field("paragraphs", ("article > p", "p"), "texts"),
    H.Field("nested", ("p p b", "div.a > [x^=v] i", "li li"), "texts", separator="|"),
    H.Field("link", ("#k a[href$=t]", "a[href*='/']", "a[href]"), "attribute", "href"),
    H.Field("none", (".missing", "table[data-x=1] td")),
    H.Field("any", ("div > *",), "texts"),
]


def test_pages_agree_with_a_tree(spark):
    pages = [r.html for r in spark.read.parquet(PAGES).select("html").collect()]
    for skipped in ((), tuple(H.NOISE)):
        extractor = H.Extractor(FIELDS, list(skipped))
        for page in pages:
            assert extractor(page) == [expected(page, f, skipped) for f in FIELDS]


def broken_page(rng):
    tags = ["p", "b", "i", "div", "article", "li", "ul", "a", "nav", "script", "br", "main", "td", "table", "template"]
    out = []
    for _ in range(rng.randint(0, 40)):
        kind, tag = rng.random(), rng.choice(tags)
        if kind < 0.4:
            out.append(f"<{tag}" + rng.choice(["", " class='a b'", ' id="k"', " x=val", " href=/t", " href='u?a=1&amp;b'", " data-x=1", " x", " class=a x=v"]) + rng.choice([">", ">", "/>"]))
        elif kind < 0.7:
            out.append(f"</{tag}>")
        else:
            out.append(rng.choice(["text", " ", "a < b", "&amp;é", "<!-- c -->", "\n x \n", "<!DOCTYPE html>", "<?pi?>", "&#65;"]))
    return "".join(out)


def test_broken_pages_agree_with_a_tree():
    rng = random.Random(8)
    for _ in range(1500):
        page = broken_page(rng)
        for skipped in ((), ("nav", "ul")):
            assert H.Extractor(FIELDS, list(skipped))(page) == [expected(page, f, skipped) for f in FIELDS], page


def test_references_without_semicolon():
    page = "<title>a &amp b &lt;c&gt; &#65; &nosuch; &ampx; &amp</title><a href='?x=1&amp;y=2&copy=3'>"
    fields = [H.Field("t", ("title",)), H.Field("h", ("a",), "attribute", "href")]
    assert H.Extractor(fields, ended=True)(page) == ["a &amp b <c> A &nosuch; &ampx; &amp", "?x=1&y=2&copy=3"]
    assert H.Extractor(fields)(page)[0] == "a & b <c> A &nosuch; &x; &"


def test_columns_nulls_and_names(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<title>T</title><li>" + "x" * (1 << 20), "t"), (4, "<![odd[", "t")], "page_id long, html string, title string")
    got = H.extract_fields(df, [H.Field("title", ("title",)), H.Field("items", ("li",), "texts")]).orderBy("page_id").collect()
    assert [(r.page_id, r.title, [len(x) for x in r["items"]]) for r in got] == [(1, "", []), (2, "", []), (3, "T", [1 << 20]), (4, "", [])]
    assert H.extract_fields(df.limit(0), [H.Field("a", ("b",))]).columns == ["page_id", "title", "a"]
    assert H.main_text(df).columns == ["page_id", "title", "text"] and H.page_title(df.drop("title")).where("page_id = 3").first().title == "T"
    for wrong in ("", "a >", "a:first", "a, b"):
        with pytest.raises(ValueError):
            H.compile_selector(wrong)
