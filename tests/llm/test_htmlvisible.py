"""Visible text against another parser, probes of ordinary pages that once lost text, and costs that grow with length only."""

import time
from html.parser import HTMLParser

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lignum.llm import htmltext


class Plain(HTMLParser):
    """Words of pages whose elements all have end tags, by the standard library's tokeniser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.found = [(False, True)], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        gone, seen = self.stack[-1]
        style = (attrs.get("style") or "").replace(" ", "")
        gone = gone or tag in ("script", "style", "head", "title", "template", "noscript") or "hidden" in attrs or "display:none" in style
        seen = "visibility:hidden" not in style and (seen or "visibility:visible" in style)
        if not gone and (tag in htmltext.BLOCK or tag in ("td", "th")):
            self.found.append(" ")
        if tag not in htmltext.VOID:
            self.stack.append((gone, seen))
        elif tag in ("br", "hr"):
            self.found.append(" ")

    def handle_endtag(self, tag):
        if tag not in htmltext.VOID:
            gone, _ = self.stack.pop()
            self.found.append(" " if not gone and (tag in htmltext.BLOCK or tag in ("td", "th")) else "")

    def handle_data(self, data):
        if self.stack[-1] == (False, True):
            self.found.append(data)


def words(page):
    p = Plain()
    p.feed(page)
    p.close()
    return [w for w in "".join(p.found).split() if w not in ("|", "-")]


def own(page):
    """Without the marks that the layout adds."""
    return [w for w in htmltext.render(page).split() if w not in ("|", "-")]


def test_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(rows) > 200 and all(own(r.html) == words(r.html) for r in rows)


ATTRIBUTES = ["", " title=it's", ' title="hidden > x"', " class='hidden'", " data-style='display:none'", " hidden", ' style="display: none"', " style='visibility:hidden'", " style=visibility:visible", ' title=" hidden "', " style='color:red;'"]
LEAF = st.text("abc &;<", max_size=6).map(lambda t: t.replace("<", " < ").replace("&", " &amp; "))
TREE = st.recursive(
    LEAF,
    lambda inner: st.tuples(st.sampled_from("div p b section ul span em blockquote".split()), st.sampled_from(ATTRIBUTES), st.lists(inner, max_size=4)),
    max_leaves=12,
)


def written(tree, inside=False):
    if isinstance(tree, str):
        return tree
    tag, attrs, kids = tree
    tag = "span" if tag == "p" or (inside and tag not in ("b", "em")) else tag
    return f"<{tag}{attrs}>" + "".join(written(k, inside or tag in ("span", "b", "em")) for k in kids) + f"</{tag}>"


@given(st.lists(TREE, max_size=5))
def test_made_pages(trees):
    page = " ".join(written(t) for t in trees)
    assert own(page) == words(page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title=it's>hello</p><p>world</p>", "hello\n\nworld"),
        ('<p title="the hidden gem">visible</p>', "visible"),
        ('<p style="visibility:hidden">a<b style="visibility:visible">b</b>c</p>', "b"),
        ('<p hidden style="display:block">v</p>', "v"),
        ("<p style='display:none !important; display:block'>n</p>y", "y"),
        ("<textarea>\na &amp; b\n  c</textarea>", "a & b\n  c"),
        ("<svg><title>t</title><text>drawn</text><desc>no</desc></svg>", "drawn"),
        ("</3>x</>y<!-->z-->", "xyz-->"),
        ("<a href=/x/>t</a>", "t"),
        ("a</p>b", "a\n\nb"),
        ("<xmp><b>x</b></xmp>", "<b>x</b>"),
        ("<pre>\nx</pre>", "x"),
        ("<dialog>closed</dialog><dialog open>open</dialog>", "open"),
        ("<ul><li style=visibility:hidden>x<li>y</ul>", "  - y"),
        ("<table><tr><td colspan=2>wide cell here<tr><td>a<td>b</table>", "wide cell here\na | b"),
    ],
)
def test_probes(page, text):
    assert htmltext.render(page) == text


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<p><button>" + "<div>" * 50_000 + "x", "<blockquote>x" * 20_000, "<a " + "b " * 200_000, "<!-- " * 100_000, "<table><tr><td>" + "x" * 300_000 + "<td>b" + "<tr><td>a<td>b" * 10_000])
def test_cost_follows_length(page):
    began = time.process_time()
    htmltext.render(page)
    assert time.process_time() - began < 15
