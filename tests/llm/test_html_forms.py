"""HTML rendering: malformed markup, visibility, table spans, and an independent reader over random trees."""

import html.parser
import random
import time

import pytest

from spindrift.llm import html_render


@pytest.mark.parametrize("markup, want", [
    ("<p title=it's>visible text</p><p>that's all</p>", "visible text\n\nthat's all"),
    ("<div hidden>" + "<div>" * 200 + "x" + "</div>" * 200 + "SECRET</div>visible", "visible"),
    ("<div style='visibility:hidden'>a<span style='visibility:visible'>shown</span></div>", "shown"),
    ("<ul style='visibility:hidden'><li>a<li style='visibility: visible'>b</ul>", "- b"),
    ("<table style='visibility:collapse'><tr><td>a<td style='visibility:visible'>b</table>", "  b"),
    ("<p style='display:none; display:block'>shown", "shown"), ("<p style='display:block; DISPLAY : none !important'>no", ""),
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"), ("<table><tr><td>a<td rowspan=2>B<td>c<tr><td>d<td>e</table>", "a  B  c\nd     e"),
    ("<table><tr><td>漢字<td>x<tr><td>abcdef<td>y</table>", "漢字    x\nabcdef  y"), ("<table><tr><td colspan=1000>a<td>b</table>", "a    b"),
    ("a <!--> b", "a b"), ("a <!-- b", "a"), ("a <x", "a <x"), ("</ b>c", "</ b>c"), ("<a href=\"x>y\">z</a>", "z"), ("<a href=\"x>y</a>", "y"),
    ("<span hidden/>no</span>yes", "yes"), ("<script>x</scripty>y</script z>shown", "shown"), ("<textarea>a<b></textarea>c", "a<b>c"),
])
def test_forms(markup, want):
    assert html_render.render(markup) == want


@pytest.mark.parametrize("markup", [
    "<a x " * 200_000, "<b></i>" * 140_000, "<ul><li>a" * 100_000, "<!--" * 250_000, "<td colspan=1000>" * 60_000, "<a x=\"'" * 140_000,
    "<script>" + "</script " * 110_000, "<b>" * 140_000 + "<p>x" * 140_000, "<table><tr>" + "<td rowspan=9>a" * 30_000 + "<tr><td>b" * 3000])
def test_a_megabyte_of_malformed_markup(markup):
    began = time.process_time()
    html_render.render(markup)
    assert time.process_time() - began < 10


def test_nesting_has_no_depth():
    deep = 20_000
    assert html_render.render("<div>" * deep + "<p hidden>no</p>x" + "</div>" * deep + "<b>y</b>") == "x\ny"
    assert html_render.render("<ul><li>" * 500 + "x").strip("- ") == "x"
    assert html_render.render("<table><tr><td>" * 500 + "x" + "</table>" * 500 + "y") == "x\n\ny"


class Reader(html.parser.HTMLParser):
    """The visible words of well-formed markup, by a stack of (shown, visible)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.words = [(True, True)], []

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        shown, seen = self.stack[-1]
        style = found.get("style") or ""
        shown = shown and "hidden" not in found and "none" not in style and tag not in ("script", "style", "template")
        self.stack.append((shown, "visible" in style or seen and "visibility:hidden" not in style))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if all(self.stack[-1]):
            self.words += data.split()


def random_tree(rng, depth):
    out = []
    for _ in range(rng.randint(1, 4)):
        if depth == 0 or rng.random() < 0.4:
            out.append(f" w{rng.randint(0, 999)} &amp;{rng.randint(0, 9)} ")
            continue
        inner = random_tree(rng, depth - 1)
        kind = rng.random()
        attr = rng.choice(["", "", "", "", ' class="a>b"', " title=it's", " hidden", ' style="display:none"', " style='visibility:hidden'", ' style="visibility:visible"'])
        if kind < 0.2:
            items = "".join(f"<li{rng.choice(['', attr])}>{random_tree(rng, depth - 1)}</li>" for _ in range(rng.randint(1, 3)))
            out.append(f"<ul{attr}>{items}</ul>")
        elif kind < 0.35:
            cell = lambda: f"<td{rng.choice(['', attr, ' colspan=2', ' rowspan=2'])}>w{rng.randint(0, 999)}</td>"
            out.append("<table>" + "".join(f"<tr>{cell()}{cell()}</tr>" for _ in range(rng.randint(1, 3))) + "</table>")
        elif kind < 0.45:
            out.append(f"<script>if (a < b) x{rng.randint(0, 99)}()</script>")
        else:
            tag = rng.choice(["div", "span", "b", "section", "i", "em"])
            out.append(f"<{tag}{attr}>{inner}</{tag}>")
    return "".join(out)


def test_visible_words_equal_an_independent_reader():
    rng = random.Random(8)
    for _ in range(600):
        markup = random_tree(rng, 4)
        reader = Reader()
        reader.feed(markup)
        reader.close()
        got = [w for w in html_render.render(markup).split() if w != "-"]
        assert got == reader.words, markup
