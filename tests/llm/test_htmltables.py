"""Text of a table outside its cells, and cells that span columns and rows."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lignum.llm import htmltext


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table>note<tr><td>a</table>", "note\n\na"),
        ("<table><tr><td>a</td>note<td>b</table>", "note\n\na | b"),
        ("<table><tr><td>a<tbody><form>name</form><tr><td>b<div>deep</div></table>end", "name\n\na\nb deep\n\nend"),
        ("<table><tr><td>a</td>one</tr>two<tr><td>b</table>", "one\ntwo\n\na\nb"),
        ("<table><tr><td>x<caption>cap</caption>y<td>z</table>", "x y | z\ncap"),
        ("<table><tr><td>o<table>in<tr><td>p</table><td>q</table>", "o in p | q"),
        ("<table><tr><th colspan=2>both<th>c<tr><td>1<td>2<td>3</table>", "both  | c\n1 | 2 | 3"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<tbody><tr><td>e</table>", "a | b\n  | c\n  | d\ne"),
        ("<table><tr><td colspan=1000>wide<td>x<tr><td>y</table>", "wide | x\ny"),
        ("<table><tr><td colspan=2>a longer cell<tr><td>1<td>2</table>", "a longer cell\n1 | 2"),
    ],
)
def test_tables(page, text):
    assert htmltext.render(page) == text


@given(st.lists(st.sampled_from(["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th colspan=3 rowspan=2>", "<caption>", "</caption>", "<tbody>", "<div>", "</div>", "<form>", "<li>"]), max_size=25))
def test_all_words_stay(tags):
    page = "<table>" + "".join(f" w{k} {t}" for k, t in enumerate(tags)) + " last"
    assert sorted(htmltext.render(page).replace("- ", " ").replace("|", " ").split()) == sorted([f"w{k}" for k in range(len(tags))] + ["last"])
