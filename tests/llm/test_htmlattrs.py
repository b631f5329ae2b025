"""What hides an element is an attribute of it, not a word inside another's value."""

import pytest

from lignum.llm import htmltext


@pytest.mark.parametrize("attrs", ['title="our hidden fees "', 'class="a hidden b"', "class='x hidden'", "data-hidden", "href=/q?type=hidden", 'data-style="display:none"', 'title="style=display:none"', 'type=hidden', 'style="--x-display:none"', 'hidden-x=1'])
def test_seen(attrs):
    assert htmltext.render(f"<div {attrs}>text <b>deep</b></div>") == "text deep"


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN", 'hidden=""', "class=a hidden", 'title="a"hidden', "style=display:none", 'style="color:red; DISPLAY : none !important"', "style='visibility:hidden'", 'style="display:&#110;one"', 'x="1" hidden x="2"'])
def test_not_seen(attrs):
    assert htmltext.render(f"<div {attrs}>no</div>yes") == "yes"


def test_values():
    assert htmltext.render("<img alt='a hidden cove'><img title=\"alt='no'\"><img alt=plain>") == "a hidden coveplain"
    assert htmltext.render('<ol data-start="7" start=3><li>c</ol>') == "  3. c"
    assert htmltext.render('<table><tr><td title="colspan=2">a<td>b<tr><td>c<td>d</table>') == "a | b\nc | d"
    assert htmltext.attributes(' A=1 b = "x y" c=\'z\' d a=2 /') == {"a": "1", "b": "x y", "c": "z", "d": ""}
