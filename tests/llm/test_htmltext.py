import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lignum.llm import htmltext


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, None),
        ("", ""),
        ("plain", "plain"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<h1>Head</h1><div>a</div><div>b</div>", "Head\n\na\nb"),
        ("a  <b>bold</b>\n text", "a bold text"),
        ("<b>in</b><i>side</i> word", "inside word"),
        ("<ul><li>one<li>two<ul><li>deep</ul><li>three</ul>", "  - one\n  - two\n    - deep\n  - three"),
        ("<ol start=3><li>c<li>d</ol>", "  3. c\n  4. d"),
        ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name      | n\nlong name | 1"),
        ("<table><td>a<td>b</table>", "a | b"),
        ("x<script>var a = '<p>';</script>y<style>p{}</style>", "xy"),
        ("<p hidden>no</p><p style='color:red; display: none'>no</p><p style=\"visibility:hidden\">no</p>yes", "yes"),
        ("<template>no</template><noscript>no</noscript>yes", "yes"),
        ("a<!-- no <p> -->b", "ab"),
        ("a<!-- open", "a"),
        ("&lt;tag&gt; &amp; caf&eacute; &#65;", "<tag> & café A"),
        ("<pre>  keep\n   this</pre>", "  keep\n   this"),
        ("line<br>break<br/>again", "line\nbreak\nagain"),
        ("<head><title>no</title></head><body>yes", "yes"),
        ("<img alt='a picture'> of", "a picture of"),
        ("</p></div>stray", "stray"),
        ("<p title='a > b'>quoted</p>", "quoted"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<blockquote>said</blockquote>", "  said"),
        ("<dl><dt>term<dd>meaning</dl>", "term\n  meaning"),
        ("<table><caption>Cap</caption><tr><td>x</table>", "Cap\nx"),
        ("<unknown>inline</unknown> <custom-tag>too</custom-tag>", "inline too"),
    ],
)
def test_layout(page, text):
    assert htmltext.render(page) == text


def test_depth_and_length():
    deep = "<div>" * 50_000 + "bottom" + "</div>" * 50_000
    assert htmltext.render(deep) == "bottom"
    assert htmltext.render("<p>word " * 100_000).count("word") == 100_000


@given(st.text(st.sampled_from("<>/ab\"'=!- \n&;p"), max_size=80))
def test_no_page_crashes(page):
    assert isinstance(htmltext.render(page), str)


@given(st.lists(st.text("abcdefg", min_size=1, max_size=8), min_size=1, max_size=12))
def test_visible_words_stay_in_order(words):
    tags = ["<p>{}</p>", "<li>{}", "<div>{}</div>", "<span>{}</span> ", "<td>{}"]
    page = " ".join(tags[k % len(tags)].format(w) for k, w in enumerate(words) if k % len(tags) != 4) or "x"
    want = [w for k, w in enumerate(words) if k % len(tags) != 4] or ["x"]
    assert htmltext.render(page).replace("- ", " ").split() == want


def test_pages(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "v", ""), (3, "w", "<p>x" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = htmltext.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    out = sorted(map(tuple, got.collect()), key=repr)
    assert (1, "u", "a") in out and out.count((1, "u", "a")) == 2 and (2, None, None) in out and (None, "v", "") in out and len(out) == 5
    assert htmltext.extract(pages.filter("false")).collect() == []


def test_all_given_pages(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        text = htmltext.render(r.html)
        assert "<script" not in text and "\n\n\n" not in text
