"""Visible text of small pages and of the given ones."""

import html as entities
import re

import pytest

from ringmatch.llm import markup

CASES = {
    "": "",
    None: "",
    "plain &amp; simple": "plain & simple",
    "<p>a<p>b": "a\n\nb",
    "<div>a</div>b<div>c</div>": "a\nb\nc",
    "a<br>b<br/>c": "a\nb\nc",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=9><li>a</li><li>b</li></ol>x": "9. a\n10. b\n\nx",
    "<table><tr><th>k<th>v<tr><td>long key<td>1</table>": "k         v\nlong key  1",
    "<table><td>a<td>b<tr><td><table><td>c<td>d</table><td>e</table>": "a    b\nc d  e",
    "<p hidden>no</p><p style='color:red; display : none'>no</p><p aria-hidden=true>yes": "yes",
    "<p title='Find hidden gems'>a</p><p class=\"nav hidden md:block\">b</p><p data-style='display:none'>c</p>": "a\n\nb\n\nc",
    "<p title='x style=display:none'>a</p><p HIDDEN=''>no</p><p style=display:none>no</p><p hidden=until-found>b": "a\n\nb",
    "<p style='visibility: hidden'>no</p><p style='--x:1;/* c */display:none'>no</p><p style='x-display:none'>a": "a",
    "a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b": "a x=2 b",
    "<svg><title>no</title><path d='M0'/><g><text>one <tspan>two</tspan></text><text>three</text></g></svg>x": "one two three x",
    "<svg><defs><text>no</text></defs><style/></svg>x<svg><path><p>b</p>": "x\n\nb",
    "<b>" * 250 + "<i style='display:none'>no<u>no</u></i>yes": "yes",
    "<div>a" + "<b>" * 250 + "<div hidden>no</div>in</div><p>b": "ain\n\nb",
    "<script>if (a<b) '</p>'</script><style>p{}</style><title>t</title><!-- c --><noscript>n</noscript>x": "x",
    "<pre> a\n  b</pre>c": " a\n  b\n\nc",
    "1 < 2 <b>bold</b> text": "1 < 2 bold text",
    "<a title=\"x>y\">link</a> <a title='open>rest": "link rest",
    "<select><option>a<option>b</select>": "a\nb",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "</p></div>stray</li>": "stray",
    "<textarea>a &lt; b</textarea>": "a < b",
    "a<!-- never ends": "a",
    "<b>x</b><i>y</i> z": "xy z",
}


@pytest.mark.parametrize("page", CASES, ids=range(len(CASES)))
def test_small_pages(page):
    assert markup.visible_text(page) == CASES[page]


def test_hostile_pages_keep_their_text_and_end():
    deep = markup.visible_text("<div>" * 50_000 + "x" + "</div>" * 50_000)
    assert deep == "x"
    assert markup.visible_text("<a \"" * 20_000).count("x") == 0
    assert markup.visible_text("<ul>" + "<li>y" * 5_000).count("y") == 5_000
    assert markup.visible_text("<table><tr><td>" * 300 + "z").count("z") == 1


def test_all_words_of_the_given_pages_survive_in_order(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = markup.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        seen = re.sub(r"<head>.*?</head>|<script>.*?</script>|<!--.*?-->", "", r["html"], flags=re.S)
        want = [w for w in entities.unescape(re.sub(r"<[^>]+>", " ", seen)).split() if w != "-"]
        assert [w for w in r["text"].split() if w != "-"] == want
        assert r["n_chars"] == len(r["text"]) and r["n_lines"] == len(r["text"].split("\n"))


def test_awkward_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "t", "c"), (None, "u", "<p>x", "t", "c"), (2, "u", "", None, None), (2, "u", "", None, None)]
    got = markup.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_lines"]) for r in got) == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert markup.extract_text(spark.createDataFrame([], schema)).count() == 0
