import html as H
import re

from trellis.llm import html

PAGE = """<html lang="en"><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><a href="/">Home</a></nav></header>
<div class="cookie-notice">We use cookies and that is all that there is to say about it in this notice, is it not?</div>
<div id="sidebar"><p>Of the sidebar that you have to read because it is there and it has all the words in it.</p></div>
<div class="content"><h1>The title</h1>
<p>This is the first paragraph of the article, and it has all of the words that it needs to be   text
on its own, which is what we want from it &amp; more &lt;here&gt;.</p>
<p>Short one.</p>
<div class="ad">Buy it now, as it is all that you have been waiting for in all of your life, is it not so?</div>
<p>And here is the second paragraph, with <a href="x">one link</a> in it, that is also long enough to be text by all of the rules.</p>
<ul><li><a href="1">Link one</a></li><li><a href="2">Link two</a></li></ul></div>
<form><p>Send us your name and the address that you have and we will be with you in no time at all.</p><input></form>
<section id="comments"><h2>Comments</h2><p>I think that this is the best article that I have read and it is all that there is to it for me.</p></section>
<script>var a = "<p>This is not the text that you are looking for and it should not be in it.</p>";</script>
<footer>&copy; The site and all of the people that are in it, who have the rights to all of this and that.</footer></body></html>"""


def test_density_page():
    assert html.extract(PAGE).split("\n") == [
        "The title",
        "This is the first paragraph of the article, and it has all of the words that it needs to be text on its own, which is what we want from it & more <here>.",
        "Short one.",
        "And here is the second paragraph, with one link in it, that is also long enough to be text by all of the rules.",
    ]


def test_edges():
    assert html.extract(None) == html.extract("") == html.extract("<p></p>") == ""
    assert html.extract("<article>Only &eacute;t&#233; this</article><aside>not</aside>") == "Only été this"
    assert html.extract("<article><p>a<p>b<!-- c --></article") == "a\nb"
    assert html.extract("<article><div class='comments'><p>no</p></div><p>yes</p><footer>no</footer></article>") == "yes"
    html.extract("<" * 20_000 + "<a " * 5_000 + '<p class="' * 3000)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    got = html.extract_pages(pages).collect()
    assert len(got) == len(raw)
    for r in got:
        article = re.search(r"<article>(.*)</article>", raw[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(H.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p)
    nulls = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", "", 2)], "page_id bigint, url string, html string, text int")
    assert [r.text for r in html.extract_pages(nulls).collect()] == ["", "", ""]
    assert html.extract_pages(pages.where("false")).count() == 0
