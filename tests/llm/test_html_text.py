import html
import re

import pytest

from schemaweave.llm import html_text as H

SF = "/root/testdata/sf0.001"
LONG = "The committee met on Tuesday, and after a long debate, it agreed on the plan; most members were content with it."


def pages(spark, sources, **kw):
    rows = [(i, f"u{i}", s) for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in H.extract(df, **kw).orderBy("page_id").collect()]


def article(body, around=""):
    return f"<html><head><title>x</title></head><body>{around}<article>{body}</article></body></html>"


def test_query_against_the_templates_definition(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = {}
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|</h1>", inside)]
        want[r.page_id] = "\n".join(x for x in parts if x)
    got = H.op12_html_extraction(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("around", [
    "<nav><ul><li>Home and away, at last.</li></ul></nav>", "<header><p>The Daily Paper, founded long ago.</p></header>",
    "<footer><p>All rights reserved, by the owner, for ever.</p></footer>", "<aside><p>Also on this site, a quiz, and more.</p></aside>",
    '<div class="cookie-banner"><p>We use cookies, as all do, to count you.</p></div>', '<div id="leftSidebar">Weather, traffic, and so on.</div>',
    "<form><label>Your name, please</label><input><textarea>Write, here.</textarea></form>", '<div role="navigation">One, two, three.</div>',
    '<section class="comments"><p>Great, truly great, article! Thanks, all.</p></section>', "<script>var a = '<p>no, no, no.</p>';</script>",
    "<style>p > a { color: red }</style>", "<!-- <p>Hidden, all of it.</p> -->", "<noscript><p>Turn on, please, scripts.</p></noscript>",
    '<p hidden>Not, to be seen.</p>', '<p style="display: none">Not, to be seen.</p>', '<div class="ad">Buy, now, and save, a lot.</div>',
])
def test_parts_around_the_article_go(spark, around):
    body = f"<h1>Plan agreed</h1><p>{LONG}</p><p>Yes.</p>"
    want = f"Plan agreed\n{LONG}\nYes."
    one = article(body, around)
    assert [H._joined(H.content(H.blocks(s), H.path_sums(H.blocks(s)), .5, 3)) for s in (one, article(body + around))] == [want, want]


def test_all_kinds_of_blocks_in_an_article_stay(spark):
    body = (f"<header><h1>A   plan\n agreed</h1></header><p>{LONG} <a href='x'>More</a>, <b>and</b> more.<br>New line</p>"
            f"<h2>Votes</h2><ul><li>Ten</li><li>Two</li></ul><table><tr><td>a</td><th>b</th></table><blockquote>He said so</blockquote>"
            f"<pre>x = 1\ny = 2</pre>tail<figure><figcaption>The hall</figcaption></figure>")
    want = [f"A plan agreed", f"{LONG} More, and more. New line", "Votes", "Ten", "Two", "a", "b", "He said so", "x = 1 y = 2", "tail", "The hall"]
    assert pages(spark, [article(body, "<nav><a>Home</a></nav>")]) == ["\n".join(want)]


def test_ratios_decide_where_names_say_nothing(spark):
    soup = ("<html><body><div><div><a href=a>Start</a> <a href=b>News</a></div></div><div><div><h1>Plan agreed</h1>"
            + f"<p>{LONG} {LONG}</p>" * 6 + "</div></div><div><span>Copyright 2020</span></div></body></html>")
    assert pages(spark, [soup]) == ["Plan agreed\n" + "\n".join([f"{LONG} {LONG}"] * 6)]
    # a short page of the same shape keeps its words: the path's ratios come from all pages
    short = soup.replace(f"<p>{LONG} {LONG}</p>" * 6, "<p>Yes.</p>")
    assert pages(spark, [soup] * 20 + [short])[-1] == "Plan agreed\nYes."


def test_broken_markup(spark):
    cases = {
        "<p>one<p>two": "one\ntwo", "<p><b>one<br><p>two</p>": "one\ntwo", "a &amp; b &lt;c&gt; &eacute;&#8212;&#x41;&copy": "a & b <c> é—A©",
        "x < y and y > z": "x < y and y > z", "<p title='a > b' data-x=\"</p>\">in</p>": "in", "<p>cut <!-- open": "cut", "<p>cut<script>var": "cut",
        "</div></p>text</b>": "text", "<li>a<li>b<p>c": "a\nb\nc", "<DIV>A<BR/>B</DIV>": "A B", "<p>a<div>b</div>c</p>d": "a\nb\nc\nd", "&nbsp;": "",
        "<p>it's 5\" wide": "it's 5\" wide", "<a href=x'y>z</a>w": "zw", "<p": "", "<": "<", "1 <2": "1 <2", "<![CDATA[x]]>t": "t", "<?xml a?>t": "t",
    }
    for source, want in cases.items():
        assert "\n".join(b.text for b in H.blocks(source)) == want, source


def test_odd_rows_and_the_join_of_many_paths(spark):
    deep = "<div>" * 3000 + "deep text, at last." + "</div>" * 3000
    wide = article("".join(f'<section class="s{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"><p>{LONG} {i}</p></section>' for i in range(300)))
    long = article(f"<p>{LONG}</p>" * 5000)
    sources = [None, "", "   ", "<p></p>", "plain words", article(f"<p>{LONG}</p>"), article(f"<p>{LONG}</p>"), deep, wide, long]
    got = pages(spark, sources)
    assert got[:4] == [""] * 4 and got[4] == "plain words" and got[5] == got[6] == LONG and got[7] == "deep text, at last."
    assert got[8].count("\n") == 299 and got[9].count("\n") == 4999
    assert pages(spark, sources, max_paths=0) == got
    df = spark.createDataFrame([(None, "a", 1, None), (None, "a", 1, None), (1, None, 2, "<p>x")], "page_id int, text string, n_chars int, html string").withColumn("url", F_lit())
    assert sorted(tuple(r) for r in H.extract(df).fillna(-1).collect()) == [(-1, "u", "", 0), (-1, "u", "", 0), (1, "u", "x", 1)]
    assert sorted(tuple(r) for r in H.extract(df, max_paths=0).fillna(-1).collect()) == [(-1, "u", "", 0), (-1, "u", "", 0), (1, "u", "x", 1)]
    assert H.extract(df.limit(0)).collect() == [] and H.extract(df.limit(0), max_paths=-1).collect() == []


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("u")


def test_sums_of_paths_add_up(spark):
    sources = [article(f"<h1>T</h1><p>{LONG}</p>"), article("<p>One, two.</p><p><a>three</a></p>"), None]
    df = spark.createDataFrame([(s,) for s in sources], "html string").repartition(3)
    got = {r.path: (r.n, r.chars, r.marks, r.links) for r in H.path_table(df, held=0).collect()}
    assert got == {"html/body/article/h1": (1, 1, 0, 0), "html/body/article/p": (3, len(LONG) + 9 + 5, sum(c in ",.;" for c in LONG) + 2, 5)}
