import html
import re

from remedex.llm import op3_html_extraction as op

PAGE = """<!DOCTYPE html><html><head><title>T, t.</title><style>p{{margin:0}}</style><script>var t="</p>";f(1);</script></head>
<body><header><h1>Site, name.</h1></header><nav><ul><li><a href="/a">Menu, one.</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy, now. Buy!</div>
{body}<div id="comments"><p>A reader, said this. And more, and more, and more.</p></div><form><label>Mail</label><button>Go</button></form><footer>&copy; us.</footer></body></html>"""


def test_article_blocks_entities_and_spaces():
    body = "<article><h1>Head &amp; tail</h1><p><b>Lead  in,\n text.<br><p>Second &#233; &lt;b&gt;.</p><p>x</p><aside>Side, bar.</aside></article>"
    assert op.extract(PAGE.format(body=body)) == "Head & tail\nLead in, text.\nSecond é <b>.\nx"


def test_page_without_article():
    body = "<div id=c><h2>Title</h2>" + "".join(f"<p>Sentence {i}, which is long enough, and has marks.</p>" for i in range(5)) + "</div>"
    got = op.extract(PAGE.format(body=body)).split("\n")
    assert got == ["Title"] + [f"Sentence {i}, which is long enough, and has marks." for i in range(5)]


def test_cut_pages_and_empty_ones():
    assert op.extract(None) == "" and op.extract("") == "" and op.extract("<nav>a</nav>") == ""
    assert op.extract("<article><p>one &amp; two</p><p>thr") == "one & two\nthr"
    assert op.extract("<article><p>one</p><p cla") == "one"
    assert op.extract("plain text") == "plain text"


def test_rows_columns_and_empty_table(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "z"), (1, "u", "<article><p>a</p></article>", "z"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = op.extract_pages(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=str)
    assert op.extract_pages(df.limit(0)).count() == 0


def test_against_a_plain_reading_of_the_article(spark):
    rows = op.query(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in rows:
        inner = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inner)]
        assert r.text == "\n".join(x for x in want if x)


LONG = "".join(f"<p>Sentence {i}, which is long enough, and has marks; it goes on.</p>" for i in range(4))
TEXT = "\n".join(f"Sentence {i}, which is long enough, and has marks; it goes on." for i in range(4))


def article(inner, before="", after=""):
    return op.extract(PAGE.format(body=f"{before}<article><h1>Head</h1>{inner}</article>{after}"))


def test_the_threshold_drops_a_link_list_within_the_article():
    page = PAGE.format(body=f"<article><h1>Head</h1>{LONG}<ul><li><a href=/a>First link</a></li><li><a href=/b>Second link</a></li></ul></article>")
    assert op.extract(page) == f"Head\n{TEXT}"
    assert op.extract(page, rule=0.0) == f"Head\n{TEXT}\nFirst link\nSecond link"


def test_names_that_only_begin_like_other_matter_stay():
    for inner in ("<button-group><p>One, two.</p></button-group>", "<style-guide><p>One, two.</p></style-guide>", "<template-x><p>One, two.</p></template-x>"):
        assert article(LONG + inner) == f"Head\n{TEXT}\nOne, two."
    assert article(LONG + "<p class=notice-period>The notice period, and more.</p>") == f"Head\n{TEXT}\nThe notice period, and more."
    body = f"<div class='post social-history'><h1>Head</h1>{LONG}</div>"
    assert op.extract(PAGE.format(body=body)) == f"Head\n{TEXT}"


def test_marked_blocks_go_and_captions_lists_and_links_stay():
    inner = LONG + "<figure><img src=x><figcaption>A caption</figcaption></figure><ul><li>one</li><li>two</li></ul><p>See <a href=x>the other text</a>.</p>"
    want = f"Head\n{TEXT}\nA caption\none\ntwo\nSee the other text."
    assert article(inner) == want
    assert article(inner + "<div class='ad'>Buy now, or never.</div><section id=comments><p>I said, and said.</p></section><div class=cookie-notice>We use them.</div>") == want


def test_other_articles_are_left_out():
    teaser = "<article><h2><a href=x>Another</a></h2><p>A teaser, short.</p></article>"
    assert op.extract(PAGE.format(body=f"<main>{teaser}<article><h1>Head</h1>{LONG}<article><p>A reader, once more.</p></article></article>{teaser}</main>")) == f"Head\n{TEXT}"
    assert op.extract(PAGE.format(body=f"<main><h1>Head</h1>{LONG}</main><div><p>Below, some words.</p></div>")) == f"Head\n{TEXT}"


def test_marks_count_against_the_region_they_lie_in():
    assert op.extract("<div class=widget><p>Only, text.</p></div>") == "Only, text."


def test_very_long_and_very_deep_pages():
    assert op.extract("<article>" + "<p>a, b.</p>" * 50_000 + "</article>").count("\n") == 49_999
    assert op.extract("<div>" * 50_000 + "deep" + "</b>" * 50_000) == "deep"
    assert op.extract("<article><p>" + "word, " * 200_000).startswith("word, word")
    assert op.extract("<p>x<script>never closed <p>y") == "x"


def test_null_ids(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(None, "u", "<p>a</p>"), (big, None, None)], "page_id long, url string, html string")
    assert sorted(map(tuple, op.extract_pages(df).collect()), key=str) == [(big, None, "", 0), (None, "u", "a", 1)]


def test_ratios_choose_what_stays():
    p = "A long paragraph of the main text, with commas, and a full stop at its end. " * 3
    page = lambda body: f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>{p}</p>{body}</article><footer>foot</footer></body></html>"
    lines = lambda body: op.extract(page(body)).split("\n")[2:]
    text = p.strip()
    assert op.extract(page("")).split("\n") == ["Title", text]
    assert lines("<dl><dt>term</dt><dd>v</dd></dl>") == ["term", "v"]
    assert lines("<p>Give the <label>name</label> of <math><mi>x</mi></math>.</p>") == ["Give the name of x."]
    assert lines("<div class='promoted-unit'>Buy it now, it is cheap.</div>") == []
    assert lines("<h3>Links</h3><ul><li><a href='1'>One more page of ours</a></li><li><a href='2'>Another page of ours</a></li></ul>") == []
    assert lines(f"<h2>Part</h2><h3>Sub</h3><p>{p}</p><h3>Links</h3><ul><li><a href='1'>One more page</a></li></ul>") == ["Part", "Sub", text]
    assert lines("<h2>Left open</h2>") == ["Left open"]
    two = f"<body><article><h2>One</h2><p>{p}{p}</p></article><article><h2>Two</h2><p>{p}</p></article><article><a href='x'>Read more of it</a></article></body>"
    assert op.extract(two).split("\n") == ["One", f"{text} {text}", "Two", text]
