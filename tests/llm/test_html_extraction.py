"""Main text of made-up pages of many layouts, and of the table against a plain reading of its article elements."""

import html
import random
import re

import pytest
from answerscope.llm import html_extraction as x
from answerscope.llm.queries import op12_html_extraction
from pyspark.sql import functions as F

WORDS = "water stone river, light house green market, bread window table garden, street morning winter".split()
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us, all</a></li><li><a href='/c'>Contact, press</a></li></ul>"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


LAYOUTS = {
    "article": "<nav>{menu}</nav><article>{body}</article><footer>&copy; all rights</footer>",
    "article header": "<header><p>Site, the best, of all</p>{menu}</header><article><header>{title}</header>{rest}<footer>Filed by nobody</footer></article>",
    "main": "<div id=top>{menu}</div><main>{body}</main><aside><p>{long}</p></aside>",
    "content div": "<div id='header'>{menu}</div><div class='content'>{body}</div><div class='sideBar'><p>{long}</p></div><div id=footer><p>{long}</p></div>",
    "bare div": "<div>{menu}</div><div>{body}</div><div class='cookie-notice'><p>{long}</p></div>",
    "title above": "<div class=wrap>{title}<div class=text>{rest}</div><div class='ad box'><p>{long}</p></div></div>",
    "wrapper named for its sidebar": "<div class='has-sidebar'><article>{body}</article><div class='sidebar'><p>{long}</p></div></div>",
    "content with sidebar": "<div class='content-with-sidebar'><div>{body}</div><div class='sidebar'><p>Small, one.</p></div></div>",
    "page form": "<form action='/'><div class='post'>{body}</div><input type=text><button>Go, now</button></form>",
    "search form": "<form><label>Find it, here</label><select><option>One, two</select></form><div class='entry'>{body}</div>",
    "comments": "<div class='story'>{body}</div><section id='comments'><h2>Replies</h2><article class='comment'><p>{long}</p></article></section>",
    "table": "<table><tr><td>{menu}</td><td>{body}</td></tr></table>",
    "advert within": "<div class='post'>{half}<div class='advert'><p>{long}</p></div>{other}</div><div role=contentinfo><p>{long}</p></div>",
    "hidden within": "<div class='post'>{half}<p style='display: none'>{long}</p><div hidden><p>{long}</p></div>{other}</div>",
    "script within": "<div class='post'>{half}<script>if (a < b) document.write('<p>{long}</p>')</script><style>p > a {{ }}</style><!-- <p>{long}</p> -->{other}</div>",
    "related links": "<article>{body}<ul><li><a href=x>One, and more</a><li><a href=y>Two, and more</a><li><a href=z>Three, and more</a></ul></article>",
    "sections": "<div id=page><section>{half}</section><section>{other}</section></div><div class=widget><p>{long}</p></div>",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layouts(layout):
    for seed in range(8):
        rng = random.Random(f"{layout}{seed}")
        title, texts = sentence(rng, 4), [sentence(rng, rng.choice([12, 30, 60])) for _ in range(rng.randint(2, 9))]
        ps = [f"<p>{t}</p>" if rng.random() < 0.7 else f"<p>{t}" for t in texts]
        k = len(ps) // 2 or 1
        parts = {"menu": MENU, "title": f"<h1>{title}</h1>", "rest": "".join(ps), "body": f"<h1>{title}</h1>" + "".join(ps), "half": f"<h1>{title}</h1>" + "".join(ps[:k]), "other": "".join(ps[k:]), "long": sentence(rng, 25)}
        page = f"<!DOCTYPE html><html><head><title>No, not this</title></head><body>{LAYOUTS[layout].format(**parts)}</body></html>"
        assert x.main_text(page) == "\n\n".join([title, *texts]), (layout, seed)


def test_blocks_references_and_white_space():
    page = "<article><h1>A &amp; B</h1><p>One<br>two \n\t three&nbsp;four &#233;&eacute &lt;b&gt; &am</p>\n<ul><li>first<li><b>sec</b>ond</ul><blockquote>quoted</blockquote><pre>x\n  y</pre><p>1 < 2 <3</p></article>"
    assert x.main_text(page) == "\n\n".join(["A & B", "One two three four éé <b> &am", "first", "second", "quoted", "x y", "1 < 2 <3"])


def test_broken_pages():
    assert x.main_text("<article><p>One.<p title='a>b'>Two.</p></article><footer>no") == "One.\n\nTwo."
    assert x.main_text("<article><p>One.</p><p cla") == "One."
    assert x.main_text("<article><p>One.</p><!-- cut off <p>no</p>") == "One."
    assert x.main_text("<article><p>One.</p><script>cut off <p>no</p>") == "One."
    assert x.main_text("<article><p>One</b></i>.</div></td></p>") == "One."
    assert x.main_text("<article><p><b>One.<br><p>Two.</article><footer>no</footer>") == "One.\n\nTwo."
    assert x.main_text("plain words, no tags") == "plain words, no tags"
    assert x.main_text("<") == "<"
    for empty in (None, "", "</", "<!--", "<nav><a href=x>Home</a></nav>", "<html><head><title>t</title></head><body></body></html>"):
        assert x.main_text(empty) == ""


def test_long_and_deep_pages():
    words = "many words, " * 400_000
    assert x.main_text(f"<article><p>{words}</p></article>") == words.strip()
    assert x.main_text("<div>" * 50_000 + "<p>deep, text</p>") == "deep, text"
    assert x.main_text("<b>" * 50_000 + "</i>" * 50_000 + "text") == "text"
    assert x.main_text("<p>" + "<a " * 50_000) == ""
    assert len(x.main_text("<article>" + "<p>a b</p>" * 100_000 + "</article>")) == 500_000 - 2


def plain(page):
    """The article elements of a page, split at its block tags."""
    found = re.findall(r"<article>(.*?)</article>", page, re.DOTALL)
    blocks = (html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))) for a in found for b in re.split(r"</?(?:p|h1|div)(?:\s[^>]*)?>", a))
    return "\n\n".join(filter(None, (" ".join(b.split()) for b in blocks)))


def test_query_on_the_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    want = sorted((r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in pages)
    assert sorted(tuple(r) for r in op12_html_extraction(spark, data).collect()) == want


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (2, None, "<p>é, ü</p>"), (2, None, "<p>é, ü</p>"), (2**60 + 1, "v", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit(9))
    got = sorted((tuple(r) for r in x.extract(df).collect()), key=str)
    assert got == sorted([(None, None, "", 0), (1, "u", "", 0), (2, None, "é, ü", 4), (2, None, "é, ü", 4), (2**60 + 1, "v", "x", 1)], key=str)
    assert x.extract(df.limit(0)).count() == 0
