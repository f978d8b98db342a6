"""Pages of the tables against their article elements, short and broken pages, and time."""

import html
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from domainforge.llm import extract


@pytest.fixture(scope="module")
def trees():
    return extract.train()


def plain(page):
    """The article element's text without what the contract leaves out, by patterns that suit these pages."""
    body = re.search(r"<article[^>]*>(.*)</article>", page, re.S)[1]
    body = re.sub(r"<!--.*?-->|<(script|style|form|nav|aside)\\b.*?</\\1\\s*>", " ", body, flags=re.S)
    body = re.sub(r"<(?!/?(b|i|a|em|strong|span|code)\\b)[^>]*>", "\n", body)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"\n(?=\n|\S)|(?<=\n)", body))
    return " ".join(" ".join(blocks).split())


def test_articles_of_the_table(trees):
    """All but a few pages give every word of their article, and no page is empty."""
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet' WHERE html LIKE '%</article>%'").fetchall()
    out = extract.extract_all([h for (h,) in rows], trees)
    assert all(out)
    lost = [o for o, (h,) in zip(out, rows) if set(re.findall(r"\w+", plain(h))) - set(re.findall(r"\w+", o))]
    assert len(rows) > 2000 and len(lost) <= 0.002 * len(rows)


def around(article):
    menu = '<nav class="menu"><ul><li><a href="/">home</a></li><li><a href="/b">more</a></li></ul></nav>'
    return f'<html><body>{menu}<article>{article}</article><footer class="footer">&copy; someone <a href="/x">legal</a></footer></body></html>'


def test_short_articles(trees):
    for article, want in (("<h1>The title.</h1><p><b>The title.<br>", "The title. The title."), ("<p>One line.</p>", "One line."), ("<h1>Two words</h1><p><b>Two words<br><p>And some more of it here.</p>", "Two words Two words And some more of it here.")):
        assert extract.main_text(around(article), trees) == want


def test_forms_and_comments_inside_an_article(trees):
    text = "First paragraph of the story, with words to read and more. And on it goes."
    article = f'<h1>A title</h1><p>{text}</p><form class="signup"><label>Your mail</label><input name="m"><button>Send it now</button></form><p>{text}</p><section class="comments"><h3>Replies</h3><div class="comment"><b>someone</b><p>I agree.</p></div></section>'
    assert extract.main_text(around(article), trees) == f"A title {text} {text}"


def test_form_around_a_page(trees):
    page = around("<h1>A title</h1>" + "<p>A paragraph of the story, with words to read and more.</p>" * 4).replace("<body>", "<body><form>").replace("</body>", "</form></body>")
    assert extract.main_text(page, trees).startswith("A title A paragraph")


def test_broken_tags(trees):
    words = lambda page: re.findall(r"\w+", " ".join(v for _, v in extract.dom(page)[1]))
    assert words('One <a title="broken>two</a> three.') == ["One", "two", "three"]
    assert words("One <a title='a > b' href=x>two</a> three <b") == ["One", "two", "three"]
    assert words('One <a "stray">two</a>') == ["One", "two"]
    assert words('<p class="x>y">One</p><p data-x="<b>no</b>">two') == ["One", "two"]


@pytest.mark.parametrize("unit", ['<a "', "<a '", '<a b="', '<a b=">"', "<", "<!--", '="', "</x", "<p>", "<script>", "<a b=\'>\' "])
def test_time_is_linear(unit):
    began = time.perf_counter()
    extract.dom(unit * 30_000)
    assert time.perf_counter() - began < 4


def test_awkward_tables(spark, trees):
    schema = "page_id long, url string, html string"
    assert extract.extract(spark.createDataFrame([], schema), trees=trees).count() == 0
    long = around("<h1>Long</h1>" + "<p>A paragraph of the story, with words to read and more.</p>" * 20_000)
    rows = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", long), (2, "u", long)], schema).withColumn("n_chars", F.lit(1))
    got = sorted(((r.page_id or 0, r.n_chars) for r in extract.extract(rows, trees=trees).collect()))
    assert got[:2] == [(0, 0), (1, 0)] and got[2] == got[3] and got[2][1] > 1_000_000
