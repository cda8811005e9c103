"""Queries against their SQL on small tables of cases that the given ones lack."""

import duckdb
import pytest

import __spark_entry__ as entry
from agora.sources import html

ITEMS = "".join(f'<li><a href="/{k}">entry {k}</a></li>' for k in range(5))
BODY = "<p>Some words that fill a paragraph of the page, and a few more.</p>" * 5


def agrees(spark, tmp_path, name, table, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    found = entry.queries()[name](spark, str(tmp_path))
    wanted = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr) and wanted


@pytest.mark.parametrize("name", ["discovered_roots", "inner_texts"])
def test_references_that_were_cut_off(spark, tmp_path, name):
    """A title that is cut within its last reference keeps the rest as it is written."""
    rows = [(k, "https://a.example.org/x", f"<html><body><nav><ul>{ITEMS}</ul></nav><article><h1>This &amp; that &lt;{end}</h1>{BODY}</article></body></html>") for k, end in enumerate(["&amp", "&lt", "&quo", "&", "&amp;"])]
    agrees(spark, tmp_path, name, "pages", "page_id long, url string, html string", rows)


def test_what_ends_a_reference():
    text = lambda given, closed: html.parsed(given, closed)[0][6]
    for given, loose, strict in [("&ampx;&amp", "&x;&", "&ampx;&amp"), ("&#39;&#x41;&#65 &nosuch;", "'AA &nosuch;", "'A&#65 &nosuch;"), ("a && b &eacute;", "a && b \u00e9", "a && b \u00e9")]:
        assert (text(f"<p>{given}", False), text(f"<p>{given}", True)) == (loose, strict)
    (script,) = html.parsed("<script a='&lt&quot;'>if (a && b &lt; &amp) {}</script>", True)
    assert script[6] == "if (a && b &lt; &amp) {}" and script[5] == {"a": '&lt"'}


def test_references_that_are_read():
    """Of closed references those that are named, and each once."""
    (row,) = html.parsed("<p a='&copy;&lt;'>&#39;&nbsp;&copy; &amp;lt; &amp;&lt;&AMP;&lt", True, ("lt", "amp"))
    assert (row[6], row[5]) == ("&#39;&nbsp;&copy; &lt; &<&AMP;&lt", {"a": "&copy;<"})


@pytest.mark.parametrize("name", ["inner_texts", "unit_samples"])
def test_references_that_sql_does_not_read(spark, tmp_path, name):
    """A text keeps the references that its SQL leaves as they are."""
    texts = ["it&#39;s", "it&#x27;s", "a&nbsp;b", "&copy;", "caf&eacute;", "&AMP; &LT;", "&amp;copy; &quot;&lt;&gt;"]
    rows = [(k, "u", f'<html><body><nav><ul><li><a href="/x">{t}</a></li></ul></nav><article><h1>{t}</h1></article></body></html>') for k, t in enumerate(texts)]
    agrees(spark, tmp_path, name, "pages", "page_id long, url string, html string", rows)


def test_blanks_of_texts(spark, tmp_path):
    """SQL squeezes spaces, tabs and ends of lines alone, and takes spaces of every width from the ends."""
    blanks = ["\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u202f", "\u3000", "\ufeff"]
    rows = [(k, "u", f'<nav><a href="/x">{b}a{b}b {b}{b} c{b}</a></nav><article><h1>a{b}b</h1><h1>{b}</h1></article>') for k, b in enumerate(blanks)]
    agrees(spark, tmp_path, "inner_texts", "pages", "page_id long, url string, html string", rows)


def test_headings_and_links_anywhere(spark, tmp_path):
    """Those outside article and nav count; those with other elements or attributes do not."""
    pages = [
        '<html><body><h1>Out</h1><p><a href="/x">one</a></p></body></html>',
        '<article><h1>a <b>x</b> c</h1><h1 class="k">d</h1><h1></h1><h1>e</h1><h1>e</h1></article>',
        '<nav><h1>N</h1><ul><li><a href="/x"><b>q</b></a><li><a href="/x" rel="y">r</a><li><a>s</a><li><a name="t">t</a><li><a href="">u</a></ul></nav>',
        '<article><h1><a href="/q">Q</a></h1></article>',
        None,
    ]
    agrees(spark, tmp_path, "inner_texts", "pages", "page_id long, url string, html string", [(k, "u", p) for k, p in enumerate(pages)])


@pytest.mark.parametrize("url", ["https://www.a.example.net/en/7442.html", "https://a.example.org/x/1", "https://a.example.org/blog/1.htm"])
def test_endings_of_addresses(spark, tmp_path, url):
    """An address that ends in .html is an article's only by what else it says."""
    agrees(spark, tmp_path, "page_evaluation", "pages", "page_id long, url string, html string", [(page, url, "<title>x</title>disqus giscus commento") for page in (6, 20, 36, 48, 60)])
