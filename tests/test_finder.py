"""Links worth following and evaluations of pages, by hand."""

import pytest
from pyspark.sql import functions as F

from agora.operators import finder
from agora.sources import html

BASE = dict(url="https://a.org/x/y", final_url="", html="", ok=True, http_status=200, error="", kind="article", source="homepage", snippet="", title="", discovery_score=0)
SCHEMA = "url string, final_url string, html string, ok boolean, http_status int, error string, kind string, source string, snippet string, title string, discovery_score int"


def judged(spark, **given):
    row = BASE | given
    return finder.evaluated(spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)).first()


def test_needles_are_in_every_match(spark):
    texts = [
        "hedgehog-comment-embed", "Disqus", "GISCUS", "utteranc.es utterances", "viafoura", "SpotIM openweb", "coral-talk Coral Comment", "hyvor-talk", "graphcomment", "commento", "remark42", "facebook.com/plugins/comments", "commentCount", "show_comments", "comment:{enabled",
        "<p id='my comments'>", "<p data-a=\"discussion\">", "<b name='reply'>", "<b class='a reviews b'>", "join the conversation", "add a comment", "reader comments", "community comments",
    ]
    assert len(finder.SIGNALS) == len(finder.NEEDLES) == len(texts) == 23
    found = finder.evaluated(spark.createDataFrame([(BASE["url"], "", t, True, 200, "", "other", "homepage", "", "", 0) for t in texts], SCHEMA)).select("html", "signals", "score").collect()
    for r, (_, name, _) in zip(sorted(found, key=lambda r: texts.index(r.html)), finder.SIGNALS):
        assert name in r.signals and r.score >= 12, (r, name)


@pytest.mark.parametrize(
    "given, score, status",
    [
        (dict(html="disqus giscus", final_url="https://a.org/2024/05/06/x", discovery_score=4), 28, "validated"),
        (dict(html="disqus giscus", final_url="https://a.org/x", discovery_score=4), 28, "likely"),
        (dict(html="disqus captcha", discovery_score=10), 20, "blocked-but-likely"),
        (dict(html="disqus", discovery_score=0), 12, "weak"),
        (dict(html="<title>Privacy policy</title> disqus", discovery_score=30), 24, "unresolved"),
        (dict(html="<title>Privacy policy</title> disqus giscus", discovery_score=30), 36, "likely"),
        (dict(kind="qa", html='itemtype="https://schema.org/QAPage"', final_url="https://a.org/q/1", discovery_score=12), 28, "validated"),
        (dict(kind="forum", html="last reply", final_url="https://a.org/t/x", discovery_score=20), 28, "validated"),
        (dict(kind="review", html="a reviewer", discovery_score=20), 28, "validated"),
        (dict(kind="article", html="", title="Inline comments, a tutorial", discovery_score=30), 4, "unresolved"),
        (dict(source="search", snippet="Comments", discovery_score=7), 9, "unresolved"),
        (dict(html=None, final_url=None, title=None, snippet=None, kind=None, discovery_score=None, error=None), 0, "unresolved"),
    ],
)
def test_status(spark, given, score, status):
    r = judged(spark, **given)
    assert (r.score, r.status) == (score, status)


def test_notes(spark):
    assert judged(spark, ok=False, http_status=403, error="timeout").access_note == "http 403; timeout; blocked or verification required"
    assert judged(spark).access_note == ""


def test_anchors(spark):
    text = """<a href="https://a.org/questions/1-x?utm=1#f"><b>First</b> of two</a><a href=' https://www.a.org/x/thread-1/ '>T</a><a href="https://a.org/questions/1-x">again</a>
    <a href="/questions/2-x">near</a><a href="https://b.org/questions/3-x">far</a><a href="https://a.org/forum/pic.png">file</a><a href="https://a.org/login/x">no</a><a>none</a>"""
    pages = spark.createDataFrame([(1, "https://a.org/start", text), (2, None, text), (3, "https://a.org/", None)], "page_id long, url string, html string")
    got = finder.anchors(pages, html.nodes(pages)).collect()
    assert [(r.page_id, r.url, r.title, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "https://a.org/questions/1-x", "First of two", 1), (1, "https://www.a.org/x/thread-1", "T", 2)]
    few = finder.anchors(pages, html.nodes(pages), F.lit("qa"), most=1).collect()
    assert [(r.url, r.discovery_score) for r in few] == [("https://a.org/questions/1-x", 3 + 8 + 2 + 10)]


def test_best_of_sites(spark):
    rows = [("s", "weak", 90, 1, "u1"), ("s", "likely", 20, 1, "u2"), ("s", "likely", 20, 5, "u3"), ("t", "other", 1, 1, "u4")]
    got = finder.best_of_sites(spark.createDataFrame(rows, "site string, status string, score int, discovery_score int, url string")).collect()
    assert {(r.site, r.url) for r in got} == {("s", "u3"), ("t", "u4")}
