"""Places and kinds of nodes against plain walks over the parsed tree."""

import random

import pytest
from pyspark.sql import functions as F

from agora.operators import content, reviews, shape
from agora.sources import html
from tests.test_pages import NEGATIVE, PAGES, POSITIVE
from tests.test_selectors import page


@pytest.fixture(scope="module")
def nodes(spark):
    return html.nodes(spark.createDataFrame(PAGES, "page_id long, html string")).cache()


def chain(rows, node):
    out = [node]
    while rows[out[-1]][1] >= 0:
        out.append(rows[out[-1]][1])
    return out


def test_paths(nodes):
    rows = html.parsed(POSITIVE)

    def step(n):
        alike = [m for m, r in enumerate(rows) if r[1] == rows[n][1] and r[4] == rows[n][4]]
        return f"/{rows[n][4]}" + (f"[{alike.index(n) + 1}]" if alike.index(n) else "")

    got = {r.node: r for r in shape.paths(nodes, nodes).where("page_id = 1").collect()}
    assert len(got) == len(rows)
    for n in range(len(rows)):
        assert got[n].xpath == "".join(step(m) for m in reversed(chain(rows, n)))
        assert got[n].sigpath.count("->") == rows[n][3]
        assert got[n].xpath_star == (got[n].xpath.rpartition("[")[0] if got[n].xpath.endswith("]") else got[n].xpath) + "[*]"
    by_tag = {rows[n][4]: got[n].css_path for n in range(len(rows))}
    assert by_tag["ol"] == "css=ol#answers" and by_tag["textarea"] == "css=html >> css=body >> css=main >> css=div >> css=textarea"
    assert by_tag["time"].startswith("css=ol#answers >> css=li:nth-of-type(3)")


def test_every_path_finds_its_node(spark):
    rng = random.Random(6)
    pages = spark.createDataFrame([(k, page(rng).replace('id="b"', "")) for k in range(30)] + [(77, '<div id="a b.c"><p>x</p><p>y</p></div>'), (78, "")], "page_id long, html string")
    nodes = html.nodes(pages).cache()
    every = shape.paths(nodes).withColumn("ref_id", F.xxhash64("page_id", "node")).cache()
    assert every.count() == nodes.count()
    by_xpath = shape.resolved(nodes, every.select("ref_id", "page_id", F.lit("").alias("css_path"), "xpath"))
    both = shape.resolved(nodes, every.select("ref_id", "page_id", "css_path", "xpath"))
    assert by_xpath.join(every.withColumnRenamed("node", "n"), ["ref_id", "page_id"]).where("node = n AND by = 'xpath'").count() == every.count()
    first = every.groupBy("page_id", "css_path").agg(F.min("node").alias("n"))  # where an id repeats, the first has the path
    assert both.join(every.select("ref_id", "css_path"), "ref_id").join(first, ["page_id", "css_path"]).where("node = n AND by = 'css'").count() == every.count()
    assert every.where("page_id = 77 AND node = 2").first().css_path == "css=div#a\\ b\\.c >> css=p:nth-of-type(2)"
    lost = shape.resolved(nodes, spark.createDataFrame([(1, 77, "css=b", "/div/p[2]"), (2, 77, "css=b", "/i"), (3, 99, "css=b", "/p")], "ref_id long, page_id long, css_path string, xpath string"))
    assert sorted((r.ref_id, r.node, r.by) for r in lost.collect()) == [(1, 2, "xpath"), (2, None, None), (3, None, None)]


def plain_text(rows, n, text):
    """All text between a node's opening and its end, from the parser's own order."""
    class Walk(html._Tree):
        def __init__(self):
            super().__init__()
            self.found = {}

        def handle_data(self, data):
            before = self.n_pieces
            super().handle_data(data)
            for k in self.open:
                held = self.found.setdefault(k, [])
                if self.n_pieces == before:
                    held[-1] += data
                else:
                    held.append(data)

    walk = Walk()
    walk.feed(text)
    walk.close()
    return " ".join(" ".join(x.split()) for x in walk.found.get(n, []) if x.split())


def test_texts_and_markup(spark):
    rng = random.Random(9)
    given = {k: page(rng) + "tail <b>3</b> comments" for k in range(25)} | {50: POSITIVE, 51: "<p>a &lt;b&gt; &amp; <i title='x\"y'>c</i> d<br>e<script>if (a < b) {}</script></p>", 52: None}
    nodes = html.nodes(spark.createDataFrame([*given.items()], "page_id long, html string")).cache()
    inner = {(r.page_id, r.node): r.inner_text for r in content.texts(nodes, nodes).collect()}
    outer = {(r.page_id, r.node): r for r in content.markup(nodes, nodes).collect()}
    for k, text in given.items():
        rows = html.parsed(text)
        for n, row in enumerate(rows):
            assert inner[k, n] == plain_text(rows, n, text)
            got = outer[k, n]
            again = html.parsed(got.outer_html)
            assert [(r[4], r[5], r[3]) for r in again] == [(r[4], r[5], r[3] - row[3]) for r in rows[n : row[2] + 1]]
            assert plain_text(again, 0, got.outer_html) == inner[k, n] and got.outer_html_length == len(got.outer_html) and got.text_excerpt == inner[k, n][:1200]
    assert outer[51, 0].outer_html == "<p>a &lt;b&gt; &amp; <i title=\"x&quot;y\">c</i> d<br>e<script>if (a < b) {}</script></p>"


def test_sample_text(spark):
    text = "<ul>" + "".join(f"<li>{x}</li>" for x in ("one <b>1</b>", "", "t" * 300, "u" * 300, "never")) + "</ul>"
    nodes = html.nodes(spark.createDataFrame([(1, text)], "page_id long, html string"))
    units = nodes.where("tag = 'li'").select("page_id", F.col("parent").alias("root"), "node")
    r = content.sample_text(nodes, units).first()
    assert r.unit_count == 5 and r.sample_text == ("one 1 | " + "t" * 220 + " | " + "u" * 220)[:500]


def test_large_pages(spark):
    deep = "<div>" * 3000 + "<textarea></textarea>" + "</div>" * 3000
    wide = "<div>" + "<p>x <b>y</b></p>" * 60_000 + "<textarea></textarea></div>"
    nodes = html.nodes(spark.createDataFrame([(1, deep), (2, wide)], "page_id long, html string")).cache()
    found = {(r.page_id, r.node): r.textarea_tree_proximity for r in shape.input_distances(nodes, nodes).where("node IN (0, 1, 2)").collect()}
    assert found == {(1, 0): 3000, (1, 1): 2999, (1, 2): 2998, (2, 0): 1, (2, 1): 2, (2, 2): 3}
    assert content.texts(nodes, nodes.where("node = 0")).where("page_id = 2").first().inner_text == " ".join(["x y"] * 60_000)


def test_input_distances(nodes):
    rows = html.parsed(POSITIVE)
    inputs = [n for n, r in enumerate(rows) if r[4] == "textarea"]

    def distance(a, b):
        up, other = chain(rows, a), chain(rows, b)
        return min(up.index(x) + other.index(x) for x in up if x in other)

    got = {(r.page_id, r.node): r for r in shape.input_distances(nodes, nodes).collect()}
    for n in range(len(rows)):
        assert got[1, n].textarea_tree_proximity == min(distance(n, t) for t in inputs)
        assert got[1, n].contenteditable_tree_proximity is None and got[1, n].has_nearby_textarea
    assert all(got[2, n].nearest_input_distance is None and not got[2, n].has_nearby_textarea for n in range(len(html.parsed(NEGATIVE))))


def test_kinds(nodes):
    got = {(r.tag, r.kind) for r in shape.kinds(nodes).where("page_id = 1").join(nodes.select("page_id", "node", "tag"), ["page_id", "node"]).collect()}
    assert {("a", "ACTION"), ("img", "MEDIA"), ("div", "COMMENT"), ("time", "META"), ("html", None)} <= got


def test_nested_penalty(spark):
    rows = [(1, 0, 9, 0.2), (1, 1, 5, 0.5), (1, 2, 3, 0.4), (1, 7, 8, 0.3), (2, 2, 3, 0.4)]
    got = shape.nested_penalty(spark.createDataFrame(rows, "page_id long, node int, last int, score double"))
    assert sorted((r.page_id, r.node, round(r.final_score, 9)) for r in got.collect()) == [(1, 0, 0.2), (1, 1, 0.5), (1, 2, 0.24), (1, 7, 0.3), (2, 2, 0.4)]


def test_folded_reviews(spark):
    log = [("a", 1, "uncertain", "x"), ("a", 2, "", None), ("a", 3, "comment_region", "y"), ("a", 4, "uncertain", ""), ("b", 1, "uncertain", "z"), ("b", 2, None, None)]
    got = reviews.folded(spark.createDataFrame(log, "key string, at long, label string, xpath string"), ["key"], "at", ["xpath"]).collect()
    assert [tuple(r) for r in got] == [("a", "uncertain", "y", 3, 4)]


def test_chosen_go_along_with_their_pages(spark):
    """Nodes that are not there, pages without chosen ones and null pages bring nothing; nodes are shuffled once."""
    nodes = html.nodes(spark.createDataFrame([(1, "<p>a<b>b</b></p><i>c</i>"), (2, "<p>d</p>"), (3, "<p>e</p>"), (None, "<p>f</p>")], "page_id long, html string"))
    chosen = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 7), (2, 1), (4, 0), (None, 0)], "page_id long, node int")
    found = content.texts(nodes, chosen)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "b"), (1, 2, "c")]
    assert [r.outer_html for r in content.markup(nodes, chosen).orderBy("node").collect()] == ["<b>b</b>", "<i>c</i>"]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(page_id") == 2 and "Join" not in plan  # of nodes, and of the chosen to be distinct
