import pytest
from pyspark.sql import functions as F

from agora.functions.text import plain
from agora.operators import crawl, discovery, dom, features, scoring
from agora.sources import html
from agora.streaming.streams import crossed, tier

TURN = '<li class="answer-row level-{1}"><span class="byline"><a href="/u/p{0}"><img class="userpic" src="/p{0}.jpg">p{0}</a></span><time datetime="2023-05-0{0}">2 days ago</time><div>Turn {0} of an exchange about gardens, with more than enough words to be read as text. (edited)</div><a role="button">reply</a><a role="button" title="helpful">7</a>{2}</li>'
INNER = '<ul><li class="answer-row" data-level="1"><span>x</span><em>short</em></li><li class="answer-row" data-level="1"><span>y</span><em>short</em></li></ul>'
POSITIVE = '<html><head><script type="application/ld+json">{"@type": "Comment"}</script></head><body><main><h3>3 answers</h3><ol id="answers">' + "".join(TURN.format(k, k % 2, INNER if k == 2 else "") for k in (1, 2, 3)) + "</ol><div><textarea></textarea><input type=submit value=Answer></div></main></body></html>"
NEGATIVE = '<html><body><nav><a href="/">Start</a><a href="/shop">Shop</a></nav><ul class="shelf">' + '<li class="offer"><h4>Kettle</h4><b>€ 25</b><button>Buy now</button></li>' * 3 + "</ul></body></html>"
PAGES = [(1, POSITIVE), (2, NEGATIVE), (3, "<p><b>a<br>b<p>c"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def found(spark):
    """Regions at every list and section, discovered or not."""
    nodes = html.nodes(spark.createDataFrame(PAGES, "page_id long, html string")).cache()
    roots = discovery.structured(nodes).where("tag IN ('ol', 'ul') AND depth < 5").withColumn("candidate_rank", F.lit(1))
    return scoring.scored(features.regions(nodes, roots)).cache()


def test_nodes_close_implied_ends():
    rows = html.parsed("<ul><li>a<li>b</ul><p>x<div>y</div>")
    assert [(r[4], r[1]) for r in rows] == [("ul", -1), ("li", 0), ("li", 0), ("p", -1), ("div", -1)]
    assert rows[0][2] == 2


def test_positive_page_is_detected(found):
    best = found.where("page_id = 1 AND detected").collect()
    assert best and max(r.score for r in best) >= 24
    turns = found.where("page_id = 1 AND tag = 'ol'").first()
    assert turns.repeating_group_count == 3 and turns.signature == "ol[li,li,li]" and turns.group_kind == "tag" and turns.unit_count == 3


def test_features_by_hand(found):
    """What three turns hold, of which the second has two answers below it, beside a textarea."""
    r = found.where("page_id = 1 AND tag = 'ol'").first()
    assert r.json_ld_has_comment_type and not r.json_ld_has_comment_action
    assert r.reply_nesting_depth == 1 and r.thread_depth_indicator and r.depth_indicator_unit_count == 3  # by their class
    assert r.has_edit_history_indicator and r.edited_unit_count == 3 and not r.read_more_truncation
    assert r.textarea_tree_proximity == 3 and r.has_nearby_textarea and r.aligned_with_textarea and not r.aligned_with_content_editable
    assert (r.reply_button_unit_coverage, r.time_datetime_per_unit, r.profile_link_coverage) == (1.0, 1.0, 1.0)
    assert r.ui_interactive_element_count == 6 and r.ui_form_count == 0 and r.text_question_mark_count == 0
    assert {"json_ld_comment_type", "reply_button_per_unit", "user_profile_link_per_unit", "substantial_text_content", "reply_nesting_depth", "has_nearby_textarea"} <= set(r.matched_signals)
    weights = {scoring.label_of(x): x[1] for x in scoring.RULES}
    assert r.score == sum(weights[x] for x in (*r.matched_signals, *r.penalty_signals))


def test_a_missing_feature_is_an_error(spark):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        scoring.scored(spark.createDataFrame([(1, True)], "page_id long, has_avatar boolean"))


def test_labels_are_one_a_rule():
    names = [scoring.label_of(r) for r in scoring.RULES]
    assert len(set(names)) == len(names) == 56


def test_product_page_is_not(found):
    assert found.where("page_id = 2 AND detected").count() == 0
    shelf = found.where("page_id = 2 AND tag = 'ul'").first()
    assert shelf.add_to_cart_present and "add_to_cart_present" in shelf.penalty_signals


def test_every_node_of_a_large_page_is_kept(spark):
    page = "<div>" + "<p>x</p>" * 30_000 + "<b>last</b></div>"
    nodes = html.nodes(spark.createDataFrame([(1, page), (2, "<i>a</i>")], "page_id long, html string"))
    assert nodes.where("page_id = 1").count() == 30_002 and nodes.where("tag = 'div'").first()["last"] == 30_001
    found = discovery.structured(nodes).where("page_id = 1 AND node IN (0, 5)").orderBy("node").collect()
    assert [(r.text_length, r.repeated, r.child_count) for r in found] == [(2 * 30_000 + 4, 30_000, 30_001), (1, 0, 0)]


def test_plain_takes_marks_off(spark):
    df = spark.createDataFrame([("Odpowiedź ÉLÈVE e\u0301 Ż ł ß",)], "t string")
    assert df.select(plain(df.t)).first()[0] == "odpowiedz eleve e z ł ß"


def test_signature(spark):
    nodes = html.nodes(spark.createDataFrame([(1, POSITIVE)], "page_id long, html string"))
    got = {r.signature for r in dom.signatures(nodes).where("tag = 'li' AND depth = 4").collect()}
    assert got == {"li[a,a,div,span,time]", "li[a,a,div,span,time,ul]"}


def test_categories(spark):
    df = spark.createDataFrame([("Leave a comment in our Forum", ["comments", "forum"]), ("nothing", []), ("Q&A", ["discussion"]), ("q&a", [])], "t string, want array<string>")
    for r in crawl.with_categories(df, "got", "t").collect():
        assert r.got == r.want


def test_frontier_and_ancestry(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    got = {r.id: r.depth for r in crawl.frontier(spark.createDataFrame([(1,)], "id int"), links, 2).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    pages = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, parent_page_id int")
    assert sorted((r.id, r.steps) for r in crawl.ancestry(pages, spark.createDataFrame([(3,)], "id int")).collect()) == [(1, 2), (2, 1), (3, 0)]


def test_ancestry_of_long_chains_and_cycles(spark):
    pages = spark.createDataFrame([(k, k - 1 if k else None) for k in range(90)] + [(100, 101), (101, 100)], "id int, parent_page_id int")
    got = crawl.ancestry(pages, spark.createDataFrame([(80,), (100,)], "id int")).collect()
    assert sorted((r.id, r.steps) for r in got if r.start == 80) == [(80 - k, k) for k in range(80, -1, -1)]
    assert sorted((r.id, r.steps) for r in got if r.start == 100) == [(100, 0), (101, 1)]


@pytest.mark.parametrize("category", crawl.CATEGORIES)
def test_needles_are_in_every_pattern(category):
    for pattern in crawl.CATEGORIES[category]:
        assert crawl.needle(pattern) in pattern.lower()


@pytest.mark.parametrize("n, want", [(1, 0), (2, 2), (4, 3), (8, 8), (14, 8), (15, 15), (24, 15), (25, 25)])
def test_tier(n, want):
    assert tier(n) == want


def test_crossed_like_counting_up():
    for before in range(0, 50, 3):
        for after in range(before, 70, 7):
            assert crossed(before, after) == sorted({tier(n) for n in range(before + 1, after + 1)} - {tier(before)} - {0})
