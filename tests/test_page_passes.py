"""One pass over whole pages against the joins that tell the same."""

from agora.operators import discovery, dom
from agora.sources import html

PAGES = [(1, "<ul><li>a<li>b</ul><p>x<div>y</div>"), (2, "<p>a</p><p>b</p><b>x</b>"), (3, "<i>q</i>"), (4, ""), (5, "<body><ul><li><b>1</b><i>2</i></li><li><i>1</i><b>2</b></li><li>x</li><p>1</p></ul></body><div>after</div>")]
GROUPS = ["child_count", "child_variety", "signature", "sig_group_count", "xpath_star_group_count", "sig_value", "group_kind", "group_value", "repeating_group_count", "sibling_homogeneity_score"]


def test_one_pass_tells_what_joins_told(spark):
    nodes = html.nodes(spark.createDataFrame(PAGES, "page_id long, html string")).cache()
    held = dom.signatures(nodes)
    joined = held.join(dom.repeated(held), ["page_id", "node"], "left").select("page_id", "node", *GROUPS)
    found = discovery.structured(nodes)
    assert sorted(map(tuple, found.select("page_id", "node", *GROUPS).collect()), key=repr) == sorted(map(tuple, joined.collect()), key=repr)
    outside = {(r.page_id, r.tag) for r in found.where("NOT in_body").collect()}
    assert outside == {(5, "div")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
