"""Words that decide a region's score and kind count wherever they stand in its texts and attributes."""

import pytest

from agora.plans import page_plans

WORDS = "plain words that say nothing much " * 12
BUTTONS = ["send this now"] * 3


def page(units, css="x", buttons=()):
    forms = "".join(f"<button>{b}</button>" for b in buttons)
    return f'<html><body><main><div class="{css}">' + "".join(f"<p>{u}</p>" for u in units) + f"</div>{forms}</main></body></html>"


PAIRS = {
    "text": (page([WORDS] * 40 + ["a comment"]), page(["a comment"] + [WORDS] * 40)),
    "third button": (page([WORDS] * 5, buttons=[*BUTTONS, "post your review"]), page([WORDS] * 5, buttons=["post your review", *BUTTONS])),
    "button": (page([WORDS] * 5, buttons=["send " + "it right now " * 4 + "as a review"]), page([WORDS] * 5, buttons=["send as a review " + "it right now " * 4])),
    "attribute": (page([WORDS] * 5, "y " * 90 + "forum"), page([WORDS] * 5, "forum " + "y " * 90)),
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    rows = [(2 * k + n, f"https://h{2 * k + n}.example.org/", html) for k, pair in enumerate(PAIRS.values()) for n, html in enumerate([*pair])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    regions = {r.page_id: r for r in page_plans.candidates(spark, str(folder), "page_id", "score", "ugc_type", "keyword_gate_tier").collect()}
    return regions, {r.hostname: r.best_score for r in page_plans.host_summary(spark, str(folder)).collect()}


@pytest.mark.parametrize("name", PAIRS)
def test_the_end_counts_as_the_beginning(found, name):
    regions, best = found
    k = 2 * [*PAIRS].index(name)
    late, early = regions[k], regions[k + 1]
    assert (late.score, late.ugc_type, late.keyword_gate_tier) == (early.score, early.ugc_type, early.keyword_gate_tier)
    assert best[f"h{k}.example.org"] == best[f"h{k + 1}.example.org"] == late.score
    assert late.keyword_gate_tier == "strong_keywords"
