"""What a text must have for a pattern leaves none out that the pattern finds."""

import random

from pyspark.sql import functions as F

from agora.functions.text import plain
from agora.operators import discovery, dom, features
from agora.sources import html

PARTS = [
    "2021-5-12", "3/4/21", "May 5, 2021", "7 sep", "2 hours ago", "9d", "4 / 10", "add to cart", "buy now", "load more", "next page", "show 3 replies", "view 2 repl", "5", "12", "2021", "min", "d", "mo", " ago", "just", " now", "Today", "yesterday", "-", "/", "May", "sept", ",", "$", "€", "4.99", "price", "USD", "EUR", "gbp", "[Deleted]", "[hidden]", "read", "More", "see", "show", "expand", "(edited)", "last", "modified", "UPDATED",
    "pinned", "Sticky", "stickied", "featured", "characters", "left", "chars", "add", "to", "Cart", "bag", "buy", "purchase", "Checkout", "load", "next", "page", "replies", "repl", "hide", "view", "answers", "collapse", "spoiler", "content-warning", "cw:", "sensitive",
    "Comment", "Kommentaré", "odpowiedź", "odpowiedz", "réponse", "Q & A", "q/a", "QA", "discussion", "feedback", "review", "thread", "respuesta", "resposta", "antwort", "forum", "question", "post", "messages", "response", "conversation", "community", "communities",
]


def test_needles(spark):
    rng = random.Random(4)
    texts = [""] + PARTS + ["".join(rng.choice(PARTS) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 5))) for _ in range(6000)]
    rows = features._searched(spark.createDataFrame([(t,) for t in texts], "inner_text string")).withColumn("p", plain(F.col("inner_text")))
    plainly = {n: features._says(F.col("inner_text"), n) for n in features.NEEDLES} | {"high": F.col("p").rlike(dom.HIGH), "medium": F.col("p").rlike(dom.MEDIUM)}
    held = lambda needles: features._holds(F.col("p"), F.lit(False), needles)
    first = {n: features._long_says(n) for n in features.NEEDLES} | {"high": held(features.HIGH_NEEDLES) & plainly["high"], "medium": held(features.MEDIUM_NEEDLES) & plainly["medium"]}
    (found,) = rows.agg(*(F.count_if(c).alias(n) for n, c in plainly.items()), *(F.count_if(c != first[n]).alias(f"{n} differs") for n, c in plainly.items())).collect()
    assert all(found[n] > 5 and found[f"{n} differs"] == 0 for n in plainly), found


def test_texts_are_not_sorted(spark):
    """Roots meet the nodes by one shuffle, and rows are summed up by hash: no text goes through a sort or falls back to one."""
    nodes = html.nodes(spark.createDataFrame([(1, "<body><div><p>a</p><p>b</p></div></body>")], "page_id long, html string"))
    roots = discovery.structured(nodes).where("tag = 'div'").withColumn("candidate_rank", F.lit(1))
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(features._prepared(nodes, roots.localCheckpoint())) == 1
    rows = features.scope(nodes, roots).localCheckpoint()
    flags = features.of_units(rows).drop("u")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in flags and "SortAggregate" not in flags
    whole = features.of_roots(rows, None)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in whole and whole.count("ObjectHashAggregate") == 2
