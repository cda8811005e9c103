import pytest
from pyspark.sql import functions as F

from agora.functions import hashing, numbers, text, urls
from agora.operators import crawl, metrics, monitor, store


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("s, want", [("", 2166136261), ("a", 3826002220), ("example.com", 1125968678)])
def test_fnv(spark, s, want):
    assert one(spark, hashing.fnv1a32(F.col("s")), s=s) == want


def test_hash31(spark):
    assert one(spark, hashing.hash31(F.col("s")), s="abc") == 96354


@pytest.mark.parametrize("url, want", [("example.com/x", "https://example.com/x"), ("//cdn.a.io/x", "https://cdn.a.io/x"), ("localhost", "localhost"), ("HTTP://A", "HTTP://A"), ("", "")])
def test_input_url(spark, url, want):
    assert one(spark, urls.normalized_input(F.col("u")), u=url) == want


@pytest.mark.parametrize("url, want", [("https://www.A.com/x", "a.com"), ("WWW.b.org/p", "b.org"), ("http://u:p@c.io:80/", "c.io")])
def test_hostname(spark, url, want):
    assert one(spark, urls.hostname(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    "item, target, required, want",
    [("https://a.com/p?utm_source=x", "https://a.com/p", False, 100), ("https://a.com/p/", "https://a.com/p", False, 85), ("https://a.com/x", "https://a.com/y", True, 65), ("https://a.com/q/z", "https://a.com/r/z", False, 72), ("https://a.com/p?id=1&z=1", "https://a.com/p?id=1", False, 95), ("https://a.com/", "https://b.com/", False, 0)],
)
def test_lookup_score(spark, item, target, required, want):
    df = spark.createDataFrame([(item, target)], "i string, t string").select(urls.lookup_parts("i").alias("i"), urls.lookup_parts("t").alias("t"))
    assert df.select(urls.match_score(F.col("i"), F.col("t"), F.lit(required)).alias("x")).first()["x"] == want


@pytest.mark.parametrize("counts, want", [((3, 0, 0, 0, 3, 0), "completed"), ((3, 0, 0, 0, 2, 1), "completed_with_errors"), ((3, 0, 0, 0, 0, 3), "failed"), ((3, 2, 0, 0, 1, 0), "running"), ((3, 0, 3, 0, 0, 0), "queued"), ((3, 3, 0, 0, 0, 0), "pending"), ((0, 0, 0, 0, 0, 0), "pending")])
def test_status_ladder(spark, counts, want):
    assert one(spark, store.status_ladder(*map(F.lit, counts))) == want


def rows(spark, values):
    return spark.createDataFrame([("i", k, y, p) for k, (p, y) in enumerate(values)], "item_id string, id int, binary_label int, probability double")


def test_curves(spark):
    df = rows(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)])
    assert metrics.roc_auc(df, "id").first()[0] == 0.75
    assert metrics.pr_auc(df, "id").first()[0] == 0.791667
    assert metrics.roc_auc(rows(spark, [(0.5, 0), (0.5, 1)]), "id").first()[0] == 0
    assert metrics.roc_auc(rows(spark, [(0.5, 1), (0.5, 0)]), "id").first()[0] == 1
    assert metrics.roc_auc(rows(spark, [(0.5, 1)]), "id").first()[0] is None


def test_ranking(spark):
    found = metrics.ranking(rows(spark, [(0.9, 0), (0.8, 1), (0.7, 0)]), "id").first()
    assert (found.mean_reciprocal_rank, found.top_1_accuracy, found.recall_at_3) == (0.5, 0, 1)


def test_stat_summary(spark):
    df = spark.createDataFrame([("a", v) for v in (0.7, 0.8, 0.9)], "k string, v double")
    assert tuple(metrics.stat_summary(df, ["k"], "v").first())[1:] == (3, 0.8, 0.1, 0.551586, 1.048414) or abs(metrics.stat_summary(df, ["k"], "v").first().ci_low - 0.5516) < 1e-3


@pytest.mark.parametrize("n, want", [(0, 0.0), (1, 0.25), (3, 0.75), (6, 1.0)])
def test_relevance(spark, n, want):
    assert one(spark, crawl.relevance(F.array_repeat(F.lit("c"), n))) == want


def test_rounding(spark):
    assert one(spark, text.half_up(F.lit(-0.5))) == 0
    assert one(spark, numbers.ratio(F.lit(1), F.lit(3))) == 0.333
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0))) == 0


def test_keyword_text(spark):
    df = spark.createDataFrame([("Réponses ÀÉ ﬁ",), (None,)], "t string").select(text.keyword_text("t").alias("x"))
    assert [r.x for r in df.collect()] == ["reponses ae fi", ""]


def test_statistics(spark):
    df = spark.createDataFrame([("One two.  Three! ",), (None,)], "t string")
    got = df.select(*(c.alias(n) for n, c in text.statistics(text.squeezed(F.col("t"))).items())).collect()
    assert got[0].text_word_count == 3 and got[0].text_sentence_count == 2
    assert got[1].text_word_count == 0 and got[1].avg_word_length == 0


def test_matches_like_brute_force(spark):
    """The best of all items of a query's host, whatever parts they are ranked in."""
    urls_ = [f"https://h{k % 3}.org/{'abc'[k % 2]}/{k % 5}?id={k % 4}" for k in range(200)]
    parts = spark.createDataFrame(list(enumerate(urls_)), "item_id long, url string").select("item_id", urls.lookup_parts("url").alias("u"), (F.col("item_id") % 7 == 0).alias("required"), F.lit(False).alias("snapshot"))
    asked = parts.where("item_id < 6").select(F.col("item_id").alias("query_id"), "u")
    got = {(r.query_id, r["rank"]): (r.score, r.item_id) for r in monitor.matched(asked, parts, 5).collect()}
    every = asked.alias("q").crossJoin(parts.alias("i")).select("query_id", "item_id", "required", urls.match_score(F.col("q.u"), F.col("i.u"), F.col("required")).alias("score")).collect()
    for k in range(6):
        best = sorted((-r.score, not r.required, r.item_id) for r in every if r.query_id == k and r.score >= 60)[:5]
        assert [got[k, n + 1] for n in range(5)] == [(-s, i) for s, _, i in best]
