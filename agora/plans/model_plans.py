"""Queries of evaluation and modeling: labelled documents are candidates, sources their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions.numbers import round6
from agora.functions.urls import hostname
from agora.operators import artifacts, metrics, modeling, sampling, splits, training
from agora.plans.registry import query, table
from agora.session import written
from agora.plans.text_plans import _HOST


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a made-up but fixed probability."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    p = (F.col("n_chars") * 7919 + F.col("doc_id") * 104729) % 10007 / 10006.0
    return docs.select(F.col("doc_id").alias("dataset_row_id"), F.col("source").alias("item_id"), F.col("quality").alias("binary_label"), p.alias("probability"))


SCORED = "WITH s AS (SELECT doc_id AS dataset_row_id, source AS item_id, quality AS binary_label, ((n_chars * 7919 + doc_id * 104729) % 10007) / 10006.0::DOUBLE AS probability FROM documents JOIN labels USING (doc_id))"
_RATES = "floor(p * 1e6 + 0.5) / 1e6 AS precision, floor(r * 1e6 + 0.5) / 1e6 AS recall, floor(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END * 1e6 + 0.5) / 1e6 AS f1, floor((tp + tn)::DOUBLE / (tp + fp + fn + tn) * 1e6 + 0.5) / 1e6 AS accuracy"


@query(SCORED + f""", c AS (SELECT count(*) FILTER (WHERE probability >= 0.5 AND binary_label = 1) AS tp, count(*) FILTER (WHERE probability >= 0.5 AND binary_label = 0) AS fp, count(*) FILTER (WHERE probability < 0.5 AND binary_label = 1) AS fn, count(*) FILTER (WHERE probability < 0.5 AND binary_label = 0) AS tn FROM s),
r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM c) SELECT tp, fp, fn, tn, {_RATES} FROM r""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir))


@query(SCORED + """, w AS (SELECT *, sum(binary_label) OVER o AS tp, sum(1 - binary_label) OVER o AS fp FROM s WINDOW o AS (ORDER BY probability DESC, dataset_row_id ROWS UNBOUNDED PRECEDING)), t AS (SELECT sum(binary_label)::DOUBLE AS p, sum(1 - binary_label)::DOUBLE AS n FROM s),
d AS (SELECT tp / p AS y, fp / n AS x, lag(tp / p, 1, 0) OVER (ORDER BY probability DESC, dataset_row_id) AS y0, lag(fp / n, 1, 0) OVER (ORDER BY probability DESC, dataset_row_id) AS x0 FROM w, t) SELECT floor(sum((x - x0) * (y + y0) / 2) * 1e6 + 0.5) / 1e6 AS roc_auc FROM d""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(scored(spark, sf_dir), "dataset_row_id")


@query(SCORED + """, w AS (SELECT *, sum(binary_label) OVER o AS tp, sum(1 - binary_label) OVER o AS fp FROM s WINDOW o AS (ORDER BY probability DESC, dataset_row_id ROWS UNBOUNDED PRECEDING)), t AS (SELECT sum(binary_label)::DOUBLE AS p FROM s),
d AS (SELECT tp / p AS x, tp::DOUBLE / (tp + fp) AS y, lag(tp / p, 1, 0) OVER (ORDER BY probability DESC, dataset_row_id) AS x0, lag(tp::DOUBLE / (tp + fp), 1, 1) OVER (ORDER BY probability DESC, dataset_row_id) AS y0 FROM w, t) SELECT floor(sum((x - x0) * (y + y0) / 2) * 1e6 + 0.5) / 1e6 AS pr_auc FROM d""")
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_auc(scored(spark, sf_dir), "dataset_row_id")


@query(SCORED + """, k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY probability DESC, dataset_row_id) AS rank FROM s), i AS (SELECT item_id, min(CASE WHEN binary_label = 1 THEN rank END) AS first FROM k GROUP BY item_id)
SELECT count(*) AS eligible_item_count, floor(count(*) FILTER (WHERE first = 1)::DOUBLE / count(*) * 1e6 + 0.5) / 1e6 AS top_1_accuracy, floor(sum(1.0::DOUBLE / first) / count(*) * 1e6 + 0.5) / 1e6 AS mean_reciprocal_rank, floor(count(*) FILTER (WHERE first <= 3)::DOUBLE / count(*) * 1e6 + 0.5) / 1e6 AS recall_at_3 FROM i WHERE first IS NOT NULL""")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking(scored(spark, sf_dir), "dataset_row_id")


@query("""WITH s AS (SELECT conv_id AS item_id, turn % 7 = 3 AS pos, ((conv_id * 7919 + turn * 104729) % 10007) / 10006.0::DOUBLE AS p FROM conversations), i AS (SELECT item_id, bool_or(pos) AS positive, bool_or(pos AND p >= 0.5) AS ok, max(p) AS most FROM s GROUP BY item_id)
SELECT count(*) AS eligible_item_count, floor(coalesce(count(*) FILTER (WHERE positive AND ok)::DOUBLE / nullif(count(*) FILTER (WHERE positive), 0), 0) * 1e6 + 0.5) / 1e6 AS page_has_correct_candidate_rate, floor(coalesce(count(*) FILTER (WHERE NOT positive AND most >= 0.5)::DOUBLE / nullif(count(*) FILTER (WHERE NOT positive), 0), 0) * 1e6 + 0.5) / 1e6 AS false_positive_page_rate,
  floor(count(*) FILTER (WHERE most < 0.8 AND most > 0.2)::DOUBLE / count(*) * 1e6 + 0.5) / 1e6 AS manual_review_rate, floor(coalesce(count(*) FILTER (WHERE NOT positive AND most >= 0.8)::DOUBLE / nullif(count(*) FILTER (WHERE NOT positive), 0), 0) * 1e6 + 0.5) / 1e6 AS overconfident_false_positive_page_rate FROM i""")
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), (F.col("turn") % 7 == 3).cast("int").alias("binary_label"), ((F.col("conv_id") * 7919 + F.col("turn") * 104729) % 10007 / 10006.0).alias("probability"))
    return metrics.pages(rows)


@query(SCORED + """ SELECT CAST(b.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_predicted, fraction_positive FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN (SELECT least(floor(probability * 10), 9) AS bin, count(*) AS n, floor(avg(probability) * 1e6 + 0.5) / 1e6 AS mean_predicted, floor(avg(binary_label) * 1e6 + 0.5) / 1e6 AS fraction_positive FROM s GROUP BY 1) c ON b.bin = c.bin""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration(scored(spark, sf_dir))


@query(SCORED + f""", c AS (SELECT t / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE probability + 1e-11 >= t / 100.0::DOUBLE AND binary_label = 1) AS tp, count(*) FILTER (WHERE probability + 1e-11 >= t / 100.0::DOUBLE AND binary_label = 0) AS fp, count(*) FILTER (WHERE probability + 1e-11 < t / 100.0::DOUBLE AND binary_label = 1) AS fn, count(*) FILTER (WHERE probability + 1e-11 < t / 100.0::DOUBLE AND binary_label = 0) AS tn FROM s, (SELECT unnest(range(101)) AS t) GROUP BY t),
r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM c) SELECT threshold, tp, fp, fn, tn, {_RATES} FROM r""")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_curve(scored(spark, sf_dir))


@query(SCORED + """, c AS (SELECT t / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE probability + 1e-11 >= t / 100.0::DOUBLE AND binary_label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE probability + 1e-11 >= t / 100.0::DOUBLE)::DOUBLE AS yes, count(*) FILTER (WHERE binary_label = 1)::DOUBLE AS pos FROM s, (SELECT unnest(range(101)) AS t) GROUP BY t),
f AS (SELECT threshold, floor(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / yes) * (tp / pos) / (tp / yes + tp / pos) END * 1e6 + 0.5) / 1e6 AS f1 FROM c) SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(metrics.threshold_curve(scored(spark, sf_dir)))


@query("""WITH a AS (SELECT event_type, count(value) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM events GROUP BY event_type) SELECT event_type, n, floor(m * 1e6 + 0.5) / 1e6 AS mean, floor(s * 1e6 + 0.5) / 1e6 AS std, floor((m - 1.96 * s / sqrt(n)) * 1e6 + 0.5) / 1e6 AS ci_low, floor((m + 1.96 * s / sqrt(n)) * 1e6 + 0.5) / 1e6 AS ci_high FROM a""")
def stat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stat_summary(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(SCORED + """ SELECT item_id, count(*) FILTER (WHERE probability >= 0.5 AND binary_label = 1) AS tp, count(*) FILTER (WHERE probability >= 0.5 AND binary_label = 0) AS fp, count(*) FILTER (WHERE probability < 0.5 AND binary_label = 1) AS fn, count(*) FILTER (WHERE probability < 0.5 AND binary_label = 0) AS tn FROM s GROUP BY item_id""")
def domain_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, pos = F.col("probability") >= 0.5, F.col("binary_label") == 1
    return scored(spark, sf_dir).groupBy("item_id").agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(~yes & ~pos).alias("tn"))


@query(SCORED + """ SELECT p AS positive, n AS negative, floor(p::DOUBLE / (p + n) * 1e6 + 0.5) / 1e6 AS positive_share, floor(greatest(p, n)::DOUBLE / least(p, n) * 1e6 + 0.5) / 1e6 AS imbalance_ratio, CASE WHEN p <= n THEN 'positive' ELSE 'negative' END AS minority FROM (SELECT count(*) FILTER (WHERE binary_label = 1) AS p, count(*) FILTER (WHERE binary_label = 0) AS n FROM s)""")
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modeling.balance(scored(spark, sf_dir))


@query("""WITH d AS (SELECT source AS item_id, doc_id, CASE WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'comment_region' WHEN quality = 0 THEN 'not_comment_region' END AS label FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS rows, count(*) FILTER (WHERE label = 'comment_region') AS positive, count(*) FILTER (WHERE label = 'not_comment_region') AS negative, count(*) FILTER (WHERE label = 'uncertain') AS uncertain, count(*) FILTER (WHERE label IS NULL) AS unlabeled, count(DISTINCT item_id) AS items FROM d""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "comment_region").when(F.col("quality") == 0, "not_comment_region")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("label", label)
    per = rows.groupBy("source").agg(F.count("*").alias("rows"), *(F.count_if(F.col("label") == v).alias(n) for n, v in (("positive", "comment_region"), ("negative", "not_comment_region"), ("uncertain", "uncertain"))), F.count_if(F.col("label").isNull()).alias("unlabeled"))
    return per.agg(*(F.sum(c).alias(c) for c in ("rows", "positive", "negative", "uncertain", "unlabeled")), F.count("*").alias("items"))


NUMERIC, CATEGORICAL = ["n_chars", "words"], ["lang"]
NAMES = [*NUMERIC, "lang=de", "lang=en", "lang=es", "lang=fr"]
#: A fixed model for the queries that only apply one.
WEIGHTS, BIAS = [0.5, -0.25, 0.1, 0.2, -0.1, 0.3], -0.2


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select("doc_id", F.col("quality").alias("binary_label"), "n_chars", F.regexp_count("text", F.lit(" ")).alias("words"), "lang")
    return rows.withColumn("features", modeling.vector(modeling.fit_vectorizer(rows, NUMERIC, CATEGORICAL)))


_FEATURES = """WITH r AS (SELECT doc_id, quality, n_chars::DOUBLE AS a, len(regexp_extract_all(text, ' '))::DOUBLE AS b, lang FROM documents JOIN labels USING (doc_id)), m AS (SELECT avg(a) AS am, stddev_pop(a) AS sa, avg(b) AS bm, stddev_pop(b) AS sb FROM r),
f AS (SELECT doc_id, quality, (a - am) / sa AS x0, (b - bm) / sb AS x1, (lang = 'de')::INT AS x2, (lang = 'en')::INT AS x3, (lang = 'es')::INT AS x4, (lang = 'fr')::INT AS x5 FROM r, m)"""
_SCORE = "(0.5::DOUBLE * x0 - 0.25::DOUBLE * x1 + 0.1::DOUBLE * x2 + 0.2::DOUBLE * x3 - 0.1::DOUBLE * x4 + 0.3::DOUBLE * x5 - 0.2::DOUBLE)"


@query("SELECT 'n_chars' AS feature, floor(avg(n_chars) * 1e4 + 0.5) / 1e4 AS mean, floor(stddev_pop(n_chars) * 1e4 + 0.5) / 1e4 AS std FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'words', floor(avg(len(regexp_extract_all(text, ' '))) * 1e4 + 0.5) / 1e4, floor(stddev_pop(len(regexp_extract_all(text, ' '))) * 1e4 + 0.5) / 1e4 FROM documents JOIN labels USING (doc_id)")
def vectorizer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("words", F.regexp_count("text", F.lit(" ")))
    fitted = modeling.fit_vectorizer(rows, NUMERIC, CATEGORICAL)
    cut = lambda x: float(int(x * 1e4 + 0.5)) / 1e4
    return spark.createDataFrame([(c, cut(m), cut(s)) for c, (m, s) in fitted["numeric"].items()], "feature string, mean double, std double")


@query(_FEATURES + " SELECT doc_id, floor(x0 * 1e4 + 0.5) / 1e4 AS x0, floor(x1 * 1e4 + 0.5) / 1e4 AS x1, x2::DOUBLE AS x2, x3::DOUBLE AS x3 FROM f")
def vectorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda k: F.floor(F.col("features")[k] * 1e4 + 0.5) / 1e4
    return features(spark, sf_dir).select("doc_id", cut(0).alias("x0"), cut(1).alias("x1"), F.col("features")[2].alias("x2"), F.col("features")[3].alias("x3"))


@query(_FEATURES + f" SELECT doc_id, floor(1 / (1 + exp(-{_SCORE})) * 1e6 + 0.5) / 1e6 AS probability, ({_SCORE} >= 0)::INT AS predicted_label FROM f")
def dot_product_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = modeling.predicted(features(spark, sf_dir), {"weights": WEIGHTS, "bias": BIAS})
    return out.select("doc_id", "probability", "predicted_label")


@query(_FEATURES + """, p AS (SELECT 'n_chars' AS feature, x0 * 0.5::DOUBLE AS v FROM f UNION ALL SELECT 'words', x1 * -0.25::DOUBLE FROM f UNION ALL SELECT 'lang=de', x2 * 0.1::DOUBLE FROM f UNION ALL SELECT 'lang=en', x3 * 0.2::DOUBLE FROM f UNION ALL SELECT 'lang=es', x4 * -0.1::DOUBLE FROM f UNION ALL SELECT 'lang=fr', x5 * 0.3::DOUBLE FROM f)
SELECT feature, floor(avg(abs(v)) * 1e5 + 0.5) / 1e5 AS mean_abs_contribution FROM p GROUP BY feature""")
def feature_reliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = modeling.reliance(features(spark, sf_dir), WEIGHTS, NAMES)
    return out.select("feature", (F.floor(F.col("mean_abs_contribution") * 1e5 + 0.5) / 1e5).alias("mean_abs_contribution"))


@query(_FEATURES + """, c AS (SELECT doc_id, [{'v': 0.5::DOUBLE * x0, 'n': 'n_chars'}, {'v': -0.25::DOUBLE * x1, 'n': 'words'}, {'v': 0.1::DOUBLE * x2, 'n': 'lang=de'}, {'v': 0.2::DOUBLE * x3, 'n': 'lang=en'}, {'v': -0.1::DOUBLE * x4, 'n': 'lang=es'}, {'v': 0.3::DOUBLE * x5, 'n': 'lang=fr'}] AS c FROM f)
SELECT doc_id, array_to_string(list_transform(list_reverse_sort(list_filter(c, lambda e: e.v > 0))[1:3], lambda e: e.n), ',') AS raises, array_to_string(list_transform(list_sort(list_filter(c, lambda e: e.v < 0))[1:3], lambda e: e.n), ',') AS lowers FROM c""")
def explain_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modeling.contributions(features(spark, sf_dir), WEIGHTS, NAMES, 3).select("doc_id", F.array_join(F.transform("top_positive", lambda c: c["name"]), ",").alias("raises"), F.array_join(F.transform("top_negative", lambda c: c["name"]), ",").alias("lowers"))


@query()
def logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 rounds of descent with classes weighted, then scores of all rows."""
    rows = features(spark, sf_dir)
    return modeling.predicted(rows, training.fit_balanced(rows, len(NAMES))._asdict()).select("doc_id", "probability", "predicted_label")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with whole numbers as features: lengths, words, marks and the language's place."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    numbers = [F.col("n_chars"), F.regexp_count("text", F.lit(" ")), F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.col("n_chars") % 10]
    rows = docs.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("binary_label"), F.array(*(c.cast("double") for c in numbers)).alias("features"))
    return written(rows, "labelled")


_LABELLED = """WITH r AS (SELECT doc_id, quality AS y, n_chars::DOUBLE AS f0, len(regexp_extract_all(text, ' '))::DOUBLE AS f1, len(regexp_extract_all(text, '[#*$%&|<>]'))::DOUBLE AS f2, (n_chars % 10)::DOUBLE AS f3 FROM documents JOIN labels USING (doc_id)),
l AS (SELECT 0 AS feature, f0 AS v, y FROM r UNION ALL SELECT 1, f1, y FROM r UNION ALL SELECT 2, f2, y FROM r UNION ALL SELECT 3, f3, y FROM r), g AS (SELECT feature, v, count(*) AS m, sum(y) AS t FROM l GROUP BY ALL),
c AS (SELECT feature, v, lead(v) OVER w AS nv, sum(m) OVER u AS nl, sum(t) OVER u AS sl, sum(m) OVER (PARTITION BY feature) AS n, sum(t) OVER (PARTITION BY feature) AS s FROM g WINDOW w AS (PARTITION BY feature ORDER BY v), u AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, sl / nl AS pl, (s - sl) / (n - nl) AS pr, s / n AS p FROM c WHERE nv IS NOT NULL), x AS (SELECT *, (1.0::DOUBLE - p * p - (1.0::DOUBLE - p) * (1.0::DOUBLE - p)) - (nl / n) * (1.0::DOUBLE - pl * pl - (1.0::DOUBLE - pl) * (1.0::DOUBLE - pl)) - ((n - nl) / n) * (1.0::DOUBLE - pr * pr - (1.0::DOUBLE - pr) * (1.0::DOUBLE - pr)) AS gain FROM p)"""


@query(_LABELLED + " SELECT CAST(feature AS INTEGER) AS feature, (v + nv) / 2 AS threshold, CAST(nl AS BIGINT) AS nl, CAST(sl AS BIGINT) AS positive_left, floor(gain * 1e9 + 0.5) / 1e9 AS gain FROM x ORDER BY x.gain DESC, feature, threshold LIMIT 1")
def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root's split of all labelled rows, over every feature and value."""
    rows = labelled(spark, sf_dir).select(F.lit(0).alias("tree"), F.lit(0).alias("node"), F.lit(1).cast("long").alias("times"), F.col("binary_label").cast("long").alias("target"), F.posexplode("features").alias("feature", "value"))
    found = splits.best_splits(rows, "classes", [])
    return found.select("feature", "threshold", "nl", F.col("sl").alias("positive_left"), (F.floor(F.col("gain") * 1e9 + 0.5) / 1e9).alias("gain"))


@query()
def decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row by an exact tree of depth 6, with what each feature added."""
    rows = labelled(spark, sf_dir)
    return splits.predicted(rows, splits.fit("decision_tree", rows, 4)).select("row_id", "binary_label", "probability", "predicted_label")


@query()
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return splits.predicted(rows, splits.fit("random_forest", rows, 4)).select("row_id", "binary_label", "probability", "predicted_label")


@query()
def gradient_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return splits.predicted(rows, splits.fit("gradient_boosting", rows, 4)).select("row_id", "binary_label", "probability", "predicted_label")


@query("SELECT doc_id AS row_id, true AS whole FROM documents JOIN labels USING (doc_id)")
def explain_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what the features add to the root's share makes up each row's probability."""
    rows = labelled(spark, sf_dir)
    found = splits.predicted(rows, splits.fit("decision_tree", rows, 4))
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    return found.select("row_id", (F.abs(total - F.col("probability")) < 1e-9).alias("whole"))


@query("""WITH r AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS p FROM documents JOIN labels USING (doc_id)) SELECT n AS draws, 0::BIGINT AS unknown, abs(0.5 - 0.5) < 0.1 AS even FROM r""")
def weighted_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as rows, all of known rows, and both classes alike."""
    rows = labelled(spark, sf_dir)
    drawn = sampling.class_weighted(rows).join(rows, "row_id", "left")
    return drawn.agg(F.count("*").alias("draws"), F.count_if(F.col("binary_label").isNull()).alias("unknown"), (F.abs(F.avg("binary_label") - 0.5) < 0.1).alias("even"))


#: A fixed artifact over whole numbers, for the queries that only apply one.
ARTIFACT = {"algorithm": "logistic_regression", "threshold": 0.5, "vectorizer": {"numeric": {"n_chars": (1000.0, 2000.0), "words": (200.0, 400.0)}, "categorical": {"lang": ["de", "en", "es", "fr"]}}, "model": {"algorithm": "logistic_regression", "weights": WEIGHTS, "bias": BIAS}}


@query(
    """WITH r AS (SELECT doc_id, source, 0.5::DOUBLE * ((n_chars - 1000.0::DOUBLE) / 2000.0::DOUBLE) + -0.25::DOUBLE * ((len(regexp_extract_all(text, ' ')) - 200.0::DOUBLE) / 400.0::DOUBLE) + 0.1::DOUBLE * (lang = 'de')::INT + 0.2::DOUBLE * (lang = 'en')::INT + -0.1::DOUBLE * (lang = 'es')::INT + 0.3::DOUBLE * (lang = 'fr')::INT - 0.2::DOUBLE AS s FROM documents JOIN labels USING (doc_id)),
p AS (SELECT source AS item_id, 1 / (1 + exp(-s)) AS p FROM r) SELECT item_id, count(*) AS candidates, CAST(count(*) FILTER (WHERE p >= 0.5) AS BIGINT) AS positives, floor(avg(p) * 1e6 + 0.5) / 1e6 AS mean_probability, floor(max(p) * 1e6 + 0.5) / 1e6 AS best_probability FROM p GROUP BY item_id"""
)
def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored by an artifact, summed up by their items."""
    found = artifacts.summed(artifacts.scored(candidates(spark, sf_dir), ARTIFACT), "item_id", "dataset_row_id")
    return found.select("item_id", "candidates", "positives", round6(F.col("mean_probability")).alias("mean_probability"), round6(F.col("best_probability")).alias("best_probability"))


@query()
def trained_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, vectorizer, boosting and metrics in one go; every candidate by the artifact that comes out."""
    rows = candidates(spark, sf_dir)
    made = artifacts.train(rows, F.col("item_id"), "dataset_row_id", NUMERIC, CATEGORICAL, "decision_tree", "class_weighted")
    return artifacts.scored(rows, made).select("dataset_row_id", "binary_label", "predicted_label", "probability")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as candidate rows of their sources, with the features of ``NUMERIC`` and ``CATEGORICAL``."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(F.col("doc_id").alias("dataset_row_id"), F.col("source").alias("item_id"), F.col("quality").alias("binary_label"), "n_chars", F.regexp_count("text", F.lit(" ")).alias("words"), "lang")


_BUCKET = "CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(source, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 5 AS BIGINT)"
_FOLDS = f"WITH r AS (SELECT doc_id, source, quality, {_BUCKET} AS fold FROM documents JOIN labels USING (doc_id)), t AS (SELECT count(*) AS n, sum(quality) AS p FROM r), f AS (SELECT fold, count(*) AS n_rows, sum(quality) AS n_positive FROM r GROUP BY fold)"


@query(f"""WITH r AS (SELECT quality, {_BUCKET} AS fold FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM r WHERE fold <> 0)
SELECT s AS strategy, p AS positive_before, n AS negative_before, floor(CASE s WHEN 'baseline' THEN p WHEN 'class_weighted' THEN (p + n) / 2.0 WHEN 'undersample' THEN least(p, n) ELSE greatest(p, n) END * 1e6 + 0.5) / 1e6 AS positive_after, floor(CASE s WHEN 'baseline' THEN n WHEN 'class_weighted' THEN (p + n) / 2.0 WHEN 'undersample' THEN least(p, n) ELSE greatest(p, n) END * 1e6 + 0.5) / 1e6 AS negative_after FROM c, (SELECT unnest(['baseline', 'class_weighted', 'undersample', 'oversample', 'smote']) AS s)""")
def imbalance_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class sizes of the training rows before and after each way to treat their imbalance."""
    rows = training.held_out(candidates(spark, sf_dir), F.col("item_id"), "dataset_row_id")
    held, _ = training.features(rows, NUMERIC, CATEGORICAL)
    return training.prepared(held.where("NOT held_out"), "dataset_row_id")[1]


@query("""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS near_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.label = 0 AND b.label = 0)
SELECT id, CAST(r AS INTEGER) AS rank, floor(d * 1e4 + 0.5) / 1e4 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, near_id) AS r FROM p) WHERE r <= 5""")
def knn_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    return modeling.nearest(rows, 5).select("id", "rank", (F.floor(F.col("distance") * 1e4 + 0.5) / 1e4).alias("distance"))


@query()
def smote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    return modeling.smote(rows).select("id", "near_id", F.size("features").alias("width"))


@query(_FOLDS + " SELECT fold, f.n_rows, CAST(f.n_positive AS BIGINT) AS n_positive, t.n - f.n_rows AS train_rows FROM f, t WHERE f.n_positive > 0 AND f.n_positive < f.n_rows AND t.p - f.n_positive > 0 AND t.p - f.n_positive < t.n - f.n_rows")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds by item, each trained and scored: their sizes; ``cross_validation_metrics`` has the rest."""
    found = training.cross_validated(candidates(spark, sf_dir), F.col("item_id"), "dataset_row_id", NUMERIC, CATEGORICAL)
    return found.select("fold", "n_rows", "n_positive", "train_rows")


@query()
def cross_validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, areas and ranks of five fitted folds."""
    return training.cross_validated(candidates(spark, sf_dir), F.col("item_id"), "dataset_row_id", NUMERIC, CATEGORICAL)


@query()
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of a fifth to all of each class, on their own rows and on those held out."""
    return training.learning_curve(candidates(spark, sf_dir), F.col("item_id"), "dataset_row_id", NUMERIC, CATEGORICAL)


@query()
def strategy_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.leaderboard(training.compared(candidates(spark, sf_dir), F.col("item_id"), "dataset_row_id", NUMERIC, CATEGORICAL))


@query(f"SELECT held_out, count(*) AS n FROM (SELECT {_BUCKET.replace('source', 'h')} = 0 AS held_out FROM (SELECT {_HOST} AS h FROM pages)) GROUP BY held_out")
def domain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modeling.split(table(spark, sf_dir, "pages"), hostname(F.col("url"))).groupBy("held_out").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT conv_id, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN NULL ELSE 0 END AS binary_label FROM conversations), d AS (SELECT *, count(*) OVER w = count(binary_label) OVER w AS review_complete FROM c WINDOW w AS (PARTITION BY conv_id))
SELECT binary_label, review_complete, count(*) AS n FROM d GROUP BY 1, 2""")
def review_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items, turns as candidates; every system and user turn has a review, the last one counts."""
    turns = table(spark, sf_dir, "conversations")
    candidate = F.struct(F.col("turn").cast("string").alias("candidate_key"), F.length("text").alias("total_text_length"))
    items = turns.groupBy(F.col("conv_id").alias("item_id")).agg(F.array_sort(F.collect_list(candidate)).alias("candidates"))
    reviews = turns.where("role <> 'assistant'").select(F.col("conv_id").alias("item_id"), F.col("turn").cast("string").alias("candidate_key"), F.when(F.col("role") == "user", "comment_region").otherwise("not_comment_region").alias("label"), F.lit(None).cast("string").alias("notes"), F.col("turn").alias("updated_at"))
    return modeling.dataset(modeling.reviewed(items, reviews)).groupBy("binary_label", "review_complete").agg(F.count("*").alias("n"))
