"""Keyed trees of live pages against replays of their logs; rings; rules for what is inserted."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from agora.operators import monitor
from agora.plans import stream_plans
from agora.plans.registry import table
from agora.streaming import security, streams, trees


def random_log(rng, n, nodes=30, page=1):
    log = []
    for seq in range(n):
        kind = rng.choices(["insert", "remove", "attribute"], [6, 1, 2])[0]
        node = rng.randrange(1, nodes)
        target = rng.randrange(5) if rng.random() < 0.85 else rng.randrange(nodes)
        target = 0 if node < 5 and kind == "insert" else target
        if kind == "attribute":
            log.append((page, seq, kind, target, None, None, rng.choice(["class", "role", "itemtype"]), rng.choice(["comment list", "comment list", "feed", "feed", "price menu", "card"])))
        else:
            log.append((page, seq, kind, target, node, rng.choice("pppppd") if kind == "insert" else None, None, rng.choice(["<p>", "<script>", "<iframe>"]) if kind == "insert" else None))
    return log


def replay(log):
    """Regions {(page, node): (size, children, activity, raw, score)} of a log, in the order of seq, from nothing."""
    parent, tag, attrs, activity = {}, {}, collections.defaultdict(dict), collections.Counter()
    for page, _, kind, target, node, t, name, value in sorted(log, key=lambda r: r[1]):
        if kind == "attribute":
            attrs[page, target][name] = value
        elif kind == "insert":
            activity[page, target] += 1
            parent[page, node], tag[page, node] = (page, target), t
        else:
            parent.pop((page, node), None)
    children = collections.defaultdict(list)
    for node, up in parent.items():
        children[up].append(node)
    signature = lambda n: (tag.get(n), tuple(sorted(tag[c] for c in children[n])))
    found = {}
    for n, under in [*children.items()]:
        size = max(collections.Counter(map(signature, under)).values(), default=0)
        if len(under) >= 3 and size >= 3:
            up = parent.get(n)
            raw = monitor.live_score(size, size / len(under), activity[n], tag.get(n) or "", attrs[n], (tag.get(up) or "") if up else "", attrs[up] if up else {}, False)
            found[n] = (size, len(under), activity[n], raw)

    def above(n):
        seen = {n}
        n = parent.get(n)
        while n is not None and n not in seen:
            yield n
            seen.add(n)
            n = parent.get(n)

    final = {n: (*v, v[3] * (trees.NESTED if any(found.get(u, (0, 0, 0, 0.0))[3] >= trees.LOW for u in above(n)) else 1.0)) for n, v in found.items()}
    return final, above


@pytest.mark.parametrize("seed", range(6))
def test_any_part_of_a_shuffled_log_is_as_if_built_anew(seed):
    rng = random.Random(seed)
    log = random_log(rng, 160)
    rng.shuffle(log)
    store, seen = {}, 0
    tree = trees.Tree(store.get, store.__setitem__)
    for k, (_, seq, kind, target, node, tag, name, value) in enumerate(log):
        tree.apply(kind, seq, target, node, tag, name, value)
        if rng.random() < 0.2:
            tree.flush()
            tree = trees.Tree(store.get, store.__setitem__)
        want, _ = replay(log[: k + 1])
        got = {n: (tree.at(n).group, tree.at(n).children, tree.at(n).activity, tree.raw(n)) for n in range(30) if tree.raw(n) is not None}
        assert got == {n: v[:4] for (_, n), v in want.items()}, k
        seen += len(got)
    assert seen > 50


def shown(rows):
    return {(r.page, r.node): (r.size, r.children, r.activity, round(r.raw, 9), round(r.score, 9)) for r in rows}


def test_stream_after_every_batch(spark, tmp_path):
    """Files of a shuffled log, a micro-batch each: regions, retractions and guards are those of a replay of the part so far."""
    rng = random.Random(12)
    log = [r for page in (1, 2, 3) for r in random_log(rng, 120, page=page)]
    rng.shuffle(log)
    parts = [log[k : k + 60] for k in range(0, len(log), 60)]
    for part in parts:
        spark.createDataFrame(part, trees.MUTATION).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(trees.MUTATION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    verdict = F.when(F.col("kind") == "insert", security.content(F.col("value"))["action"]).otherwise("pass")
    with stream_plans._keyed_state(spark):
        changes = streams.numbered(trees.followed(stream.withColumn("verdict", verdict)), "update", "test-regions").cache()
    assert changes.select("batch").distinct().count() == len(parts) and changes.where("score < raw").count()
    assert {r.change for r in changes.select("change").distinct().collect()} >= {"found", "changed", "gone"}
    seen = []
    for k in range(len(parts)):
        seen += parts[k]
        want, above = replay(seen)
        got = trees.latest(changes.where(F.col("batch") <= k)).collect()
        assert shown(got) == {n: (*v[:3], round(v[3], 9), round(v[4], 9)) for n, v in want.items()}, k
        judged = {(r.page, r.seq): (r.node, r.action) for r in changes.where((F.col("batch") == k) & F.col("action").isNotNull()).collect()}
        says = {"<script>": "block", "<iframe>": "flag", "<p>": "pass"}
        expect = {}
        for page, seq, kind, target, _, _, _, value in parts[k]:
            if kind == "insert" and says[value] != "pass" and max((want[n][4] for n in ((page, target), *above((page, target))) if n in want), default=0) >= trees.HIGH:
                expect[page, seq] = (target, says[value])
        assert judged == expect


def test_a_guarded_region(spark):
    """Many like entries under a container that says comments and is a feed of a schema type: what is put into it is judged."""
    log = [(1, 1, "insert", 0, 1, "section", None, "<p>"), (1, 2, "attribute", 1, None, None, "class", "comments"), (1, 3, "attribute", 1, None, None, "role", "feed"), (1, 4, "attribute", 1, None, None, "itemtype", "http://schema.org/Comment")]
    log += [(1, 10 + k, "insert", 1, 10 + k, "article", None, "<p>" if k else "<script>") for k in range(16)]
    out = stream_plans.followed(spark, spark.createDataFrame(log, trees.MUTATION)).collect()
    region = [r for r in out if r.change == "found"]
    assert [(r.node, r["size"], round(r.score, 9)) for r in region] == [(1, 16, 0.8)]
    assert [(r.seq, r.node, r.action) for r in out if r.action] == [(10, 1, "block")]


def test_rebuilt_is_what_the_stream_holds(spark, sf_dir):
    log = stream_plans.mutations(spark, "/root/testdata/sf0.01").where("page < 20")
    got = shown(trees.latest(stream_plans.followed(spark, log)).collect())
    want = {(r.page, r.node): (r["size"], r.children, r.activity) for r in trees.rebuilt(log).collect()}
    assert {k: v[:3] for k, v in got.items()} == want and len(want) > 50
    assert any(v[4] < v[3] for v in got.values())


def test_rings_at_every_batch(spark, tmp_path, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(6).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    last, folder = streams.ring(stream, ["event_type"], [F.col("ts"), F.col("event_id")], 7, "test")
    files = sorted({r.f for r in spark.read.parquet(str(tmp_path / "events")).select(F.input_file_name().alias("f")).collect()})
    sizes = []
    for k in range(len(files)):
        held = spark.read.parquet(f"{folder}/{k}")
        sizes.append(held.count())
    assert sizes[-1] == last.count() == 35 and sizes == sorted(sizes)
    top = lambda df: {(r.event_type, r.event_id) for r in trees.merged_ring(None, df, ["event_type"], [F.col("ts"), F.col("event_id")], 7).collect()}
    assert {(r.event_type, r.event_id) for r in last.collect()} == top(rows)
    # every version is the best of what its batches brought: they only ever gain later rows
    floor = {}
    for k in range(len(files)):
        for r in spark.read.parquet(f"{folder}/{k}").groupBy("event_type").agg(F.min("ts").alias("t"), F.count("*").alias("n")).where("n = 7").collect():
            assert r.t >= floor.get(r.event_type, r.t)
            floor[r.event_type] = r.t


FITS = {
    "script_tag": ["<SCRIPT>", "<script src"], "javascript_protocol": ["JavaScript :", "javascript:x"], "event_handler_attr": ["<img onmouseover=x>", "<a ONCLICK ='x'"], "data_uri_sink": ["<a href=data:x", "src = \" data:"],
    "dom_clobbering": ['id="__proto__"', "ID=location"], "iframe_injection": ["<iframe>", "<IFRAME src"], "object_embed": ["<object >", "<embed\n"], "svg_event": ["<svg a onload", "<SVG\n onx"], "css_expression": ["expression ("], "template_injection": ["{{x}}", "a {{}} b"],
}


def test_every_content_rule(spark):
    rows = [(reason, text) for reason, some in FITS.items() for text in some] + [("", t) for t in ("<scripts>", "java script:", "button = 1", "href=/data:", "id=locale", "<iframes>", "<objects>", "expressions(", "{ {x} }", "")] + [("", None)]
    df = spark.createDataFrame(rows, "reason string, t string")
    for r in df.select("reason", "t", security.content(F.col("t")).alias("v")).collect():
        assert r.v.reason == r.reason, r
    actions = {r.v.reason: r.v.action for r in df.select(security.content(F.col("t")).alias("v")).collect()}
    assert [k for k, v in actions.items() if v == "block"] == list(FITS)[:4] and actions[""] == "pass"


def test_every_attribute_rule(spark):
    rows = [("OnLoad ", "x", "block"), ("on", "x", "pass"), ("href", "  JAVASCRIPT:x", "block"), ("src", "data:x", "block"), ("srcdoc", "<iframe>", "flag"), ("srcdoc", "x", "pass"), ("title", "javascript:x", "pass"), ("action", "/x?javascript:", "pass"), (None, None, "pass"), ("data", "data:", "block")]
    df = spark.createDataFrame(rows, "n string, v string, want string")
    assert [r.got for r in df.select(security.attribute(F.col("n"), F.col("v"))["action"].alias("got")).collect()] == [r[2] for r in rows]


def test_activity_score_by_hand(spark):
    rows = [
        # family, homogeneity, times, authors, replies, avatars, activity, table, blob, itemtype, role, composer, score
        (15, 0.8, 0.5, 0.5, 0.4, 0.4, 10, False, "section class Kommentaré list", "http://schema.org/Comment", "feed", True, 1.0),
        (3, 0.5, 0.2, 0.2, 0.39, 0.39, 3, False, "div class posts", "", "comment", False, 0.1 + 0.05 * 4 + 0.08 + 0.08),
        (5, 0.1, 0.0, 0.0, 0.0, 0.0, 0, False, "div class card", "Review", "", True, 0.15 + 0.03 + 0.12 + 0.06),
        (8, 0.8, 0.0, 0.0, 0.0, 0.0, 0, True, "div id x", "", "", False, 0.2 + 0.1 - 0.15),
        (8, 0.8, 0.0, 0.0, 0.0, 0.0, 0, False, "ul class menu add-to-cart", "", "", False, 0.3 - 0.25),
        (2, 0.0, 0.0, 0.0, 0.0, 0.0, 0, False, "nav", "", "", False, 0.0),
    ]
    names = "family homogeneity times authors replies avatars activity table blob itemtype role composer".split()
    df = spark.createDataFrame(rows, "family int, homogeneity double, times double, authors double, replies double, avatars double, activity int, table boolean, blob string, itemtype string, role string, composer boolean, want double")
    got = df.select("want", monitor.activity_score(*(F.col(c) for c in names[:8]), **{c: F.col(c) for c in names[8:]}).alias("s")).collect()
    assert [round(r.s, 9) for r in got] == [round(r.want, 9) for r in got]
    for r in df.where("times = 0 AND NOT composer AND family >= 2").collect():
        tag, *rest = r.blob.split(" ")
        attrs = {rest[0]: " ".join(rest[1:])} if rest else {}
        assert monitor.live_score(r.family, r.homogeneity, r.activity, tag, attrs, "", {}, r.table) == round(r.want, 9)
