"""Selectors against a plain walk over trees."""

import random

import pytest

from agora.operators import selectors
from agora.sources import html

CSS = [
    "p", "*", "#a", ".x", ".x.y", "p.x", "div#a", "div p", "div > p", "p + p", "p ~ b", "div div p", "div > div > p", "ul > li:nth-of-type(2)", "li:nth-child(odd)", "li:nth-child(2n+3)", "li:nth-last-child(1)",
    "p:first-child", "p:last-of-type", ":not(p)", "div :not(.x, p)", "[href]", '[href="/u"]', "[href^='/u']", '[href$="z"]', "[href*=u]", '[class~="y"]', '[lang|="en"]', '[TITLE="ab" i]', "p, b.x , li > b",
    "div.x ~ div p + b", "b:only-child", ":root", "section > *:nth-last-of-type(-n+2)", "p:empty", "div > p ~ p > b", '[class*=""]',
]


def page(rng):
    def some(depth):
        out = []
        for _ in range(rng.randint(0, 4) if depth < 6 else 0):
            tag = rng.choice(["div", "div", "section", "b", "ul", "span"] if depth < 4 else ["p", "b"])
            attrs = "".join(f' {k}="{rng.choice(v)}"' for k, v in {"class": ["x", "y", "x y", "", "xy"], "id": ["a", "b"], "href": ["/u", "/u/z", "z"], "lang": ["en", "en-gb", "eng"], "title": ["ab", "AB", "a"]}.items() if rng.random() < 0.3)
            inner = "".join(f"<li{attrs}>{some(depth + 2)}</li>" for _ in range(rng.randint(0, 4))) if tag == "ul" else some(depth + 1)
            out.append(f"<{tag}{attrs}>{inner}</{tag}>" + rng.choice(["", "<p>", "<p>t</p>", "text"]))
        return "".join(out)

    return some(0)


class Plain:
    """A selector's meaning, straight from its definition."""

    def __init__(self, text):
        self.rows = html.parsed(text)
        self.children = {}
        for r in self.rows:
            self.children.setdefault(r[1], []).append(r[0])

    def compound(self, n, css):
        tag, attrs = self.rows[n][4], self.rows[n][5]
        return all(self.simple(n, tag, attrs, kind, value) for kind, value in css)

    def simple(self, n, tag, attrs, kind, v):
        family = self.children[self.rows[n][1]]
        alike = [k for k in family if self.rows[k][4] == tag]
        place, index = family.index(n) + 1, alike.index(n) + 1
        nth = lambda k, a, b: any(a * m + b == k for m in range(200))
        if kind == "attr":
            name, op, value = v
            held = attrs.get(name)
            if held is None or (not value and op not in ("", "=", "|=")):
                return False
            return {"": True, "=": held == value, "^=": held.startswith(value), "$=": held.endswith(value), "*=": value in held, "~=": value in held.split(), "|=": held == value or held.startswith(value + "-"), "i": held.lower() == value.lower()}[op]
        return {"tag": lambda: v in ("*", tag), "not": lambda: not any(self.compound(n, c) for c in v), "child": lambda: nth(place, *v), "last": lambda: nth(len(family) - place + 1, *v), "type": lambda: nth(index, *v), "lasttype": lambda: nth(len(alike) - index + 1, *v), "only": lambda: len(family) == 1, "root": lambda: self.rows[n][1] < 0, "empty": lambda: self.rows[n][2] == n and self.rows[n][6] == ""}[kind]()

    def matches(self, n, steps):
        *before, (combine, css) = steps
        if not self.compound(n, css):
            return False
        if not before:
            return True
        up, family = self.rows[n][1], self.children[self.rows[n][1]]
        if combine == " ":
            while up >= 0:
                if self.matches(up, before):
                    return True
                up = self.rows[up][1]
            return False
        if combine == ">":
            return up >= 0 and self.matches(up, before)
        ahead = family[: family.index(n)] if up >= 0 else []
        return any(self.matches(k, before) for k in (ahead[-1:] if combine == "+" else ahead))


def attr(name, op="", value=""):
    return "attr", (name, op, value)


def t(name):
    return "tag", name


X, Y, ID = attr("class", "~=", "x"), attr("class", "~=", "y"), attr("id", "=", "a")
MEANING = [
    [[(" ", [t("p")])]], [[(" ", [t("*")])]], [[(" ", [ID])]], [[(" ", [X])]], [[(" ", [X, Y])]], [[(" ", [t("p"), X])]], [[(" ", [t("div"), ID])]],
    [[(" ", [t("div")]), (" ", [t("p")])]], [[(" ", [t("div")]), (">", [t("p")])]], [[(" ", [t("p")]), ("+", [t("p")])]], [[(" ", [t("p")]), ("~", [t("b")])]],
    [[(" ", [t("div")]), (" ", [t("div")]), (" ", [t("p")])]], [[(" ", [t("div")]), (">", [t("div")]), (">", [t("p")])]], [[(" ", [t("ul")]), (">", [t("li"), ("type", (0, 2))])]],
    [[(" ", [t("li"), ("child", (2, 1))])]], [[(" ", [t("li"), ("child", (2, 3))])]], [[(" ", [t("li"), ("last", (0, 1))])]], [[(" ", [t("p"), ("child", (0, 1))])]], [[(" ", [t("p"), ("lasttype", (0, 1))])]],
    [[(" ", [("not", [[t("p")]])])]], [[(" ", [t("div")]), (" ", [("not", [[X], [t("p")]])])]], [[(" ", [attr("href")])]], [[(" ", [attr("href", "=", "/u")])]], [[(" ", [attr("href", "^=", "/u")])]],
    [[(" ", [attr("href", "$=", "z")])]], [[(" ", [attr("href", "*=", "u")])]], [[(" ", [Y])]], [[(" ", [attr("lang", "|=", "en")])]], [[(" ", [attr("title", "i", "ab")])]],
    [[(" ", [t("p")])], [(" ", [t("b"), X])], [(" ", [t("li")]), (">", [t("b")])]], [[(" ", [t("div"), X]), ("~", [t("div")]), (" ", [t("p")]), ("+", [t("b")])]], [[(" ", [t("b"), ("only", None)])]], [[(" ", [("root", None)])]],
    [[(" ", [t("section")]), (">", [t("*"), ("lasttype", (-1, 2))])]], [[(" ", [t("p"), ("empty", None)])]], [[(" ", [t("div")]), (">", [t("p")]), ("~", [t("p")]), (">", [t("b")])]], [[(" ", [attr("class", "*=", "")])]],
]


def test_like_plain_walks(spark):
    rng = random.Random(4)
    pages = [(k, page(rng)) for k in range(200)]
    nodes = html.nodes(spark.createDataFrame(pages, "page_id long, html string")).cache()
    plain = {k: Plain(x) for k, x in pages}
    for at in range(0, len(CSS), 13):
        some = dict(zip(CSS[at : at + 13], MEANING[at : at + 13]))
        got = {(r.selector, r.page_id, r.node) for r in selectors.select(nodes, {c: c for c in some}).collect()}
        want = {(css, k, n) for css, means in some.items() for k, tree in plain.items() for n in range(len(tree.rows)) if any(tree.matches(n, steps) for steps in means)}
        assert got == want, {c: len([x for x in got ^ want if x[0] == c]) for c in some}
    assert len(CSS) == len(MEANING)


def test_no_join_but_by_parent(spark):
    nodes = html.nodes(spark.createDataFrame([(1, "<div><p>")], "page_id long, html string"))
    plan = selectors.select(nodes, {"a": "div p", "b": "p ~ p", "c": "li:nth-child(2)"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert "Join LeftOuter, ((page_id" in selectors.select(nodes, {"a": "div > p"})._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("css", ["", "p >", "> p", "p,,b", "p:hover", "p:nth-child(x)", ":not(a b)", "[", "p!", ":nth-child"])
def test_what_cannot_be_read(spark, css):
    with pytest.raises(ValueError):
        selectors.parse(css)


def test_a_large_page(spark):
    text = "<div>" + "<p class=x><b>t</b></p>" * 100_000 + "</div>"
    nodes = html.nodes(spark.createDataFrame([(1, text)], "page_id long, html string"))
    assert selectors.select(nodes, {"a": "div .x b"}).count() == 100_000
