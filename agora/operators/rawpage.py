"""What a page's raw HTML and its headers tell without a tree: features, blockers, scores of search results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora.functions.text import squeezed, title_of
from agora.functions.urls import NEGATIVE_PAGE, path_score

#: Patterns over raw HTML, whatever the case.
JSON_LD = r"""<script[^>]+type=["']application/ld\+json["'][^>]*>([\s\S]*?)</script>"""
FLAGS = {
    "schema_org_in_head_json_ld": r"application/ld\+json",
    "interaction_counter_schema": r'"interactionType"\s*:\s*"[^"]*CommentAction"',
    "framework_react": r"data-reactroot|__REACT_DEVTOOLS|_reactFiber|_reactRootContainer",
    "framework_vue": r"__vue__|data-v-[a-f0-9]+",
    "framework_angular": r"ng-version|ng-app|ng-controller",
    "framework_svelte": r"data-svelte|svelte-",
    "framework_next": r"__NEXT_DATA__|_next/",
    "framework_nuxt": r"__NUXT__|nuxt\.js",
    "csrf_token_in_form": r"""<input[^>]+type=["']hidden["'][^>]+name=["'](?:_token|csrf|authenticity_token|__RequestVerificationToken)[^"']*["']""",
    "html_contains_comment_route": r"""src=["'][^"']*/(?:comments?|reviews?|feed|discussion|replies|ugc)[^"']*\.js""",
}
EXTRACTS = {
    "meta_charset": [r"""<meta[^>]+charset=["']?([^"'\s>]+)"""],
    "og_type": [r"""<meta[^>]+property=["']og:type["'][^>]+content=["']([^"']+)["']""", r"""<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:type["']"""],
    "html_lang": [r"""<html[^>]+lang=["']([^"']+)["']"""],
}
PRELOAD = r"""<link[^>]+rel=["']preload["'][^>]+as=["']image["'][^>]*>"""
CSP = {"response_csp_has_script_src": "script-src", "response_csp_allows_unsafe_inline": "unsafe-inline", "response_csp_allows_unsafe_eval": "unsafe-eval"}
#: What pages say that keep a visitor out.
CLOUDFLARE = "verify to continue|checking if the site connection is secure|review the security of your connection before proceeding|attention required"
CAPTCHA = "captcha|human verification|security check|are you a human|unusual traffic"
LOGIN, TO_DO = r"\b(?:sign in|log in|join|create account|start trial|subscribe)\b", r"\b(?:to continue|to view|to watch|to comment|to reply|to proceed)\b"
TURNSTILE = r"""id=["']cf-chl-widget|class=["'][^"']*\bcf-turnstile\b|name=["']cf-turnstile-response["']"""
CAPTCHA_FRAME, ANCHOR_FRAME = "captcha|turnstile|challenge|recaptcha", r"recaptcha/(?:enterprise/)?anchor"
#: What titles and snippets of search results add to a path's score.
RESULT_POINTS = [
    (r"\bcomments?\b", 5), (r"\b(?:join the conversation|leave a comment|post a comment|reader comments)\b", 8), (r"\bdiscussion|thread|forum|topic|reply|replies\b", 6),
    (r"\bquestion|questions|answer|answers\b", 6), (r"\breview|reviews|rating|ratings\b", 6), (NEGATIVE_PAGE, -16), (r"\bcommentary\b", -6),
]


def features(html: Column) -> dict[str, Column]:
    """Flags and values of a page's raw HTML; a null page has none."""
    held = F.coalesce(html, F.lit(""))
    data = F.array_join(F.regexp_extract_all(held, F.lit(f"(?i){JSON_LD}"), F.lit(1)), "\n")
    preloads = F.filter(F.regexp_extract_all(held, F.lit(f"(?i){PRELOAD}"), F.lit(0)), lambda x: x.rlike("(?i)avatar|profile|user"))
    out = {name: held.rlike(f"(?i){pattern}") for name, pattern in FLAGS.items()}
    for name, patterns in EXTRACTS.items():
        found = [F.nullif(F.regexp_extract(held, f"(?i){p}", 1), F.lit("")) for p in patterns]
        out[name] = F.lower(F.coalesce(*found, F.lit("")))
    return out | {
        "json_ld_has_comment_type": data.rlike(r'(?i)"@type"\s*:\s*"Comment"'),
        "json_ld_has_comment_action": data.rlike(r'(?i)"@type"\s*:\s*"CommentAction"'),
        "preload_avatar_count": F.size(preloads).cast("long"),
    }


def csp(headers: Column) -> dict[str, Column]:
    """Flags of the content security policy in a map of response headers."""
    policy = F.coalesce(F.nullif(headers["content-security-policy"], F.lit("")), headers["Content-Security-Policy"], F.lit(""))
    return {"response_has_csp_header": policy != ""} | {name: policy.rlike(f"(?i){word}") for name, word in CSP.items()}


def blocker(html: Column, text: Column) -> Column:
    """What keeps a visitor out of a page: cloudflare, captcha, login_wall or nothing; what only a browser shows does not count."""
    held = F.coalesce(html, F.lit(""))
    said = F.concat_ws(" ", title_of(html), squeezed(text))
    frames = F.regexp_extract_all(held, F.lit(r"""(?i)<iframe\b[^>]*\bsrc\s*=\s*["']([^"']+)"""), F.lit(1))
    captcha = F.exists(frames, lambda u: u.rlike(f"(?i){CAPTCHA_FRAME}") & ~u.rlike(f"(?i){ANCHOR_FRAME}"))
    return (
        F.when(said.rlike(f"(?i){CLOUDFLARE}") | held.rlike(f"(?i){TURNSTILE}") | F.exists(frames, lambda u: u.rlike(r"(?i)challenges\.cloudflare\.com")), "cloudflare")
        .when(said.rlike(f"(?i){CAPTCHA}") | captcha, "captcha")
        .when(said.rlike(f"(?i){LOGIN}") & said.rlike(f"(?i){TO_DO}"), "login_wall")
        .otherwise("")
    )


def result_score(url: Column, title: Column, snippet: Column, kind: Column | None = None, hint: Column | None = None) -> Column:
    """How likely a search result leads to a page with discussion: its path's score and what it says."""
    said = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    return sum((F.when(said.rlike(p), points).otherwise(0) for p, points in RESULT_POINTS), path_score(url, title, kind, hint))
