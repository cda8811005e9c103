"""What inserted content and attributes are let do, by fixed patterns in their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of inserted content in order, what they lead to, and why.
CONTENT = [
    (r"(?i)<script[\s>]", "block", "script_tag"),
    (r"(?i)javascript\s*:", "block", "javascript_protocol"),
    (r"(?i)\bon\w+\s*=", "block", "event_handler_attr"),
    (r"(?i)(?:src|href)\s*=\s*[\"']?\s*data:", "block", "data_uri_sink"),
    (r"(?i)\bid\s*=\s*[\"']?(location|document|window|__proto__|constructor)", "flag", "dom_clobbering"),
    (r"(?i)<iframe[\s>]", "flag", "iframe_injection"),
    (r"(?i)<(?:object|embed)[\s>]", "flag", "object_embed"),
    (r"(?i)<svg[^>]*\s+on\w+", "flag", "svg_event"),
    (r"(?i)expression\s*\(", "flag", "css_expression"),
    (r"\{\{.*\}\}", "flag", "template_injection"),
]
#: Attributes whose values lead elsewhere, and how bad values begin.
SINKS = ["href", "src", "action", "formaction", "srcdoc", "data"]
STARTS = [("javascript:", "javascript_protocol"), ("data:", "data_uri_sink")]

def _says(action: str, reason: str) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))


def content(value: Column) -> Column:
    """(action, reason) of inserted content: block, flag or pass by the first pattern that fits; null content passes."""
    out = _says("pass", "")
    for pattern, action, reason in reversed(CONTENT):
        out = F.when(value.rlike(pattern), _says(action, reason)).otherwise(out)
    return out


def attribute(name: Column, value: Column) -> Column:
    """(action, reason) of an attribute that is set: handlers, and addresses that run or hold content, are blocked."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    start = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+", ""))
    out = F.when(low == "srcdoc", content(value)).otherwise(_says("pass", ""))
    for begins, reason in reversed(STARTS):
        out = F.when(low.isin(*SINKS) & start.startswith(begins), _says("block", reason)).otherwise(out)
    return F.when(low.rlike(r"^on\w+$"), _says("block", "event_handler_attr")).otherwise(out)
