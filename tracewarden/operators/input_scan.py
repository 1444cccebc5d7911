"""Scans of text that goes into a model: injection, role confusion, hidden Unicode.

One pass per row and no shuffle: every rule becomes one offset column, and the
alerts of a row are built from those offsets and unrolled with ``inline``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.text import let, snippet, unroll, unroll_items, utf16_length
from tracewarden.rules.base import Rule
from tracewarden.rules.injection import (
    INJECTION,
    ROLE_CONFUSION,
    SUSPICIOUS_UNICODE,
    TRUSTED_ROLES,
)

ALERT = (
    "index int, role string, tool_name string, severity string, pattern string, "
    "match string, offset int, length int"
)


def _first_hit(text: Column, rule: Rule) -> Column:
    """struct<offset, match> of the first match, null when there is none."""
    java = rule.java
    if rule.anchor:
        # The first match can only start at the first occurrence of the anchor, so
        # one anchored attempt there replaces a search from every occurrence.
        tail = F.substr(text, F.instr(text, rule.anchor))
        match = F.regexp_extract(tail, rf"\A(?:{java})", 0)
        offset = utf16_length(F.substring_index(text, rule.anchor, 1))
        return let(
            match,
            lambda m: F.when(m != "", F.struct(offset.alias("offset"), m.alias("match"))),
        )
    return let(
        F.regexp_instr(text, F.lit(java)),
        lambda at: F.when(
            at > 0,
            F.struct((at - 1).alias("offset"), F.regexp_extract(text, java, 0).alias("match")),
        ),
    )


def _alert(severity: str, pattern: str, hit: Column, index: Column, role: Column, tool: Column) -> Column:
    return F.when(
        hit.isNotNull(),
        F.struct(
            index.cast("int").alias("index"),
            F.coalesce(role, F.lit("unknown")).alias("role"),
            tool.alias("tool_name"),
            F.lit(severity).alias("severity"),
            F.lit(pattern).alias("pattern"),
            snippet(hit["match"]).alias("match"),
            hit["offset"].cast("int").alias("offset"),
            utf16_length(hit["match"]).cast("int").alias("length"),
        ),
    )


def injection_alert(text: Column, lowered: Column, rule: Rule, index: Column, role: Column, tool: Column) -> Column:
    hit = _first_hit(text, rule)
    guard = rule.may_match(lowered)
    if rule.probe:
        light = F.rlike(text, F.lit(rule.probe.java))
        guard = light if guard is None else guard & light
    if guard is not None:
        hit = F.when(guard, hit)
    return let(hit, lambda h: _alert(rule.severity, rule.id, h, index, role, tool))


def role_confusion_alert(text: Column, index: Column, role: Column, tool: Column) -> Column:
    """At most one alert, and only for text that a tool returned."""
    tries = [_first_hit(text, Rule("role_confusion", p)) for p in ROLE_CONFUSION]
    return let(
        F.when(role == "tool", F.coalesce(*tries)),
        lambda h: _alert("medium", "role_confusion", h, index, role, tool),
    )


def unicode_alert(text: Column, index: Column, role: Column, tool: Column) -> Column:
    java = SUSPICIOUS_UNICODE.java

    def build(n: Column) -> Column:
        message = F.concat(
            n.cast("string"),
            F.lit(" suspicious Unicode character"),
            F.when(n > 1, "s").otherwise(""),
            F.lit(" (zero-width, RTL override, etc.)"),
        )
        return F.when(
            n > 0,
            F.struct(
                index.cast("int").alias("index"),
                F.coalesce(role, F.lit("unknown")).alias("role"),
                tool.alias("tool_name"),
                F.lit("info").alias("severity"),
                F.lit("suspicious_unicode").alias("pattern"),
                message.alias("match"),
                (F.regexp_instr(text, F.lit(java)) - 1).cast("int").alias("offset"),
                F.lit(1).alias("length"),
            ),
        )

    # Every suspicious character but the soft hyphen group takes three bytes; pure
    # ASCII rows are told apart by comparing byte and character counts.
    return let(
        F.when(F.octet_length(text) > F.length(text), F.regexp_count(text, F.lit(java))).otherwise(0),
        build,
    )


def scan_texts(
    df: DataFrame,
    text: str = "text",
    keys: list[str] | None = None,
    role: str | None = None,
    tool: str | None = None,
    index: str | None = None,
    skip_trusted: bool = False,
    tiers: tuple[str, ...] = ("injection", "role_confusion", "unicode"),
) -> DataFrame:
    """Alerts for a text table: the key columns followed by the alert fields.

    The first match per rule is reported. With ``skip_trusted`` rows written by a
    system or developer role are left out.
    """
    keys = keys or [c for c in df.columns if c not in (text, role, tool, index)]
    role_col = F.col(role) if role else F.lit(None).cast("string")
    tool_col = F.col(tool) if tool else F.lit(None).cast("string")
    index_col = F.col(index) if index else F.lit(0)
    if skip_trusted and role:
        df = df.filter(F.coalesce(~F.col(role).isin(*TRUSTED_ROLES), F.lit(True)))
    body = F.col(text)
    rows = df.filter(F.length(body) > 0).withColumn("_low", F.lower(body))
    alerts: list[Column] = []
    if "injection" in tiers:
        alerts += [
            injection_alert(body, F.col("_low"), r, index_col, role_col, tool_col)
            for r in INJECTION
        ]
    if "role_confusion" in tiers:
        alerts.append(role_confusion_alert(body, index_col, role_col, tool_col))
    if "unicode" in tiers:
        alerts.append(unicode_alert(body, index_col, role_col, tool_col))
    found = F.array_compact(F.array(*alerts))
    return unroll(rows, keys, found)


def scan_conversations(
    messages: DataFrame, keys: list[str], index: str = "idx", role: str = "role", text: str = "text"
) -> DataFrame:
    """Alerts for conversation messages; trusted roles are skipped, positions are kept."""
    return scan_texts(messages, text=text, keys=keys, role=role, index=index, skip_trusted=True)


def message_text(message: Column) -> Column:
    """Text of one request message given as variant.

    A string ``content`` wins, else the texts of ``parts``, else those of
    ``content_blocks``. An array-valued ``content`` is not read.
    """
    from tracewarden.functions.jsonpath import items, text as string_at

    def joined(path: str, *fields: str) -> Column:
        return F.array_join(
            F.transform(
                items(message, path),
                lambda p: F.coalesce(*[F.try_variant_get(p, f"$.{f}", "string") for f in fields], F.lit("")),
            ),
            "\n",
        )

    return F.coalesce(
        string_at(message, "$.content"),
        joined("$.parts", "text"),
        joined("$.content_blocks", "text", "content"),
    )


def request_messages(requests: DataFrame, body: str = "request_body", keys: list[str] | None = None) -> DataFrame:
    """One row per message of a JSON request body: keys, idx, role, text."""
    from tracewarden.functions.jsonpath import items, text as string_at

    keys = keys or [c for c in requests.columns if c != body]
    messages = items(F.try_parse_json(F.col(body)), "$.messages")
    exploded = unroll_items(requests, keys, messages, "idx", "_message")
    return exploded.select(
        *keys,
        "idx",
        string_at(F.col("_message"), "$.role").alias("role"),
        message_text(F.col("_message")).alias("text"),
    )


def severity_summary(alerts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of high, medium and info alerts, overall or per group."""
    counts = [
        F.count_if(F.col("severity") == level).alias(level) for level in ("high", "medium", "info")
    ]
    return alerts.groupBy(*(by or [])).agg(*counts)


def severity_rollup(alerts: DataFrame, by: list[str]) -> DataFrame:
    """The same counters for every prefix of the grouping columns."""
    counts = [
        F.count_if(F.col("severity") == level).alias(level) for level in ("high", "medium", "info")
    ]
    return alerts.rollup(*by).agg(*counts)
