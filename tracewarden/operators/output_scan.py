"""Scans of text that a model produced: banned strings, custom patterns, URLs, code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.dialect import Pattern, quote, replacement
from tracewarden.functions.text import (
    all_matches,
    let,
    located_all,
    match_parts,
    snippet,
    unroll,
    unroll_items,
    utf16_length,
)
from tracewarden.rules.output import BANNED, BLOCKED_DOMAINS, DANGEROUS_CODE, REDACTED, URL

_TAGS = ("index", "severity", "pattern")
_ALERTS = "array<struct<index:int,severity:string,pattern:string,match:string,offset:int,length:int>>"


def _tagged(body: Column, java: str, index: int, severity: str, pattern: str) -> Column:
    """The matches of one rule with what its alerts will say."""
    return match_parts(
        body, java, 0, index=F.lit(index), severity=F.lit(severity), pattern=F.lit(pattern)
    )


def _alerts(per_rule: list[Column]) -> Column:
    """Alerts of several rules, rule after rule."""
    if not per_rule:
        return F.array().cast(_ALERTS)
    return F.transform(
        located_all(per_rule, _TAGS),
        lambda m: F.struct(
            *[m[tag].alias(tag) for tag in _TAGS],
            snippet(m["match"]).alias("match"),
            m["offset"].alias("offset"),
            m["length"].alias("length"),
        ),
    )


def _unroll(df: DataFrame, keys: list[str], alerts: Column) -> DataFrame:
    return unroll(df, keys, alerts)


def _keys(df: DataFrame, text: str, keys: list[str] | None) -> list[str]:
    return keys or [c for c in df.columns if c != text]


#: Per Java pattern: does it match the empty string? None if it does not compile.
_CHECKED: dict[str, bool | None] = {}


def _check(spark: SparkSession, patterns: list[str]) -> None:
    """One job for all patterns; one each only if some of them does not compile."""
    try:
        row = spark.range(1).select(*[F.lit("").rlike(p) for p in patterns]).head()
        _CHECKED.update(zip(patterns, row, strict=True))
    except Exception as error:  # raised by the pattern compiler
        if "PATTERN" not in str(error).upper():
            raise
        if len(patterns) == 1:
            _CHECKED[patterns[0]] = None
        else:
            for p in patterns:
                _check(spark, [p])


def usable_patterns(spark: SparkSession, sources: list[str], flags: str = "i") -> list[tuple[int, Pattern]]:
    """The patterns that compile, with their positions in the list.

    Invalid ones are dropped, as a bad custom pattern must not stop a scan. A pattern
    that matches the empty string has no well-defined occurrences and is refused.
    """
    patterns = [Pattern(source, flags) for source in sources]
    unknown = [p.java for p in patterns if p.java not in _CHECKED]
    if unknown:
        _check(spark, list(dict.fromkeys(unknown)))
    for p in patterns:
        if _CHECKED[p.java]:
            raise ValueError(f"pattern matches the empty string: {p.source}")
    return [(i, p) for i, p in enumerate(patterns) if _CHECKED[p.java] is not None]


def _banned_alerts(body: Column, lowered: Column, substrings, case_sensitive: bool) -> list[Column]:
    per_rule = []
    for i, banned in enumerate(substrings):
        java = Pattern(quote(banned), "" if case_sensitive else "i").java
        guard = F.contains(lowered, F.lit(banned.lower()))
        per_rule.append(
            F.when(guard, _tagged(body, java, i, "high", "ban_substring"))
        )
    return per_rule


def _pattern_alerts(body: Column, usable: list[tuple[int, Pattern]]) -> list[Column]:
    return [
        F.when(F.rlike(body, F.lit(p.java)), _tagged(body, p.java, i, "medium", f"regex_{i}"))
        for i, p in usable
    ]


def scan_banned(
    df: DataFrame,
    text: str = "text",
    keys: list[str] | None = None,
    substrings: tuple[str, ...] | list[str] = BANNED,
    case_sensitive: bool = False,
) -> DataFrame:
    """Every occurrence of every banned string."""
    keys = _keys(df, text, keys)
    rows = df.withColumn("_low", F.lower(F.col(text)))
    per_rule = _banned_alerts(F.col(text), F.col("_low"), substrings, case_sensitive)
    return _unroll(rows, keys, _alerts(per_rule))


def scan_patterns(
    df: DataFrame, patterns: list[str], text: str = "text", keys: list[str] | None = None
) -> DataFrame:
    """Blocked mode: an alert for every match of every custom pattern."""
    keys = _keys(df, text, keys)
    per_rule = _pattern_alerts(F.col(text), usable_patterns(df.sparkSession, patterns))
    return _unroll(df, keys, _alerts(per_rule))


def scan_required(
    df: DataFrame, patterns: list[str], text: str = "text", keys: list[str] | None = None
) -> DataFrame:
    """Required mode: an alert for every custom pattern that a text lacks."""
    keys = _keys(df, text, keys)
    missing = [
        F.when(
            ~F.rlike(F.col(text), F.lit(p.java)),
            F.struct(
                F.lit(i).alias("index"),
                F.lit("medium").alias("severity"),
                F.lit(f"regex_{i}").alias("pattern"),
                F.lit(f"(required pattern not found: {p.source})").alias("match"),
                F.lit(0).alias("offset"),
                F.lit(0).alias("length"),
            ),
        )
        for i, p in usable_patterns(df.sparkSession, patterns)
    ]
    return _unroll(df, keys, F.array_compact(F.array(*missing)).cast(_ALERTS))


def redact_patterns(df: DataFrame, patterns: list[str], text: str = "text", out: str = "redacted") -> DataFrame:
    """Each match of each custom pattern replaced in place, pattern after pattern."""
    result = F.col(text)
    for _, p in usable_patterns(df.sparkSession, patterns):
        result = F.regexp_replace(result, p.java, replacement(REDACTED))
    return df.withColumn(out, result)


def extract_urls(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """One row per URL in a text: keys, ord, url."""
    keys = _keys(df, text, keys)
    urls = F.when(F.contains(F.col(text), F.lit("://")), all_matches(F.col(text), URL.java))
    return unroll_items(df, keys, urls, "ord", "url")


def url_host(url: Column) -> Column:
    """Lower-cased host of an http(s) URL, without user info and port."""
    authority = F.regexp_extract(url, r"^https?:[/\\]+([^/\\?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    return F.lower(F.regexp_replace(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), r":[0-9]*$", ""))


def _url_alerts(body: Column, domains) -> Column:
    urls = all_matches(body, URL.java)
    listed = F.array(*[F.lit(d) for d in domains]).cast("array<string>")

    def listed_parents(url: Column) -> Column:
        return let(
            url_host(url),
            lambda host: F.filter(
                listed, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))
            ),
        )

    def alerts_of(found: Column) -> Column:
        return F.flatten(
            F.transform(
                found,
                lambda url, i: F.transform(
                    listed_parents(url),
                    lambda _: F.struct(
                        i.cast("int").alias("index"),
                        F.lit("high").alias("severity"),
                        F.lit("suspicious_url").alias("pattern"),
                        url.alias("match"),
                        utf16_length(F.call_function("substring_index", body, url, F.lit(1))).cast("int").alias("offset"),
                        utf16_length(url).cast("int").alias("length"),
                    ),
                ),
            )
        )

    return F.when(F.contains(body, F.lit("://")), let(urls, alerts_of))


def blocked_urls(
    df: DataFrame,
    text: str = "text",
    keys: list[str] | None = None,
    domains: tuple[str, ...] | list[str] = BLOCKED_DOMAINS,
) -> DataFrame:
    """An alert per URL and blocklist entry whose domain, or a parent of it, is listed.

    The blocklist travels as a literal array, so the check needs no join;
    ``blocked_urls_by_table`` takes a blocklist of any size.
    """
    keys = _keys(df, text, keys)
    return _unroll(df, keys, _url_alerts(F.col(text), domains))


def parent_domains(host: Column) -> Column:
    """The host and every suffix of it that starts after a dot."""
    labels = F.split(host, r"\.")
    return let(
        labels,
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
        ),
    )


def blocked_urls_by_table(
    df: DataFrame, blocklist: DataFrame, text: str = "text", keys: list[str] | None = None
) -> DataFrame:
    """``blocked_urls`` against a blocklist table with a ``domain`` column.

    Hosts are reduced to their distinct values before the suffix equi-join, so one
    popular host costs one row; Spark broadcasts the list when it is small enough.
    """
    keys = _keys(df, text, keys)
    urls = extract_urls(df, text, keys).withColumn("host", url_host(F.col("url")))
    hosts = urls.select("host").distinct()
    hits = (
        hosts.select("host", F.explode(parent_domains(F.col("host"))).alias("domain"))
        .join(blocklist.select("domain").distinct(), "domain")
    )
    return urls.join(hits, "host").select(*keys, F.col("ord").alias("index"), "url", "host", "domain")


def _code_alerts(body: Column, lowered: Column) -> list[Column]:
    return [
        F.when(r.may_match(lowered), _tagged(body, r.java, 0, r.severity, r.id))
        for r in DANGEROUS_CODE
    ]


def scan_code(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Every occurrence of a dangerous code idiom."""
    keys = _keys(df, text, keys)
    rows = df.withColumn("_low", F.lower(F.col(text)))
    return _unroll(rows, keys, _alerts(_code_alerts(F.col(text), F.col("_low"))))


def with_output_alerts(
    df: DataFrame,
    text: str = "text",
    banned: list[str] | tuple[str, ...] | bool | None = None,
    patterns: list[str] | None = None,
    urls: bool = True,
    code: bool = True,
) -> DataFrame:
    """The table with an ``alerts`` array: banned strings, patterns, URLs, code, in this order.

    All scans share one pass over the text. ``banned=False`` turns the banned-string
    scan off, an empty list scans nothing.
    """
    body, lowered = F.col(text), F.col("_low")
    first: list[Column] = []
    if not isinstance(banned, bool):
        first += _banned_alerts(body, lowered, BANNED if banned is None else banned, False)
    if patterns:
        first += _pattern_alerts(body, usable_patterns(df.sparkSession, patterns))
    none = F.array().cast(_ALERTS)
    listed = F.coalesce(_url_alerts(body, BLOCKED_DOMAINS), none) if urls else none
    last = _code_alerts(body, lowered) if code else []
    found = F.concat(_alerts(first), listed, _alerts(last))
    return df.withColumn("_low", F.lower(body)).withColumn("alerts", found).drop("_low")


def scan_output(df: DataFrame, text: str = "text", keys: list[str] | None = None, **switches) -> DataFrame:
    """One row per alert of the combined scan."""
    keys = _keys(df, text, keys)
    return unroll(with_output_alerts(df, text, **switches), keys, F.col("alerts"))


def output_verdicts(df: DataFrame, text: str = "text", keys: list[str] | None = None, **switches) -> DataFrame:
    """is_safe and the alert count of every row, safe ones included."""
    keys = _keys(df, text, keys)
    scanned = with_output_alerts(df, text, **switches)
    return scanned.select(
        *keys, F.size("alerts").alias("alerts"), (F.size("alerts") == 0).alias("is_safe")
    )
