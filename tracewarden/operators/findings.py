"""All-match scans: credentials in text, and the secret inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.text import (
    any_of,
    located_all,
    match_parts,
    shannon_entropy,
    unroll,
)
from tracewarden.rules.base import Rule
from tracewarden.rules.credentials import CREDENTIALS


def suppressed(rule: Rule, match: Column, captured: Column) -> Column | None:
    """Whether the rule's own allowlist or entropy floor drops a match; None if it has neither."""
    tests = [
        F.rlike(captured if p.source.startswith("^") else match, F.lit(p.java)) for p in rule.allow
    ]
    if rule.min_entropy is not None:
        tests.append(shannon_entropy(captured) < rule.min_entropy)
    return any_of(tests) if tests else None


def rule_guard(rule: Rule, text: Column, lowered: Column) -> Column:
    """A necessary condition for a match, from the cheapest check to the rule's probe."""
    checks = F.lit(True)
    literal = rule.may_match(lowered)
    if literal is not None:
        checks = literal
    return checks & F.rlike(text, F.lit(rule.probe_java))


def scan_credentials(
    df: DataFrame, text: str = "text", keys: list[str] | None = None, rules: tuple[Rule, ...] = CREDENTIALS
) -> DataFrame:
    """One row per credential found: keys, rule position, id, label, match, offset, length."""
    keys = keys or [c for c in df.columns if c != text]
    body, lowered = F.col(text), F.col("_low")
    rows = df.filter(F.length(text) > 0).withColumn("_low", F.lower(body))
    tags = ("rule_ord", "rule", "label")
    per_rule = [
        F.when(
            rule_guard(r, body, lowered),
            match_parts(
                body, r.java, r.group, rule_ord=F.lit(i), rule=F.lit(r.id), label=F.lit(r.label)
            ),
        )
        for i, r in enumerate(rules)
    ]

    def kept(hit: Column) -> Column:
        verdict = F
        for i, r in enumerate(rules):
            drop = suppressed(r, hit["match"], hit["captured"])
            if drop is not None:
                verdict = verdict.when(hit["rule_ord"] == i, ~drop)
        return F.lit(True) if verdict is F else verdict.otherwise(True)

    hits = F.filter(located_all(per_rule, tags), kept)
    return unroll(rows, keys, hits).withColumnRenamed("ord", "match_ord")


def secret_inventory(findings: DataFrame, key: str) -> DataFrame:
    """Findings and affected rows per rule."""
    return findings.groupBy("rule", "label").agg(
        F.count("*").alias("findings"), F.count_distinct(key).alias("rows")
    )


def match_entropy(findings: DataFrame) -> DataFrame:
    """Entropy in bits per character of every captured value."""
    return findings.withColumn("entropy", shannon_entropy(F.col("captured")))
