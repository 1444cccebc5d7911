"""Policy-driven redaction of text columns and JSON bodies.

A policy is a small ordered rule list on the driver. It compiles to a chain of
projections, one per rule, each seeing the text that the previous ones left. The
chain is row-local, so redaction is a narrow stage whatever the size of the table.

Most rows match no rule. Every step is therefore guarded by literal look-ups on the
lower-cased text, which is made anew only where a rule has changed the text, and the
pattern itself runs only on rows that pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.dialect import Pattern, replacement
from tracewarden.functions.text import (
    all_matches,
    any_of,
    code_units,
    fold_in_blocks,
    gaps,
    indices,
    let,
    running_starts,
    unroll,
    unroll_items,
)
from tracewarden.operators.findings import suppressed
from tracewarden.rules.base import Rule
from tracewarden.rules.redaction import PRESETS
from tracewarden.session import gateway

HITS = "array<struct<rule_ord:int,rule:string,hit_ord:int,original:string>>"


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...] = ()
    allow_strings: tuple[str, ...] = ()
    allow_patterns: tuple[Pattern, ...] = ()
    only: tuple[tuple[str, ...], ...] | None = None
    skip: tuple[tuple[str, ...], ...] = ()

    @property
    def scoped(self) -> bool:
        return self.only is not None or bool(self.skip)

    def unscoped(self) -> "Policy":
        return Policy(self.rules, self.allow_strings, self.allow_patterns)

    def exceptions(self) -> "Policy":
        """The allowlists alone."""
        return Policy((), self.allow_strings, self.allow_patterns)

    def covers(self, path: tuple[str, ...]) -> bool:
        """Whether a string leaf at this path is redacted."""
        def fits(matcher: tuple[str, ...]) -> bool:
            return len(matcher) == len(path) and all(
                m in ("*", p) for m, p in zip(matcher, path)
            )
        if any(fits(m) for m in self.skip):
            return False
        return self.only is None or any(fits(m) for m in self.only)


def preset(name: str) -> Policy:
    return compile_policy({"extends": name})


def parse_path(path: str) -> tuple[str, ...]:
    """Dotted path to segments; ``[*]`` stands for the elements of an array."""
    return tuple(part for part in path.replace("[*]", ".*.").split(".") if part)


def compile_policy(spec: dict) -> Policy:
    """A policy from its JSON form: extends, rules, allowlist, paths."""
    rules: tuple[Rule, ...] = ()
    if spec.get("extends"):
        if spec["extends"] not in PRESETS:
            raise ValueError(f"unknown preset {spec['extends']!r}, use one of {', '.join(PRESETS)}")
        rules = PRESETS[spec["extends"]]
    for item in spec.get("rules") or []:
        source, flags = item["pattern"], ""
        if source.startswith("(?i)"):
            source, flags = source[4:], "i"
        context = tuple(word.lower() for word in item.get("context") or ())
        rules += (
            Rule(
                item["id"],
                Pattern(source, flags),
                token=item["replacement"],
                context=context,
                window=item.get("contextWindow") or 100 if context else 100,
            ),
        )
    allow = spec.get("allowlist") or {}
    paths = spec.get("paths") or {}
    return Policy(
        rules=rules,
        allow_strings=tuple(allow.get("strings") or ()),
        allow_patterns=tuple(Pattern(p) for p in allow.get("patterns") or ()),
        only=tuple(parse_path(p) for p in paths["only"]) if paths.get("only") is not None else None,
        skip=tuple(parse_path(p) for p in paths.get("skip") or ()),
    )


# --- one rule as a step -------------------------------------------------------


def _dropped(policy: Policy, rule: Rule, match: Column, captured: Column) -> Column | None:
    """Whether an allowlist or the entropy floor keeps this match in the text."""
    tests = []
    if policy.allow_strings:
        tests.append(match.isin(*policy.allow_strings))
    tests += [F.rlike(match, F.lit(p.java)) for p in policy.allow_patterns]
    own = suppressed(rule, match, captured)
    if own is not None:
        tests.append(own)
    return any_of(tests) if tests else None


def _step_guard(rule: Rule, now: Column, lowered: Column) -> Column:
    """A necessary condition for the rule to fire; ``lowered`` is the text as it stands, lower-cased."""
    literal = rule.may_match(lowered)
    if rule.context and all(word.isascii() for word in rule.context):
        spoken = any_of([F.contains(lowered, F.lit(word)) for word in rule.context])
        literal = spoken if literal is None else literal & spoken
    pattern = F.rlike(now, F.lit(rule.probe_java))
    return pattern if literal is None else literal & pattern


def _parts(rule: Rule, now: Column) -> Column:
    if rule.lead:
        return let(
            F.struct(
                all_matches(now, rule.java, 1).alias("lead"),
                all_matches(now, rule.java, 2).alias("m"),
                gaps(now, rule.java).alias("g"),
            ),
            lambda x: F.struct(
                x["m"].alias("m"),
                x["m"].alias("c"),
                F.transform(x["g"], lambda g, i: F.concat(g, F.coalesce(F.get(x["lead"], i), F.lit("")))).alias("g"),
            ),
        )
    found = [all_matches(now, rule.java).alias("m"), gaps(now, rule.java).alias("g")]
    if rule.group and (rule.allow or rule.min_entropy is not None):
        return F.struct(*found, all_matches(now, rule.java, rule.group).alias("c"))
    # Only a suppression looks at captures: the text is not searched for them a third time.
    return let(F.struct(*found), lambda x: F.struct(x["m"].alias("m"), x["m"].alias("c"), x["g"].alias("g")))


def _stitch(parts: Column, chosen: Column, token: Callable[[Column], Column]) -> Column:
    """Gaps and matches put together again, with a token for every chosen match."""
    return F.concat(
        F.get(parts["g"], F.lit(0)),
        F.array_join(
            F.transform(
                indices(parts["m"]),
                lambda i: F.concat(
                    F.when(F.get(chosen, i), token(i)).otherwise(F.get(parts["m"], i)),
                    F.get(parts["g"], i + 1),
                ),
            ),
            "",
        ),
    )


def _gate(policy: Policy, rule: Rule, parts: Column, token: Column) -> Column:
    """array<boolean>: which matches of a context-gated rule are replaced.

    Matches are settled from the last to the first. A match sees the text as it then
    stands: still original on its left, already redacted on its right. Only `window`
    characters on either side matter, so the left side is joined from the few nearest
    pieces and the right side is carried along cut to the window.
    """
    window = rule.window
    # A piece pair holds at least one character, so `window` pairs always fill the left side.
    reach = window + 1

    def left_of(i: Column) -> Column:
        start = F.greatest(i - reach, F.lit(0))
        pieces = F.transform(
            F.sequence(start, i),
            lambda k: F.concat(
                F.get(parts["g"], k), F.when(k < i, F.get(parts["m"], k)).otherwise("")
            ),
        )
        return F.right(code_units(F.right(F.array_join(pieces, ""), F.lit(window))), F.lit(window))

    def settle(acc: Column, i: Column) -> Column:
        match = F.get(parts["m"], i)
        right = F.left(
            code_units(F.left(F.concat(F.get(parts["g"], i + 1), acc["head"]), F.lit(window))),
            F.lit(window),
        )
        region = F.lower(F.concat(left_of(i), match, right))
        near = let(
            region, lambda r: any_of([F.contains(r, F.lit(word)) for word in rule.context])
        )
        dropped = _dropped(policy, rule, match, F.get(parts["c"], i))
        fires = near if dropped is None else ~dropped & near
        return let(
            fires,
            lambda hit: F.struct(
                F.left(
                    F.concat(
                        F.when(hit, token).otherwise(match), F.get(parts["g"], i + 1), acc["head"]
                    ),
                    F.lit(window),
                ).alias("head"),
                F.concat(acc["flags"], F.when(hit, "1").otherwise("0")).alias("flags"),
            ),
        )

    start = F.struct(F.lit("").alias("head"), F.lit("").alias("flags"))
    flags = F.aggregate(
        F.reverse(indices(parts["m"])), start, settle, lambda acc: acc["flags"]
    )
    return F.transform(F.split(F.reverse(flags), ""), lambda f: f == "1")


def _choose(policy: Policy, rule: Rule, parts: Column, token: Column) -> Column:
    """array<boolean>: which matches are replaced."""
    if rule.context:
        return _gate(policy, rule, parts, token)
    dropped = lambda i: _dropped(policy, rule, F.get(parts["m"], i), F.get(parts["c"], i))
    return F.transform(
        indices(parts["m"]),
        lambda i: F.lit(True) if dropped(i) is None else ~dropped(i),
    )


def _plain(policy: Policy, rule: Rule) -> bool:
    """No decision per match: the rule is a single replace."""
    return not (
        rule.context
        or rule.allow
        or rule.min_entropy is not None
        or policy.allow_strings
        or policy.allow_patterns
    )


def _done(policy: Policy, rule: Rule, now: Column) -> Column:
    """The text after one rule that may fire."""
    token = F.lit(rule.token)
    if _plain(policy, rule):
        kept = "$1" if rule.lead else ""
        return F.regexp_replace(now, F.lit(rule.java), F.lit(kept + replacement(rule.token)))
    return let(
        _parts(rule, now),
        lambda parts: let(
            _choose(policy, rule, parts, token),
            lambda chosen: _stitch(parts, chosen, lambda i: token),
        ),
    )


def _lowered(x: Column, now: Column) -> Column:
    """The lower-cased text for the next rule."""
    return F.when(now == x["now"], x["low"]).otherwise(F.lower(now))


# --- the chain ----------------------------------------------------------------
#
# The texts of a row travel as array<struct<was, low, now[, hits]>>, and a rule is one
# `transform` over that array. Each projection uses its input once, so the optimizer
# folds the whole chain into a single projection: no row is copied between rules.

Namer = Callable[[Rule, Column], Column]


def _start(text: Column, keep_hits: bool = False) -> Column:
    fields = [text.alias("was"), F.lower(text).alias("low"), text.alias("now")]
    if keep_hits:
        fields.append(F.array().cast(HITS).alias("hits"))
    return F.struct(*fields)


def _rule_step(policy: Policy, rule: Rule) -> Callable[[Column], Column]:
    def step(x: Column) -> Column:
        changed = let(
            _done(policy, rule, x["now"]),
            lambda now: F.struct(x["was"].alias("was"), _lowered(x, now).alias("low"), now.alias("now")),
        )
        return F.when(_step_guard(rule, x["now"], x["low"]), changed).otherwise(x)

    return step


def _hit_step(policy: Policy, rule: Rule, ord_: int, token: Namer | None) -> Callable[[Column], Column]:
    seen = F.lit(rule.token) if token is None else token(rule, F.lit(1))

    def replaced(x: Column, parts: Column, chosen: Column) -> Column:
        def named(before: Column) -> Column:
            # Gated rules settle from the right, so their serials run the other way.
            last = F.size(x["hits"]) + F.size(F.filter(chosen, lambda c: c))
            serial = lambda i: last - F.get(before, i) if rule.context else F.size(x["hits"]) + F.get(before, i) + 1
            return _stitch(parts, chosen, lambda i: token(rule, serial(i)))

        if token is None:
            now = _stitch(parts, chosen, lambda i: seen)
        else:
            now = let(running_starts(F.transform(chosen, lambda c: F.when(c, 1).otherwise(0))), named)
        return let(
            now,
            lambda text: F.struct(
                x["was"].alias("was"),
                _lowered(x, text).alias("low"),
                text.alias("now"),
                F.concat(x["hits"], _hits(rule, ord_, parts, chosen)).alias("hits"),
            ),
        )

    def step(x: Column) -> Column:
        done = let(
            _parts(rule, x["now"]),
            lambda parts: let(
                _choose(policy, rule, parts, seen), lambda chosen: replaced(x, parts, chosen)
            ),
        )
        return F.when(_step_guard(rule, x["now"], x["low"]), done).otherwise(x)

    return step


def _hits(rule: Rule, ord_: int, parts: Column, chosen: Column) -> Column:
    """The replaced originals in the order they are settled: gated rules from the right."""
    order = F.reverse(indices(parts["m"])) if rule.context else indices(parts["m"])
    return F.transform(
        F.filter(order, lambda i: F.get(chosen, i)),
        lambda i, n: F.struct(
            F.lit(ord_).alias("rule_ord"),
            F.lit(rule.id).alias("rule"),
            n.cast("int").alias("hit_ord"),
            F.get(parts["m"], i).alias("original"),
        ),
    )


# Building a step costs a few hundred calls into the JVM, and Columns are not tied to a
# table, so finished steps are kept and shared between queries. ``jvm`` tells apart the
# gateways of a process that restarts Spark.


@lru_cache(maxsize=1024)
def _step_column(texts: str, policy: Policy, rule: Rule, jvm: int) -> Column:
    return F.transform(F.col(texts), _rule_step(policy, rule))


@lru_cache(maxsize=1024)
def _hit_step_column(
    texts: str, policy: Policy, rule: Rule, ord_: int, token: Namer | None, jvm: int
) -> Column:
    return F.transform(F.col(texts), _hit_step(policy, rule, ord_, token))


def _run_rules(df: DataFrame, policy: Policy, texts: str) -> DataFrame:
    for rule in policy.rules:
        df = df.withColumn(texts, _step_column(texts, policy.exceptions(), rule, gateway(df)))
    return df


def _run_rules_with_hits(df: DataFrame, policy: Policy, texts: str, token: Namer | None) -> DataFrame:
    for ord_, rule in enumerate(policy.rules):
        step = _hit_step_column(texts, policy.exceptions(), rule, ord_, token, gateway(df))
        df = df.withColumn(texts, step)
    return df


def _field(texts: str, name: str) -> Column:
    return F.element_at(F.transform(F.col(texts), lambda x: x[name]), 1)


def redact_with_hits(
    df: DataFrame, policy: Policy, text: str = "text", token: Namer | None = None
) -> DataFrame:
    """Adds ``redacted`` and ``hits``, the replaced originals in replacement order.

    ``token(rule, serial)`` names the replacement of one match; ``serial`` counts the
    replacements of the row so far. The default is the rule's static token.
    """
    df = df.withColumn("_texts", F.array(_start(F.col(text), keep_hits=True)))
    df = _run_rules_with_hits(df, policy, "_texts", token)
    return df.withColumns(
        {"redacted": _field("_texts", "now"), "hits": _field("_texts", "hits")}
    ).drop("_texts")


# --- tables -------------------------------------------------------------------


def redact_table(df: DataFrame, policy: Policy, text: str = "text", out: str | None = None) -> DataFrame:
    """The table with one text column redacted.

    A bare text column has the empty path: a policy scoped by ``only`` leaves it alone.
    """
    if not policy.covers(()):
        return df if out is None else df.withColumn(out, F.col(text))
    df = _run_rules(df.withColumn("_texts", F.array(_start(F.col(text)))), policy, "_texts")
    return df.withColumn(out or text, _field("_texts", "now")).drop("_texts")


def redaction_findings(
    df: DataFrame, policy: Policy, text: str = "text", keys: list[str] | None = None
) -> DataFrame:
    """One row per replacement: keys, rule_ord, rule, hit_ord, original."""
    keys = keys or [c for c in df.columns if c != text]
    rows = df.select(*keys, F.col(text).alias("_text"))
    return unroll(redact_with_hits(rows, policy, "_text"), keys, F.col("hits"))


def redaction_stats(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Replacements per rule, and per group when given."""
    return findings.groupBy(*(by or []), "rule").agg(F.count("*").alias("replacements"))


# --- JSON bodies --------------------------------------------------------------

# One JSON string literal; possessive, so long strings do not recurse.
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _unquote(literal: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(literal), "$", "string")


def _quote(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _literal_paths(parts: Column) -> Column:
    """For each string literal its path as array<string>, or null for an object key.

    The gaps between literals hold only structure. Walking them keeps the open
    containers on a stack: ``*`` for an array, the current key for an object.
    """

    def enter(stack: Column, gap: Column) -> Column:
        moves = F.split(F.regexp_replace(gap, r"[^{}\[\]]", ""), "")
        return F.aggregate(
            F.filter(moves, lambda c: c != ""),
            stack,
            lambda st, c: F.when(c == "{", F.concat(st, F.array(F.lit(""))))
            .when(c == "[", F.concat(st, F.array(F.lit("*"))))
            .otherwise(F.slice(st, F.lit(1), F.size(st) - 1)),
        )

    def walk(stack: Column, i: Column) -> Column:
        named = lambda st: F.concat(
            F.slice(st, F.lit(1), F.size(st) - 1), F.array(_unquote(F.get(parts["m"], i)))
        )
        is_key = F.rlike(F.get(parts["g"], i + 1), F.lit(r"^\s*:"))
        return let(
            F.struct(enter(stack, F.get(parts["g"], i)).alias("stack"), is_key.alias("key")),
            lambda x: F.struct(
                F.when(x["key"], named(x["stack"])).otherwise(x["stack"]).alias("state"),
                F.when(~x["key"], x["stack"]).alias("out"),
            ),
        )

    return fold_in_blocks(
        F.size(parts["m"]), F.array().cast("array<string>"), "array<string>", walk
    )


def _path_fits(path: Column, matcher: tuple[str, ...]) -> Column:
    test = F.size(path) == len(matcher)
    for i, segment in enumerate(matcher):
        if segment != "*":
            test = test & F.coalesce(F.get(path, F.lit(i)) == segment, F.lit(False))
    return test


def _in_scope(policy: Policy, path: Column) -> Column:
    scope = F.lit(True)
    if policy.only is not None:
        scope = any_of([_path_fits(path, m) for m in policy.only]) if policy.only else F.lit(False)
    if policy.skip:
        scope = scope & ~any_of([_path_fits(path, m) for m in policy.skip])
    return scope


def redact_json(df: DataFrame, policy: Policy, body: str, out: str | None = None) -> DataFrame:
    """The table with the string leaves of a JSON text column redacted.

    The text is cut into string literals and the structure between them, so depth does
    not matter and keys, their order and the layout survive. All leaves of a row go
    through a rule together. A body that is not JSON is returned as it is.
    """
    text = F.col(body)
    inner = policy.unscoped()
    cut = F.struct(
        all_matches(text, _JSON_STRING).alias("m"), gaps(text, _JSON_STRING).alias("g")
    )
    parts = F.col("_parts")
    if policy.scoped:
        chosen = F.transform(
            _literal_paths(parts), lambda path: path.isNotNull() & _in_scope(policy, path)
        )
    else:
        chosen = F.transform(
            indices(parts["m"]), lambda i: ~F.rlike(F.get(parts["g"], i + 1), F.lit(r"^\s*:"))
        )
    leaves = F.transform(
        F.zip_with(
            parts["m"], F.col("_chosen"), lambda literal, on: F.when(on, _unquote(literal))
        ),
        lambda plain: _start(plain),
    )
    df = (
        df.withColumn("_parts", F.when(F.try_parse_json(text).isNotNull(), cut))
        .withColumn("_chosen", chosen)
        .withColumn("_leaves", leaves)
    )
    df = _run_rules(df, inner, "_leaves")
    # Bound once: inside the stitching it would be worked out anew for every literal.
    rebuilt = let(
        F.transform(F.col("_leaves"), lambda x: F.coalesce(x["now"] != x["was"], F.lit(False))),
        lambda changed: _stitch(parts, changed, lambda i: _quote(F.get(F.col("_leaves"), i)["now"])),
    )
    return df.withColumn(
        out or body, F.when(parts.isNotNull(), rebuilt).otherwise(text)
    ).drop("_parts", "_chosen", "_leaves")


def json_leaves(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """One row per string leaf: keys, leaf_ord, path (dotted, ``*`` for elements), value."""
    text = F.col(body)
    cut = F.struct(
        all_matches(text, _JSON_STRING).alias("m"), gaps(text, _JSON_STRING).alias("g")
    )
    leaves = let(
        cut,
        lambda parts: F.filter(
            F.zip_with(
                _literal_paths(parts),
                parts["m"],
                lambda path, literal: F.struct(
                    path.alias("path"), F.when(path.isNotNull(), _unquote(literal)).alias("value")
                ),
            ),
            lambda leaf: leaf["path"].isNotNull(),
        ),
    )
    valid = F.when(F.try_parse_json(text).isNotNull(), leaves)
    return unroll_items(df, keys, valid, "leaf_ord", "_leaf").select(
        *keys,
        "leaf_ord",
        F.array_join(F.col("_leaf.path"), ".").alias("path"),
        F.col("_leaf.path").alias("segments"),
        F.col("_leaf.value").alias("value"),
    )
