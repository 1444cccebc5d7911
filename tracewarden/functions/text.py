"""Column helpers for text: UTF-16 lengths, match lists, entropy, number display.

Offsets and lengths count UTF-16 code units, as the captured tools report them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ASTRAL = r"[^\x{0000}-\x{FFFF}]"
# Two noncharacters stand for the halves of a surrogate pair.
_HIGH, _LOW = "\ufdd0", "\ufdd1"
_BLOCK = 128
SNIPPET_LIMIT = 120


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unroll(df: DataFrame, keys: list[str], structs: Column) -> DataFrame:
    """One row per struct of an array: the keys, then the fields.

    The outer form keeps the optimizer from filtering on the array first, which would
    evaluate the expression that builds it once more.
    """
    rows = df.select(*keys, F.inline_outer(structs))
    # A field is null for every row without structs; the first one never is otherwise.
    return rows.filter(F.col(rows.columns[len(keys)]).isNotNull())


def unroll_items(df: DataFrame, keys: list[str], items: Column, place: str, value: str) -> DataFrame:
    """One row per array item with its position."""
    rows = df.select(*keys, F.posexplode_outer(items).alias(place, value))
    return rows.filter(F.col(place).isNotNull())


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def code_units(text: Column) -> Column:
    """``text`` with each astral character spelled as two BMP characters."""
    return F.regexp_replace(text, _ASTRAL, _HIGH + _LOW)


def utf16_length(text: Column) -> Column:
    # UTF-8 spends four bytes exactly on astral characters, so a text whose byte
    # count equals its character count needs no closer look.
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(
        F.length(code_units(text))
    )


def first_units(text: Column, n: int) -> Column:
    """The longest prefix of at most ``n`` code units that ends on a character."""
    head = F.left(code_units(text), F.lit(n))
    halves = F.length(head) - F.length(F.replace(head, F.lit(_HIGH), F.lit("")))
    return F.left(text, F.lit(n) - halves)


def snippet(match: Column) -> Column:
    """A match as reported in alerts: at most 120 units, cut with an ellipsis."""
    return F.when(utf16_length(match) <= SNIPPET_LIMIT, match).otherwise(
        F.concat(first_units(match, SNIPPET_LIMIT - 3), F.lit("..."))
    )


def gaps(text: Column, java: str) -> Column:
    """The stretches around the matches: one more entry than there are matches."""
    return F.split(text, java, -1)


def all_matches(text: Column, java: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java), F.lit(group))


def indices(items: Column) -> Column:
    """0 .. size-1, empty for an empty array."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def running_starts(lengths: Column) -> Column:
    """Exclusive running sum of an int array.

    Sums are taken per block first, so the work stays close to linear for texts
    with very many matches.
    """

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda a, x: a + x)

    def with_blocks(xs: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")),
            lambda b: total(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK))),
        )
        return let(
            blocks,
            lambda sums: F.transform(
                indices(xs),
                lambda i: total(F.slice(sums, F.lit(1), F.floor(i / _BLOCK).cast("int")))
                + total(
                    F.slice(
                        xs,
                        (F.floor(i / _BLOCK) * _BLOCK).cast("int") + 1,
                        (i % _BLOCK).cast("int"),
                    )
                ),
            ),
        )

    return let(
        lengths,
        lambda xs: F.when(F.size(xs) > 0, with_blocks(xs)).otherwise(F.array().cast("array<int>")),
    )


def fold_in_blocks(
    count: Column, state: Column, emitted: str, step: Callable[[Column, Column], Column]
) -> Column:
    """What ``step(state, i)``, a struct<state, out>, puts out for i from 0 to count - 1.

    An array that grows is copied with every item. Items are gathered per block here, and blocks
    in the whole, so the work stays close to linear for very many items. Every step is used in
    one place alone: what it puts out is taken over with the next one.
    """
    none = F.lit(None).cast(emitted)
    items = f"array<{emitted}>"

    def block(state: Column, b: Column) -> Column:
        """struct<last, out> after the items of a block."""
        start = F.struct(
            F.struct(state.alias("state"), none.alias("out")).alias("last"), F.array().cast(items).alias("out")
        )
        numbers = F.sequence((b * _BLOCK).cast("int"), F.least(b * _BLOCK + (_BLOCK - 1), count - 1).cast("int"))
        taken = lambda acc: F.concat(acc["out"], F.array(acc["last"]["out"]))
        return F.aggregate(
            numbers,
            start,
            lambda acc, i: F.struct(step(acc["last"]["state"], i).alias("last"), taken(acc).alias("out")),
            # The first thing taken is the null from before the first item.
            lambda acc: F.struct(acc["last"].alias("last"), F.slice(taken(acc), F.lit(2), F.lit(_BLOCK)).alias("out")),
        )

    start = F.struct(
        F.struct(
            F.struct(state.alias("state"), none.alias("out")).alias("last"), F.array().cast(items).alias("out")
        ).alias("block"),
        F.array().cast(f"array<{items}>").alias("done"),
    )
    taken = lambda acc: F.concat(acc["done"], F.array(acc["block"]["out"]))
    whole = F.aggregate(
        F.sequence(F.lit(0), F.floor((count - 1) / _BLOCK).cast("int")),
        start,
        lambda acc, b: F.struct(block(acc["block"]["last"]["state"], b).alias("block"), taken(acc).alias("done")),
        lambda acc: F.flatten(taken(acc)),
    )
    return F.when(count > 0, whole).otherwise(F.array().cast(items))


def match_parts(text: Column, java: str, group: int, **tags: Column) -> Column:
    """struct<tags…, m, c, g>: matches, captures and the gaps around the matches.

    A capture is the group's text, or the whole match for group 0.
    """
    whole = all_matches(text, java)
    return F.struct(
        *[value.alias(name) for name, value in tags.items()],
        whole.alias("m"),
        (all_matches(text, java, group) if group else whole).alias("c"),
        gaps(text, java).alias("g"),
    )


def located(parts: Column, tags: tuple[str, ...]) -> Column:
    """array<struct<tags…, ord, match, captured, offset, length>> of one rule's matches.

    Matches and gaps interleave, so the offsets are running sums of their lengths.
    """
    sizes = F.transform(
        indices(parts["m"]),
        lambda i: utf16_length(F.get(parts["g"], i)) + utf16_length(F.get(parts["m"], i)),
    )
    return let(
        running_starts(sizes),
        lambda starts: F.transform(
            indices(parts["m"]),
            lambda i: F.struct(
                *[parts[tag].alias(tag) for tag in tags],
                i.alias("ord"),
                F.get(parts["m"], i).alias("match"),
                F.get(parts["c"], i).alias("captured"),
                (F.get(starts, i) + utf16_length(F.get(parts["g"], i))).cast("int").alias("offset"),
                utf16_length(F.get(parts["m"], i)).cast("int").alias("length"),
            ),
        ),
    )


def located_all(rules: list[Column], tags: tuple[str, ...]) -> Column:
    """The located matches of several rules, rule after rule.

    Each entry of ``rules`` is a ``match_parts`` struct, or null where the rule does not
    apply; positions are worked out in one place for all of them.
    """
    hit = F.array_compact(F.array(*rules))
    return F.flatten(F.transform(hit, lambda parts: located(parts, tags)))


def shannon_entropy(value: Column) -> Column:
    """Average bits per character."""

    def bits(s: Column) -> Column:
        share = lambda ch: (
            (F.length(s) - F.length(F.replace(s, ch, F.lit("")))) / F.length(s)
        )
        return F.aggregate(
            F.array_sort(F.array_distinct(F.split(s, ""))),
            F.lit(0.0),
            lambda acc, ch: acc - share(ch) * F.log2(share(ch)),
        )

    return let(value, lambda s: F.when(F.length(s) > 0, bits(s)).otherwise(F.lit(0.0)))


def to_fixed(x: Column, digits: int) -> Column:
    """A non-negative double with ``digits`` decimals, rounded on its exact binary value.

    Rounding compares 2·x·10^d with the odd integer between two candidates. The
    product is formed from the two halves of x, which makes its sign exact.
    """
    scale = 10**digits

    def parts(v: Column) -> Column:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        base = F.floor(v * scale).cast("long")
        odd = (base * 2 + 1).cast("double")
        above = (high * (2.0 * scale) - odd) + (v - high) * (2.0 * scale) >= 0
        return base + F.when(above, 1).otherwise(0)

    def show(n: Column) -> Column:
        if digits == 0:
            return n.cast("string")
        frac = F.lpad((n % scale).cast("string"), digits, "0")
        return F.concat(F.floor(n / scale).cast("long").cast("string"), F.lit("."), frac)

    return let(x.cast("double"), lambda v: let(parts(v), show))


def text_tokens(text: Column) -> Column:
    """Estimated tokens of a plain string: a quarter of its length, rounded up."""
    return F.coalesce(F.ceil(utf16_length(text) / 4), F.lit(0)).cast("long")
