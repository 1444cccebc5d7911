"""Type-guarded reads from variants, as SQL text.

The same reads as in ``jsonpath``, for expressions of hundreds of reads: text is parsed once,
where columns cost a call each, and every value that is used twice is bound by a lambda.
"""

from __future__ import annotations


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` evaluated once, under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def node(value: str, path: str) -> str:
    return f"try_variant_get({value}, '{path}', 'variant')"


def number(value: str, path: str) -> str:
    """The number at ``path`` as double; 0 when absent or not a number."""
    read = "try_variant_get(n, '$', 'double')"
    guard = "schema_of_variant(n) rlike '^(BIGINT|DECIMAL|DOUBLE)'"
    return bound(
        node(value, path), "n", f"if(coalesce({guard}, false) and abs({read}) < double('infinity'), {read}, 0D)"
    )


def text(value: str, path: str) -> str:
    """The string at ``path``; null when absent or not a string."""
    return bound(node(value, path), "s", "if(schema_of_variant(s) = 'STRING', try_variant_get(s, '$', 'string'), null)")


def filled_text(value: str, path: str) -> str:
    """Like ``text``, with the empty string taken as absent."""
    return f"nullif({text(value, path)}, '')"


def object_at(value: str, path: str) -> str:
    """The object at ``path``; null when absent or no object."""
    return bound(node(value, path), "o", "if(coalesce(schema_of_variant(o) like 'OBJECT%', false), o, null)")


def objects_at(value: str, path: str) -> str:
    """The object elements of an array; null when there is no array."""
    return (
        f"filter(try_variant_get({value}, '{path}', 'array<variant>'), "
        "x -> coalesce(schema_of_variant(x) like 'OBJECT%', false))"
    )


def truthy(value: str, path: str) -> str:
    """Whether the leaf counts as present: not null, false, 0 or the empty string."""
    read = lambda kind: f"try_variant_get(l, '$', '{kind}')"
    empty = (
        "case when schema_of_variant(l) = 'VOID' then true "
        f"when schema_of_variant(l) = 'STRING' then {read('string')} = '' "
        f"when schema_of_variant(l) = 'BOOLEAN' then not {read('boolean')} "
        f"when schema_of_variant(l) rlike '^(BIGINT|DECIMAL|DOUBLE)' then {read('double')} = 0D else false end"
    )
    return bound(node(value, path), "l", f"(schema_of_variant(l) is not null and not coalesce({empty}, false))")
