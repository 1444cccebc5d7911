"""Type-guarded reads from variant values.

A cast-style variant read turns the string "5" into the number 5. Usage fields
must be genuine JSON numbers and names genuine JSON strings, so each read checks
the type of the leaf first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column, path: str = "$") -> Column:
    """First letters of the type: O(bject), A(rray), S(tring), B(IGINT/OOLEAN), D…, V(oid)."""
    return F.schema_of_variant(node(value, path) if path != "$" else value)


def is_object(value: Column, path: str = "$") -> Column:
    return F.coalesce(F.startswith(kind(value, path), F.lit("OBJECT")), F.lit(False))


def is_array(value: Column, path: str = "$") -> Column:
    return F.coalesce(F.startswith(kind(value, path), F.lit("ARRAY")), F.lit(False))


def number(value: Column, path: str) -> Column:
    """The number at ``path`` as double; 0 when absent or not a number."""
    shape = kind(value, path)
    numeric = shape.startswith("BIGINT") | shape.startswith("DECIMAL") | shape.startswith("DOUBLE")
    got = F.try_variant_get(value, path, "double")
    return F.when(numeric & (F.abs(got) < F.lit(float("inf"))), got).otherwise(F.lit(0.0))


def text(value: Column, path: str) -> Column:
    """The string at ``path``; null when absent or not a string."""
    return F.when(kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def filled_text(value: Column, path: str) -> Column:
    """Like ``text``, with the empty string taken as absent."""
    return F.nullif(text(value, path), F.lit(""))


def items(value: Column, path: str) -> Column:
    """The array at ``path`` as array<variant>; null when it is not an array."""
    return F.try_variant_get(value, path, "array<variant>")


def truthy(value: Column, path: str) -> Column:
    """Whether the leaf counts as present: not null, false, 0 or the empty string."""
    leaf = kind(value, path)
    empty = (
        (leaf == "VOID")
        | ((leaf == "STRING") & (F.try_variant_get(value, path, "string") == ""))
        | ((leaf == "BOOLEAN") & ~F.try_variant_get(value, path, "boolean"))
        | (
            (leaf.startswith("BIGINT") | leaf.startswith("DECIMAL") | leaf.startswith("DOUBLE"))
            & (F.try_variant_get(value, path, "double") == 0.0)
        )
    )
    return leaf.isNotNull() & ~F.coalesce(empty, F.lit(False))
