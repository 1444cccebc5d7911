"""Server-sent-event bodies as arrays of parsed events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewarden.functions.jsonpath import is_object

_SPACES = " \t\r\x0b\x0c\u00a0\ufeff"


def data_lines(body: Column) -> Column:
    """Payloads of the ``data:`` lines, in order, trimmed."""
    lines = F.transform(F.split(body, "\n"), lambda line: F.ltrim(line, F.lit(_SPACES)))
    return F.transform(
        F.filter(lines, lambda line: F.startswith(line, F.lit("data:"))),
        lambda line: F.btrim(F.substring(line, 6, 2147483647), F.lit(_SPACES)),
    )


def has_data_lines(body: Column) -> Column:
    """Whether a body is an event stream: some line starts with ``data:``."""
    return F.rlike(body, F.lit(r"(?:^|\n)[ \t\r\x0B\f\u00A0\uFEFF]*data:"))


def events(body: Column) -> Column:
    """array<variant> of the JSON objects in the stream; ``[DONE]`` and junk are skipped."""
    objects = F.filter(data_lines(body), lambda data: F.startswith(data, F.lit("{")))
    parsed = F.transform(objects, lambda data: F.try_parse_json(data))
    return F.filter(parsed, lambda event: is_object(event))
