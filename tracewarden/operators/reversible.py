"""Reversible redaction: session dictionaries, pseudonymised text, rehydration.

A text is rewritten in two narrow steps with one join in between. The rule chain first
replaces every finding by a numbered stand-in that cannot occur in text, and lists the
originals. The dictionary numbers the distinct originals of a session. The stand-ins are
then exchanged for the placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.text import all_matches, fold_in_blocks, gaps, indices, let, unroll_items
from tracewarden.operators.ranking import numbered, order_slices
from tracewarden.operators.redact import Policy, redact_with_hits
from tracewarden.rules.base import Rule

DEFAULT_SESSION = "__default__"
# Noncharacters in place of the brackets of a placeholder mark a stand-in.
_OPEN, _CLOSE = "\ufdd2", "\ufdd3"
_STAND_IN = _OPEN + r"[A-Z0-9_]+?_([0-9]+)" + _CLOSE


def rule_label(rule: Column) -> Column:
    return F.regexp_replace(F.upper(rule), "[^A-Z0-9]", "_")


def _stand_in(rule: Rule, serial: Column) -> Column:
    label = "".join(c if c.isascii() and c.isalnum() else "_" for c in rule.id.upper())
    return F.concat(F.lit(_OPEN + label + "_"), serial.cast("string"), F.lit(_CLOSE))


def with_stand_ins(df: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """Adds ``redacted`` with stand-ins and ``hits``, the originals in replacement order.

    The n-th stand-in of a row belongs to the n-th hit.
    """
    return redact_with_hits(df, policy, text, _stand_in)


def session_hits(
    marked: DataFrame, session: str, order: str, leaf: str | None = None
) -> DataFrame:
    """Hits as rows: session, order, leaf, serial, rule, original."""
    place = F.col(leaf) if leaf else F.lit(0)
    rows = marked.select(
        F.coalesce(F.nullif(F.col(session), F.lit("")), F.lit(DEFAULT_SESSION)).alias("session_id"),
        F.col(order).alias("seq"),
        place.alias("leaf"),
        "hits",
    )
    unrolled = unroll_items(rows, ["session_id", "seq", "leaf"], F.col("hits"), "serial", "_hit")
    return unrolled.select("session_id", "seq", "leaf", "serial", "_hit.rule", "_hit.original")


def _written(df: DataFrame, staging: str | None, name: str) -> DataFrame:
    """``df`` as it is, or written to the staging folder and read back."""
    if not staging:
        return df
    df.write.mode("overwrite").parquet(f"{staging}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{staging}/{name}")


def build_dictionary(
    hits: DataFrame, bucket_width: int = 4096, staging: str | None = None, slices: int = 64
) -> DataFrame:
    """session_id, original, rule, ordinal, placeholder.

    An original gets its placeholder from the rule that met it first in the session.
    Hits are first reduced to distinct originals with map-side combining, and the numbering
    works per slice of the order, so that one busy session spreads over many tasks. With a
    ``staging`` folder that all executors share, the originals are written once and cut into
    even ``slices`` whatever the unit of ``seq`` is; without one, a slice is ``bucket_width`` of it.
    """
    place = F.struct("seq", "leaf", "serial")
    originals = hits.groupBy("session_id", "original").agg(
        F.min(F.struct(place.alias("at"), F.col("rule"))).alias("_first")
    ).select("session_id", "original", F.col("_first.rule").alias("rule"), F.col("_first.at").alias("at"))
    originals = _written(
        originals.withColumns({"_seq": F.col("at.seq").cast("long"), "_leaf": F.col("at.leaf").cast("long")}),
        staging,
        "originals",
    )
    if staging:
        bucket = order_slices(originals, "_seq", "_leaf", slices)
    else:
        bucket = F.floor(F.col("_seq") / bucket_width)
    counted = numbered(
        originals, keys=["session_id", "rule"], order=[F.col("at")], bucket=bucket, out="ordinal"
    )
    return counted.select(
        "session_id",
        "original",
        "rule",
        "ordinal",
        F.concat(
            F.lit("["), rule_label(F.col("rule")), F.lit("_"), F.col("ordinal").cast("string"), F.lit("]")
        ).alias("placeholder"),
    )


def resolve_stand_ins(text: Column, names: Column) -> Column:
    """The text with the n-th stand-in replaced by entry n of ``names``."""
    parts = F.struct(
        all_matches(text, _STAND_IN, 1).alias("serial"), gaps(text, _STAND_IN).alias("g")
    )
    return let(
        parts,
        lambda p: F.concat(
            F.get(p["g"], F.lit(0)),
            F.array_join(
                F.transform(
                    indices(p["serial"]),
                    lambda i: F.concat(
                        F.get(names, F.get(p["serial"], i).cast("int") - 1), F.get(p["g"], i + 1)
                    ),
                ),
                "",
            ),
        ),
    )


def pseudonymise(
    df: DataFrame,
    policy: Policy,
    key: str,
    session: str = "session_id",
    order: str = "seq",
    text: str = "text",
    out: str = "pseudonymised",
    staging: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(the table with placeholders, the dictionary). ``key`` identifies a row.

    Only rows with hits take part in the join: their hits meet the dictionary on
    (session, original), and the placeholders return to the row on ``key``. An original
    that fills a large share of the hits meets a single dictionary row, which adaptive
    skew handling can split. The marked texts feed the dictionary and the result; with
    ``staging``, a folder that all executors share, they and the dictionary are written once and
    read back, so that the rules run a single time.
    """
    marked = _written(with_stand_ins(df, policy, text), staging, "marked")
    hits = session_hits(marked, session, order)
    dictionary = _written(build_dictionary(hits, staging=staging), staging, "dictionary")
    owned = marked.select(
        F.col(key).alias("_row"),
        F.coalesce(F.nullif(F.col(session), F.lit("")), F.lit(DEFAULT_SESSION)).alias("session_id"),
        "hits",
    )
    named = (
        unroll_items(owned, ["_row", "session_id"], F.col("hits"), "serial", "_hit")
        .select("_row", "session_id", "serial", F.col("_hit.original").alias("original"))
        .join(dictionary.select("session_id", "original", "placeholder"), ["session_id", "original"])
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("serial", "placeholder"))).alias("_names"))
        .select("_row", F.col("_names.placeholder").alias("_names"))
    )
    table = (
        marked.join(named, F.col(key) == F.col("_row"), "left")
        .withColumn(
            out,
            F.when(F.col("_names").isNull(), F.col("redacted")).otherwise(
                resolve_stand_ins(F.col("redacted"), F.col("_names"))
            ),
        )
        .drop("_row", "_names", "redacted", "hits")
    )
    return table, dictionary


# --- rehydration --------------------------------------------------------------

# Placeholders have one shape, whatever the rule.
_PLACEHOLDER = r"\[[A-Z0-9_]+_[0-9]+\]"


def json_escape(text: Column) -> Column:
    """A string as it stands inside a JSON literal."""
    inside = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)
    return F.when(text.isNotNull(), inside)


def found_placeholders(text: str) -> Column:
    """The distinct placeholder-shaped tokens of a text, overlapping digits included."""
    return F.array_distinct(all_matches(F.col(text), _PLACEHOLDER))


def rehydrate(
    df: DataFrame,
    dictionary: DataFrame,
    key: str,
    session: str = "session_id",
    text: str = "text",
    out: str = "rehydrated",
    escape: bool = False,
) -> DataFrame:
    """The table with every known placeholder of its session put back to the original.

    Only placeholders that occur in a text are looked up, so a row never meets its
    session's whole dictionary. A placeholder ends in a bracket, so none is part of a
    longer one and the pieces of the text are replaced side by side. With ``escape``
    originals are written as they stand inside a JSON string.
    """
    tokens = df.filter(F.contains(F.col(text), F.lit("["))).select(
        F.col(key).alias("_row"),
        F.coalesce(F.nullif(F.col(session), F.lit("")), F.lit(DEFAULT_SESSION)).alias("session_id"),
        F.explode(found_placeholders(text)).alias("placeholder"),
    )
    known = (
        tokens.join(
            dictionary.select("session_id", "placeholder", "original"), ["session_id", "placeholder"]
        )
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("_names"))
    )
    original = lambda token: (
        json_escape(F.try_element_at(F.col("_names"), token))
        if escape
        else F.try_element_at(F.col("_names"), token)
    )
    body = F.col(text)
    parts = F.struct(all_matches(body, _PLACEHOLDER).alias("m"), gaps(body, _PLACEHOLDER).alias("g"))
    restored = let(
        parts,
        lambda p: F.concat(
            F.get(p["g"], F.lit(0)),
            F.array_join(
                F.transform(
                    indices(p["m"]),
                    lambda i: F.concat(
                        F.coalesce(original(F.get(p["m"], i)), F.get(p["m"], i)),
                        F.get(p["g"], i + 1),
                    ),
                ),
                "",
            ),
        ),
    )
    return (
        df.join(known, F.col(key) == F.col("_row"), "left")
        .withColumn(out, F.when(F.col("_names").isNull(), body).otherwise(restored))
        .drop("_row", "_names")
    )


def reverse_lookup(requests: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Originals for (session_id, placeholder) rows; unknown ones give null."""
    return requests.join(
        dictionary.select("session_id", "placeholder", "original"),
        ["session_id", "placeholder"],
        "left",
    )


def dictionary_inventory(dictionary: DataFrame) -> DataFrame:
    """Entries per session and rule, and the size of each session's dictionary."""
    by_rule = dictionary.groupBy("session_id", "rule").agg(F.count("*").alias("entries"))
    return by_rule.withColumn(
        "session_size", F.sum("entries").over(Window.partitionBy("session_id"))
    )


# --- event streams ------------------------------------------------------------

# The string value of a field inside one JSON text; possessive, so long values do not recurse.
_FIELD = r'"%s"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def content_field(data: Column) -> Column:
    """Name of the field that carries the text of an event; null when none does."""
    has = lambda piece: F.contains(data, F.lit(piece))
    holds = lambda name: F.rlike(data, F.lit(_FIELD % name))
    return (
        F.when(has("text_delta") & holds("text"), "text")
        .when(has("thinking_delta") & holds("thinking"), "thinking")
        .when(has('"delta"') & has('"content"') & holds("content"), "content")
        .when(has('"parts"') & has('"text"') & holds("text"), "text")
    )


def content_literal(data: Column) -> Column:
    """The escaped text of an event, as it stands in the JSON; null when there is none."""
    pick = lambda name: F.regexp_extract(data, _FIELD % name, 1)
    return let(
        content_field(data),
        lambda f: F.when(f == "text", pick("text"))
        .when(f == "thinking", pick("thinking"))
        .when(f == "content", pick("content")),
    )


def unescaped(literal: Column) -> Column:
    """The plain text of an escaped JSON string body."""
    return F.try_variant_get(
        F.try_parse_json(F.concat(F.lit('"'), literal, F.lit('"'))), "$", "string"
    )


def sse_deltas(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """One row per text-bearing event of a stream body: keys, line, delta."""
    lines = F.transform(
        F.split(F.col(body), "\n"),
        lambda line: F.when(
            F.startswith(line, F.lit("data: ")),
            unescaped(content_literal(F.substring(line, 7, 2147483647))),
        ),
    )
    return unroll_items(df, keys, lines, "line", "delta").filter(F.col("delta").isNotNull())


def sse_text(df: DataFrame, body: str, keys: list[str], out: str = "answer") -> DataFrame:
    """The whole text that a stream body delivers, joined inside the row."""
    lines = F.transform(
        F.filter(F.split(F.col(body), "\n"), lambda line: F.startswith(line, F.lit("data: "))),
        lambda line: unescaped(content_literal(F.substring(line, 7, 2147483647))),
    )
    return df.select(*keys, F.array_join(F.array_compact(lines), "").alias(out))


def _restored(text: Column, names: Column) -> Column:
    """A text with the placeholders that ``names`` knows exchanged."""
    parts = F.struct(all_matches(text, _PLACEHOLDER).alias("m"), gaps(text, _PLACEHOLDER).alias("g"))
    return let(
        parts,
        lambda p: F.concat(
            F.get(p["g"], F.lit(0)),
            F.array_join(
                F.transform(
                    indices(p["m"]),
                    lambda i: F.concat(
                        F.coalesce(F.try_element_at(names, F.get(p["m"], i)), F.get(p["m"], i)),
                        F.get(p["g"], i + 1),
                    ),
                ),
                "",
            ),
        ),
    )


def _released(held: Column, names: Column) -> Column:
    """Lines that leave together, with the placeholders of their joint text restored.

    When something was restored, the first text-bearing line takes all of the text and
    the later ones are emptied.
    """
    carriers = F.filter(indices(held), lambda i: F.get(held, i)["text"].isNotNull())
    joint = F.array_join(F.transform(held, lambda h: F.coalesce(h["text"], F.lit(""))), "")

    def lines(x: Column) -> Column:
        # Escaping is applied once here: the joint text is plain.
        return let(
            json_escape(x["now"]),
            lambda escaped: F.transform(
                held,
                lambda h, i: F.when(h["text"].isNull() | (x["now"] == x["was"]), h["line"]).otherwise(
                    F.concat(h["head"], F.when(i == x["first"], escaped).otherwise(""), h["tail"])
                ),
            ),
        )

    return let(
        joint,
        lambda text: let(
            F.struct(
                text.alias("was"), _restored(text, names).alias("now"), F.get(carriers, F.lit(0)).alias("first")
            ),
            lines,
        ),
    )


def _split_event(line: Column) -> Column:
    """struct<head, tail, text>: the event line around its text value; null without one."""
    data = F.substring(line, 7, 2147483647)

    def cut(name: str) -> Column:
        around = rf'(?s)\A(.*?"{name}"\s*:\s*")([^"\\]*+(?:\\.[^"\\]*+)*+)(".*)\z'
        return F.struct(
            F.concat(F.lit("data: "), F.regexp_extract(data, around, 1)).alias("head"),
            F.regexp_extract(data, around, 3).alias("tail"),
            unescaped(F.regexp_extract(data, around, 2)).alias("text"),
        )

    field = content_field(data)
    return F.when(
        F.startswith(line, F.lit("data: ")),
        let(
            field,
            lambda f: F.when(f == "text", cut("text"))
            .when(f == "thinking", cut("thinking"))
            .when(f == "content", cut("content")),
        ),
    )


def rehydrated_stream(body: Column, names: Column) -> Column:
    """A complete event-stream body with placeholders restored across events.

    Text is held back while it may end inside a placeholder: while its last bracket opens.
    Blank lines wait with it, any other line forces it out. A first pass finds where lines
    leave; what leaves together is then put together by itself, so no line is copied twice.
    """
    event, blank, other = 0, 1, 2

    def read(line: Column) -> Column:
        return let(
            _split_event(line),
            lambda e: F.struct(
                line.alias("line"),
                e["head"].alias("head"),
                e["tail"].alias("tail"),
                e["text"].alias("text"),
                F.when(e["text"].isNotNull(), event).when(F.trim(line) == "", blank).otherwise(other).alias("kind"),
                F.right(F.regexp_replace(e["text"], r"[^\[\]]", ""), F.lit(1)).alias("bracket"),
            ),
        )

    def open_after(was: Column, x: Column) -> Column:
        """Whether text waits after a line."""
        return (
            F.when(x["kind"] == other, False)
            .when(x["bracket"] == "[", True)
            .when(x["bracket"] == "]", False)
            .otherwise(was)
        )

    def cut(lines: Column, waits: Column) -> Column:
        last = F.size(lines) - 1
        kind = lambda i: F.get(lines, i)["kind"]
        leaves = lambda i: (i == last) | ~F.get(waits, i) | (kind(i + 1) == other)
        return let(
            F.filter(indices(lines), leaves),
            lambda stops: F.flatten(
                F.transform(
                    stops,
                    lambda stop, j: let(
                        F.when(j > 0, F.get(stops, j - 1) + 1).otherwise(0),
                        lambda start: let(
                            F.slice(lines, start + 1, stop - start + 1), lambda held: _released(held, names)
                        ),
                    ),
                )
            ),
        )

    def whole(lines: Column) -> Column:
        step = lambda was, i: let(
            open_after(was, F.get(lines, i)), lambda now: F.struct(now.alias("state"), now.alias("out"))
        )
        return let(
            fold_in_blocks(F.size(lines), F.lit(False), "boolean", step), lambda waits: cut(lines, waits)
        )

    return F.array_join(let(F.transform(F.split(body, "\n"), read), whole), "\n")


def rehydrate_streams(
    df: DataFrame,
    dictionary: DataFrame,
    key: str,
    session: str = "session_id",
    body: str = "response_body",
    out: str = "rehydrated",
) -> DataFrame:
    """Event-stream bodies with the placeholders of their session restored."""
    answers = sse_text(df, body, [key, session], "_answer")
    tokens = answers.filter(F.contains("_answer", F.lit("["))).select(
        F.col(key).alias("_row"),
        F.coalesce(F.nullif(F.col(session), F.lit("")), F.lit(DEFAULT_SESSION)).alias("session_id"),
        F.explode(found_placeholders("_answer")).alias("placeholder"),
    )
    known = (
        tokens.join(
            dictionary.select("session_id", "placeholder", "original"), ["session_id", "placeholder"]
        )
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("_names"))
    )
    return (
        df.join(known, F.col(key) == F.col("_row"), "left")
        .withColumn(
            out,
            F.when(F.col("_names").isNull(), F.col(body)).otherwise(
                rehydrated_stream(F.col(body), F.col("_names"))
            ),
        )
        .drop("_row", "_names")
    )
