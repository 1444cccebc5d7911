"""Session reports over captures: lists, prompts, tools, overhead, ledger, totals."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.jsonpath import is_array, is_object, items, text
from tracewarden.functions.text import let, text_tokens, to_fixed, unroll_items
from tracewarden.operators.usage import cost_ledger, usage_ledger
from tracewarden.session import gateway


def _filled(value: Column, fallback: str = "?") -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback))


# --- selection ----------------------------------------------------------------


def matching(df: DataFrame, session: str | None = None, source: str | None = None) -> DataFrame:
    """Captures of one session, of one source, or of both; no condition keeps all."""
    if session:
        df = df.filter(F.col("session_id") == session)
    if source:
        df = df.filter(F.col("source") == source)
    return df


_UNITS = {"s": "SECOND", "m": "MINUTE", "h": "HOUR"}


def parse_last(span: str) -> int | None:
    """Seconds of a span such as 30m; null when it is not one."""
    digits, unit = span[:-1], span[-1:]
    if not (digits.isascii() and digits.isdigit() and unit in _UNITS):
        return None
    return int(digits) * {"s": 1, "m": 60, "h": 3600}[unit]


def recent(df: DataFrame, span: str, now: Column, at: str = "modified") -> DataFrame:
    """Rows no older than ``span`` at the time ``now``; an unreadable or zero span keeps all."""
    seconds = parse_last(span)
    if not seconds:
        return df
    return df.filter(F.col(at) >= now - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")))


# --- sessions -----------------------------------------------------------------


def session_list(captures: DataFrame) -> DataFrame:
    """One row per session, sorted by its first time.

    First and last go by file name, the order in which captures are listed, and not by
    time.
    """
    first = F.min_by(F.struct("source", "provider", "ts"), "file")
    return (
        captures.filter(F.col("session_id") != "")
        .groupBy("session_id")
        .agg(
            first.alias("_first"),
            F.count("*").alias("requests"),
            F.max_by("ts", "file").alias("last_time"),
        )
        .select(
            "session_id",
            _filled(F.col("_first.source")).alias("source"),
            _filled(F.col("_first.provider")).alias("provider"),
            "requests",
            F.col("_first.ts").alias("first_time"),
            "last_time",
        )
        .orderBy("first_time", "session_id")
    )


def latest_session_id(captures: DataFrame) -> DataFrame:
    """The session of the last file that has one."""
    return captures.filter(F.col("session_id") != "").agg(
        F.max_by("session_id", "file").alias("session_id")
    )


def latest_session(captures: DataFrame, source: str | None = None) -> DataFrame:
    """All captures that share the session of the last matching file, null included."""
    chosen = matching(captures, source=source)
    last = chosen.agg(
        F.max_by(F.struct("session_id"), "file").alias("_last"), F.count("*").alias("_n")
    ).filter("_n > 0").select(F.col("_last.session_id").alias("_session"))
    # One row by construction.
    return chosen.join(
        F.broadcast(last), F.col("session_id").eqNullSafe(F.col("_session")), "left_semi"
    )


def session_captures(captures: DataFrame, session: str) -> DataFrame:
    return matching(captures, session=session).orderBy("file")


def retained(captures: DataFrame, max_sessions: int) -> DataFrame:
    """Captures of the newest sessions, plus all captures without a session.

    The newest sessions come from a distributed top-k whose size is the parameter.
    """
    if max_sessions <= 0:
        return captures
    kept = captures.join(newest_sessions(captures, max_sessions), "file_session", "left_semi")
    return kept.unionByName(captures.filter(F.col("file_session").isNull()))


def newest_sessions(captures: DataFrame, most: int) -> DataFrame:
    """``file_session`` of the newest sessions by the write time in their file names."""
    stamp = F.regexp_extract("file", r"_(\d{13})-\d{6,}\.json$", 1)
    return (
        captures.filter(F.col("file_session").isNotNull())
        .groupBy("file_session")
        .agg(
            F.max(F.coalesce(F.try_to_number(F.nullif(stamp, F.lit("")), F.lit("9999999999999")), F.lit(0))).alias("_newest"),
            F.min("file").alias("_first"),
        )
        .orderBy(F.desc("_newest"), "_first")
        .limit(most)
        .select("file_session")
    )


# --- request bodies -----------------------------------------------------------


def _objects(value: Column, path: str) -> Column:
    """Object elements of an array; an empty array when there is none."""
    return F.coalesce(
        F.filter(items(value, path), lambda x: is_object(x)), F.array().cast("array<variant>")
    )


def _string_or_empty(value: Column, path: str) -> Column:
    return F.coalesce(text(value, path), F.lit(""))


def _text_parts(value: Column, path: str) -> Column:
    """Text of a content field: a string, or the text parts of an array; else null."""
    parts = F.filter(_objects(value, path), lambda p: text(p, "$.type") == "text")
    joined = F.array_join(F.transform(parts, lambda p: _string_or_empty(p, "$.text")), "\n")
    return F.coalesce(text(value, path), F.when(is_array(value, path), joined))


def _anthropic_system(body: Column) -> Column:
    def piece(item: Column) -> Column:
        return F.coalesce(
            text(item, "$"),
            F.when(is_object(item) & (text(item, "$.type") == "text"), _string_or_empty(item, "$.text")),
        )

    blocks = F.array_compact(F.transform(items(body, "$.system"), piece))
    return F.coalesce(
        text(body, "$.system"), F.when(is_array(body, "$.system"), F.array_join(blocks, "\n"))
    )


def _openai_system(body: Column) -> Column:
    """The first system or developer message decides, even when it has no text."""
    leading = F.filter(
        _objects(body, "$.messages"), lambda m: text(m, "$.role").isin("system", "developer")
    )
    return _text_parts(F.get(leading, F.lit(0)), "$.content")


def _gemini_system(body: Column) -> Column:
    parts = F.array_compact(
        F.transform(_objects(body, "$.systemInstruction.parts"), lambda p: text(p, "$.text"))
    )
    return F.coalesce(
        text(body, "$.systemInstruction"),
        F.when(is_array(body, "$.systemInstruction.parts"), F.array_join(parts, "\n")),
    )


def system_prompt(body: Column, provider: Column) -> Column:
    return (
        F.when(provider == "anthropic", _anthropic_system(body))
        .when(provider == "gemini", _gemini_system(body))
        .otherwise(_openai_system(body))
    )


def _tool(value: Column, schema: str) -> Column:
    properties = F.try_variant_get(value, schema, "string")
    return F.struct(
        F.coalesce(text(value, "$.name"), F.lit("?")).alias("name"),
        _string_or_empty(value, "$.description").alias("description"),
        F.when(is_object(value, schema), F.size(F.json_object_keys(properties)))
        .otherwise(0)
        .alias("param_count"),
    )


def tool_definitions(body: Column, provider: Column) -> Column:
    """array<struct<name, description, param_count>>"""
    listed = F.when(is_array(body, "$.tools"), _objects(body, "$.tools"))
    openai = F.coalesce(listed, _objects(body, "$.functions"))
    declared = F.flatten(
        F.transform(_objects(body, "$.tools"), lambda t: _objects(t, "$.functionDeclarations"))
    )
    return (
        F.when(
            provider == "anthropic",
            F.transform(_objects(body, "$.tools"), lambda t: _tool(t, "$.input_schema.properties")),
        )
        .when(
            provider == "gemini",
            F.transform(declared, lambda t: _tool(t, "$.parameters.properties")),
        )
        .otherwise(F.transform(openai, lambda t: _tool(t, "$.parameters.properties")))
    )


def first_user_message(body: Column) -> Column:
    said = F.transform(
        F.filter(_objects(body, "$.messages"), lambda m: text(m, "$.role") == "user"),
        lambda m: _text_parts(m, "$.content"),
    )
    return F.get(F.array_compact(said), F.lit(0))


def request_object(body: Column) -> Column:
    """The parsed request body when it is a JSON object."""
    return let(F.try_parse_json(body), lambda v: F.when(is_object(v), v))


def with_request(df: DataFrame, body: str = "request_body") -> DataFrame:
    return df.withColumn("_request", request_object(F.col(body)))


def system_prompts(captures: DataFrame, keys: list[str]) -> DataFrame:
    return with_request(captures).select(
        *keys, system_prompt(F.col("_request"), F.col("provider")).alias("system_prompt")
    )


def tool_table(captures: DataFrame, keys: list[str]) -> DataFrame:
    """One row per tool definition: keys, tool_ord, name, description, param_count."""
    tools = tool_definitions(F.col("_request"), F.col("provider"))
    return (
        unroll_items(with_request(captures), keys, tools, "tool_ord", "_tool")
        .select(*keys, "tool_ord", "_tool.*")
    )


def first_user_messages(captures: DataFrame, keys: list[str]) -> DataFrame:
    return with_request(captures).select(
        *keys, first_user_message(F.col("_request")).alias("first_user_message")
    )


def context_overhead(captures: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated tokens of prompt, tools and first user message, and the share of the first two."""
    body, provider = F.col("_request"), F.col("provider")
    described = F.aggregate(
        tool_definitions(body, provider),
        F.lit(0).cast("long"),
        lambda acc, t: acc + text_tokens(t["description"]),
    )
    rows = with_request(captures).select(
        *keys,
        text_tokens(system_prompt(body, provider)).alias("system_tokens"),
        F.coalesce(described, F.lit(0).cast("long")).alias("tool_tokens"),
        text_tokens(first_user_message(body)).alias("first_user_tokens"),
    )
    context = F.col("system_tokens") + F.col("tool_tokens")
    share = context / (context + F.col("first_user_tokens")) * 100.0
    return rows.withColumn(
        "overhead_pct",
        F.when((context > 0) & (F.col("first_user_tokens") > 0), to_fixed(share, 1)),
    )


# --- ledger and totals --------------------------------------------------------


def _short_number(n: Column) -> Column:
    thousands = F.replace(F.concat(to_fixed(n / 1000, 1), F.lit("k")), F.lit(".0k"), F.lit("k"))
    return F.when(n >= 1000, thousands).otherwise(n.cast("long").cast("string"))


def token_display(tokens_in: Column, tokens_out: Column) -> Column:
    both = F.concat(_short_number(tokens_in), F.lit("/"), _short_number(tokens_out))
    return F.when((tokens_in == 0) & (tokens_out == 0), "?/?").otherwise(both)


def latency_display(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(
        F.concat(to_fixed(ms / 1000, 1), F.lit("s"))
    )


def cost_display(cost: Column) -> Column:
    return (
        F.when(cost.isNull(), "$?")
        .when(cost < 0.01, F.concat(F.lit("$"), to_fixed(cost, 3)))
        .otherwise(F.concat(F.lit("$"), to_fixed(cost, 2)))
    )


@lru_cache(maxsize=4)
def _displays(jvm: int) -> dict[str, Column]:
    """The display columns of a ledger. Building them costs a thousand calls into the JVM, once."""
    return {
        "latency": latency_display(F.coalesce(F.col("total_ms"), F.lit(0))),
        "tokens": token_display(F.col("input_tokens"), F.col("output_tokens")),
        "cost": cost_display(F.col("cost_usd")),
    }


def request_ledger(captures: DataFrame, keys: list[str]) -> DataFrame:
    """One display row per capture. The model is the requested one, usage is the response's."""
    used = usage_ledger(with_request(captures))
    named = used.drop("model").withColumn(
        "model", F.coalesce(text(F.col("_request"), "$.model"), F.lit("?"))
    )
    priced = cost_ledger(named)
    shown = _displays(gateway(captures))
    return priced.select(
        *keys,
        "session_id",
        F.date_format(F.to_timestamp("ts"), "HH:mm:ss").alias("time"),
        _filled(F.col("source")).alias("source"),
        "model",
        F.col("response_status").alias("status"),
        shown["latency"].alias("latency"),
        F.col("input_tokens").alias("tokens_in"),
        F.col("output_tokens").alias("tokens_out"),
        shown["tokens"].alias("tokens"),
        "cost_usd",
        shown["cost"].alias("cost"),
    )


def ledger_totals(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sessions, requests, tokens and cost. The displayed cost adds up the displayed figures."""
    shown = F.when(F.col("cost") != "$?", F.substring("cost", 2, 64).cast("decimal(18,3)"))
    return ledger.groupBy(*(by or [])).agg(
        F.count_distinct(F.nullif("session_id", F.lit(""))).alias("sessions"),
        F.count("*").alias("requests"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,6)")), F.lit(0)).cast("double").alias("cost_usd"),
        F.coalesce(F.sum(shown), F.lit(0)).cast("double").alias("cost_shown"),
    )
