"""Token usage, models and costs from response bodies.

All parsing is local to the row. A stream is an ordered list of events in one body;
each event proposes updates, and a single fold over the list keeps the last one per
field, so no body is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import jsonsql as js
from tracewarden.functions.jsonpath import is_object, node, text, truthy
from tracewarden.functions.sse import events, has_data_lines
from tracewarden.functions.text import let, unroll
from tracewarden.rules.models import CACHE_SHARES, DEFAULT_CONTEXT_LIMIT, MODELS
from tracewarden.session import gateway

COUNTS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "thinking_tokens")
_TYPES = {**{c: "double" for c in COUNTS}, "model": "string", "finish_reasons": "array<string>"}


# Expressions below are SQL text: a step is a struct of counts, in which null says nothing.


def _coalesce(*values: str) -> str:
    return f"coalesce({', '.join(values)})"


def _present(*values: str) -> str:
    """The first value that is not zero, null when all are."""
    return _coalesce(*[f"nullif({v}, 0D)" for v in values])


def _struct(fields: dict[str, str]) -> str:
    listed = ", ".join(f"'{c}', cast({fields.get(c, 'null')} as double)" for c in COUNTS)
    return f"named_struct({listed})"


def _step(usage: str, fields: Callable[[Callable[[str], str]], dict[str, str]]) -> str:
    """The counts that an object proposes; null when there is no object."""
    proposed = _struct(fields(lambda path: js.number("u", "$." + path)))
    return js.bound(usage, "u", f"if(u is null, null, {proposed})")


def _openai(at: Callable[[str], str]) -> dict[str, str]:
    """Counts of an OpenAI- or Anthropic-style usage object; zero means absent."""
    return {
        "input_tokens": _present(at("input_tokens"), at("prompt_tokens")),
        "output_tokens": _present(at("output_tokens"), at("completion_tokens")),
        "cache_read_tokens": _present(
            at("cache_read_input_tokens"),
            at("input_tokens_details.cached_tokens"),
            at("prompt_tokens_details.cached_tokens"),
        ),
        "cache_write_tokens": _present(at("cache_creation_input_tokens")),
        "thinking_tokens": _present(
            at("thinking_tokens"),
            at("reasoning_tokens"),
            at("output_tokens_details.reasoning_tokens"),
            at("completion_tokens_details.reasoning_tokens"),
        ),
    }


def _gemini(at: Callable[[str], str]) -> dict[str, str]:
    """Counts of a Gemini usage object; every field is set, zero included."""
    prompt, cached = at("promptTokenCount"), at("cachedContentTokenCount")
    return {
        "input_tokens": f"greatest(0D, {prompt} - {cached})",
        "output_tokens": _coalesce(
            _present(at("candidatesTokenCount")), f"greatest(0D, {at('totalTokenCount')} - {prompt})"
        ),
        "cache_read_tokens": cached,
        "thinking_tokens": at("thoughtsTokenCount"),
    }


def _message_start(at: Callable[[str], str]) -> dict[str, str]:
    return {
        "input_tokens": at("input_tokens"),
        "cache_read_tokens": at("cache_read_input_tokens"),
        "cache_write_tokens": at("cache_creation_input_tokens"),
        "thinking_tokens": _coalesce(_present(at("thinking_tokens"), at("reasoning_tokens")), "0D"),
    }


def _message_delta(at: Callable[[str], str]) -> dict[str, str]:
    return {
        "output_tokens": at("output_tokens"),
        "thinking_tokens": _present(at("thinking_tokens"), at("reasoning_tokens")),
    }


def _latest(steps: list[str], model: str, reasons: str, name: str = "p") -> str:
    """Per count what the last of the steps says that says something; the steps are evaluated once."""
    bundle = ", ".join(f"'s{i}', {step}" for i, step in enumerate(steps))
    counts = [
        f"'{c}', " + _coalesce(*[f"{name}.s{i}.{c}" for i in reversed(range(len(steps)))]) for c in COUNTS
    ]
    fields = ", ".join([*counts, f"'model', {name}.model", f"'finish_reasons', {name}.reasons"])
    return js.bound(
        f"named_struct({bundle}, 'model', cast({model} as string), 'reasons', cast({reasons} as array<string>))",
        name,
        f"named_struct({fields})",
    )


def _event(steps: list[str], finish: list[str], model: list[str]) -> str:
    """What an event ``e`` proposes."""
    reason = js.bound(_coalesce(*finish), "r", "if(r is null, null, array(r))")
    return _latest(steps, _coalesce(*model) if model else "null", reason)


def _fold(chunks: str, proposal: str) -> str:
    """The last proposal per field over the events, an array<variant>, of a stream."""
    start = ", ".join(f"'{c}', 0D" for c in COUNTS)
    last = ", ".join(f"'{f}', coalesce(x.{f}, acc.{f})" for f in _TYPES)
    return (
        f"aggregate(transform({chunks}, e -> {proposal}), named_struct({start}, 'model', cast(null as string), "
        f"'finish_reasons', cast(array() as array<string>)), (acc, x) -> named_struct({last}))"
    )


def _when(type_: str, value: str) -> str:
    return f"if({js.text('e', '$.type')} = '{type_}', {value}, null)"


_START = _step(_when("message_start", js.object_at(js.object_at("e", "$.message"), "$.usage")), _message_start)
_START_MODEL = _when("message_start", js.filled_text("e", "$.message.model"))
_DELTA = _step(_when("message_delta", js.object_at("e", "$.usage")), _message_delta)
_STOP_REASON = _when("message_delta", js.filled_text("e", "$.delta.stop_reason"))


def _first_reason(field: str, *containers: str) -> str:
    return js.text(f"get({_coalesce(*[js.objects_at('e', c) for c in containers])}, 0)", "$." + field)


def _usage_metadata(value: str) -> str:
    own, nested = js.object_at(value, "$.usageMetadata"), js.object_at(value, "$.response.usageMetadata")
    return f"if({js.truthy(value, '$.usageMetadata')}, {own}, {nested})"


_ANY_PROVIDER = _event(
    steps=[
        _START,
        _step(_coalesce(js.object_at("e", "$.usage"), js.object_at("e", "$.response.usage")), _openai),
        _step(_usage_metadata("e"), _gemini),
    ],
    finish=[
        _first_reason("finishReason", "$.candidates", "$.response.candidates"),
        _first_reason("finish_reason", "$.choices", "$.response.choices"),
        _STOP_REASON,
    ],
    model=[
        *[js.filled_text("e", p) for p in ("$.modelVersion", "$.model", "$.response.modelVersion", "$.response.model")],
        _START_MODEL,
    ],
)


def _object_usage(value: str) -> str:
    """Usage struct of a parsed JSON response object."""

    def reasons(path: str, field: str) -> str:
        return f"array_compact(transform({js.objects_at(value, path)}, c -> {js.text('c', '$.' + field)}))"

    carried = js.truthy(value, "$.usageMetadata")
    finish = js.bound(
        js.filled_text(value, "$.stop_reason"),
        "stop",
        "case when stop is not null then array(stop) "
        f"when {js.truthy(value, '$.choices')} then {reasons('$.choices', 'finish_reason')} "
        f"when {js.truthy(value, '$.candidates')} then {reasons('$.candidates', 'finishReason')} "
        f"when not {carried} and {js.truthy(value, '$.response.candidates')} "
        f"then {reasons('$.response.candidates', 'finishReason')} end",
    )
    steps = [
        _struct({c: "0D" for c in COUNTS}),
        _step(js.object_at(value, "$.usage"), _openai),
        _step(js.object_at(value, "$.response.usage"), _openai),
        _step(_usage_metadata(value), _gemini),
    ]
    model = [js.filled_text(value, p) for p in ("$.model", "$.modelVersion", "$.response.model", "$.response.modelVersion")]
    return _latest(steps, _coalesce(*model), _coalesce(finish, "array()"))


def _wrapped_stream(value: Column) -> Column:
    """The chunks of a ``{streaming: true, chunks}`` wrapper, else null."""
    flagged = F.try_variant_get(value, "$.streaming", "boolean") & (
        F.schema_of_variant(node(value, "$.streaming")) == "BOOLEAN"
    )
    return F.when(flagged, text(value, "$.chunks"))


def usage_ledger(df: DataFrame, body: str = "response_body") -> DataFrame:
    """Adds the usage fields and ``stream`` for JSON and event-stream bodies alike."""
    raw = F.col(body)
    df = df.withColumn("_value", F.when(~has_data_lines(raw), F.try_parse_json(raw)))
    df = df.withColumn("_value", F.when(is_object(F.col("_value")), F.col("_value")))
    df = df.withColumn(
        "_chunks", F.when(has_data_lines(raw), raw).otherwise(_wrapped_stream(F.col("_value")))
    )
    df = df.withColumn("_events", events(F.col("_chunks")))
    zeros = ", ".join(f"'{c}', 0D" for c in COUNTS)
    got = (
        f"case when _chunks is not null then {_fold('_events', _ANY_PROVIDER)} "
        f"when _value is not null then {_object_usage('_value')} "
        f"else named_struct({zeros}, 'model', cast(null as string), 'finish_reasons', cast(array() as array<string>)) end"
    )
    df = df.withColumn("_usage", F.expr(got)).withColumns(
        {
            **{c: F.col(f"_usage.{c}").cast("long") for c in COUNTS},
            "model": F.col("_usage.model"),
            "finish_reasons": F.col("_usage.finish_reasons"),
            "stream": F.col("_chunks").isNotNull(),
        }
    )
    return df.drop("_value", "_chunks", "_events", "_usage")


#: What an event proposes when it is read as one provider sends it.
_STRICT = {
    "anthropic": _event([_START, _DELTA], [_STOP_REASON], [_START_MODEL]),
    "openai": _event(
        [_step(f"if({js.truthy('e', '$.choices')}, {js.object_at('e', '$.usage')}, null)", _openai)],
        [_first_reason("finish_reason", "$.choices")],
        [],
    ),
    "gemini": _event(
        [_step(js.object_at("e", "$.usageMetadata"), _gemini)],
        [_first_reason("finishReason", "$.candidates")],
        [js.filled_text("e", "$.modelVersion")],
    ),
}


def provider_stream_usage(df: DataFrame, body: str = "response_body", provider: str = "provider") -> DataFrame:
    """Usage of event streams read strictly as the stated provider sends them.

    Rows whose five counts are all zero are left out, and with them every provider
    without a stream format of its own. One fold: each event is read as its row's provider asks.
    """
    reading = {"anthropic": "anthropic", "openai": "openai", "chatgpt": "openai", "gemini": "gemini"}
    rows = df.filter(F.col(provider).isin(*reading))
    rows = rows.withColumns({"_events": events(F.col(body)), "_who": F.col(provider)})
    cases = " ".join(f"when '{who}' then {_STRICT[how]}" for who, how in reading.items() if who != "chatgpt")
    got = _fold("_events", f"case if(_who = 'chatgpt', 'openai', _who) {cases} end")
    # Unrolling an array of at most one struct drops the empty results and, unlike a
    # filter, is not pushed into the fold, which would evaluate it once per count.
    counted = F.expr(f"filter(array({got}), u -> {' + '.join(f'u.{c}' for c in COUNTS)} > 0)")
    kept = [c for c in df.columns if c not in _TYPES]
    return unroll(rows, kept, counted).withColumns(
        {c: F.col(c).cast("long") for c in COUNTS}
    )


# --- response ids -------------------------------------------------------------


def _plain(value: Column, path: str) -> Column:
    """A present leaf as text, whatever its type."""
    return F.when(truthy(value, path), F.try_variant_get(value, path, "string"))


def response_id(body: Column) -> Column:
    """Id of a response: from the object itself, or the first event that carries one.

    A raw event stream is read like a wrapped one.
    """
    value = F.try_parse_json(body)

    def of_event(event: Column) -> Column:
        named = text(event, "$.type").isin("response.completed", "response.created")
        return F.coalesce(
            F.when(is_object(event, "$.response"), _plain(event, "$.response.id")),
            F.when(named, _plain(event, "$.id")),
        )

    def first(chunks: Column) -> Column:
        ids = F.transform(events(chunks), of_event)
        return F.get(F.array_compact(ids), F.lit(0))

    return F.when(has_data_lines(body) & value.isNull(), first(body)).otherwise(
        let(
            value,
            lambda v: F.coalesce(
                _plain(v, "$.id"), _plain(v, "$.response_id"), first(_wrapped_stream(v))
            ),
        )
    )


def response_index(df: DataFrame, body: str = "response_body") -> DataFrame:
    return df.withColumn("response_id", response_id(F.col(body)))


# --- models -------------------------------------------------------------------


def model_table(spark: SparkSession) -> DataFrame:
    """Limits and prices per model key, with the look-up order as ``ord``."""
    rows = [(i, *m) for i, m in enumerate(MODELS)]
    return spark.createDataFrame(
        rows, "ord int, key string, context_limit long, input_price double, output_price double"
    )


def _hyphened(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit("-"))


def _pieces(value: Column, n: int) -> Column:
    """All substrings of ``n`` characters."""
    last = F.length(value) - n + 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(value, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))


def resolve_models(models: DataFrame, table: DataFrame, model: str = "model") -> DataFrame:
    """Each distinct model name with the first key of ``table`` that it contains.

    For price tables of the caller's own, of any size. A key is found through the one of its
    pieces of three characters that the fewest keys have (a shorter key through itself): names
    and keys meet on equal pieces, and only what meets is compared.
    """
    names = models.select(F.col(model).alias("model")).distinct()
    keys = table.withColumn("_key", _hyphened(F.col("key")))
    own = F.when(F.length("_key") >= 3, _pieces(F.col("_key"), 3)).otherwise(F.array("_key"))
    pieces = keys.select("ord", "_key", F.explode(F.array_distinct(own)).alias("_piece"))
    held = pieces.groupBy("_piece").agg(F.count("*").alias("_n"))
    rarest = (
        pieces.join(held, "_piece")
        .groupBy("ord", "_key")
        .agg(F.min_by("_piece", F.struct("_n", "_piece")).alias("_piece"))
    )
    name = _hyphened(F.col("model"))
    every = F.concat(F.array(F.lit("")), _pieces(name, 1), _pieces(name, 2), _pieces(name, 3))
    first = (
        names.select("model", F.explode(F.array_distinct(every)).alias("_piece"))
        .join(rarest, "_piece")
        .filter(F.contains(name, F.col("_key")))
        .groupBy("model")
        .agg(F.min("ord").alias("ord"))
    )
    hits = first.join(table, "ord").drop("ord")
    return names.join(hits, "model", "left").select("model", *[c for c in table.columns if c != "ord"])


def model_place(model: Column) -> Column:
    """Position of the first model key that the name contains; null when none fits.

    The key list is fixed and short, so the look-up is a conditional expression inside
    the projection and needs no join.
    """

    def chain(name: Column) -> Column:
        place = F
        for i, (key, *_) in enumerate(MODELS):
            place = place.when(F.contains(name, F.lit(key.replace(".", "-"))), F.lit(i))
        return place

    return let(_hyphened(model), chain)


def model_field(place: Column, field: int) -> Column:
    """Key (0), context limit (1), input price (2) or output price (3) at a position."""
    return F.get(F.array(*[F.lit(m[field]) for m in MODELS]), place)


def context_limit(model: Column) -> Column:
    limit = F.coalesce(
        model_field(model_place(model), 1).cast("long"), F.lit(DEFAULT_CONTEXT_LIMIT).cast("long")
    )
    return F.when(model.isNotNull(), limit)


def cost(key: Column, input_price: Column, output_price: Column, counts: dict[str, Column]) -> Column:
    """USD for one call, rounded to six decimals; null when the model is unknown."""
    read_share, write_share = F.lit(0.0), F.lit(0.0)
    for prefix, read, write in CACHE_SHARES:
        mine = F.startswith(key, F.lit(prefix))
        read_share = F.when(mine, read).otherwise(read_share)
        write_share = F.when(mine, write).otherwise(write_share)
    n = {c: counts[c].cast("double") for c in COUNTS if c != "thinking_tokens"}
    total = (
        n["input_tokens"] * input_price
        + n["output_tokens"] * output_price
        + n["cache_read_tokens"] * input_price * read_share
        + n["cache_write_tokens"] * input_price * write_share
    )
    scaled = total / 1000000.0 * 1000000.0
    return F.when(
        key.isNotNull(), F.floor(scaled + 0.5).cast("double") / 1000000.0
    )


@lru_cache(maxsize=16)
def _priced(model: str, jvm: int) -> tuple[Column, dict[str, Column], Column]:
    """The model's place, what the price list says of it, and the cost; kept, as they take long to build."""
    place = F.col("_place")
    limit = F.coalesce(
        model_field(place, 1).cast("long"), F.lit(DEFAULT_CONTEXT_LIMIT).cast("long")
    )
    fields = {
        "model_key": model_field(place, 0),
        "context_limit": F.when(F.col(model).isNotNull(), limit),
        "_in": model_field(place, 2),
        "_out": model_field(place, 3),
    }
    counts = {c: F.col(c) for c in COUNTS}
    usd = cost(F.col("model_key"), F.col("_in"), F.col("_out"), counts)
    return model_place(F.col(model)), fields, usd


def cost_ledger(df: DataFrame, model: str = "model") -> DataFrame:
    """Adds model_key, context_limit and cost_usd to a usage ledger."""
    place, fields, usd = _priced(model, gateway(df))
    keyed = df.withColumn("_place", place).withColumns(fields)
    return keyed.withColumn("cost_usd", usd).drop("_in", "_out", "_place")


def known_models(df: DataFrame, model: str = "model") -> DataFrame:
    """Every priced model key, in name order, with the number of calls billed under it.

    Calls are counted per model name first; only the distinct names are looked up.
    """
    table = model_table(df.sparkSession).select("key")
    names = df.groupBy(F.col(model).alias("model")).agg(F.count("*").alias("calls"))
    calls = (
        names.select(model_field(model_place(F.col("model")), 0).alias("key"), "calls")
        .groupBy("key")
        .agg(F.sum("calls").alias("calls"))
    )
    return (
        table.join(calls, "key", "left")
        .select(F.col("key").alias("model_key"), F.coalesce("calls", F.lit(0)).alias("calls"))
        .orderBy("model_key")
    )
