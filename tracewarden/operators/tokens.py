"""Token estimates of texts and JSON bodies, counting images at a flat rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.jsonpath import is_array, is_object, items, kind, text, truthy
from tracewarden.functions.text import text_tokens, utf16_length

IMAGE_TOKENS = 1600


def token_rollup(df: DataFrame, by: list[str], body: str = "text") -> DataFrame:
    """Rows, total, largest and median token estimate per group."""
    tokens = df.select(*by, text_tokens(F.col(body)).alias("tokens"))
    return tokens.groupBy(*by).agg(
        F.count("*").alias("texts"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("largest"),
        F.expr("percentile_disc(0.5) within group (order by tokens)").alias("median"),
    )


def _is_image(value: Column) -> Column:
    typed = F.coalesce(text(value, "$.type").isin("image", "image_url"), F.lit(False))
    return is_object(value) & (typed | truthy(value, "$.inlineData") | truthy(value, "$.fileData"))


def _nested(value: Column) -> Column:
    """The one array an object is searched in: a tool result's content, or Gemini parts."""
    content = F.when(
        (text(value, "$.type") == "tool_result") & is_array(value, "$.content"),
        items(value, "$.content"),
    )
    return F.when(is_object(value), F.coalesce(content, items(value, "$.parts")))


def _children(value: Column) -> Column:
    own = F.when(is_array(value), F.try_variant_get(value, "$", "array<variant>"))
    return F.coalesce(own, F.when(~_is_image(value), _nested(value)), F.array().cast("array<variant>"))


def _searched(value: Column) -> Column:
    """(images, spared): image blocks at any depth, and the text that stand-ins save for them.

    The levels of arrays and results are gone through in a fold whose number of steps comes from
    the row: a value nests no deeper than it has opening brackets.
    """
    deepest = F.regexp_count(F.to_json(value), F.lit(r"\["))

    def stand_in(v: Column) -> Column:
        return utf16_length(
            F.concat(
                F.lit('{"type":'),
                F.coalesce(
                    F.when(truthy(v, "$.type"), F.to_json(F.try_variant_get(v, "$.type", "variant"))),
                    F.lit('"image"'),
                ),
                F.lit(',"_image":true}'),
            )
        )

    def level_done(acc: Column, _: Column) -> Column:
        found = F.filter(acc["level"], _is_image)
        spared = F.aggregate(
            found, F.lit(0).cast("long"), lambda n, v: n + utf16_length(F.to_json(v)) - stand_in(v)
        )
        return F.struct(
            F.flatten(F.transform(acc["level"], _children)).alias("level"),
            (acc["images"] + F.size(found)).alias("images"),
            (acc["spared"] + spared).alias("spared"),
        )

    start = F.struct(
        F.array(value).alias("level"), F.lit(0).alias("images"), F.lit(0).cast("long").alias("spared")
    )
    return F.aggregate(F.sequence(F.lit(0), F.coalesce(deepest, F.lit(0))), start, level_done)


def image_count(value: Column) -> Column:
    """Image blocks in a value, however deep they lie in arrays and results."""
    return F.when(value.isNull(), 0).otherwise(_searched(value)["images"])


def json_tokens(value: Column) -> Column:
    """Estimated tokens of a JSON value: a quarter of its text, images at a flat rate.

    Image blocks count with the size of a short stand-in instead of their data.
    """
    found = _searched(value)
    whole = F.ceil((utf16_length(F.to_json(value)) - found["spared"]) / 4) + found["images"] * IMAGE_TOKENS
    shape = kind(value)
    return (
        F.when(value.isNull() | (shape == "VOID") | ~truthy(value, "$"), F.lit(0))
        .when(shape == "STRING", text_tokens(F.try_variant_get(value, "$", "string")))
        .when(_is_image(value), F.lit(IMAGE_TOKENS))
        .otherwise(whole)
        .cast("long")
    )
