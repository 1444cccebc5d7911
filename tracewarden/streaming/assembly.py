"""Captures from requests and responses as they arrive, and responses told apart by their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.usage import response_id
from tracewarden.schemas import TIMINGS
from tracewarden.sources.requests import captures_of

#: How far arrivals may be out of order, and how long after its request a response may come.
LATENESS, PATIENCE = "10 minutes", "1 hour"


def _moment(millis: str) -> Column:
    return F.timestamp_millis(F.floor(millis).cast("long"))


def assemble_stream(
    requests: DataFrame,
    responses: DataFrame,
    key: str = "request_id",
    lateness: str = LATENESS,
    patience: str = PATIENCE,
) -> DataFrame:
    """Captures of two streams, whichever side of a pair comes first; for append mode.

    A pair leaves as soon as both sides are there. A request without a response within
    ``patience`` comes once, with nulls for the response, when both watermarks have passed it;
    its state goes with it, and so does that of responses whose request never came. Rows that
    come later than ``lateness`` behind their stream are dropped. Ids are unique on both
    sides, so the state is spread evenly.
    """
    asked = requests.withColumn("_asked", _moment("start_ms")).withWatermark("_asked", lateness)
    answered = (
        responses.withColumnRenamed(key, "_key")
        .withColumn("_answered", _moment("end_ms"))
        .withWatermark("_answered", lateness)
    )
    # Clocks of the two sides may disagree by as much as arrivals may.
    near = (
        (F.col(key) == F.col("_key"))
        & (F.col("_answered") >= F.col("_asked") - F.expr(f"interval {lateness}"))
        & (F.col("_answered") <= F.col("_asked") + F.expr(f"interval {patience}"))
    )
    done = captures_of(asked.join(answered, near, "leftOuter"))
    came = F.col("_key").isNotNull()
    return done.withColumns({t: F.when(came, F.col(t)) for t in TIMINGS}).drop("_key", "_asked", "_answered")


def first_responses(
    captures: DataFrame, key: str, at: str, body: str = "response_body", within: str = PATIENCE
) -> DataFrame:
    """A stream of captures with ``response_id``, each id once; for append mode.

    The capture that comes first stays; repeats are dropped if their time ``at`` lies within
    ``within`` of it, and so are rows that come later than that behind the stream. Captures
    without an id are never repeats of each other; ``key`` tells them apart.
    """
    named = captures.withColumn("response_id", response_id(F.col(body)))
    own = F.coalesce(
        F.concat(F.lit("id "), F.col("response_id")), F.concat(F.lit("key "), F.col(key).cast("string"))
    )
    return (
        named.withColumn("_once", own)
        .withWatermark(at, within)
        .dropDuplicatesWithinWatermark(["_once"])
        .drop("_once")
    )
