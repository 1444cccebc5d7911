"""Pseudonymisation of a stream with a dictionary per session.

Finding and replacing stay in the JVM: the rule chain puts numbered stand-ins into the
text and lists the originals. Only the naming of originals is stateful.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewarden.operators.redact import Policy
from tracewarden.operators.reversible import DEFAULT_SESSION, resolve_stand_ins, with_stand_ins

IDLE_MINUTES = 30
OUTPUT = "row_key long, session_id string, redacted string, names array<string>"


class SessionNames(StatefulProcessor):
    """Placeholders per session; forgotten after an idle period, if one is given."""

    def __init__(self, idle_minutes: int | None) -> None:
        self._idle_ms = idle_minutes * 60_000 if idle_minutes else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._names = handle.getMapState("names", "original string", "placeholder string")
        self._counts = handle.getMapState("counts", "label string", "n int")

    def _rearm(self, timers) -> None:
        for expiry in list(self._handle.listTimers()):
            self._handle.deleteTimer(expiry)
        self._handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self._idle_ms)

    def _name(self, original: str, label: str) -> str:
        if self._names.containsKey((original,)):
            return self._names.getValue((original,))[0]
        n = self._counts.getValue((label,))[0] + 1 if self._counts.containsKey((label,)) else 1
        placeholder = f"[{label}_{n}]"
        self._counts.updateValue((label,), (n,))
        self._names.updateValue((original,), (placeholder,))
        return placeholder

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for batch in rows:
            names = [
                [self._name(o, l) for o, l in zip(originals, labels)]
                for originals, labels in zip(batch["originals"], batch["labels"])
            ]
            yield pd.DataFrame(
                {
                    "row_key": batch["row_key"],
                    "session_id": key[0],
                    "redacted": batch["redacted"],
                    "names": names,
                }
            )
        if self._idle_ms:
            self._rearm(timers)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self._names.clear()
        self._counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def pseudonymise_stream(
    stream: DataFrame,
    policy: Policy,
    row_key: str,
    session: str = "session_id",
    text: str = "text",
    idle_minutes: int | None = IDLE_MINUTES,
) -> DataFrame:
    """row_key, session_id, pseudonymised text. Rows without a session share one dictionary.

    Idle sessions are forgotten by processing-time timers, which keep a stream running.
    A run that should end with its input passes None and keeps every session.
    """
    marked = with_stand_ins(stream, policy, text)
    rows = marked.select(
        F.col(row_key).cast("long").alias("row_key"),
        F.coalesce(F.nullif(F.col(session), F.lit("")), F.lit(DEFAULT_SESSION)).alias("session_id"),
        "redacted",
        F.transform("hits", lambda h: h["original"]).alias("originals"),
        F.transform(
            "hits", lambda h: F.regexp_replace(F.upper(h["rule"]), "[^A-Z0-9]", "_")
        ).alias("labels"),
    )
    named = rows.groupBy("session_id").transformWithStateInPandas(
        SessionNames(idle_minutes),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime" if idle_minutes else "None",
    )
    return named.select(
        "row_key",
        "session_id",
        resolve_stand_ins(F.col("redacted"), F.col("names")).alias("pseudonymised"),
    )


# --- sessions of any size ------------------------------------------------------

PARTS = "row_key long, session_id string, slot int, redacted string, size int, place int, original string, name string"


class SliceNames(StatefulProcessor):
    """Placeholders of one slice of a session's originals.

    A slice takes its own numbers out of every block of as many numbers as there are slices, so
    that no slice needs to ask another one.
    """

    def __init__(self, slices: int, idle_ms: int | None) -> None:
        self._slices, self._idle_ms = slices, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._names = handle.getMapState("names", "original string", "placeholder string", self._idle_ms)
        self._counts = handle.getMapState("counts", "label string", "n int", self._idle_ms)

    def _name(self, original: str, label: str, slot: int) -> str:
        if self._names.containsKey((original,)):
            placeholder = self._names.getValue((original,))[0]
        else:
            n = self._counts.getValue((label,))[0] + 1 if self._counts.containsKey((label,)) else 0
            self._counts.updateValue((label,), (n,))
            placeholder = f"[{label}_{n * self._slices + slot + 1}]"
        if self._idle_ms or not self._names.containsKey((original,)):
            self._names.updateValue((original,), (placeholder,))
        return placeholder

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if not frames:
            return
        batch = pd.concat(frames).sort_values(["row_key", "place"], kind="stable")
        batch["name"] = [
            None if original is None else self._name(original, label, key[1])
            for original, label in zip(batch["original"], batch["name"], strict=True)
        ]
        yield batch[[c.split()[0] for c in PARTS.split(", ")]]

    def close(self) -> None:
        pass


class RowNames(StatefulProcessor):
    """Puts the names of a row beside its text once all of them are there."""

    def __init__(self, idle_ms: int | None) -> None:
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._text = handle.getValueState("text", "session_id string, redacted string, size int", self._idle_ms)
        self._met = handle.getMapState("met", "place int", "name string", self._idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        text = self._text.get() if self._text.exists() else None
        met = {}
        for batch in rows:
            for row in batch.itertuples(index=False):
                if row.place < 0:
                    text = (row.session_id, row.redacted, row.size)
                else:
                    met[int(row.place)] = row.name
        for (place,), (name,) in self._met.iterator():
            met[place] = name
        if text is not None and len(met) == text[2]:
            self._text.clear()
            self._met.clear()
            yield pd.DataFrame(
                {"row_key": [key[0]], "session_id": [text[0]], "redacted": [text[1]], "names": [[met[i] for i in range(text[2])]]}
            )
            return
        if text is not None:
            self._text.update(text)
        for place, name in met.items():
            self._met.updateValue((place,), (name,))

    def close(self) -> None:
        pass


def slice_number(original, slices: int):
    """The slice of an original: the first six digits of its MD5, modulo the number of slices."""
    return (F.conv(F.substring(F.md5(original), 1, 6), 16, 10).cast("long") % slices).cast("int")


def pseudonymise_spread(
    stream: DataFrame,
    policy: Policy,
    row_key: str,
    session: str = "session_id",
    text: str = "text",
    slices: int = 64,
    idle_minutes: int | None = None,
) -> DataFrame:
    """row_key, session_id, pseudonymised text, for sessions of any size; ``row_key`` is unique.

    A session's dictionary is cut into ``slices`` by its originals, and each slice is a group of
    its own: a session that holds a third of all rows, or all rows without a session, spreads
    over all tasks. Numbers are unique per session and label, and count in each slice in the
    order of the rows, in steps of ``slices``. State of slices that were idle for
    ``idle_minutes`` expires, if given; a name lives on while it is used.
    """
    idle_ms = idle_minutes * 60_000 if idle_minutes else None
    mode = "ProcessingTime" if idle_ms else "None"
    marked = with_stand_ins(stream, policy, text)
    rows = marked.select(
        F.col(row_key).cast("long").alias("row_key"),
        F.coalesce(F.nullif(F.col(session), F.lit("")), F.lit(DEFAULT_SESSION)).alias("session_id"),
        "redacted",
        F.coalesce(F.size("hits"), F.lit(0)).alias("size"),
        "hits",
    )
    null = lambda kind: F.lit(None).cast(kind)
    # One array per row: its text, in a slice by its key, and each hit, in the slice of its original.
    head = F.struct(
        F.pmod(F.xxhash64("row_key"), F.lit(slices)).cast("int").alias("slot"),
        F.col("redacted").alias("redacted"),
        F.lit(-1).alias("place"),
        null("string").alias("original"),
        null("string").alias("name"),
    )
    hits = F.transform(
        "hits",
        lambda h, i: F.struct(
            slice_number(h["original"], slices).alias("slot"),
            null("string").alias("redacted"),
            i.cast("int").alias("place"),
            h["original"].alias("original"),
            F.regexp_replace(F.upper(h["rule"]), "[^A-Z0-9]", "_").alias("name"),
        ),
    )
    parts = rows.select(
        "row_key", "session_id", "size", F.explode(F.concat(F.array(head), F.coalesce(hits, F.array()))).alias("p")
    ).select("row_key", "session_id", "p.slot", "p.redacted", "size", "p.place", "p.original", "p.name")
    named = parts.groupBy("session_id", "slot").transformWithStateInPandas(
        SliceNames(slices, idle_ms), outputStructType=PARTS, outputMode="Append", timeMode=mode
    )
    whole = named.groupBy("row_key").transformWithStateInPandas(
        RowNames(idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode=mode
    )
    return whole.select(
        "row_key", "session_id", resolve_stand_ins(F.col("redacted"), F.col("names")).alias("pseudonymised")
    )


# The processor travels with the query, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
