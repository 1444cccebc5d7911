"""A response chain over live event streams.

Chunks become lines in one stateful operator; a step changes lines row by row, in the JVM, and a
step that has something to say at the end of a stream is one more stateful operator behind it.
Lines and end marks pass from step to step, so the order of the steps is that of the operators.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LINES = "stream_id string, line_no long, kind string, text string, failed array<string>"


@dataclass(frozen=True)
class StreamStep:
    """One member of a response chain over a live stream; each part is optional.

    ``line`` changes a line, and a null result stands for a failure. ``see`` takes what the step
    knows of a stream and its next line, as it leaves the step, and returns what it knows then;
    ``end`` makes the line that is added once the stream is over, or none. What a step knows
    starts as ``start`` and is kept as JSON.
    """

    name: str
    line: Callable[[Column], Column] | None = None
    start: Any = None
    see: Callable[[Any, str], Any] | None = None
    end: Callable[[Any], str | None] | None = None


#: Chunks that wait are kept so many numbers to an entry of the state: a call for an entry costs
#: far more than a chunk in it.
WAITING = 64


class Liner(StatefulProcessor):
    """Chunks to lines. Chunks that come before their turn wait for the ones between."""

    def __init__(self, idle_ms: int | None) -> None:
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # What is left of an ended stream is a number, by which repeated chunks are known.
        self._open = handle.getValueState("open", "next long, lines long, partial string, waiting long", self._idle_ms)
        self._early = handle.getMapState("early", "block long", "chunks string", self._idle_ms)

    def _waiting(self, block: int) -> dict[int, tuple[str, str | None]]:
        """The chunks that wait in a block of numbers."""
        found = self._early.getValue((block,))
        return {seq: (kind, payload) for seq, kind, payload in json.loads(found[0])} if found else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        due, lines, partial, waiting = self._open.get() or (0, 0, "", 0)
        came: dict[int, dict[int, tuple[str, str | None]]] = {}
        for batch in rows:
            for seq, kind, payload in zip(batch["seq"].tolist(), batch["kind"], batch["payload"], strict=True):
                if seq >= due:
                    came.setdefault(seq // WAITING, {})[seq] = (kind, payload)
        blocks: dict[int, dict[int, tuple[str, str | None]]] = {}
        kept: dict[int, int] = {}

        def block_of(block: int) -> dict[int, tuple[str, str | None]]:
            """What waits in a block and what came for it, read once."""
            if block not in blocks:
                old = self._waiting(block) if waiting else {}
                kept[block] = len(old)
                blocks[block] = {**old, **came.get(block, {})}
            return blocks[block]

        out: list[tuple[int, str, str | None]] = []
        while True:
            now = block_of(due // WAITING).pop(due, None)
            if now is None:
                break
            kind, payload = now
            due += 1
            *whole, partial = (partial + (payload or "")).split("\n")
            if kind == "end":
                whole.append(partial)
                partial = ""
            for line in whole:
                out.append((lines, "line", line))
                lines += 1
            if kind == "end":
                out.append((lines, "end", None))
        for block in came:
            block_of(block)
        left = waiting
        for block, chunks in blocks.items():
            left += len(chunks) - kept[block]
            if chunks and (block in came or len(chunks) != kept[block]):
                text = json.dumps([[seq, kind, payload] for seq, (kind, payload) in chunks.items()])
                self._early.updateValue((block,), (text,))
            elif kept[block] and not chunks:
                self._early.removeKey((block,))
        self._open.update((due, lines, partial, left))
        if out:
            numbers, kinds, texts = zip(*out, strict=True)
            yield pd.DataFrame(
                {
                    "stream_id": [key[0]] * len(out),
                    "line_no": numbers,
                    "kind": kinds,
                    "text": texts,
                    "failed": [[] for _ in out],
                }
            )

    def close(self) -> None:
        pass


class Closer(StatefulProcessor):
    """The end of one step: sees all lines of a stream and may add one before the end mark."""

    def __init__(self, step: StreamStep, idle_ms: int | None) -> None:
        self._step = StreamStep(step.name, None, step.start, step.see, step.end)
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = handle.getValueState("known", "known string, failed boolean", self._idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        step = self._step
        known, failed, ended = step.start, False, False
        before = self._known.get()
        if before:
            text, failed = before
            known = json.loads(text)
        for batch in [pd.concat(list(rows)).sort_values("line_no", kind="stable")]:
            out = []
            for row in batch.itertuples(index=False):
                marks = list(row.failed)
                if row.kind == "line":
                    try:
                        known = step.see(known, row.text) if step.see else known
                    except Exception:  # a step that fails never stops the stream
                        failed = True
                    out.append((row.line_no, "line", row.text, marks))
                    continue
                said, ended = None, True
                try:
                    said = step.end(known)
                except Exception:
                    failed = True
                number = row.line_no
                if said is not None:
                    out.append((number, "line", said, []))
                    number += 1
                out.append((number, "end", None, [*marks, step.name] if failed else marks))
            numbers, kinds, texts, marks = zip(*out, strict=True)
            yield pd.DataFrame(
                {"stream_id": [key[0]] * len(out), "line_no": numbers, "kind": kinds, "text": texts, "failed": marks}
            )
        if ended and before:
            self._known.clear()
        elif not ended:
            self._known.update((json.dumps(known), failed))

    def close(self) -> None:
        pass


def _stateful(df: DataFrame, processor: StatefulProcessor, idle_ms: int | None) -> DataFrame:
    return df.groupBy("stream_id").transformWithStateInPandas(
        processor, outputStructType=LINES, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None"
    )


def chain_lines(chunks: DataFrame, steps: Sequence[StreamStep], idle_minutes: int | None = None) -> DataFrame:
    """stream_id, line_no, kind (line, end), text, failed: the lines of all streams after all steps.

    Input columns: stream_id, seq, kind (chunk, end), payload. ``seq`` counts from 0 in each
    stream, and the end mark has the last number; chunks may come in any order, repeated ones
    count once. Lines leave in order, as soon as they are complete, whatever the cuts were. A
    step that fails on a line keeps it as it came, and ``failed`` names the step; failures at
    the end are named at the end mark. The state of streams that were idle for ``idle_minutes``
    expires, if given.
    """
    idle_ms = idle_minutes * 60_000 if idle_minutes else None
    out = _stateful(chunks.select("stream_id", "seq", "kind", "payload"), Liner(idle_ms), idle_ms)
    for step in steps:
        if step.line:
            spoken = F.col("kind") == "line"
            tried = out.withColumn("_tried", F.when(spoken, step.line(F.col("text"))))
            bad = spoken & F.col("_tried").isNull()
            out = tried.withColumns(
                {
                    "text": F.coalesce("_tried", "text"),
                    "failed": F.when(bad, F.array_append("failed", F.lit(step.name))).otherwise(F.col("failed")),
                }
            ).drop("_tried")
        if step.end:
            out = _stateful(out.select("stream_id", "line_no", "kind", "text", "failed"), Closer(step, idle_ms), idle_ms)
    return out


def chain_bodies(lines: DataFrame, steps: Sequence[StreamStep]) -> DataFrame:
    """stream_id, body, failed_steps of ended streams, from the collected output of ``chain_lines``.

    Steps are named in their order. The lines of one response are put together in one row, as a
    capture holds them.
    """
    text = F.struct("line_no", "text")
    bodies = lines.groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "line", text))).alias("_lines"),
        F.array_distinct(F.flatten(F.collect_list("failed"))).alias("_failed"),
        F.bool_or(F.col("kind") == "end").alias("_ended"),
    )
    names = F.array(*[F.lit(s.name) for s in steps]) if steps else F.array().cast("array<string>")
    return bodies.filter("_ended").select(
        "stream_id",
        F.array_join(F.transform("_lines", lambda x: x["text"]), "\n").alias("body"),
        F.array_intersect(names, "_failed").alias("failed_steps"),
    )


# The processors travel with the query, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
