"""Restoring placeholders in streams of event-stream chunks.

A chunk may end anywhere, also inside a placeholder. Per stream the processor keeps the
unfinished line and the lines whose text may still grow into a placeholder. What it
emits does not depend on where the chunks were cut.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "stream_id string, seq long, text string"
INPUT_COLUMNS = ("stream_id", "seq", "kind", "placeholder", "payload")

_TOKEN = re.compile(r"\[[A-Z0-9_]+_[0-9]+\]")
# An event qualifies through these marks, tried in order, and carries its text in the field.
_CARRIERS = (
    (("text_delta",), "text"),
    (("thinking_delta",), "thinking"),
    (('"delta"', '"content"'), "content"),
    (('"parts"', '"text"'), "text"),
)
_VALUE = {
    f: re.compile(rf'"{f}"\s*:\s*("(?:[^"\\]|\\.)*")', re.S) for f in ("text", "thinking", "content")
}


def _text_span(line: str) -> tuple[int, int, str] | None:
    """Bounds of the text literal in an event line, and its plain text."""
    if not line.startswith("data: "):
        return None
    for marks, name in _CARRIERS:
        if all(mark in line for mark in marks):
            found = _VALUE[name].search(line, 6)
            if found:
                try:
                    return found.start(1), found.end(1), json.loads(found.group(1), strict=False)
                except ValueError:
                    return None
    return None


class Held:
    """Lines whose text may still grow into a placeholder, each read once."""

    def __init__(self, lines: list[str]) -> None:
        self.clear()
        for line in lines:
            self.add(line, _text_span(line))

    def clear(self) -> None:
        self.lines: list[str] = []
        self.spans: list[tuple[int, int, str] | None] = []
        self.unfinished = False

    def add(self, line: str, span: tuple[int, int, str] | None) -> None:
        self.lines.append(line)
        self.spans.append(span)
        if span:
            opened, closed = span[2].rfind("["), span[2].rfind("]")
            if max(opened, closed) >= 0:
                self.unfinished = opened > closed


class ChunkRehydrator(StatefulProcessor):
    """Rows of kind ``name`` fill the dictionary, ``chunk`` rows carry text, ``end`` flushes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._names = handle.getMapState("names", "placeholder string", "original string")
        self._open = handle.getValueState("open", "partial string, held string")

    def _restore(self, text: str) -> str:
        def original(found: re.Match) -> str:
            key = (found.group(),)
            return self._names.getValue(key)[0] if self._names.containsKey(key) else found.group()

        return _TOKEN.sub(original, text)

    def _settle(self, held: Held, out: list[str]) -> None:
        joint = "".join(s[2] for s in held.spans if s)
        restored = self._restore(joint)
        pending = json.dumps(restored, ensure_ascii=False)
        for line, span in zip(held.lines, held.spans, strict=True):
            if span and restored != joint:
                line = line[: span[0]] + pending + line[span[1] :]
                pending = '""'
            out.append(line)
        held.clear()

    def _take(self, line: str, held: Held, out: list[str]) -> None:
        span = _text_span(line)
        if span is None and line.strip():
            self._settle(held, out)
            out.append(line)
            return
        held.add(line, span)
        if not held.unfinished:
            self._settle(held, out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        partial, held_json = self._open.get() if self._open.exists() else ("", "[]")
        held = Held(json.loads(held_json))
        out: list[str] = []
        last = 0
        # A micro-batch holds the few chunks that one stream sent since the last one.
        for batch in sorted_batches(rows):
            for row in batch.itertuples(index=False):
                last = int(row.seq)
                if row.kind == "name":
                    self._names.updateValue((row.placeholder,), (row.payload,))
                    continue
                if row.kind == "chunk":
                    *lines, partial = (partial + row.payload).split("\n")
                    for line in lines:
                        self._take(line, held, out)
                    continue
                if partial:
                    self._take(partial, held, out)
                    self._settle(held, out)
                else:
                    self._settle(held, out)
                    out.append("")
                partial = ""
        self._open.update((partial, json.dumps(held.lines)))
        if out:
            yield pd.DataFrame({"stream_id": [key[0]], "seq": [last], "text": ["\n".join(out)]})

    def close(self) -> None:
        pass


def sorted_batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows of one key in sequence order."""
    frames = list(rows)
    if frames:
        yield pd.concat(frames).sort_values("seq", kind="stable")


def rehydrate_chunks(stream: DataFrame) -> DataFrame:
    """stream_id, seq, text: lines released so far, in order of ``seq`` per stream.

    Input columns: stream_id, seq, kind (name, chunk, end), placeholder, payload. The
    lines of consecutive rows of one stream are joined by newlines.
    """
    return stream.select(*INPUT_COLUMNS).groupBy("stream_id").transformWithStateInPandas(
        ChunkRehydrator(),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None",
    )


# The processor travels with the query, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
