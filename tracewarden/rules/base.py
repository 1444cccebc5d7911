"""The shape of a rule. Catalogues are plain data; operators turn them into columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewarden.dialect import Pattern
from tracewarden.functions.text import all_of, any_of


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: Pattern
    severity: str | None = None
    label: str | None = None
    token: str | None = None
    # Findings matching one of these are dropped. A pattern that starts with ^ is
    # tested on the first capture group, any other one on the whole match.
    allow: tuple[Pattern, ...] = ()
    min_entropy: float | None = None
    # Context gate: one of the words within `window` characters of the match.
    context: tuple[str, ...] = ()
    window: int = 100
    # Cheap necessary conditions. `needs`: of every tuple, one literal must occur in
    # the lower-cased text. `probe`: a lighter pattern that matches whenever the rule does.
    needs: tuple[tuple[str, ...], ...] = ()
    probe: Pattern | None = None
    # A literal that the first match, if there is one, must start at the first occurrence of.
    anchor: str | None = None
    # Java spelling where `to_java` cannot derive one.
    java_override: str | None = None
    # The Java spelling consumes what the pattern only looks back at: its group 1 stays in the
    # text, group 2 is the match.
    lead: bool = False

    @property
    def java(self) -> str:
        return self.java_override or self.pattern.java

    @property
    def group(self) -> int:
        return 1 if self.pattern.groups else 0

    @property
    def probe_java(self) -> str:
        """The lightest pattern that matches whenever the rule does.

        Without its word boundaries a pattern matches at least as much and is faster.
        """
        if self.probe:
            return self.probe.java
        if self.java_override or r"\b" not in self.pattern.source:
            return self.java
        return Pattern(self.pattern.source.replace(r"\b", ""), self.pattern.flags).java

    def may_match(self, lowered: Column) -> Column | None:
        """Byte-level pre-check on the lower-cased text; None when there is none."""
        if not self.needs:
            return None
        return all_of(
            [any_of([F.contains(lowered, F.lit(word)) for word in words]) for words in self.needs]
        )


def rule(id: str, source: str, flags: str = "", **kwargs) -> Rule:
    return Rule(id, Pattern(source, flags), **kwargs)
