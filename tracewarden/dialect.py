"""ECMAScript regular expressions rewritten for java.util.regex.

Rules are written once, in the ECMAScript spelling. Spark evaluates Java
patterns, which differ in a few constructs; ``to_java`` rewrites those:

* ``\\b`` is an ASCII word boundary (Java up to 18 uses Unicode letters),
* ``\\s`` covers the no-break and Unicode spaces,
* ``.``, ``^`` and ``$`` follow the four ECMAScript line terminators,
* a bare ``[`` or ``&&`` inside a class is literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_EOL = r"\n\r\u2028\u2029"
_WORD = r"[A-Za-z0-9_]"
_BEFORE_WORD = rf"(?<!{_WORD})"
_AFTER_WORD = rf"(?!{_WORD})"
_BOUNDARY = rf"(?:(?<={_WORD}){_AFTER_WORD}|{_BEFORE_WORD}(?={_WORD}))"

_TOKEN = re.compile(
    r"""(?P<cls>\[\^?(?:\\.|[^\]\\])*\])   # character class
      | (?P<esc>\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|.))
      | (?P<grp>\(\?(?:[:=!]|<[=!]))
      | (?P<chr>.)""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Pattern:
    """An ECMAScript pattern: ``source`` plus the flags ``i`` and ``m``."""

    source: str
    flags: str = ""

    @property
    def java(self) -> str:
        return to_java(self.source, self.flags)

    @property
    def groups(self) -> int:
        """Number of capture groups."""
        bare = re.sub(r"\[\^?(?:\\.|[^\]\\])*\]|\\.", "", self.source, flags=re.S)
        return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def _tokens(source: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in _TOKEN.finditer(source)]


def _java_class(token: str) -> str:
    negated = token.startswith("[^")
    body = token[2 if negated else 1 : -1]
    out = []
    for m in re.finditer(r"\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|.)|.", body, re.S):
        part = m.group()
        if part == r"\s":
            out.append(_SPACE)
        elif part in ("[", "&"):
            out.append("\\" + part)
        else:
            out.append(part)
    # [\s\S] spells "any character"; Java accepts the same union.
    return ("[^" if negated else "[") + "".join(out) + "]"


def _only_word_chars(token: tuple[str, str]) -> bool:
    kind, text = token
    if kind == "chr":
        return re.fullmatch(r"[A-Za-z0-9_]", text) is not None
    if kind == "esc":
        return text in (r"\d", r"\w")
    if kind == "cls":
        return re.fullmatch(r"\[(?:[A-Za-z0-9_]|(?<=\w)-(?=\w)|\\d|\\w)+\]", text) is not None
    return False


def _skippable(tokens: list[tuple[str, str]], i: int) -> bool:
    """Whether the quantifier at ``i`` allows zero repeats."""
    text = "".join(t for _, t in tokens[i : i + 2])
    return text[:1] in ("?", "*") or text == "{0"


def _ends_in_word(tokens: list[tuple[str, str]], i: int) -> bool:
    """Whether the atom before position ``i`` surely ends in a word character."""
    j = i - 1
    if j > 0 and tokens[j][1] == "}":
        while j > 0 and tokens[j][1] != "{":
            j -= 1
        if _skippable(tokens, j):
            return False
        j -= 1
    elif j > 0 and tokens[j][1] == "+":
        j -= 1
    return j >= 0 and _only_word_chars(tokens[j])


def to_java(source: str, flags: str = "") -> str:
    """Rewrite an ECMAScript pattern to an equivalent Java pattern."""
    multiline = "m" in flags
    tokens = _tokens(source)
    out: list[str] = []
    for i, (kind, text) in enumerate(tokens):
        if kind == "cls":
            out.append(_java_class(text))
        elif kind == "esc":
            if text == r"\b":
                follows = i + 1 < len(tokens) and _only_word_chars(tokens[i + 1])
                if follows and not _skippable(tokens, i + 2):
                    out.append(_BEFORE_WORD)
                elif _ends_in_word(tokens, i):
                    out.append(_AFTER_WORD)
                else:
                    out.append(_BOUNDARY)
            elif text == r"\s":
                out.append(f"[{_SPACE}]")
            elif text == r"\S":
                out.append(f"[^{_SPACE}]")
            else:
                out.append(text)
        elif kind == "chr" and text == ".":
            out.append(f"[^{_EOL}]")
        elif kind == "chr" and text == "^":
            out.append(rf"(?:\A|(?<=[{_EOL}]))" if multiline else r"\A")
        elif kind == "chr" and text == "$":
            out.append(rf"(?=[{_EOL}]|\z)" if multiline else r"\z")
        else:
            out.append(text)
    java = "".join(out)
    if "i" in flags:
        java = ("(?i)" if source.isascii() else "(?iu)") + java
    return java


def quote(literal: str) -> str:
    """A pattern source that matches ``literal`` itself."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", literal)


def replacement(literal: str) -> str:
    """Escape a replacement so that it is inserted literally."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")
