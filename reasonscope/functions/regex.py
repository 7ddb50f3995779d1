"""Regular-expression building blocks with Python ``re`` semantics.

Spark evaluates patterns with java.util.regex. To get the word boundary and
whitespace rules of Python's Unicode ``re`` module, the patterns spell the
classes out instead of relying on ``\\b`` and ``\\s`` (whose meaning differs
between Java versions and flags).
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

# A word character in Python's Unicode regex: letters, numbers, underscore.
WORD_CLASS_BODY = r"\p{L}\p{N}_"
WORD_CLASS = "[" + WORD_CLASS_BODY + "]"
NON_WORD_CLASS = "[^" + WORD_CLASS_BODY + "]"


def _ranges(codes: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


@lru_cache(maxsize=1)
def space_class_body() -> str:
    """Characters for which ``str.isspace()`` holds (what ``\\s`` and
    ``str.strip()`` use in Python), as a class body valid in Java and RE2."""
    codes = [c for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    parts = []
    for lo, hi in _ranges(codes):
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "".join(parts)


def space_class() -> str:
    return "[" + space_class_body() + "]"


def escape_literal(text: str) -> str:
    """Escape text so a Java or RE2 pattern matches it literally."""
    out = []
    for ch in text:
        if ("a" <= ch <= "z") or ("A" <= ch <= "Z") or ("0" <= ch <= "9") or ch == "_":
            out.append(ch)
        else:
            out.append(f"\\x{{{ord(ch):x}}}")
    return "".join(out)


def is_word_char(ch: str) -> bool:
    return re.match(r"\w", ch) is not None


def whole_word(phrase_pattern: str, first: str, last: str, length: int | None = None, prefix: bool = False) -> str:
    """Wrap a pattern with Python ``\\b`` semantics at both ends, given the
    first and last character the pattern matches.

    With a fixed match ``length`` the pattern starts with the literal and
    checks the left boundary afterwards, looking back past the match; Java
    then rejects most positions on the first character, which is several
    times faster than a leading lookbehind.
    """
    right = ("" if prefix else f"(?!{WORD_CLASS})") if is_word_char(last) else f"(?={WORD_CLASS})"
    if length is None:
        left = f"(?<!{WORD_CLASS})" if is_word_char(first) else f"(?<={WORD_CLASS})"
        return left + phrase_pattern + right
    back = f"{WORD_CLASS}.{{{length}}}"
    left = f"(?<!{back})" if is_word_char(first) else f"(?<={back})"
    return phrase_pattern + left + right


def phrase_pattern(phrase: str, ignore_case: bool = True) -> str:
    """``\\bPHRASE\\b`` (literal phrase), optionally case-insensitive (Unicode)."""
    if not phrase:
        raise ValueError("empty phrase")
    body = whole_word(escape_literal(phrase), phrase[0], phrase[-1], len(phrase))
    return ("(?ius)" if ignore_case else "(?s)") + body


def any_phrase_pattern(phrases: list[str] | tuple[str, ...], ignore_case: bool = True, prefix: bool = False) -> str:
    """Match any of the phrases as a whole word (for existence tests only); with
    ``prefix`` a word may go on behind a phrase that ends inside one."""
    alts = [whole_word(escape_literal(p), p[0], p[-1], len(p), prefix) for p in phrases if p]
    if not alts:
        raise ValueError("no phrases")
    return ("(?ius)" if ignore_case else "(?s)") + "(?:" + "|".join(alts) + ")"


def java_replacement(text: str) -> str:
    """Escape a replacement so Java treats it literally (``\\`` and ``$``)."""
    return text.replace("\\", "\\\\").replace("$", "\\$")
