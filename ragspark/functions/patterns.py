"""Regex dialect: patterns are written once and run on the JVM.

The rules come as patterns in the common scripting dialect, where word, digit and
space classes are Unicode aware, combining marks are not word characters and
``.`` stops at a line feed only. The JVM's own shorthands are ASCII or
version dependent, so they are spelled out here.
"""

from __future__ import annotations

import re
import unicodedata

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
DIGIT = r"\p{Nd}"
NOT_SPACE = rf"[^{SPACE}]"

STARTS_WORD = rf"(?<![{WORD}])"
ENDS_WORD = rf"(?![{WORD}])"
BOUNDARY = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"

_TOKEN = re.compile(r"\\.|\[|\]|.", re.S)
_GROUP = re.compile(r"^(\\b)?\((?:\?:)?([^()\[\]\\*+?{}^$]+)\)(\\b)?$")
_OPENS_WITH_WORD = re.compile(r"^\\b(?:\((?:\?:)?)?(?:\\d|[A-Za-z]|\[A-Z\])")
_CLOSES_WITH_WORD = re.compile(r"(?:\\d(?:\{\d+\})?|[A-Za-z]\)|\[a-z\]\+)\\b$")


def to_jvm(pattern: str, ignore_case: bool = True, multiline: bool = False) -> str:
    """Spell a rule pattern for ``java.util.regex``."""
    body = _sequence(pattern) or _group(pattern) or _spell(pattern)
    flags = "d" + ("iu" if ignore_case else "") + ("m" if multiline else "")
    return f"(?{flags}){body}"


def to_jvm_folded(pattern: str, multiline: bool = False) -> str:
    """As :func:`to_jvm`, for texts passed through :func:`ragspark.functions.text.fold_case`.

    Case then needs no care at match time, which is several times faster.
    """
    if re.sub(r"\\.", "", pattern).lower() == re.sub(r"\\.", "", pattern):
        return to_jvm(pattern, ignore_case=False, multiline=multiline)
    return to_jvm(pattern, ignore_case=True, multiline=multiline)


def _spell(pattern: str) -> str:
    head = tail = ""
    if _OPENS_WITH_WORD.match(pattern) and "|" not in _outside_groups(pattern):
        head, pattern = STARTS_WORD, pattern[2:]
    if _CLOSES_WITH_WORD.search(pattern) and "|" not in _outside_groups(pattern):
        tail, pattern = ENDS_WORD, pattern[:-2]
    out, in_class = [], False
    for token in _TOKEN.findall(pattern):
        if token == "[":
            in_class = True
        elif token == "]":
            in_class = False
        elif token == r"\b":
            token = BOUNDARY
        elif token == r"\d":
            token = DIGIT
        elif token == r"\s":
            token = SPACE if in_class else f"[{SPACE}]"
        elif token == r"\w":
            token = WORD if in_class else f"[{WORD}]"
        out.append(token)
    return head + "".join(out) + tail


def _outside_groups(pattern: str) -> str:
    return re.sub(r"\([^()]*\)", "", re.sub(r"\[[^\]]*\]", "", pattern))


def _is_word(char: str) -> bool:
    return char == "_" or unicodedata.category(char)[0] in "LN"


def _group(pattern: str) -> str | None:
    """A group of words, with or without word boundaries.

    The first letter is tested before anything else, as it rules out most places.
    """
    found = _GROUP.match(pattern)
    if not found:
        return None
    opens, listed, closes = found.groups()
    words = listed.split("|")
    if not all(w and w[0].isalnum() and w[-1] != "." for w in words):
        return None
    letters = "".join(sorted({w[0] for w in words}))
    head = tail = ""
    if opens:
        head = STARTS_WORD if all(_is_word(w[0]) for w in words) else BOUNDARY
    if closes:
        tail = ENDS_WORD if all(_is_word(w[-1]) for w in words) else BOUNDARY
    return f"(?=[{letters}]){head}(?:{listed}){tail}"


def _sequence(pattern: str) -> str | None:
    """Word groups joined by ``.*``, matched without backtracking.

    Only whether a line holds the groups in order matters, and taking each
    group at its earliest place never loses a match. Atomic groups from the
    start of the line make that linear; the plain form is of a power of the
    line length that grows with the number of gaps.
    """
    groups = sequence_groups(pattern)
    return groups and "(?m:^)" + "".join(f"(?>.*?{g})" for g in groups)


def sequence_groups(pattern: str) -> list[str] | None:
    """The groups of a pattern that :func:`_sequence` handles; all of them must occur.

    A group must not hold a word inside another of its words, as the shorter one could
    then end earlier.
    """
    parts = pattern.split(".*")
    groups = [_group(p) for p in parts]
    if len(parts) < 2 or None in groups or any("." in p for p in parts):
        return None
    for part in parts[:-1]:
        words = _GROUP.match(part).group(2).split("|")
        if any(a in b[:-1] for a in words for b in words if a != b):
            return None
    return groups
