"""Rule patterns are written for an ASCII, line-free regex dialect; Spark runs java.util.regex."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile(r"(\^?)((?:[^\\^$.|?*+()\[\]{}]|\\\()+)")
_WORD_END = re.compile(r"([^\\^$.|?*+()\[\]{}]+?)(?:(.)\?)?(\\b)?")


def java_pattern(pattern: str) -> str:
    """The same pattern for Java.

    ``\\b`` follows a word character wherever the rules use it and counts ASCII letters only, so it
    becomes a negative lookahead; ``$`` means the end of the text, not the end before a newline.
    """
    pattern = pattern.replace(r"\b", "(?![A-Za-z0-9_])")
    return re.sub(r"\$(?=[|)]|\Z)", r"\\z", pattern)


def quoted(text: str) -> str:
    """A SQL literal that takes every character as it is."""
    return f'r"{text}"' if "'" in text else f"r'{text}'"


def matches(column: str, pattern: str) -> str:
    """A SQL condition: whether a pattern occurs in a text column.

    Most rules are lists of phrases. Phrases are looked up as substrings, which takes a fraction of the
    time of trying every branch of an alternation at every position; only the rest stays a regex.
    """
    inner = pattern[1:-1]
    if not (pattern.startswith("(") and pattern.endswith(")")) or re.search(r"(?<!\\)[()]", inner):
        return f"{column} rlike {quoted(java_pattern(pattern))}"
    tests, rest = [], []
    for phrase in inner.split("|"):
        plain, word_end = _PLAIN.fullmatch(phrase), _WORD_END.fullmatch(phrase)
        if plain:
            test = "startswith" if plain[1] else "contains"
            tests.append(f"{test}({column}, {quoted(plain[2].replace('\\(', '('))})")
        elif word_end:
            held = f"contains({column}, {quoted(word_end[1])})"
            # The regex runs only on texts that hold the word at all; with nothing after it, an
            # optional last letter decides nothing.
            tests.append(f"({held} and {column} rlike {quoted(java_pattern(phrase))})" if word_end[3] else held)
        else:
            rest.append(phrase)
    if rest:
        tests.append(f"{column} rlike {quoted(java_pattern('(' + '|'.join(rest) + ')'))}")
    return "(" + " or ".join(tests) + ")"


def literal(value: str | int | float | None) -> str:
    if value is None:
        return "null"
    return quoted(value) if isinstance(value, str) else f"{value}D" if isinstance(value, float) else str(value)


def first_match(cases: Iterable[tuple[str, str | int | float | None]], default: str | int | float | None) -> Column:
    """The value of the first condition that holds; one expression, however many rules there are."""
    branches = " ".join(f"when {condition} then {literal(value)}" for condition, value in cases)
    return F.expr(f"case {branches} else {literal(default)} end")
