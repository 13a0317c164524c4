"""Expressions over text, paths and years."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "(blank)"


def nonblank(c: Column) -> Column:
    """Neither NULL nor an empty text. Numbers are compared with nothing, and not turned into text."""
    return c.isNotNull() & (F.when(F.typeof(c) == "string", c.cast("string")).otherwise("-") != "")


def or_blank(c: Column) -> Column:
    """The value as text, blanks named rather than dropped."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(BLANK))


# Every Unicode space separator.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def plain_number(c: Column) -> Column:
    """A floating-point number as plain decimals: as many as it has, at least one, and no exponent."""
    shown = c.cast("string")
    digits = shown.try_cast("decimal(38,18)")
    trimmed = F.rtrim(digits.cast("string"), F.lit("0"))
    exact = digits.isNotNull() & ((digits != 0) | (c == 0))
    return F.when(exact, F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)).otherwise(shown)


def trim_spaces(c: Column) -> Column:
    """Strip every kind of space character (no tabs), where ``trim`` only strips U+0020."""
    return F.btrim(c, F.lit(SPACES))


def ilike_any_part(c: Column, part: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the part act as wildcards, ``\\`` does not."""
    return c.ilike("%" + part.replace("\\", "\\\\") + "%")


def year_number(c: Column, dtype: str) -> Column:
    """A year as an integer, NULL where it is not a number."""
    if dtype in ("tinyint", "smallint", "int"):
        return c
    return F.round(c.try_cast("double")).try_cast("int")


def folded_path(c: Column) -> Column:
    """A path for comparison: one kind of slash, lower case, no slash at either end."""
    return F.btrim(F.lower(F.translate(c, "\\", "/")), F.lit("/"))


def under_any_folder(path: Column, folders: Sequence[str]) -> Column:
    """Whether a path is one of the folders or lies below one; a NULL path is not."""
    if not folders:
        return F.lit(False)
    folded = folded_path(F.coalesce(path.cast("string"), F.lit("")))
    wanted = [f.replace("\\", "/").lower().strip("/") for f in folders]
    return reduce(or_, [(folded == w) | folded.startswith(w + "/") for w in wanted])


def parent_folder(path: Column) -> Column:
    """The folder holding a path, '' where the path has none."""
    p = F.translate(F.coalesce(path, F.lit("")), "\\", "/")
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"/[^/]*\z", "")).otherwise("")


def leading_folders(path: Column, depth: int) -> Column:
    """The first ``depth`` slash-separated segments."""
    return F.substring_index(F.coalesce(path.cast("string"), F.lit("")), "/", depth)


def path_depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def matches_count(text: Column, like_patterns: Sequence[str]) -> Column:
    """How many LIKE patterns the lower-cased text matches."""
    folded = F.lower(text)
    return reduce(add, [F.when(folded.like(p), 1).otherwise(0) for p in like_patterns], F.lit(0))


def figure_key(year: Column, value: Column, unit: Column) -> Column:
    """One text for a stated figure: the same year, value and unit give the same key."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (year, value, unit)]
    return F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2])
