"""String expressions: excerpts, counts, escapes, sizes, slugs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MORE_BEFORE = "… "
MORE_AFTER = " …[truncated]"
LEADING_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?[+-]\d{4}\s+"


def short_id(value: Column) -> Column:
    return F.substring(value, 1, 8)


def markdown_cell(value: Column) -> Column:
    text = F.replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.coalesce(text, F.lit(""))


def human_size(size: Column) -> Column:
    """1024-based with one decimal, halves to even, B to TB."""
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(size / 1024.0**power, 1))
    out = shown(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024 ** (power + 1), shown(power, unit)).otherwise(out)
    return out


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; the needle must not be empty."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")


def truncated(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit(MORE_AFTER))).otherwise(text)


def _cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with marks where something is left out."""
    return F.concat(
        F.when(start > 0, F.lit(MORE_BEFORE)).otherwise(""),
        F.substring(text, start + 1, end - start),
        F.when(end < F.length(text), F.lit(MORE_AFTER)).otherwise(""),
    )


def excerpt_around(text: Column, needle: Column, width: int, ignore_case: bool = False) -> Column:
    """At most about `width` characters with the needle's first occurrence in the middle; room left at
    one edge goes to the other side. Without the needle: the beginning."""
    n = F.length(text)
    pos = F.instr(F.lower(text), F.lower(needle)) if ignore_case else F.instr(text, needle)
    pos = pos - 1
    half = F.greatest(F.lit(1), F.floor((F.lit(width) - F.length(needle)) / 2).cast("int"))
    start = F.greatest(F.lit(0), pos - half)
    end = F.least(n, pos + F.length(needle) + half)
    spare = F.greatest(F.lit(0), F.lit(width) - (end - start))
    start2 = F.when((start > 0) & (end == n), F.greatest(F.lit(0), start - spare)).otherwise(start)
    end2 = F.when(start == 0, F.least(n, end + spare)).otherwise(end)
    return F.when(pos < 0, truncated(text, width)).when(n <= width, text).otherwise(_cut(text, start2, end2))


def excerpt_first_of(text: Column, needles: list[str], width: int) -> Column:
    """Excerpt that begins half a width before the earliest of the needles."""
    spots = [F.nullif(F.instr(text, F.lit(x)), F.lit(0)) for x in needles if x]
    pos = (F.least(*spots) if len(spots) > 1 else spots[0] if spots else F.lit(None).cast("int")) - 1
    start = F.greatest(F.lit(0), pos - width // 2)
    end = F.least(F.length(text), start + width)
    start = F.when(end - start < width, F.greatest(F.lit(0), end - width)).otherwise(start)
    return F.when(pos.isNull(), truncated(text, width)).otherwise(_cut(text, start, end))


def without_leading_stamp(line: Column) -> Column:
    return F.regexp_replace(line, LEADING_STAMP, "")


def slug(value: str, width: int = 80, joiner: str = "-", otherwise: str = "case") -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", joiner, value.strip()).strip(".-")[:width] or otherwise
