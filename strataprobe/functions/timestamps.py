"""Timestamp expressions: finding, parsing, epoch decoding, rendering. All native, no UDF."""

from __future__ import annotations

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any timestamp form, the most specific first: Z, +hh:mm, +hhmm, "+hhmm UTC", none.
ANY_STAMP = (
    r"\b\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}|[+-]\d{4})\b"
    r"| \d{2}:\d{2}:\d{2}(?:\.\d+)? [+-]\d{4} UTC\b"
    r"|[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?\b)"
)
PARTS = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?(?: UTC)?$"
MINUTE = 60_000_000


def parse_timestamp(raw: Column) -> Column:
    """UTC timestamp of one stamp; no offset: UTC. Null if the text is no stamp or no valid time.
    Fractions beyond microseconds are cut."""
    raw = F.trim(raw)
    day, clock = F.regexp_extract(raw, PARTS, 1), F.regexp_extract(raw, PARTS, 2)
    fraction = F.substring(F.regexp_extract(raw, PARTS, 3), 1, 7)
    zone = F.regexp_extract(raw, PARTS, 4)
    base = F.concat(day, F.lit("T"), clock, fraction, F.lit("Z")).try_cast("timestamp")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    shift = F.when((hours < 24) & (minutes < 60), sign * (hours * 60 + minutes))
    offset = F.when((zone == "") | (zone == "Z"), F.lit(0)).otherwise(shift).cast("long")
    # the dash of a day is looked for first, as epochs are many and the patterns dear
    return F.when((F.substring(raw, 5, 1) == "-") & (day != ""), F.timestamp_micros(F.unix_micros(base) - offset * F.lit(MINUTE)))


def timestamps_in(text: Column) -> Column:
    """Distinct timestamps of a text, those of more specific forms first, then by position. A form that
    doesn't parse is read again without its offset."""
    found = F.regexp_extract_all(text, F.lit(ANY_STAMP), 0)

    def parts(r):
        rest = F.substr(r, F.lit(20))  # what follows the seconds
        fraction = F.when(rest.startswith("."), F.regexp_extract(rest, r"^\.\d{1,6}", 0)).otherwise("")
        base = F.concat(F.substring(r, 1, 10), F.lit("T"), F.substring(r, 12, 8), fraction, F.lit("Z")).try_cast("timestamp")
        zone = F.when(rest == "", "").otherwise(F.regexp_extract(rest, r"(Z|[+-]\d{2}:?\d{2})(?: UTC)?$", 1))
        return F.struct(base.alias("base"), zone.alias("zone"), rest.endswith(" UTC").alias("named"))

    def read(x, i):
        zone = x["zone"]
        plain = (zone == "") | (zone == "Z")
        minutes = F.substring(zone, 2, 2).cast("int") * 60 + F.right(zone, F.lit(2)).cast("int")
        valid = (F.substring(zone, 2, 2) < "24") & (F.right(zone, F.lit(2)) < "60")
        shift = F.when(plain | ~valid, F.lit(0)).otherwise(F.when(zone.startswith("-"), -minutes).otherwise(minutes)).cast("long")
        kind = F.when(zone == "Z", 0).when(plain | ~valid, 4).when(zone.contains(":"), 1).when(x["named"], 3).otherwise(2)
        return F.struct(kind.alias("kind"), i.alias("at"), F.timestamp_micros(F.unix_micros(x["base"]) - shift * F.lit(MINUTE)).alias("ts"))

    real = F.filter(F.transform(found, parts), lambda x: x["base"].isNotNull())
    rows = F.array_sort(F.transform(real, read))
    return F.array_distinct(F.transform(rows, lambda x: x["ts"]))


def first_timestamp(text: Column) -> Column:
    return F.try_element_at(timestamps_in(text), F.lit(1))


def epoch_to_timestamp(number: Column) -> Column:
    """Seconds, milli-, micro- or nanoseconds since 1970 by magnitude, null up to 1e9. Goes by way of
    a double and rounds to even, so digits that a double does not hold are lost as in any such reader."""
    num = number.cast("double")
    seconds = F.when(num > 1e17, num / 1e9).when(num > 1e14, num / 1e6).when(num > 1e11, num / 1e3).when(num > 1e9, num)
    whole = F.floor(seconds)
    return F.timestamp_micros(whole * 1_000_000 + F.rint((seconds - whole) * 1e6).cast("long"))


def stamp_or_epoch(text: Column) -> Column:
    """A JSON scalar's text: a stamp, or an epoch number."""
    return F.coalesce(parse_timestamp(text), epoch_to_timestamp(text.try_cast("double")))


def iso_utc(ts: Column) -> Column:
    """ISO text with Z; the fraction is left out when zero, else six digits. Null gives ''."""
    text = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(F.concat(F.replace(text, F.lit(".000000"), F.lit("")), F.lit("Z")), F.lit(""))


def user_datetime(value: str | None, assume_tz: str | None = None) -> datetime | None:
    """A bound given by the user; ValueError if it is no ISO datetime or has no zone and none is assumed."""
    if value is None:
        return None
    try:
        at = datetime.fromisoformat(value.strip())
    except ValueError as e:
        raise ValueError(f"invalid datetime {value!r}: ISO 8601 is asked for, as 2026-08-14T17:18:30Z") from e
    if at.tzinfo is None:
        if assume_tz is None:
            raise ValueError(f"datetime {value!r} has no zone: give an offset, or a zone to assume")
        at = at.replace(tzinfo=ZoneInfo(assume_tz))
    return at.astimezone(UTC)


def in_window(ts: Column, start: datetime | None, end: datetime | None) -> Column:
    """Inclusive bounds; rows without a time pass only if no bound is given."""
    if start is None and end is None:
        return F.lit(True)
    ok = ts.isNotNull()
    if start is not None:
        ok &= ts >= F.lit(start)
    if end is not None:
        ok &= ts <= F.lit(end)
    return ok
