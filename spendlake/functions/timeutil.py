"""Time helpers for dedup and mail headers (SC-7, SC-8, SC-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_time(x) -> Column:
    """SC-7: ISO date/datetime text -> TIMESTAMP_NTZ (wall clock of the writer), NULL if bad.

    An offset is dropped and the local wall clock kept; a bare date means midnight.
    """
    c = _c(x)
    s = F.regexp_replace(F.trim(c), r"([+-]\d{2}:?\d{2}|Z)$", "")
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(None).cast("timestamp_ntz")).otherwise(
        s.try_cast("timestamp_ntz")
    )


def gap_minutes(a, b) -> Column:
    """SC-8: absolute gap in minutes, fractional (no truncation to whole seconds)."""
    micros = F.abs(F.timestamp_diff("MICROSECOND", _c(a), _c(b)))
    return micros / F.lit(60_000_000.0)


# Zone names of mail dates and their offsets.
MAIL_ZONES = {
    "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}


def mail_date_to_iso(x, as_of_iso: str) -> Column:
    """SC-13 (native form): 'Mon, 23 Mar 2026 22:00:00 +0530' -> '2026-03-23T22:00:00+05:30'.

    The weekday (short or full) is stripped (an ``EEE`` field raises even in the try form),
    the wall clock and the sender's offset are kept; an offset may be a zone name, hours
    may have one digit and years two (pivot 69).  Missing or bad -> ``as_of_iso``.
    """
    c = F.trim(_c(x))
    body = F.regexp_replace(c, r"^[A-Za-z]{3,9},?\s*", "")
    m = (r"^(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4}|\d{2})\s+(\d{1,2})(:\d{2}(?::\d{2})?)\s*"
         r"(?:([+-]\d{2})(\d{2})|([A-Za-z]{1,3})\b)")
    day, mon, year, hour, rest, oh, om, zone = (F.regexp_extract(body, m, i) for i in range(1, 9))
    full_year = (
        F.when(F.length(year) == 4, year)
        .when(year >= "69", F.concat(F.lit("19"), year))
        .otherwise(F.concat(F.lit("20"), year))
    )
    local = F.try_to_timestamp(
        F.concat_ws(" ", F.lpad(day, 2, "0"), F.initcap(mon), full_year, F.concat(F.lpad(hour, 2, "0"), rest)),
        F.lit("dd MMM yyyy HH:mm[:ss]"),
    )
    zones = F.create_map(*[F.lit(v) for pair in MAIL_ZONES.items() for v in pair])
    offset = F.when(oh != "", F.concat(oh, F.lit(":"), om)).otherwise(F.try_element_at(zones, F.upper(zone)))
    iso = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)
    return F.when(day != "", F.coalesce(iso, F.lit(as_of_iso))).otherwise(F.lit(as_of_iso))
