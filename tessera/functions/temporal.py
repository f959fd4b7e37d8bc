"""Dates and times. Every function takes `as_of` instead of reading a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import once, strip, text

#: The formats of posted dates, after the weekday is gone, with a shape that all texts of the format have: a parser that fails costs
#: far more than a look at the shape.
FORMATS = {
    "yyyy-MM-dd": "^[^:,]*-[^:,]*-[^:, ]*$",
    "yyyy-MM-dd'T'HH:mm:ss": "-.*-.*[Tt].*:.*:",
    "yyyy-MM-dd HH:mm:ss": "-.*-.* .*:.*:",
    "dd MMM yyyy HH:mm:ss": " .* .* .*:.*:",
    "dd MMM yyyy": "^[^:,]* [^:,]* [^:,]*$",
    "MMM dd, yyyy": " .*, ",
}
#: What every relative phrase holds.
RELATIVE = r"(?i)\bago\b|\btoday\b|\byesterday\b|\bjust\s+posted\b"


def _minus(as_of: Column, days: Column) -> Column:
    return as_of - F.make_dt_interval(days)


def relative_date(c: Column | str, as_of: Column) -> Column:
    """From phrases such as `2 weeks ago` on short lines or at the start; null without one."""
    return once(text(c), lambda t: F.when(t.rlike(RELATIVE), _relative(t, as_of)))


def _relative(c: Column, as_of: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), strip), lambda s: (s != "") & (F.length(s) <= 40))
    head = F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 80)
    blobs = F.concat(lines, F.filter(F.array(head), lambda h: h != ""))
    number = lambda b, unit: F.regexp_extract(b, rf"(?i)\b(\d+)\s*{unit}s?\s*ago\b", 1).try_cast("int")

    def days(b: Column) -> Column:
        short = F.length(b) <= 28
        return (
            F.when(b.rlike(r"(?i)\bjust\s+posted\b|\btoday\b|\bhours?\s+ago\b|\bminutes?\s+ago\b"), 0)
            .when(b.rlike(r"(?i)\byesterday\b"), 1)
            .otherwise(F.coalesce(number(b, "day"), number(b, "week") * 7, F.when(short, number(b, "month") * 30), F.when(short, number(b, "year") * 365)))
        )

    found = F.filter(F.transform(blobs, days), lambda d: d.isNotNull())
    return _minus(as_of, F.try_element_at(found, F.lit(1)))


def posted_at(c: Column | str, as_of: Column, keep_offset: bool = True) -> Column:
    """timestamp_ntz from an epoch (milliseconds from 1e12 on), a relative phrase, or a date in one of FORMATS. An offset is
    converted to UTC; with keep_offset False it is dropped."""
    return once(strip(c), lambda t: _posted(t, as_of, keep_offset))


def _posted(t: Column, as_of: Column, keep_offset: bool) -> Column:
    number = F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.try_cast("double"))
    epoch = once(number, lambda n: F.timestamp_seconds(F.when(n > 1e12, n / 1000).otherwise(n)).cast("timestamp_ntz"))
    bare = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\.\d+", "")
    return F.coalesce(epoch, relative_date(t, as_of), once(bare, lambda b: _written(b, keep_offset)))


def _written(bare: Column, keep_offset: bool) -> Column:
    local = F.regexp_replace(bare, r"(?<=\d{2}:\d{2}:\d{2})\s*(Z|[+-]\d{2}:?\d{2}|GMT|UTC)$", "")
    plain = once(local, lambda x: F.coalesce(*[F.when(x.rlike(shape), F.try_to_timestamp(x, F.lit(f)).cast("timestamp_ntz")) for f, shape in FORMATS.items()]))
    if not keep_offset:
        return plain
    offset = F.regexp_extract(bare, r"(?<=\d{2}:\d{2}:\d{2})\s*(Z|[+-]\d{2}:?\d{2}|GMT|UTC)$", 1)
    digits = lambda o: F.regexp_replace(o, ":", "")
    minutes = lambda o: F.when(o.rlike("^[+-]"), (F.substring(digits(o), 2, 2).try_cast("int") * 60 + F.substring(digits(o), 4, 2).try_cast("int")) * F.when(o.startswith("-"), -1).otherwise(1)).otherwise(0)
    return plain - F.make_dt_interval(F.lit(0), F.lit(0), once(offset, minutes))


def age_days(c: Column, as_of: Column) -> Column:
    """Days as a fraction."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(c.cast("timestamp"))) / F.lit(86_400_000_000.0)


def hiring_class(posted: Column, as_of: Column, days: int = 7) -> Column:
    """likely, stale, or unknown without a date."""
    return F.when(posted.isNull(), "unknown").when(age_days(posted, as_of) <= max(1, days), "likely").otherwise("stale")


def hiring_order(cls: Column) -> Column:
    return F.when(cls == "likely", 0).when(cls == "unknown", 1).otherwise(2)


def recency_score(posted: Column, scraped: Column, as_of: Column, hiring_mode: bool = True) -> Column:
    """1 up to two days, then in a line to 0 at thirty."""
    score = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (age_days(c, as_of) - 2) / 28))
    missing = F.lit(0.0) if hiring_mode else F.coalesce(score(scraped), F.lit(0.3))
    return F.coalesce(score(posted), missing)


def recency_bonus(posted: Column, scraped: Column, as_of: Column, hours: int = 48, bonus: int = 5) -> Column:
    return F.when(age_days(F.coalesce(posted, scraped), as_of) * 24 <= hours, bonus).otherwise(0)


def in_quiet_hours(minute: Column, start: int, end: int) -> Column:
    """Whether a minute of the day is in [start, end), which may pass midnight; equal bounds hold nothing."""
    if start == end:
        return F.lit(False)
    return (minute >= start) & (minute < end) if start < end else (minute >= start) | (minute < end)


def in_cool_down(status: Column, updated: Column, as_of: Column, seconds: int = 1800) -> Column:
    return status.isin("rate_limited", "captcha_blocked", "disabled") & (age_days(updated, as_of) * 86400 < seconds)


def posted_label(posted: Column, as_of: Column) -> Column:
    days = F.floor(age_days(posted, as_of)).cast("int")
    return F.when(posted.isNull(), "Date unknown").when(days <= 0, "Posted today").when(days == 1, "Posted 1 day ago").otherwise(F.concat(F.lit("Posted "), days.cast("string"), F.lit(" days ago")))


def total_months(jobs: Column, as_of: Column) -> Column:
    """Months over array<struct<start, end, current>> of `yyyy-MM` or `yyyy` texts; an open end is as_of, overlaps count twice."""
    months = lambda s: F.when(F.regexp_extract(s, r"(20\d{2})", 1) != "", F.regexp_extract(s, r"(20\d{2})", 1).cast("int") * 12 + F.coalesce(F.nullif(F.regexp_extract(s, r"20\d{2}-(\d{2})", 1), F.lit("")).cast("int"), F.lit(1)))
    now = F.year(as_of) * 12 + F.month(as_of)
    one = lambda j: F.greatest(F.lit(0), F.when(j["current"], now).otherwise(F.coalesce(months(j["end"]), now)) - months(j["start"]))
    return F.aggregate(jobs, F.lit(0), lambda t, j: t + F.coalesce(one(j), F.lit(0)))
