"""Times in integer milliseconds as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; negative times read as zero."""
    t = F.greatest(ms, F.lit(0).cast("long"))
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(t / 3600000),
        F.floor(t / 60000) % 60,
        F.floor(t / 1000) % 60,
        t % 1000,
    )


def vtt_time(ms: Column) -> Column:
    """HH:MM:SS.mmm."""
    return F.replace(srt_time(ms), F.lit(","), F.lit("."))


def mmss_time(ms: Column) -> Column:
    """MM:SS.mmm with as many minutes as it takes."""
    t = F.greatest(ms, F.lit(0).cast("long"))
    return F.format_string("%02d:%02d.%03d", F.floor(t / 60000), F.floor(t / 1000) % 60, t % 1000)


def parse_time(text: Column) -> Column:
    """Milliseconds of H:MM:SS with , or . and one to three digits; null when malformed."""
    pattern = r"^\s*(\d{1,3}):([0-5]\d):([0-5]\d)[.,](\d{1,3})\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    ms = F.rpad(part(4), 3, "0").try_cast("long")
    whole = part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60 + part(3).try_cast("long")
    return F.when(text.rlike(pattern), whole * 1000 + ms)


def parse_mmss(text: Column) -> Column:
    """Milliseconds of a strict MM:SS.mmm; null when malformed."""
    pattern = r"^(\d{2,}):([0-5]\d)\.(\d{3})$"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("long")
    return F.when(text.rlike(pattern), part(1) * 60000 + part(2) * 1000 + part(3))


def quota_day(ts: Column) -> Column:
    """The business day of an instant: days turn at 16:00 in UTC+8."""
    return F.to_date(ts + F.expr("interval 8 hours") - F.expr("interval 16 hours"))
