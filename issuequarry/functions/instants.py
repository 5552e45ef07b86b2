"""ISO-8601 text to UTC wall-clock timestamps, whatever the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$"
)
_OFFSET = r"[T ].*([Zz]|[+-]\d{2}(:?\d{2})?)$"


def utc_naive(raw: Column) -> Column:
    """UTC timestamp without zone; text without an offset counts as UTC; bad text gives null."""
    clean = F.replace(F.upper(F.trim(raw)), F.lit(","), F.lit("."))
    clean = F.regexp_replace(clean, r"([T ]\d{2}(?::\d{2})?)(?=Z|[+-]|$)", "$1:00")
    clean = F.regexp_replace(clean, r"([T ]\d{2}:\d{2})(?=Z|[+-]|$)", "$1:00")
    clean = F.regexp_replace(clean, r"([T ].*[+-]\d{2})(\d{2})$", "$1:$2")
    clean = F.regexp_replace(clean, r"([T ].*[+-]\d{2})$", "$1:00")
    seconds = (F.unix_micros(clean.try_cast("timestamp")) / F.lit(1_000_000)).cast("decimal(18,6)")
    shifted = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )
    parsed = F.when(raw.rlike(_OFFSET), shifted).otherwise(clean.try_cast("timestamp_ntz"))
    return F.when(F.trim(raw).rlike(_ISO), parsed)


def utc_or_default(raw: Column, run_ts: Column) -> Column:
    """Missing or bad text falls back to the timestamp of the run."""
    return F.coalesce(utc_naive(raw), run_ts)


def run_timestamp(iso: str) -> Column:
    """Literal stand-in for "now", the same for every row of a run."""
    return F.lit(iso).cast("timestamp_ntz")
