"""Scalar functions that need no Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_pdf_date(c: Column) -> Column:
    """A PDF date string as timestamp: full form, without seconds, Z forms, date alone (UTC)."""
    s = F.translate(c, "D:'", "")
    forms = [F.try_to_timestamp(s, F.lit(p)) for p in ("yyyyMMddHHmmssxx", "yyyyMMddHHmmxx", "yyyyMMddHHmmssX", "yyyyMMddHHmmX")]
    # a date alone is midnight of UTC in any session's zone
    return F.coalesce(*forms, F.when(F.length(s) == 8, F.try_to_timestamp(F.concat(s, F.lit("+0000")), F.lit("yyyyMMddxx"))))


def write_pdf_date(ts: Column) -> Column:
    """UTC with Z, in any session's zone."""
    return F.concat(F.lit("D:"), F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyyMMddHHmmss"), F.lit("Z"))
