"""PDF dates as plain functions; the DataFrame form is in operators.scalars."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

FORM = re.compile(r"(\d{8})(?:(\d{4})(\d{2})?([+-]\d{4}|Z))?")


def normalised(raw: bytes | str) -> str:
    text = raw.decode() if isinstance(raw, bytes) else raw
    return text.translate({ord(c): None for c in "D:'"})


def parse_date(raw: bytes | str) -> datetime | None:
    """With the stated offset; a date alone, or Z, is UTC; None if no form fits."""
    m = FORM.fullmatch(normalised(raw))
    if not m:
        return None
    try:
        return datetime.strptime(m[1] + (m[2] or "0000") + (m[3] or "00") + (m[4] or "Z").replace("Z", "+0000"), "%Y%m%d%H%M%S%z")
    except ValueError:
        return None


def write_date(d: datetime) -> str:
    offset = d.utcoffset()
    if not offset:
        return d.strftime("D:%Y%m%d%H%M%SZ")
    sign, minutes = ("-", -offset // timedelta(minutes=1)) if offset < timedelta(0) else ("+", offset // timedelta(minutes=1))
    return d.strftime("D:%Y%m%d%H%M%S") + f"{sign}{minutes // 60:02d}'{minutes % 60:02d}'"
