"""Date functions (S1-S4). All of them mean UTC, whatever the session zone is."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaksieve.errors import InvalidDate

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}", re.ASCII)
# Fixed value: the shape of an RFC 3339 instant.
RFC3339 = r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})"
_RFC3339 = re.compile(RFC3339, re.ASCII)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid_date(text: Column | str) -> Column:
    """The text is a real date written as zero-padded YYYY-MM-DD."""
    c = _col(text)
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "yyyy-MM-dd") == c, F.lit(False))


def is_rfc3339(text: Column | str) -> Column:
    """S3: the text is an RFC 3339 instant."""
    c = _col(text)
    return F.coalesce(F.rlike(c, F.lit(rf"\A{RFC3339}\z")) & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def day_bound(text: Column | str, kind: str) -> Column:
    """First (``kind="start"``) or last (anything else) second of a day, as
    UTC wall-clock TIMESTAMP_NTZ; NULL for text that is no date."""
    day = F.try_to_date(_col(text), "yyyy-MM-dd").cast("timestamp_ntz")
    return day if kind == "start" else day + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def parse_bound(text: str, kind: str) -> dt.datetime:
    """The same for a scan argument, on the driver; also takes RFC 3339."""
    try:
        if _DAY.fullmatch(text):
            day = dt.datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=dt.timezone.utc)
            return day if kind == "start" else day + dt.timedelta(hours=23, minutes=59, seconds=59)
        if _RFC3339.fullmatch(text):
            return dt.datetime.fromisoformat(text.upper())
    except ValueError:
        pass
    raise InvalidDate(text)


def time_range(since: str, until: str) -> tuple[dt.datetime, dt.datetime]:
    """Both bounds as days or both as instants; a mixture is refused."""
    if bool(_DAY.fullmatch(since)) != bool(_DAY.fullmatch(until)):
        raise InvalidDate(f"{since} .. {until}")
    return parse_bound(since, "start"), parse_bound(until, "end")


def commit_date_text(
    ts: Column | str, offset_minutes: Column | str, fix_offset: bool = False
) -> Column:
    """``YYYY-MM-DD HH:MM:SS +/-HH:MM``.

    Reports print the author's offset with the sign turned round (the instant is
    right). That is the default here too; ``fix_offset=True`` prints it straight.
    """
    shift = _col(offset_minutes) if fix_offset else -_col(offset_minutes)
    utc = F.to_utc_timestamp(_col(ts), F.current_timezone())
    local = F.timestamp_add("MINUTE", shift, utc)
    sign = F.when(shift < 0, "-").otherwise("+")
    hours = F.lpad((F.abs(shift) / 60).cast("int").cast("string"), 2, "0")
    minutes = F.lpad((F.abs(shift) % 60).cast("string"), 2, "0")
    return F.concat(
        F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), sign, hours, F.lit(":"), minutes
    )
