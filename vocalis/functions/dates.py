"""Date parsing, formatting and the time-range filter (FN-3, FN-4, FLT-2).

The shape of a string (a regular expression) picks the one format it is parsed
with, so no attempt fails by an exception.  The clock is never read:
the reference date ``as_of`` is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# The accepted date forms (Java patterns) and the shape of text
# each applies to.  The shapes exclude one another, so a string is parsed
# once: ISO with fraction, ISO, datetime, date, "Jan 01, 2025", "01 Jan 2025",
# "January 01, 2025"; then, beyond the original list, the Graph-style "+0000"
# offset, normalised to UTC instead of being kept unparsed.
_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
_TIME = r"\d{1,2}:\d{1,2}:\d{1,2}"
DATE_FORMATS = (
    ("yyyy-M-d'T'H:m:s.SSSSSS'Z'", rf"^{_DAY}T{_TIME}\.\d{{1,6}}Z$"),
    ("yyyy-M-d'T'H:m:s'Z'", rf"^{_DAY}T{_TIME}Z$"),
    ("yyyy-M-d H:m:s", rf"^{_DAY} {_TIME}$"),
    ("yyyy-M-d", rf"^{_DAY}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{4,} \d{1,2}, \d{4}$"),
    ("yyyy-M-d'T'H:m:sZ", rf"^{_DAY}T{_TIME}[+-]\d{{4}}$"),
)
# forum form "1:01pmOnFeb 12" (year taken from the reference date)
FORUM_RE = r"(?i)^(\d{1,2}:\d{2}(?:am|pm))On(\w{3} \d{1,2})"


def epoch_to_ntz(seconds) -> Column:
    """UTC wall-clock ``timestamp_ntz`` of epoch seconds, whatever the
    session time zone."""
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), col_(seconds).cast("decimal(18,6)")))


def hours(n) -> Column:
    """A day-time interval of ``n`` hours, for any long ``n`` of up to 10^11."""
    h = col_(n).cast("long")
    return F.make_dt_interval(F.floor(h / 24).cast("int"), (h % 24).cast("int"), F.lit(0), F.lit(0))


def _to_utc_ntz(ltz: Column) -> Column:
    """An instant (``timestamp``) as UTC wall-clock ``timestamp_ntz``."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ltz.cast("timestamp_ntz"))


def parse_date(c, as_of: str = "2024-02-12") -> Column:
    """Parse a raw date string to ``timestamp_ntz``; unparsable -> null."""
    s = F.trim(col_(c))
    year = F.lit(as_of[:4])
    is_forum = s.rlike(FORUM_RE)
    raw = F.when(is_forum, F.concat_ws(" ", F.regexp_extract(s, FORUM_RE, 2), year,
                                       F.upper(F.regexp_extract(s, FORUM_RE, 1)))).otherwise(s)
    fmt = F.when(is_forum, "MMM d yyyy h:mma")
    for f, shape in DATE_FORMATS:
        fmt = fmt.when(s.rlike(shape), f)
    # wall-clock forms are parsed and cast in the same (session) zone, so the
    # wall clock is kept; the offset form is an instant, put in UTC
    t = F.try_to_timestamp(raw, fmt)
    return F.when(s.rlike(r"[+-]\d{4}$") & s.contains("T"), _to_utc_ntz(t)).otherwise(t.cast("timestamp_ntz"))


def format_date(ts, raw) -> Column:
    """``%Y-%m-%d %H:%M:%S`` of the parsed value, else the raw string."""
    return F.coalesce(F.date_format(col_(ts), "yyyy-MM-dd HH:mm:ss"), col_(raw))


def within_range(ts, as_of: str, months: int) -> Column:
    """``ts >= as_of - 30*months days``; an unknown date passes."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(30 * months))
    t = col_(ts)
    return t.isNull() | (t >= start)
