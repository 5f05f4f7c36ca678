"""Column expressions for parsing, casting and rounding."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried in order, and the texts that stand for a missing id.
DATE_FORMATS = ("%d/%m/%Y", "%Y-%m-%d", "%d-%m-%Y")
TIME_FORMATS = ("%H:%M:%S", "%H:%M", "%H:%M:%S.%f")
MISSING_TOKENS = ("", "nan", "null", "none")
TRUE_TOKENS = ("true", "1", "yes", "si", "sí")
LOCAL_ZONE = "America/Mexico_City"

_BLANKS = " \t\n\r\x0b\x0c"
# strftime directive → the digits it may have; times are range-checked here, dates by the calendar
_DIRECTIVES = {
    "%d": "[0-9]{1,2}",
    "%m": "[0-9]{1,2}",
    "%Y": "[0-9]{4}",
    "%H": "[01]?[0-9]|2[0-3]",
    "%M": "[0-5]?[0-9]",
    "%S": "[0-5]?[0-9]",
    "%f": "[0-9]{1,6}",
}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def format_shape(strftime_format: str) -> tuple[str, dict[str, int]]:
    """(regular expression of the texts a format reads, directive → group number)."""
    parts = re.split(r"(%[A-Za-z])", strftime_format)
    groups: dict[str, int] = {}
    shape = ""
    for part in parts:
        if part.startswith("%"):
            if part not in _DIRECTIVES or part in groups:
                raise ValueError(f"unsupported format {strftime_format!r}")
            groups[part] = len(groups) + 1
            shape += f"({_DIRECTIVES[part]})"
        else:
            shape += re.escape(part)
    return f"^{shape}$", groups


_ISO = ("%Y-%m-%d", "%H:%M:%S", "%H:%M:%S.%f", "%H:%M")


def _iso_text(text: Column, strftime_format: str, order: Sequence[tuple[str, str]]) -> Column:
    """The text in ISO order where it has the shape of the format, else NULL."""
    shape, groups = format_shape(strftime_format)
    separators = set(re.split(r"%[A-Za-z]", strftime_format)[1:-1])
    if strftime_format in _ISO:
        iso = text
    elif len(separators) == 1 and strftime_format[0] == "%" and strftime_format[-2] == "%":
        pieces = [(lead, F.split_part(text, F.lit(*separators), F.lit(groups[d])) if d in groups else F.lit("0")) for lead, d in order]
        iso = F.concat(*[c for lead, piece in pieces for c in (F.lit(lead), piece)])
    else:
        iso = F.regexp_replace(text, shape, "".join(lead + (f"${groups[d]}" if d in groups else "0") for lead, d in order))
    return F.when(text.rlike(shape), iso)


def parse_datetime(
    date: Column,
    time: Column,
    date_formats: Sequence[str] = DATE_FORMATS,
    time_formats: Sequence[str] = TIME_FORMATS,
) -> Column:
    """First formats that parse win; NULL where none does. Day and month are never swapped.

    Texts are put into ISO order and cast: a failed cast is a plain NULL, while a failed pattern parser
    raises and catches an exception per row and format.
    """
    day, clock = strip(date), strip(time)
    dates = [_iso_text(day, f, (("", "%Y"), ("-", "%m"), ("-", "%d"))).try_cast("date") for f in date_formats]
    clocks = [_iso_text(clock, f, (("", "%H"), (":", "%M"), (":", "%S"), (".", "%f"))) for f in time_formats]
    iso = F.concat(F.coalesce(*dates).cast("string"), F.lit(" "), F.coalesce(*clocks))
    return iso.try_cast("timestamp_ntz")


def clean_id(c: Column) -> Column:
    """Trimmed id, NULL for the missing markers; leading zeros are kept."""
    trimmed = strip(c.cast("string"))
    return F.when(~F.lower(trimmed).isin(*MISSING_TOKENS), trimmed)


def coerce_age(c: Column) -> Column:
    number = strip(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), F.bround(number, 0).try_cast("int"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a naive timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def duration_min(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(60e6)


def epoch_diff(ts: Column, target: Column) -> Column:
    return F.abs(micros(ts) - micros(target)) / F.lit(1e6)


def row_hash(columns: Iterable[Column], source_file: Column) -> Column:
    """Stable id of a raw row: the same on every run, unlike a salted in-process hash."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *parts, source_file), 256)


def as_int(c: Column) -> Column:
    text = strip(c.cast("string"))
    return F.coalesce(text.try_cast("bigint"), _whole(text))


def _whole(text: Column) -> Column:
    number = text.try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(9.0e18))
    return F.when(finite, F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("bigint"))


def as_float(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("double")


def as_bool(c: Column) -> Column:
    text = F.lower(strip(c.cast("string")))
    number = text.try_cast("double")
    return F.when(c.isNotNull(), text.isin(*TRUE_TOKENS) | F.coalesce(number != 0, F.lit(False)))


def as_str(c: Column) -> Column:
    return c.cast("string")


def null_negatives(c: Column) -> Column:
    return F.when(c >= 0, c)


def capture_id(station_id: Column, last_reported: Column) -> Column:
    return F.concat(station_id, F.lit("|"), last_reported.cast("string"))


def clip(c: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """NULL stays NULL (greatest/least alone would skip it)."""
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, low)
    if high is not None:
        bounded = F.least(bounded, high)
    return F.when(c.isNotNull(), bounded)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def null_default(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def pct(part: Column, total: Column, digits: int | None = None) -> Column:
    """Percentage, 0 where the total is 0 or NULL."""
    value = F.when(total > 0, F.lit(100.0) * part / total).otherwise(F.lit(0.0))
    return value if digits is None else F.bround(value, digits)


def hour_ts(date: Column, hour: Column) -> Column:
    return F.make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), hour, F.lit(0), F.lit(0))


def trunc_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def utc_to_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def epoch_to_utc(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with offset; the fraction appears only when it is not zero."""
    instant = ts.cast("timestamp")
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(instant, ".SSSSSS")
    return F.concat(whole, F.when(fraction != ".000000", fraction).otherwise(F.lit("")), F.lit("+00:00"))
