"""Publication dates: source-formatted text to UTC time and to ISO text."""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweave.functions.text import let, or_blank

# ISO 8601 in extended form: date, then optionally any one separator and a time
# of one to three parts, then optionally an offset.
ISO = (
    r"(?s)^(\d{4}-\d{2}-\d{2})"
    r"(?:.(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?"
    r"(?: ?([+-])([01]\d|2[0-3])(?::?([0-5]\d)(?::?([0-5]\d))?)?)?)?$"
)
DATE, HOUR, MINUTE, SECOND, FRACTION, SIGN, OFF_HOUR, OFF_MINUTE, OFF_SECOND = range(9)
PARTS = 9
MARK = "\x01"

# 'Mon, 13 Jan 2025 12:00:00 GMT'; the weekday is optional.
RFC822 = (
    r"^(?:[A-Za-z]{3}, )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) "
    r"(\d{2}:\d{2}(?::\d{2})?) (GMT|UTC|UT|Z|[+-]\d{4})$"
)
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

# Stands for "no usable date": sorts after every real one when newest is first.
EARLIEST = "0001-01-01 00:00:00"


def _parts(text: Column) -> Column:
    """The parts of an ISO text, '' for those not given. One regex pass; any other
    text comes back as an array of another length."""
    unmarked = F.translate(text, MARK, "\x02")
    marked = F.regexp_replace(unmarked, ISO, MARK.join(f"${group + 1}" for group in range(PARTS)))
    return F.split(marked, MARK)


def _two(part: Column) -> Column:
    return F.lpad(part, 2, "0")


def _micros(parts: Column) -> Column:
    return F.rpad(parts[FRACTION], 6, "0")


def _wall_clock(parts: Column) -> Column:
    """Local time, null when the text was not ISO or names no real time."""
    moment = F.concat(
        parts[DATE], F.lit(" "), _two(parts[HOUR]), F.lit(":"), _two(parts[MINUTE]),
        F.lit(":"), _two(parts[SECOND]), F.lit("."), _micros(parts),
    ).try_cast("timestamp_ntz")
    return F.when((F.size(parts) == PARTS) & ~parts[DATE].startswith("0000"), moment)


def _utc(parts: Column) -> Column:
    seconds = (
        _two(parts[OFF_HOUR]).try_cast("int") * 3600
        + _two(parts[OFF_MINUTE]).try_cast("int") * 60
        + _two(parts[OFF_SECOND]).try_cast("int")
    )
    east = F.when(parts[SIGN] == "-", -seconds).otherwise(seconds)
    offset = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), east.cast("decimal(18,6)"))
    clock = _wall_clock(parts)
    return F.when(parts[SIGN] != "", clock - offset).otherwise(clock)


def iso_to_utc(text: Column) -> Column:
    """UTC time of an ISO text; text without an offset is taken as UTC."""
    return let(_parts(text), lambda parts: F.when(F.size(parts) == PARTS, _utc(parts)))


def _spell_out_zone(text: Column) -> Column:
    """Write a zone given as Z, GMT or UTC as a numeric offset."""
    named = text.contains("+") | text.endswith("GMT") | text.endswith("UTC")
    zoned = F.replace(
        F.replace(text, F.lit("GMT"), F.lit("+00:00")), F.lit("UTC"), F.lit("+00:00")
    )
    return (
        F.when(text.contains("Z"), F.replace(text, F.lit("Z"), F.lit("+00:00")))
        .when(named, zoned)
        .otherwise(text)
    )


def _rfc822_as_iso(text: Column) -> Column:
    month = F.array_position(
        F.array(*[F.lit(name) for name in MONTHS]), F.regexp_extract(text, RFC822, 2)
    )
    zone = F.regexp_extract(text, RFC822, 5)
    return F.when(
        text.rlike(RFC822) & (month > 0),
        F.concat(
            F.regexp_extract(text, RFC822, 3), F.lit("-"),
            F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
            F.lpad(F.regexp_extract(text, RFC822, 1), 2, "0"), F.lit("T"),
            F.regexp_extract(text, RFC822, 4),
            F.when(zone.rlike("^[+-]"), zone).otherwise("+00:00"),
        ),
    )


def published_time(published: Column, parse_rfc822: bool = False) -> Column:
    """UTC time of a publication text, null when it cannot be read.

    The usual feed form (``Mon, 13 Jan 2025 12:00:00 GMT``) counts as unreadable
    unless ``parse_rfc822`` is set.
    """
    text = _spell_out_zone(or_blank(published))
    if parse_rfc822:
        text = F.coalesce(_rfc822_as_iso(or_blank(published)), text)
    return iso_to_utc(text)


def newest_first_key(published_ts: Column) -> Column:
    """Sort key that puts rows without a date last under descending order."""
    return F.coalesce(published_ts, F.lit(EARLIEST).cast("timestamp_ntz"))


def _full_iso(parts: Column) -> Column:
    """An ISO text in its full form, its own offset kept."""
    micros = _micros(parts)
    off_second = _two(parts[OFF_SECOND])
    return F.concat(
        parts[DATE], F.lit("T"), _two(parts[HOUR]), F.lit(":"), _two(parts[MINUTE]),
        F.lit(":"), _two(parts[SECOND]),
        F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""),
        F.when(
            parts[SIGN] != "",
            F.concat(
                parts[SIGN], _two(parts[OFF_HOUR]), F.lit(":"), _two(parts[OFF_MINUTE]),
                F.when(off_second != "00", F.concat(F.lit(":"), off_second)).otherwise(""),
            ),
        ).otherwise(""),
    )


def normalize_published(published: Column, run_ts: datetime) -> Column:
    """Publication text of an API item in full ISO form.

    Text with no ``T`` stays as it is; blank or unreadable text becomes the
    time of the run.
    """
    text = or_blank(published)
    spelled = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    now = F.lit(run_ts.isoformat())
    return (
        F.when(text == "", now)
        .when(~text.contains("T"), text)
        .otherwise(
            let(
                _parts(spelled),
                lambda parts: F.when(
                    (F.size(parts) == PARTS) & _wall_clock(parts).isNotNull(), _full_iso(parts)
                ).otherwise(now),
            )
        )
    )


def iso_text(moment: Column) -> Column:
    """ISO text of a TIMESTAMP_NTZ, with microseconds only when it has any.

    Taken from its plain text: formatting functions would pass through the session
    time zone, where some wall-clock times do not exist.
    """
    plain = moment.cast("string")
    fraction = F.rpad(F.substring(plain, 21, 6), 6, "0")
    return F.concat(
        F.substring(plain, 1, 10),
        F.lit("T"),
        F.substring(plain, 12, 8),
        F.when(F.length(plain) > 19, F.concat(F.lit("."), fraction)).otherwise(""),
    )


def compact_date(moment: Column) -> Column:
    """The date of a TIMESTAMP_NTZ as ``yyyymmdd``."""
    return F.replace(F.substring(moment.cast("string"), 1, 10), F.lit("-"), F.lit(""))


def as_instant(moment: Column) -> Column:
    """A UTC wall-clock time as an instant (TIMESTAMP)."""
    return F.concat(moment.cast("string"), F.lit("+00:00")).cast("timestamp")


def utc_literal(moment: datetime) -> Column:
    """A UTC wall-clock moment as a TIMESTAMP_NTZ literal."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
