"""Calendar functions.  Instants are UTC ``TIMESTAMP_NTZ``; local time is a fixed offset without DST.
``now`` is always a parameter."""

from datetime import datetime

from pyspark.sql import Column, functions as F

from . import rules as R
from .patterns import group, let, spell

_OFFSET = f"INTERVAL '{R.LOCAL_OFFSET_HOURS}' HOUR"


def ts_lit(value) -> Column:
    """Literal UTC instant from a ``datetime`` or an ISO string."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def hours(n: float) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' HOUR")


def to_local(ts: Column) -> Column:
    return ts + F.expr(_OFFSET)


def to_utc(ts: Column) -> Column:
    return ts - F.expr(_OFFSET)


def local_day_key(ts: Column) -> Column:
    return F.date_format(to_local(ts), "yyyy-MM-dd")


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def start_of_local_day(ts: Column) -> Column:
    return to_utc(_ntz(F.to_date(to_local(ts))))


def end_of_local_day(ts: Column) -> Column:
    return start_of_local_day(ts) + F.expr("INTERVAL '86399' SECOND")


def end_of_day_from_date(day: Column) -> Column:
    return to_utc(_ntz(day)) + F.expr("INTERVAL '86399' SECOND")


def micros_between(a: Column, b: Column) -> Column:
    """Microseconds from ``a`` to ``b``."""
    return F.timestamp_diff("MICROSECOND", a, b)


def hours_until(target: Column, now: Column) -> Column:
    return micros_between(now, target) / F.lit(3.6e9)


def add_hours(ts: Column, n: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n * F.lit(3600.0))


def add_days(ts: Column, n: Column) -> Column:
    return add_hours(ts, n * F.lit(24.0))


def time_left_label(deadline: Column, now: Column) -> Column:
    h = hours_until(deadline, now)
    whole = F.floor(h).cast("string")
    return (F.when(deadline.isNull(), F.lit("No deadline stated"))
            .when(h <= 0, F.lit("Expired"))
            .when(h < 1, F.lit("Less than 1 hour left"))
            .when(h < 48, F.concat(whole, F.when(F.floor(h) == 1, F.lit(" hour left")).otherwise(F.lit(" hours left"))))
            .otherwise(F.concat(F.floor(h / 24).cast("string"), F.lit(" days left"))))


def format_local_date(ts: Column) -> Column:
    text = F.replace(F.date_format(to_local(ts), "dd MMM yyyy"), F.lit("Sep"), F.lit("Sept"))
    return F.coalesce(text, F.lit("Not specified"))


def format_local_datetime(ts: Column) -> Column:
    day = F.replace(F.date_format(to_local(ts), "dd MMM yyyy"), F.lit("Sep"), F.lit("Sept"))
    clock = F.lower(F.date_format(to_local(ts), "hh:mm a"))
    return F.coalesce(F.concat(day, F.lit(", "), clock, F.lit(" BST")), F.lit("Not specified"))


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in R.MONTHS.items() for x in pair])
    return F.try_element_at(table, F.coalesce(name, F.lit("")))


_YMD, _DMY = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b"
_D_MON, _MON_D = r"\b(\d{1,2}) ([a-z]{3,9}) (\d{4})\b", r"\b([a-z]{3,9}) (\d{1,2}) (\d{4})\b"
_ISO = r"^(\d{4}-\d{2}-\d{2})t(\d{2}:\d{2})(:\d{2})?(\.\d{1,6})?\d*(z|[+-]\d{2}:?\d{2})?$"


def _date_parts(text: Column) -> Column:
    """First of year-month-day, day/month/year, day month-name year, month-name day year."""
    def i(pattern, n):
        return group(text, pattern, n).cast("int")

    def parts(y, m, d, ok):
        return F.when((y > 0) & ok, F.struct(y.alias("y"), m.alias("m"), d.alias("d")))

    yes = F.lit(True)
    m3, m1 = _month(group(text, _D_MON, 2)), _month(group(text, _MON_D, 1))
    return F.coalesce(
        parts(i(_YMD, 1), i(_YMD, 2), i(_YMD, 3), yes), parts(i(_DMY, 3), i(_DMY, 2), i(_DMY, 1), yes),
        parts(i(_D_MON, 3), m3, i(_D_MON, 1), m3.isNotNull()), parts(i(_MON_D, 3), m1, i(_MON_D, 2), m1.isNotNull()))


def _end_of_parts(p: Column) -> Column:
    day = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"]), F.lit("yyyy-MM-dd"))
    return F.when(p["y"].between(2000, 2100) & (p["m"] <= 12) & (p["d"] <= 31), end_of_day_from_date(day.cast("date")))


def _exact_instant(text: Column) -> Column:
    stamp = F.concat(group(text, _ISO, 1), F.lit(" "), group(text, _ISO, 2), F.coalesce(group(text, _ISO, 3), F.lit(":00")),
                     F.coalesce(group(text, _ISO, 4), F.lit("")))
    zone = F.coalesce(group(text, _ISO, 5), F.lit("z"))
    digits = F.replace(F.substring(zone, 2, 6), F.lit(":"), F.lit(""))
    minutes = F.when(zone == "z", F.lit(0)).otherwise(
        F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
        * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    return stamp.try_cast("timestamp_ntz") - F.expr("INTERVAL '1' MINUTE") * minutes


def _plain(c: Column) -> Column:
    text = F.lower(F.regexp_replace(c, spell(r"^\s+|\s+$"), ""))
    text = F.regexp_replace(text, spell(r"(\d+)(st|nd|rd|th)\b"), "$1")
    text = F.regexp_replace(F.replace(text, F.lit(","), F.lit(" ")), spell(r"\s+"), " ")
    return F.regexp_replace(text, spell(r"\b(\d{1,2})[-./]([a-z]{3,9})[-./](\d{4})\b"), "$1 $2 $3")


def parse_local_date(c: Column) -> Column:
    """End of the stated local day in UTC; an ISO date-time is taken as it stands; null when unclear."""
    return let(_plain(c), lambda text: F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}t\d{2}:\d{2}"), _exact_instant(text))
               .otherwise(let(_date_parts(text), _end_of_parts)))
