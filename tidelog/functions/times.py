"""Date and time expressions; all work on TIMESTAMP and TIMESTAMP_NTZ alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import _c

# Month abbreviations in calendar order.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Japanese half-day marks and their English forms.
HALF_DAY_MARKS = {"午前": "AM", "午後": "PM"}
# Month first, year of 2 or 4 digits, clock of 12 or 24 hours, half-day mark on either side.
_MONTH_FIRST = r"^\s*\d{1,2}[/-]\d{1,2}[/-](\d{2}|\d{4})\s+((AM|PM)\s*)?\d{1,2}:\d{2}(:\d{2})?(\s*(AM|PM))?\s*$"


def stamp(date_text, time_text, layout: str = "yyyy/MM/dd HH:mm:ss") -> Column:
    """Timestamp (no zone) from separate date and time texts; NULL when unreadable."""
    joined = F.concat_ws(" ", _c(date_text), _c(time_text))
    return F.try_to_timestamp(joined, F.lit(layout)).cast("timestamp_ntz")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_month_first(text) -> Column:
    """Timestamp of a month-first text in any of its usual layouts; NULL when unreadable.

    The digits are cut out and put together, so no layout has to be tried and failed.
    """
    clean = F.upper(_c(text))
    for mark, english in HALF_DAY_MARKS.items():
        clean = F.replace(clean, F.lit(mark), F.lit(english))

    def number(parts: Column, i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("int")

    def build(t: Column) -> Column:
        evening = F.contains(t, F.lit("PM"))
        marked = evening | F.contains(t, F.lit("AM"))

        def assemble(parts: Column) -> Column:
            hour, year = number(parts, 3), number(parts, 2)
            return F.try_make_timestamp_ntz(
                F.when(F.length(F.get(parts, F.lit(2))) == 2, year + 2000).otherwise(year),
                number(parts, 0), number(parts, 1),
                F.when(marked, hour % 12 + F.when(evening, 12).otherwise(0)).otherwise(hour),
                number(parts, 4), F.coalesce(number(parts, 5), F.lit(0)).cast("decimal(16,6)"),
            )

        digits = F.split(F.trim(F.regexp_replace(t, "[^0-9]+", " ")), " ")
        return F.when(t.rlike(_MONTH_FIRST), _let(digits, assemble))

    return _let(clean, build)


def _seconds(ts: Column) -> Column:
    return F.extract(F.lit("SECOND"), ts).cast("decimal(18,6)")


def floor_minutes(ts, minutes: int = 1) -> Column:
    """Start of the ``minutes``-long slot of the hour that holds ``ts``."""
    if 60 % minutes:
        raise ValueError("minutes must divide 60")
    ts = _c(ts)
    zero = F.lit(0)
    return ts - F.make_dt_interval(zero, zero, F.minute(ts) % minutes, _seconds(ts))


def round_minutes(ts, minutes: int = 10) -> Column:
    """Nearest slot boundary; a tie goes up."""
    half = F.expr(f"INTERVAL '{minutes * 30}' SECOND")
    return floor_minutes(_c(ts) + half, minutes)


def floor_month(ts) -> Column:
    return F.trunc(F.to_date(_c(ts)), "month")


def decimal_hour(ts) -> Column:
    ts = _c(ts)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def shift_days(ts, days: int) -> Column:
    return _c(ts) + F.expr(f"INTERVAL '{days}' DAY")


def length_days(start, end) -> Column:
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))


def month_name(month) -> Column:
    """Abbreviation of a month number, the same in every locale."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), _c(month).cast("int"))


def month_suffix(month, suffix: str = "月") -> Column:
    return F.concat(_c(month).cast("string"), F.lit(suffix))


def season_rank(month, first: int = 7) -> Column:
    """0 for ``first`` month, 11 for the month before it."""
    return F.pmod(_c(month) - F.lit(first), F.lit(12))
