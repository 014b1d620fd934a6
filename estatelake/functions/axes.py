"""Axes of charts as expressions: where the ticks of a span of time or of values stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a time axis from fine to coarse, and a unit's seconds (a month's and a year's on average).
TIME_STEPS = (
    *(("minute", n) for n in (1, 2, 5, 10, 15, 30)),
    *(("hour", n) for n in (1, 2, 3, 6, 12)),
    *(("day", n) for n in (1, 2, 3, 7, 14)),
    *(("month", n) for n in (1, 3, 6)),
    *(("year", n) for n in (1, 2, 5, 10, 25, 50, 100)),
)
SECONDS = {"minute": 60, "hour": 3_600, "day": 86_400, "month": 2_629_746, "year": 31_556_952}
#: An axis has no more ticks than this.
MOST = 400


def _seconds(t: Column) -> Column:
    return F.unix_timestamp(t.cast("timestamp"))


def time_axis(start: Column, end: Column, target: int = 6) -> Column:
    """struct(unit, step, ticks) of a span of civil times (timestamp_ntz): the finest step that gives about ``target`` ticks or
    fewer. Ticks stand on round times: weeks on Mondays, months and years on the first; steps of one to three days begin at
    the start's midnight. A span without any such time has its ends as ticks; null for a null end or an end before the start."""
    start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    wanted = F.greatest(_seconds(end) - _seconds(start), F.lit(0)) / target
    pick = lambda f: _first([(wanted <= SECONDS[u] * n, f(u, n)) for u, n in TIME_STEPS], f(*TIME_STEPS[-1]))
    unit, step = pick(lambda u, n: F.lit(u)), pick(lambda u, n: F.lit(n))
    months = F.when(unit == "year", step * 12).otherwise(step)
    minutes = F.when(unit == "day", step * 1440).when(unit == "hour", step * 60).otherwise(step)
    # calendar steps count months of the era, clock steps minutes of the day
    era = F.year(start) * 12 + F.month(start) - 1
    first_month = F.make_date(F.floor((era - era % months) / 12).cast("int"), ((era - era % months) % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    day = F.date_trunc("day", start).cast("timestamp_ntz")
    of_day = F.hour(start) * 60 + F.minute(start)
    first_clock = F.when(unit == "day", F.when(step % 7 == 0, F.date_trunc("week", start).cast("timestamp_ntz")).otherwise(day)).otherwise(day + F.make_dt_interval(mins=(of_day - of_day % minutes).cast("int")))
    by_month = F.when(first_month <= end, F.sequence(first_month, F.greatest(first_month, end), F.make_ym_interval(months=F.greatest(months, F.lit(1)).cast("int"))))
    by_clock = F.when(first_clock <= end, F.sequence(first_clock, F.greatest(first_clock, end), F.make_dt_interval(mins=minutes.cast("int"))))
    stood = F.slice(F.filter(F.when(unit.isin("month", "year"), by_month).otherwise(by_clock), lambda t: t >= start), 1, MOST)
    ticks = F.when(F.size(stood) > 0, stood).otherwise(F.array_distinct(F.array(start, end)))
    return F.when(end >= start, F.struct(unit.alias("unit"), step.alias("step"), ticks.alias("ticks")))


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    return out.otherwise(otherwise)


def value_axis(low: Column, high: Column, target: int = 5, zero_based: bool = False, whole: bool = False) -> Column:
    """struct(step, low, high, ticks): steps of 1, 2 or 5 times a power of ten, of which about ``target`` cover the values, and the
    multiples of it around them. ``zero_based`` takes zero in; ``whole`` has no steps below one. Equal ends get a band of a
    tenth of the value (or one) around them; null ends read as zero."""
    a, b = F.coalesce(low.cast("double"), F.lit(0.0)), F.coalesce(high.cast("double"), F.lit(0.0))
    lo, hi = F.least(a, b), F.greatest(a, b)
    lo = F.least(F.lit(0.0), lo) if zero_based else lo
    pad = F.lit(1.0) if whole else F.coalesce(F.nullif(F.abs(hi) * 0.1, F.lit(0.0)), F.lit(1.0))
    flat = lo == hi
    top, bottom = F.when(flat, hi + pad).otherwise(hi), lo if zero_based else F.when(flat, lo - pad).otherwise(lo)
    raw = (top - bottom) / target
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.when(raw / power <= 1, power).when(raw / power <= 2, 2 * power).when(raw / power <= 5, 5 * power).otherwise(10 * power)
    step = F.greatest(F.lit(1.0), F.round(step)) if whole else step
    first, last = F.floor(bottom / step), F.ceil(top / step)
    ticks = F.transform(F.sequence(first, last), lambda i: F.round(i * step, 9))
    return F.struct(step.alias("step"), F.round(first * step, 9).alias("low"), F.round(last * step, 9).alias("high"), ticks.alias("ticks"))
