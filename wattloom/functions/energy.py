"""Time buckets, household income and vehicle energy as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVAL_MINUTES = 15
UNITS = {"hourly": "hour", "daily": "day", "monthly": "month"}
_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}
_DEPTH = {"hourly": 4, "daily": 3, "monthly": 2}

# Income limits of the survey's household income buckets 1 to 11.
INCOME_LIMITS = (10_000, 15_000, 25_000, 35_000, 50_000, 75_000, 100_000, 125_000, 150_000, 200_000)
# kWh a mile by outdoor temperature in degrees F, constant term first, and the range it holds in.
KWH_PER_MILE = (0.3950, -0.0022, 9.1978e-5, -3.9249e-6, 5.2918e-8, -2.0659e-10)
TEMPERATURE_RANGE = (-15.0, 110.0)
BATTERY_KWH, BATTERY_SPARE = (12, 40, 60, 90, 120), 1.2


def interval_start(ts: Column, minutes: int = INTERVAL_MINUTES) -> Column:
    """A reading is stamped at the end of its interval; the start decides the bucket."""
    return ts - F.expr(f"interval {minutes} minutes")


def bucket(ts: Column, step: str, minutes: int = INTERVAL_MINUTES) -> Column:
    """Start of the hour, day or month of an interval-ending stamp, without time zone."""
    return F.date_trunc(UNITS[step], interval_start(ts, minutes)).cast("timestamp_ntz")


def bucket_text(ts: Column, step: str) -> Column:
    return F.date_format(interval_start(ts), {"monthly": "yyyy-MM", "daily": "yyyy-MM-dd", "hourly": "yyyy-MM-dd-HH"}[step])


def calendar_parts(ts: Column, step: str) -> dict[str, Column]:
    """year, month and, as fine as the step, day and hour."""
    return {name: f(ts) for name, f in list(_PARTS.items())[: _DEPTH[step]]}


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def days_between(start: Column, end: Column) -> Column:
    """Both ends count."""
    return F.datediff(end, start) + 1


def hour_of(hhmm: Column) -> Column:
    return F.floor(hhmm / 100).cast("int")


def within_day(hour: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(23), hour))


def at_most(c: Column, most: int) -> Column:
    """Caps a value; null stays null."""
    return F.when(c > most, F.lit(most)).otherwise(c)


def income_midpoint(text: Column) -> Column:
    """'60000-69999' to 64999, '200000' to itself; null stays null."""
    parts = F.split(text, "-")
    low, high = parts[0].cast("long"), F.get(parts, F.lit(1)).cast("long")
    return F.when(F.size(parts) > 1, F.floor((low + high) / 2)).otherwise(low).cast("long")


def clean_income(text: Column) -> Column:
    """Open brackets of the income labels: '<10000' to 0-10000, '200000+' to 200000; 'Not Available' to null."""
    return F.when(text == "<10000", "0-10000").when(text == "200000+", "200000").when(text == "Not Available", F.lit(None)).otherwise(text)


def income_bucket(income: Column) -> Column:
    out = F.when(income < INCOME_LIMITS[0], 1)
    for n, limit in enumerate(INCOME_LIMITS[1:], 2):
        out = out.when(income < limit, n)
    return out.when(income.isNotNull(), len(INCOME_LIMITS) + 1)


def occupants(text: Column) -> Column:
    return F.when(text == "10+", F.lit(10)).otherwise(text.cast("int"))


def miles_to_kwh(miles: Column, fahrenheit: Column) -> Column:
    t = F.greatest(F.lit(TEMPERATURE_RANGE[0]), F.least(F.lit(TEMPERATURE_RANGE[1]), fahrenheit))
    per_mile = F.lit(0.0)
    for a in reversed(KWH_PER_MILE):
        per_mile = per_mile * t + F.lit(a)
    return per_mile * miles


def battery_for(daily_kwh: Column, capacities: Sequence[int] = BATTERY_KWH) -> Column:
    """The first capacity that covers the day with spare, else the last."""
    table = F.array(*[F.lit(c) for c in capacities])
    fits = F.filter(table, lambda c: c >= daily_kwh * BATTERY_SPARE)
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(capacities[-1]))


def share_of_total(weight: Column, window) -> Column:
    return weight / F.sum(weight).over(window)


def whole_target(fraction: float, total: int) -> int:
    """Double arithmetic, truncated: 0.29 of 100 is 28, as decimal arithmetic would not say."""
    return int(float(fraction) * total)


def md5_uniform(*parts: Column) -> Column:
    """[0, 1) from the first 48 bits of the md5 of the parts, as text with colons between: alike in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def hash_uniform(*parts: Column) -> Column:
    return md5_uniform(*[p.cast("string") for p in parts])


#: Draws that one hash is good for, of 24 bits each.
DRAWS = 5


def draws_of(*parts: Column) -> Column:
    """The hash of the parts, as text with colons between, that ``draw`` takes its numbers from."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def draw(hash_: Column, number: int) -> Column:
    """[0, 1) from 24 bits of a hash; number: 0 to DRAWS - 1. Keep the hash in a column of its own, or it is made anew for each."""
    return F.conv(F.substring(hash_, 1 + 6 * number, 6), 16, 10).cast("double") / F.lit(float(1 << 24))


def normal(mean: Column, sigma: Column, u: Column, v: Column) -> Column:
    """A normal draw by Box and Muller from two uniform ones."""
    return mean + sigma * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def hour_offset(u: Column) -> Column:
    """-2 to 2 with chances .05, .10, .70, .10 and .05."""
    return F.when(u < 0.05, -2).when(u < 0.15, -1).when(u < 0.85, 0).when(u < 0.95, 1).otherwise(2)


def draw_key(weight: Column, u: Column) -> Column:
    """Rows in rising order of this key are drawn without replacement, each next with a chance in proportion to its weight among
    those left (exponential waiting times). Null, and so last, without a positive weight."""
    return F.when(weight > 0, -F.log(1 - u) / weight)
