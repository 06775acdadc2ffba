"""Calendar expressions: weekday distances, default event sets, phases of a date in its event cycles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The channels, their cycles and half-lives in trading days, and the weights of the volatility prior.
CHANNELS = ["earnings", "fed", "options_expiry", "rebalance", "holiday"]
PERIODS = [63.0, 31.5, 21.0, 63.0, 252.0]
HALFLIVES = [5.0, 2.0, 3.0, 3.0, 2.0]
PRIOR_WEIGHTS = [0.6, 0.8, 0.3, 0.2, 0.1]
EARNINGS_MONTHS = [1, 4, 7, 10]
FED_MONTHS = [1, 3, 5, 6, 7, 9, 11, 12]
REBALANCE_MONTHS = [3, 6, 9, 12]
HOLIDAYS = [(1, 1), (1, 20), (2, 17), (5, 26), (7, 4), (9, 1), (11, 27), (12, 25)]
ACTIVE = 0.3


def third_friday(year: Column, month: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, month, F.lit(1)), 1), "FRI"), 14)


def weekday_ordinal(d: Column) -> Column:
    """Weekdays up to and including a date, counted from Monday 1970-01-05."""
    n = F.datediff(d, F.to_date(F.lit("1970-01-05")))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))


def trading_days(a: Column, b: Column) -> Column:
    """Weekdays in (a, b], negative if b is before a."""
    return weekday_ordinal(b) - weekday_ordinal(a)


def default_events(d: Column, channel: str, earnings_from_2020: bool = False) -> Column:
    """The usual events of a channel in the years around a date, in the order in which ties are decided.
    earnings_from_2020: take last year's earnings in only from 2021 on."""
    year, around = F.year(d), (-1, 0, 1)
    if channel == "earnings":
        dates = [F.make_date(year + y, F.lit(m), F.lit(15)) for m in EARNINGS_MONTHS for y in (0, -1, 1)]
        if earnings_from_2020:
            dates = [F.when(year > 2020, x) if i % 3 == 1 else x for i, x in enumerate(dates)]
        return F.filter(F.array(*dates), lambda x: x.isNotNull())
    if channel == "fed":
        return F.array(*[F.make_date(year + y, F.lit(m), F.lit(15)) for y in around for m in FED_MONTHS])
    if channel == "holiday":
        return F.array(*[F.make_date(year + y, F.lit(m), F.lit(k)) for y in around for m, k in HOLIDAYS])
    months = REBALANCE_MONTHS if channel == "rebalance" else range(1, 13)
    return F.array(*[third_friday(year + y, F.lit(m)) for y in around for m in months])


def nearest_distance(d: Column, events: Column) -> Column:
    """Signed trading days to the nearest of an array of dates; of equally near ones the first in the array."""
    from_d = weekday_ordinal(d)
    steps = F.transform(events, lambda x, i: F.struct(F.abs(weekday_ordinal(x) - from_d).alias("far"), i.alias("ord"), (weekday_ordinal(x) - from_d).alias("dist")))
    return F.array_min(steps)["dist"]


def theta(distance: Column, period: float) -> Column:
    return F.coalesce(F.pmod(distance * (2.0 * math.pi) / period, F.lit(2.0 * math.pi)), F.lit(math.pi))


def amplitude(distance: Column, halflife: float) -> Column:
    return F.coalesce(F.exp(-F.abs(distance) / halflife), F.lit(0.0))


def synthetic_phase(d: Column, period: float) -> Column:
    """Phase of an even cycle from 2020-01-01 on."""
    return F.pmod(F.datediff(d, F.to_date(F.lit("2020-01-01"))) * 5.0 / 7.0, F.lit(period)) / period * (2.0 * math.pi)


def synthetic_amplitude(phase: Column) -> Column:
    return F.exp(-F.abs(F.cos(phase / 2.0) - 1.0) / 0.5)


def active_events(amplitudes: Column) -> Column:
    names = F.array(*[F.lit(c) for c in CHANNELS])
    return F.filter(F.transform(amplitudes, lambda a, i: F.when(a > ACTIVE, F.element_at(names, i + 1))), lambda x: x.isNotNull())


def regime_prior(amplitudes: Column) -> Column:
    return F.zip_with(amplitudes, F.array(*[F.lit(w) for w in PRIOR_WEIGHTS]), lambda a, w: a * w)


def phase_view(amplitudes: Column, active: Column) -> dict[str, Column]:
    """What is shown of a phase: the dominant cycle, whether the two largest amplitudes are near, a volatility
    multiplier and a label."""
    names, ranked = F.array(*[F.lit(c) for c in CHANNELS]), F.sort_array(amplitudes, asc=False)
    dominant = F.element_at(names, F.array_position(amplitudes, ranked[0]).cast("int"))
    return {
        "dominant_cycle": dominant,
        "resonance_detected": (ranked[1] > 0.05) & (ranked[0] / (ranked[1] + 1e-12) <= 2.5),
        "vol_multiplier": F.round(1.0 + ranked[0] * 0.20, 3),
        "regime_label": F.upper(F.when(F.size(active) > 0, F.array_join(F.slice(active, 1, 2), "+")).otherwise(dominant)),
    }
