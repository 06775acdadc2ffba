"""Calendar operators: phases of dates, interval anchors, date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import calendar as cal
from tidegauge.operators.nearest import beside


def nearest_event_phase(dates: DataFrame, events: DataFrame, channel: str, date_col: str = "d") -> DataFrame:
    """Adds theta and amplitude of the nearest event before or after each date, in weekdays. events: (kind, d, ord), any
    number of them; of equally near events the one with the smallest ord. Without events theta is pi and amplitude 0."""
    i = cal.CHANNELS.index(channel)
    own = events.where((F.col("kind") == channel) & F.col("d").isNotNull()).groupBy(cal.weekday_ordinal(F.col("d")).cast("long").alias("_day")).agg(F.min("ord").alias("ord"))
    listed = own.select("_day", F.struct(F.col("_day").alias("day"), F.col("ord").alias("ord")).alias("entry"))
    met = beside(dates.withColumn("_day", cal.weekday_ordinal(F.col(date_col)).cast("long")), listed, [], "_day")
    sides = F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(f"{s}.day") - F.col("_day")).alias("far"), F.col(f"{s}.ord").alias("ord"), (F.col(f"{s}.day") - F.col("_day")).alias("dist"))) for s in ("before", "after")])
    met = met.withColumn("_distance", F.array_min(F.array_compact(sides))["dist"]).drop("_day", "before", "after")
    return met.withColumn("theta", cal.theta(F.col("_distance"), cal.PERIODS[i])).withColumn("amplitude", cal.amplitude(F.col("_distance"), cal.HALFLIVES[i])).drop("_distance")


def phases(dates: DataFrame, date_col: str = "d", earnings_from_2020: bool = False) -> DataFrame:
    """Adds `theta` and `amplitudes` (arrays by channel) from the default events around each date; no join."""
    far = [cal.nearest_distance(F.col(date_col), cal.default_events(F.col(date_col), c, earnings_from_2020)) for c in cal.CHANNELS]
    return dates.withColumn("theta", F.array(*[cal.theta(x, p) for x, p in zip(far, cal.PERIODS, strict=True)])).withColumn("amplitudes", F.array(*[cal.amplitude(x, h) for x, h in zip(far, cal.HALFLIVES, strict=True)]))


def pack(df: DataFrame) -> DataFrame:
    """Adds active_events and regime_prior to rows with theta and amplitudes."""
    active = F.coalesce(F.col("active_events"), cal.active_events(F.col("amplitudes"))) if "active_events" in df.columns else cal.active_events(F.col("amplitudes"))
    return df.withColumn("active_events", active).withColumn("regime_prior", cal.regime_prior(F.col("amplitudes")))


def apply_anchors(phased: DataFrame, anchors: DataFrame, date_col: str = "d") -> DataFrame:
    """Dates within an anchor's interval take its phases and severity; the first anchor in order counts. anchors: (ord,
    name, start_date, end_date, anchor, severity); each is a row for every day, so that days meet by equality."""
    days = anchors.where("start_date <= end_date").withColumn(date_col, F.explode(F.sequence("start_date", "end_date")))
    first = days.groupBy(date_col).agg(F.min_by(F.struct("name", "anchor", "severity"), "ord").alias("_a"))
    joined = phased.join(first, date_col, "left")
    return (
        joined.withColumn("theta", F.coalesce("_a.anchor", "theta")).withColumn("amplitudes", F.coalesce(F.when(F.col("_a").isNotNull(), F.array_repeat(F.col("_a.severity"), len(cal.CHANNELS))), F.col("amplitudes")))
        .withColumn("active_events", F.when(F.col("_a").isNotNull(), F.array(F.concat(F.lit("historical:"), "_a.name")))).drop("_a")
    )


def date_range(spans: DataFrame, start_col: str, end_col: str, weekdays: bool = True, most_days: int | None = None) -> DataFrame:
    """A row for every (week)day between two dates, both included."""
    days = spans if most_days is None else spans.where(F.datediff(end_col, start_col) < most_days)
    days = days.where(F.col(start_col) <= F.col(end_col)).withColumn("d", F.explode(F.sequence(start_col, end_col)))
    return days.where(F.weekday("d") < 5) if weekdays else days


def momentum(df: DataFrame, key: list[str], order: str | Column, value: str) -> DataFrame:
    """Adds the change of a value over the row before, as a share of it; null for a key's first row and after a zero."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("momentum", F.when(before != 0, (F.col(value) - before) / before))
