"""Seasonal demand profiles and weather summaries (exploratory reports).

Each report is one or two hash aggregates over the hourly rentals; the
per-station ratios divide a SUM by a COUNT(DISTINCT station), a two-phase
distinct aggregate. The holiday report and the reports by several periods keep
the stations as bitmaps (``station_bitmaps``), which merge by bitwise or: no
Expand, and the rentals are read once for months and years. ``orderBy`` is only applied at the outermost
level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.functions.time import day_of_week, hour_bucket


def _per_station(rentals: DataFrame, keys: list, order: list[str]) -> DataFrame:
    g = rentals.groupBy(*keys).agg(
        F.sum("rentals").alias("__rentals"),
        F.countDistinct("station_id").alias("__stations"))
    cols = [c for c in g.columns if not c.startswith("__")]
    return g.select(*cols, (F.col("__rentals") / F.col("__stations")).alias("per_station_rentals")).orderBy(*order)


def rentals_by_year(rentals: DataFrame) -> DataFrame:
    return (rentals.groupBy(F.year("hour").alias("year"))
            .agg(F.sum("rentals").alias("rentals")).orderBy("year"))


def stations_by_year(rentals: DataFrame) -> DataFrame:
    return (rentals.groupBy(F.year("hour").alias("year"))
            .agg(F.countDistinct("station_id").alias("active_stations")).orderBy("year"))


def per_station_by_year(rentals: DataFrame, first_year: int = 2014, last_year: int = 2019) -> DataFrame:
    r = rentals.filter(F.year("hour").between(first_year, last_year))
    return _per_station(r, [F.year("hour").alias("year")], ["year"])


def per_station_by_month(rentals: DataFrame) -> DataFrame:
    return _per_station(rentals, [F.month("hour").alias("month")], ["month"])


def per_station_by_year_month(rentals: DataFrame) -> DataFrame:
    return _per_station(rentals, [F.trunc("hour", "MM").alias("month")], ["month"])


def per_station_by_dow(rentals: DataFrame, first_year: int = 2014, last_year: int = 2020) -> DataFrame:
    r = rentals.filter(F.year("hour").between(first_year, last_year))
    return _per_station(r, [day_of_week("hour").alias("day_of_week")], ["day_of_week"])


def per_station_by_dow_hour(rentals: DataFrame) -> DataFrame:
    return _per_station(rentals, [day_of_week("hour").alias("day_of_week"),
                                  F.hour("hour").alias("hour_of_day")],
                        ["day_of_week", "hour_of_day"])


def station_bitmaps(df: DataFrame, keys: list, station_col: str = "station_id", *sums) -> DataFrame:
    """The distinct stations of every key as bitmaps of 32,768 ids each: ``(*keys, bucket, stations, *sums)``.

    Exact and mergeable: bitmaps of one bucket combine by ``bitmap_or_agg``
    into those of a coarser key. Tasks build them before the shuffle. Rows
    without a station count in the sums alone.
    """
    bucket = F.bitmap_bucket_number(F.col(station_col).cast("long")).alias("bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(station_col).cast("long"))).alias("stations")
    return df.groupBy(*keys, bucket).agg(bits, *sums)


def merge_bitmaps(bitmaps: DataFrame, keys: list, *sums) -> DataFrame:
    """Bitmaps of coarser keys: ``(*keys, bucket, stations, *sums)``."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("stations").alias("stations"), *sums)


def count_stations(bitmaps: DataFrame, keys: list, *sums) -> DataFrame:
    """``(*keys, active_stations, *sums)``: the buckets of a key hold different ids, so their counts add up."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("stations")).alias("active_stations"), *sums)


def activity_by_month_and_year(rentals: DataFrame) -> DataFrame:
    """``(period, first_day, active_stations, rentals)`` of every month and every year.

    The rentals are aggregated once, by month; the years merge the months'
    bitmaps, of which there are as many as months and buckets.
    """
    total = F.sum("rentals").alias("rentals")
    months = station_bitmaps(rentals, [F.trunc("hour", "MM").alias("first_day")], "station_id", total)
    years = merge_bitmaps(months, [F.trunc("first_day", "YEAR").alias("first_day")], total)
    rows = [count_stations(b, ["first_day"], total).select(F.lit(p).alias("period"), "first_day", "active_stations", "rentals")
            for p, b in (("month", months), ("year", years))]
    return rows[0].unionByName(rows[1])


def per_station_holiday(rentals: DataFrame, holidays: DataFrame) -> DataFrame:
    """Day-of-week x hour profile on holidays, also per holiday occurrence.

    The holiday table has a dozen rows a year. Only holiday rows are kept, so the LEFT JOIN of the reference reduces to an inner
    join (the non-holiday group is filtered out after aggregation there).
    """
    h = holidays.select(F.to_date("date").alias("__d")).distinct()
    j = rentals.join(h, F.to_date(rentals["hour"]) == h["__d"], "inner")
    # The dates of a group are holidays, a dozen a year: a set of them stays small.
    keys = [day_of_week("hour").alias("day_of_week"), F.hour("hour").alias("hour_of_day")]
    parts = station_bitmaps(j, keys, "station_id", F.sum("rentals").alias("__rentals"), F.collect_set("__d").alias("__days"))
    g = count_stations(parts, ["day_of_week", "hour_of_day"], F.sum("__rentals").alias("__rentals"),
                       F.size(F.array_distinct(F.flatten(F.collect_list("__days")))).alias("__occurrences")
                       ).withColumnRenamed("active_stations", "__stations")
    per = F.col("__rentals") / F.col("__stations")
    return g.select("day_of_week", "hour_of_day", F.lit(1).alias("is_holiday"),
                    per.alias("per_station_rentals"),
                    (per / F.col("__occurrences")).alias("per_station_rentals_normalized")
                    ).orderBy("day_of_week", "hour_of_day")


def bucket_rentals(rentals: DataFrame, bucket_hours: int) -> DataFrame:
    """Rentals re-aggregated to (station, k-hour block of the day).

    The reference joined every rental hour to the calendar only to look up
    its block; the block is an expression of the hour, so no join is needed.
    """
    return (rentals.groupBy("station_id", hour_bucket("hour", bucket_hours).alias("hour_agg"))
            .agg(F.sum("rentals").alias("rentals")))


def bucket_profile(rentals: DataFrame, bucket_hours: int) -> DataFrame:
    """Day-of-week x block-start-hour profile of per-station rentals."""
    b = bucket_rentals(rentals, bucket_hours)
    return _per_station(b, [day_of_week("hour_agg").alias("day_of_week"),
                            F.hour("hour_agg").alias("hour_of_day")],
                        ["day_of_week", "hour_of_day"])


def monthly_weather(weather: DataFrame, column: str, how: str, out_col: str) -> DataFrame:
    """Mean over years of a monthly aggregate (``how`` = 'max' or 'sum')."""
    fn = {"max": F.max, "sum": F.sum}[how]
    inner = weather.groupBy(F.month("hour").alias("month"), F.year("hour").alias("year")).agg(
        fn(column).alias("__v"))
    return inner.groupBy("month").agg(F.avg("__v").alias(out_col)).orderBy("month")


def avg_monthly_max(weather: DataFrame) -> DataFrame:
    return monthly_weather(weather, "max_temp_f", "max", "avg_max_temp_f")


def avg_monthly_sum(weather: DataFrame) -> DataFrame:
    return monthly_weather(weather, "precip_in", "sum", "avg_precip_in")
