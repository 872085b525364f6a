"""Registered queries of the demand side (pipeline A) over the test tables.

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame built
from the operators. Parameters that the reference hard-codes appear here
as arguments sized for the one-month fixtures (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hourglass.functions.holidays import us_holidays
from hourglass.functions.time import hour_bucket, hour_floor, parse_timestamps
from hourglass.operators import demand, profiles, timegrid
from hourglass.operators.joins import range_join
from hourglass.plans.prepared import base_table, shared_folder
from hourglass.sources import files
from hourglass.sources import fixtures
from hourglass.sources.sinks import create_table, insert_into

# Fixture parameters. The data span 30 days, so the 30-day activity filter
# of the reference keeps no station; 7 days keeps almost all.
MIN_HISTORY_DAYS = 7
YEARS_PER_STATION = (1996, 2000)   # reference: 2014-2019 on 2013-2020 data
YEARS_DOW = (1996, 2001)           # reference: 2014-2020
MOST_ACTIVE_N = 200
TOP_N = 20
FLOAT_PLACES = 8
RENTALS_DDL = "station_id int, hour timestamp_ntz, rentals int"


def rentals(spark, sf):
    """The hourly rentals table (built once where the build step is run, like the reference's table)."""
    return base_table(spark, sf, "rentals", lambda: demand.hourly_rentals(fixtures.trips(spark, sf)))


def history_rentals(spark, sf):
    return base_table(spark, sf, "history_rentals",
                      lambda: demand.hourly_rentals(fixtures.history_trips(spark, sf)))


def stations(spark, sf):
    return base_table(spark, sf, "stations", lambda: demand.stations(rentals(spark, sf)))


def stations_active(spark, sf):
    return demand.stations_active(stations(spark, sf), MIN_HISTORY_DAYS)


def calendar(spark, sf):
    return timegrid.calendar(stations(spark, sf))


def periods(spark, sf):
    return base_table(spark, sf, "periods", lambda: timegrid.hourly_calendar(calendar(spark, sf)))


def holidays(spark, sf):
    return us_holidays(timegrid.calendar_years(calendar(spark, sf)))


def history_holidays(spark, sf):
    st = demand.stations(history_rentals(spark, sf))
    return us_holidays(timegrid.calendar_years(timegrid.calendar(st)))


def q_clean_trips(spark, sf):
    """Raw text rows, bad ones among them -> cleaned (station_id, start_time)."""
    return demand.clean_trips(_raw_trips_text(spark, sf))


def q_parse_timestamps(spark, sf):
    """Render each event time as text in one of the trip layouts, parse it back."""
    ev = fixtures.table(spark, sf, "events").select("event_id", "ts")
    return ev.select("event_id", parse_timestamps(_time_text()).alias("start_time"))


# Layouts of the rendered times, chosen by event_id modulo their number.
RENDERED_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm",
                    "yyyy-MM-dd HH:mm:ss.SSSS", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss")
# Every so many-th raw row has a bad time, and a bad station.
BAD_TIME_EVERY, BAD_STATION_EVERY = 11, 13


def _time_text():
    text = F.lit(None).cast("string")
    for i, layout in enumerate(RENDERED_LAYOUTS):
        text = F.when(F.col("event_id") % len(RENDERED_LAYOUTS) == i, F.date_format("ts", layout)).otherwise(text)
    return text


def _raw_trips_text(spark, sf):
    """Events as raw trip rows: every column text, start time in one of the
    layouts of the trip files, some rows with a bad time or a bad station."""
    ev = fixtures.table(spark, sf, "events").select("event_id", "ts", "user_id")
    cols = {c: F.lit(None).cast("string") for c in files.TRIP_COLUMNS}
    cols["start_time"] = F.when(F.col("event_id") % BAD_TIME_EVERY == 0, F.lit("no time")).otherwise(_time_text())
    cols["start_station_id"] = (F.when(F.col("event_id") % BAD_STATION_EVERY == 0, F.lit("no station"))
                                .otherwise(F.col("user_id").cast("string")))
    cols["bike_id"] = F.col("event_id").cast("string")
    return ev.select(*[v.alias(k) for k, v in cols.items()])


def q_read_trips_csv(spark, sf):
    """CSV trip files (header, all text) -> parsed (station_id, start_time)."""
    path = shared_folder(spark, "trips_csv")
    _raw_trips_text(spark, sf).write.option("header", True).csv(path)
    return files.read_trips(spark, path)


def q_read_weather_csv(spark, sf):
    """Hourly weather written in the weather files' layout and read back typed."""
    cols = {c: F.lit(None).cast("string") for c in files.WEATHER_COLUMNS}
    cols["hour"] = F.date_format("hour", files.WEATHER_TIME_FORMAT)
    for c in ("max_temp_f", "avg_temp_f", "precip_in"):
        cols[c] = F.col(c).cast("string")
    path = shared_folder(spark, "weather_csv")
    (fixtures.weather(spark, sf).select(*[v.alias(k) for k, v in cols.items()])
     .write.option("header", True).csv(path))
    r = files.read_weather(spark, path)
    return r.select("hour", *[F.round(c, FLOAT_PLACES).alias(c) for c in ("max_temp_f", "avg_temp_f", "precip_in")])


def q_hourly_rentals(spark, sf):
    return demand.hourly_rentals(fixtures.trips(spark, sf))


def q_insert_rentals(spark, sf):
    """CREATE TABLE and two INSERT INTO of a typed rentals table (INTEGER count
    column), read back: all counts, then those of even stations again."""
    counts = (fixtures.trips(spark, sf).groupBy("station_id", hour_floor("start_time").alias("hour"))
              .agg(F.count(F.lit(1)).alias("rentals")))
    path = shared_folder(spark, "rentals_table")
    name = "hourglass_" + path.rsplit("-", 1)[1]
    create_table(spark, name, RENTALS_DDL, path)
    insert_into(counts, name)
    return insert_into(counts.filter("station_id % 2 = 0"), name)


def q_calendar_bounds(spark, sf):
    return timegrid.calendar_bounds(stations(spark, sf))


def q_stations(spark, sf):
    return stations(spark, sf)


def q_stations_active(spark, sf):
    return stations_active(spark, sf)


def q_calendar(spark, sf):
    return calendar(spark, sf)


def q_hourly_calendar(spark, sf):
    return periods(spark, sf)


def q_us_holidays(spark, sf):
    return history_holidays(spark, sf).unionByName(holidays(spark, sf))


def q_holiday_hours(spark, sf):
    return timegrid.holiday_hours(holidays(spark, sf), periods(spark, sf))


def q_entity_hours(spark, sf):
    """Active station x calendar hour rows (the reference's BETWEEN join)."""
    return range_join(periods(spark, sf), stations_active(spark, sf), "hour",
                      "start_date", "end_date").select("station_id", "hour")


def q_range_join(spark, sf):
    """Calendar hours x every station's lifetime."""
    return range_join(periods(spark, sf), stations(spark, sf), "hour",
                      "start_date", "end_date").select("station_id", "hour")


def q_hour_bucket(spark, sf):
    p = periods(spark, sf)
    return p.select("hour", hour_bucket("hour", 4).alias("hour_agg_4"),
                    hour_bucket("hour", 6).alias("hour_agg_6"))


def q_bucket_rentals(spark, sf):
    return profiles.bucket_rentals(rentals(spark, sf), 4)


def _sparsity(k):
    def q(spark, sf):
        return demand.sparsity(rentals(spark, sf), stations_active(spark, sf), k)
    return q


def q_stations_most_active(spark, sf):
    return demand.stations_most_active(rentals(spark, sf), stations_active(spark, sf), MOST_ACTIVE_N)


def q_stations_top(spark, sf):
    """A top-n that cuts: the ranking's ties decide who is in."""
    return demand.stations_most_active(rentals(spark, sf), stations_active(spark, sf), TOP_N)


def q_rentals_by_year(spark, sf):
    return profiles.rentals_by_year(history_rentals(spark, sf))


def q_stations_by_year(spark, sf):
    return profiles.stations_by_year(history_rentals(spark, sf))


def q_per_station_by_year(spark, sf):
    return profiles.per_station_by_year(history_rentals(spark, sf), *YEARS_PER_STATION)


def q_per_station_by_month(spark, sf):
    return profiles.per_station_by_month(history_rentals(spark, sf))


def q_per_station_by_year_month(spark, sf):
    return profiles.per_station_by_year_month(history_rentals(spark, sf))


def q_per_station_by_dow(spark, sf):
    return profiles.per_station_by_dow(history_rentals(spark, sf), *YEARS_DOW)


def q_per_station_by_dow_hour(spark, sf):
    return profiles.per_station_by_dow_hour(rentals(spark, sf))


def q_per_station_holiday(spark, sf):
    return profiles.per_station_holiday(rentals(spark, sf), holidays(spark, sf))


def q_avg_monthly_max(spark, sf):
    df = profiles.avg_monthly_max(fixtures.history_weather(spark, sf))
    return df.select("month", F.round("avg_max_temp_f", FLOAT_PLACES).alias("avg_max_temp_f"))


def q_avg_monthly_sum(spark, sf):
    df = profiles.avg_monthly_sum(fixtures.history_weather(spark, sf))
    return df.select("month", F.round("avg_precip_in", FLOAT_PLACES).alias("avg_precip_in"))


def _profile(k):
    def q(spark, sf):
        return profiles.bucket_profile(rentals(spark, sf), k)
    return q


QUERIES = {
    "clean_trips": q_clean_trips,
    "read_trips_csv": q_read_trips_csv,
    "read_weather_csv": q_read_weather_csv,
    "parse_timestamps": q_parse_timestamps,
    "hourly_rentals": q_hourly_rentals,
    "insert_rentals": q_insert_rentals,
    "calendar_bounds": q_calendar_bounds,
    "stations": q_stations,
    "stations_active": q_stations_active,
    "calendar": q_calendar,
    "hourly_calendar": q_hourly_calendar,
    "us_holidays": q_us_holidays,
    "holiday_hours": q_holiday_hours,
    "entity_hours": q_entity_hours,
    "range_join": q_range_join,
    "hour_bucket": q_hour_bucket,
    "bucket_rentals": q_bucket_rentals,
    "sparsity_1h": _sparsity(1),
    "sparsity_4h": _sparsity(4),
    "sparsity_6h": _sparsity(6),
    "stations_most_active": q_stations_most_active,
    "stations_most_active_top": q_stations_top,
    "rentals_by_year": q_rentals_by_year,
    "stations_by_year": q_stations_by_year,
    "per_station_by_year": q_per_station_by_year,
    "per_station_by_month": q_per_station_by_month,
    "avg_monthly_max": q_avg_monthly_max,
    "avg_monthly_sum": q_avg_monthly_sum,
    "per_station_by_year_month": q_per_station_by_year_month,
    "per_station_by_dow": q_per_station_by_dow,
    "per_station_by_dow_hour": q_per_station_by_dow_hour,
    "per_station_holiday": q_per_station_holiday,
    "profile_4h": _profile(4),
    "profile_6h": _profile(6),
}
