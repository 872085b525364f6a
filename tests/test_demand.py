"""Demand-side operators: parsing, calendars, holidays, range joins, sparsity."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from conftest import SF_SMALL
from hourglass.functions.holidays import us_holidays
from hourglass.functions.time import hour_bucket, parse_timestamps
from hourglass.operators import demand, timegrid
from hourglass.operators.joins import explode_hours, range_join
from hourglass.plans import demand_queries as dq
from hourglass.sources import files
from hourglass.sources.sinks import create_table, insert_into, write_table


def test_parse_timestamps_formats_and_bad_rows(spark):
    df = spark.createDataFrame([("2015-03-01 10:20:56",), ("03/01/2015 10:20:56",), ("03/01/2015 10:20",),
                                ("garbage",), (None,)], "s string")
    out = [r[0] for r in df.select(parse_timestamps("s")).collect()]
    assert out[:3] == [dt.datetime(2015, 3, 1, 10, 20, 56), dt.datetime(2015, 3, 1, 10, 20, 56),
                       dt.datetime(2015, 3, 1, 10, 20)]
    assert out[3] is None and out[4] is None
    more = spark.createDataFrame([("2018-01-01 13:50:57.4340",), ("1/2/2015 0:05",), ("1/2/2015 0:05:10",), ("12/31/2015 23:59:59",)], "s string")
    assert [r[0] for r in more.select(parse_timestamps("s")).collect()] == [
        dt.datetime(2018, 1, 1, 13, 50, 57, 434000), dt.datetime(2015, 1, 2, 0, 5), dt.datetime(2015, 1, 2, 0, 5, 10),
        dt.datetime(2015, 12, 31, 23, 59, 59)]


def test_csv_trips_round_trip(spark, scratch_dir):
    header = ",".join(files.TRIP_COLUMNS)
    rows = []
    for i, ts in enumerate(["2019-01-01 08:15:00", "01/01/2019 08:59:59", "01/01/2019 09:01", "bad time"]):
        vals = [""] * len(files.TRIP_COLUMNS)
        vals[1], vals[3] = ts, str(100 + i % 2)
        rows.append(",".join(vals))
    rows.append(",".join(["", "2019-01-01 08:00:00", "", "not-an-id"] + [""] * 11))
    with open(f"{scratch_dir}/trips.csv", "w") as f:
        f.write(header + "\n" + "\n".join(rows) + "\n")
    trips = files.read_trips(spark, scratch_dir)
    assert trips.count() == 3  # bad time and bad id dropped
    counts = {(r.station_id, r.hour.hour): r.rentals for r in demand.hourly_rentals(trips).collect()}
    assert counts == {(100, 8): 1, (101, 8): 1, (100, 9): 1}


def test_weather_csv_drops_rows_without_hour(spark, scratch_dir):
    header = ",".join(files.WEATHER_COLUMNS)
    good = ["x", "01/02/2019 13:00:00"] + ["1.5"] * 16 + ["t", "40.7", "-74.0", "a", "b", "c", "d", "e"]
    bad = ["x", "not a time"] + ["2.5"] * 16 + ["t", "40.7", "-74.0", "a", "b", "c", "d", "e"]
    with open(f"{scratch_dir}/w.csv", "w") as f:
        f.write(header + "\n" + ",".join(good) + "\n" + ",".join(bad) + "\n")
    w = files.read_weather(spark, scratch_dir).collect()
    assert len(w) == 1 and w[0].hour == dt.datetime(2019, 1, 2, 13) and w[0].avg_temp_f == 1.5


def test_us_holidays_rules(spark):
    years = spark.createDataFrame([(2021,), (2022,), (2024,)], "year int")
    h = {(r.date.date(), r.holiday) for r in us_holidays(years).collect()}
    assert (dt.date(2024, 1, 15), "Martin Luther King Jr. Day") in h
    assert (dt.date(2024, 5, 27), "Memorial Day") in h
    assert (dt.date(2024, 11, 28), "Thanksgiving") in h
    assert (dt.date(2024, 9, 2), "Labor Day") in h
    assert (dt.date(2024, 10, 14), "Columbus Day") in h
    assert (dt.date(2024, 6, 19), "Juneteenth National Independence Day") in h
    # 2022: Christmas on a Sunday -> observed Monday; Jan 1 2022 a Saturday -> Dec 31 2021
    assert (dt.date(2022, 12, 26), "Christmas Day (Observed)") in h
    assert (dt.date(2021, 12, 31), "New Year's Day (Observed)") in h
    assert not any(d.year == 2024 and "Observed" in n for d, n in h)  # no 2024 weekend fixed dates
    # The last day of a single year is the next year's observed New Year.
    alone = {(r.date.date(), r.holiday) for r in us_holidays(years.filter("year = 2021")).collect()}
    assert (dt.date(2021, 12, 31), "New Year's Day (Observed)") in alone and all(d.year == 2021 for d, _ in alone)
    assert not any(d.year == 2010 for d, _ in {(r.date.date(), 0) for r in us_holidays(spark.createDataFrame([(2011,)], "year int")).collect()})


def test_a_wild_date_does_not_make_a_calendar(spark):
    st = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), dt.datetime(9999, 1, 1, 23))],
                               "station_id int, start_date timestamp_ntz, end_date timestamp_ntz")
    with pytest.raises(Exception, match="200 years"):
        timegrid.calendar(st).count()


def test_hour_bucket(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 5, 1, 23, 59),)], "t timestamp_ntz")
    r = df.select(hour_bucket("t", 4).alias("b4"), hour_bucket("t", 6).alias("b6"),
                  hour_bucket("t", 5).alias("b5")).first()
    assert r.b4 == dt.datetime(2020, 5, 1, 20) and r.b6 == dt.datetime(2020, 5, 1, 18)
    assert r.b5 == dt.datetime(2020, 5, 1, 20)


def test_range_join_equals_explode_and_between(spark):
    st = dq.stations_active(spark, SF_SMALL)
    hours = dq.periods(spark, SF_SMALL)
    rj = range_join(hours, st, "hour", "start_date", "end_date", salts=1).select("station_id", "hour")
    rj2 = range_join(hours, st, "hour", "start_date", "end_date").select("station_id", "hour")
    ex = explode_hours(st, "start_date", "end_date", spread_partitions=4, key_col="station_id").select(
        "station_id", "hour")
    nl = hours.join(st, hours["hour"].between(st["start_date"], st["end_date"])).select("station_id", "hour")
    assert rj.exceptAll(nl).count() == 0 and nl.exceptAll(rj).count() == 0
    assert rj2.exceptAll(nl).count() == 0 and ex.exceptAll(nl).count() == 0 and nl.exceptAll(ex).count() == 0
    assert rj.count() == nl.count() == ex.count()


def test_sparsity_equals_dense_formula(spark):
    r = dq.rentals(spark, SF_SMALL)
    active = dq.stations_active(spark, SF_SMALL)
    hours = dq.periods(spark, SF_SMALL)
    for k in (1, 4, 5, 6):
        grid = (range_join(hours, active, "hour", "start_date", "end_date")
                .select("station_id", hour_bucket("hour", k).alias("b")).distinct())
        rb = r.groupBy("station_id", hour_bucket("hour", k).alias("b")).agg(F.sum("rentals").alias("r"))
        dense = (grid.join(rb, ["station_id", "b"], "left").groupBy("station_id")
                 .agg((100 * F.count(F.lit(1)) / F.sum(F.coalesce("r", F.lit(1)))).alias("p")))
        fast = demand.sparsity(r, active, k)
        j = dense.join(fast, "station_id", "full")
        assert j.filter(F.col("p").isNull() | (F.abs(F.col("p") - F.col(demand.SPARSITY_COL)) > 1e-12)).count() == 0


def test_default_history_filter_keeps_none_on_one_month(spark):
    st = dq.stations(spark, SF_SMALL)
    assert demand.stations_active(st).count() == 0        # 30 days, data span 30 days
    assert demand.stations_active(st, 7).count() > 0


def test_calendar_extends_ten_dates(spark):
    st = dq.stations(spark, SF_SMALL)
    cal = timegrid.calendar(st).agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert cal[0] == dt.datetime(2024, 1, 1) and cal[1] == dt.datetime(2024, 2, 8) and cal[2] == 39


def test_write_ignore_mode_keeps_first(spark, scratch_dir):
    path = f"{scratch_dir}/t"
    write_table(spark.range(3), path, mode="ignore")
    write_table(spark.range(10), path, mode="ignore")
    assert spark.read.parquet(path).count() == 3


def test_create_and_insert_into_casts_by_position(spark, scratch_dir):
    create_table(spark, "hourglass_insert_test", "station_id int, hour timestamp_ntz, rentals int", f"{scratch_dir}/t")
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), 5)], "a long, b timestamp_ntz, c long")
    insert_into(df, "hourglass_insert_test")
    out = insert_into(df, "hourglass_insert_test")
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["int", "timestamp_ntz", "int"]
    assert out.columns == ["station_id", "hour", "rentals"] and out.count() == 2


def test_databases_list_and_drop(spark, scratch_dir):
    from hourglass.sources.catalog import drop_database, list_tables, register_table

    spark.range(3).write.parquet(f"{scratch_dir}/a")
    register_table(spark, "a", f"{scratch_dir}/a", database="hourglass_drop_test")
    assert list_tables(spark, "hourglass_drop_test") == ["a"]
    drop_database(spark, "hourglass_drop_test")
    assert not spark.catalog.databaseExists("hourglass_drop_test")


def test_built_base_tables_serve_until_released(spark):
    from hourglass.plans import prepared
    from hourglass.plans.registry import BASE_TABLES

    plain = sorted(tuple(r) for r in dq.stations(spark, SF_SMALL).collect())
    prepared.build(spark, SF_SMALL, {k: BASE_TABLES[k] for k in ("rentals", "stations")})
    try:
        assert sorted(tuple(r) for r in dq.stations(spark, SF_SMALL).collect()) == plain
        assert "Aggregate" not in dq.stations(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        prepared.release(spark, SF_SMALL)
    assert "Aggregate" in dq.stations(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_register_table_over_written_files(spark, scratch_dir):
    from hourglass.sources.catalog import register_table

    r = dq.rentals(spark, SF_SMALL)
    path = f"{scratch_dir}/rentals"
    write_table(r, path, sort_within=["station_id"])
    t = register_table(spark, "rentals", path, database="hourglass_test")
    assert t.count() == r.count()
    assert spark.sql("SELECT SUM(rentals) FROM hourglass_test.rentals").first()[0] == \
        r.agg(F.sum("rentals")).first()[0]
    register_table(spark, "rentals", path, database="hourglass_test")   # re-run replaces
    assert spark.catalog.tableExists("hourglass_test.rentals")


def test_bucketed_rentals_keep_results_and_read_bucketed(spark, scratch_dir):
    from hourglass.sources.sinks import write_bucketed

    r = dq.rentals(spark, SF_SMALL)
    active = dq.stations_active(spark, SF_SMALL)
    b = write_bucketed(r, "rentals_by_station", ["station_id"], 8, f"{scratch_dir}/rb", sort_by=["station_id", "hour"])
    before = sorted(tuple(x) for x in demand.sparsity(r, active, 4).collect())
    after_df = demand.sparsity(b, active, 4)
    assert sorted(tuple(x) for x in after_df.collect()) == before
    plan = after_df._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
