"""Rejects, tables and views by name, merges of touched partitions, bitmaps, pruned reads."""

import datetime as dt
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from hourglass.operators import profiles
from hourglass.sources import catalog, files, sinks


def _write(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


def test_trip_rejects_name_reason_line_and_file(spark, scratch_dir):
    header = ",".join(files.TRIP_COLUMNS)
    row = lambda station, time: f"60,{time},x,{station}" + ",y" * 11
    _write(scratch_dir, "a.csv", header, row(7, "2018-01-02 03:04:05"), row("seven", "2018-01-02 03:04:05"), row(7, "late"), row("", ""))
    _write(scratch_dir, "b.csv", header, "60,2018-01-02 03:04:05", "60,1/2/2018 3:04,x,8", row(9, "1/2/2018 3:04") + ",more")
    good, bad = files.read_trips_checked(spark, scratch_dir)
    assert {r.station_id for r in good.collect()} == {7, 8, 9}                 # a short line with both fields is a trip
    got = {(r.reason, r.record, r.input_file.rsplit("/", 1)[1]) for r in bad.collect()}
    assert got == {("station_id", row("seven", "2018-01-02 03:04:05"), "a.csv"), ("start_time", row(7, "late"), "a.csv"),
                   ("station_id, start_time", "60,,x," + ",y" * 11, "a.csv"), ("fields", "60,2018-01-02 03:04:05", "b.csv")}
    assert bad.groupBy("reason").count().count() == 4 and good.count() + bad.count() == 7
    assert sorted(map(tuple, files.read_trips(spark, scratch_dir).collect())) == sorted(map(tuple, good.collect()))


def test_weather_rejects(spark, scratch_dir):
    line = lambda hour, temp: ",".join([hour if c == "hour" else temp if c == "avg_temp_f" else "" for c in files.WEATHER_COLUMNS])
    _write(scratch_dir, "w.csv", ",".join(files.WEATHER_COLUMNS), line("01/02/2018 03:00:00", "50.5"), line("soon", "1"), line("01/02/2018 04:00:00", "warm"))
    good, bad = files.read_weather_checked(spark, scratch_dir)
    assert [(r.hour.hour, r.avg_temp_f) for r in good.orderBy("hour").collect()] == [(3, 50.5), (4, None)]
    assert [(r.reason, "soon" in r.record) for r in bad.collect()] == [("hour", True)]


def test_table_as_select_modes_and_views(spark, scratch_dir):
    name = f"t_{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert catalog.create_table_as(rows, name, f"{scratch_dir}/one", partition_by=["v"]).count() == 2
    assert os.path.isdir(f"{scratch_dir}/one/v=a")
    with pytest.raises(Exception, match="already exists"):
        catalog.create_table_as(rows, name, f"{scratch_dir}/two")
    assert catalog.create_table_as(rows.limit(1), name, f"{scratch_dir}/two", mode="ignore").count() == 2
    catalog.create_view(spark, f"{name}_v", f"SELECT count(*) AS n FROM {name}")
    assert catalog.create_table_as(rows.limit(1), name, f"{scratch_dir}/two", mode="replace").count() == 1
    assert spark.table(f"{name}_v").first().n == 1                             # the view reads the table by name
    with pytest.raises(Exception, match="already exists"):
        catalog.create_view(spark, f"{name}_v", "SELECT 1 AS n")
    assert catalog.create_view(spark, f"{name}_v", "SELECT 5 AS n", replace=True).first().n == 5
    assert catalog.create_view(spark, f"{name}_t", rows).count() == 2
    with pytest.raises(Exception, match="already exists"):
        catalog.create_view(spark, f"{name}_t", rows)
    assert catalog.create_view(spark, f"{name}_t", rows.limit(1), replace=True).count() == 1
    for view in (f"{name}_v", f"{name}_t"):
        catalog.drop_view(spark, view)
        assert not spark.catalog.tableExists(view)
    with pytest.raises(ValueError, match="mode"):
        catalog.create_table_as(rows, name, f"{scratch_dir}/x", mode="append")


def test_table_as_select_gathers_partitions(spark, scratch_dir):
    rows = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 40 > 0, F.col("id") % 40).alias("k"), "id")
    out = catalog.create_table_as(rows, f"t_{uuid.uuid4().hex}", f"{scratch_dir}/t", partition_by=["k"])
    assert sorted(r.id for r in out.collect()) == list(range(4000)) and out.groupBy("k").count().filter("count = 100").count() == 40
    assert len(_files(f"{scratch_dir}/t")) == 40                               # not one a task: a file for each key, null among them


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_merge_leaves_untouched_partitions_files_alone(spark, scratch_dir):
    schema, path = "m string, channel string, p double", f"{scratch_dir}/t"
    spark.createDataFrame([("a", "x", 0.1), ("a", "y", 0.2), ("b", "x", 0.9), (None, "x", 0.5)], schema).write.partitionBy("m").parquet(path)
    before = _files(path)
    source = spark.createDataFrame([("a", "y", 0.7), ("c", "x", 1.0), (None, "x", 0.6)], schema)
    for _ in range(2):                                                         # a repeated merge gives the same but for null keys, which match nothing
        out = sinks.upsert_partitions(source.filter("m IS NOT NULL"), path, ["m", "channel"], ["m"])
        assert {tuple(r) for r in out.select("m", "channel", "p").collect()} == {("a", "x", 0.1), ("a", "y", 0.7), ("b", "x", 0.9), ("c", "x", 1.0), (None, "x", 0.5)}
    kept = {f for f in before if f.startswith(("m=b", "m=__HIVE"))}
    assert len(kept) == 2 and kept <= _files(path) and not {f for f in before if f.startswith("m=a")} & _files(path)
    nulls = sinks.upsert_partitions(source.filter("m IS NULL"), path, ["m", "channel"], ["m"])
    assert sorted(r.p for r in nulls.filter("m IS NULL").collect()) == [0.5, 0.6] and nulls.count() == 6
    now = _files(path)
    with pytest.raises(Exception, match="several source rows"):
        sinks.upsert_partitions(spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], schema), path, ["m", "channel"], ["m"])
    assert _files(path) == now                                                 # a merge that fails changes nothing
    with pytest.raises(ValueError, match="among the keys"):
        sinks.upsert_partitions(source, path, ["channel"], ["m"])


def test_bitmaps_count_stations_exactly_without_expand(spark):
    days = [dt.datetime(2018, 12, 30) + dt.timedelta(days=d) for d in range(40)]
    rows = [(s, days[(i * 7 + (s or 3)) % 40], 1 + i % 3) for i in range(30) for s in (-5, 0, 1, 32767, 32768, 32769, 70000 + i, None)]
    df = spark.createDataFrame(rows, "station_id int, hour timestamp_ntz, rentals int")
    got = {(r.period, r.first_day): (r.active_stations, r.rentals) for r in profiles.activity_by_month_and_year(df).collect()}
    want = {}
    for s, hour, n in rows:
        for key in (("month", hour.date().replace(day=1)), ("year", hour.date().replace(month=1, day=1))):
            stations, total = want.setdefault(key, (set(), []))
            stations |= {s} - {None}
            total.append(n)
    assert got == {k: (len(s), sum(t)) for k, (s, t) in want.items()}
    holidays = spark.createDataFrame([(dt.datetime(2019, 1, 1), "New Year"), (dt.datetime(2018, 12, 31), "Eve")], "date timestamp_ntz, holiday string")
    plan = profiles.per_station_holiday(df, holidays)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "bitmap_construct_agg" in plan


def test_months_without_a_span_are_pruned(spark, scratch_dir):
    start = dt.datetime(2019, 1, 1)
    rows = [(s, start + dt.timedelta(days=d), 1) for s in range(5) for d in range(0, 365, 3)]
    sinks.write_by_month(spark.createDataFrame(rows, "station_id int, hour timestamp_ntz, rentals int"), f"{scratch_dir}/r")
    spans = [(1, dt.datetime(2019, 3, 10), dt.datetime(2019, 4, 2)), (3, dt.datetime(2019, 12, 30), dt.datetime(2020, 1, 9)), (4, dt.datetime(2019, 5, 2), dt.datetime(2019, 5, 1))]
    spark.createDataFrame(spans, "station_id int, start_date timestamp_ntz, end_date timestamp_ntz").write.parquet(f"{scratch_dir}/s")
    out = sinks.read_lifespans(spark, f"{scratch_dir}/r", spark.read.parquet(f"{scratch_dir}/s"))
    assert {(r.station_id, r.hour) for r in out.collect()} == {(s, h) for s, h, _ in rows for t, a, b in spans if s == t and a <= h <= b}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search("PartitionFilters: .*dynamicpruning", plan)
