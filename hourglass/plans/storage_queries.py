"""Registered queries of storage: rejects, tables and views by name, partitioned merges, pruned reads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hourglass.operators import journeys, profiles
from hourglass.plans import attribution_queries as aq
from hourglass.plans import demand_queries as dq
from hourglass.plans.prepared import shared_folder
from hourglass.sources import catalog, files, fixtures, sinks

# Every so many-th event is a line cut after the third field; hours of these numbers are spoiled.
SHORT_LINE_EVERY, SPOILED_HOUR_EVERY = 17, 7
BUSY = 10


def _counted(accepted, rejects):
    """Accepted rows and rejects by reason and folder of their file."""
    folder = F.regexp_extract("input_file", "/(full|short)/[^/]*$", 1)
    return (rejects.groupBy("reason", folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))
            .unionByName(accepted.agg(F.lit("accepted").alias("reason"), F.lit("").alias("folder"), F.count(F.lit(1)).alias("n"))))


def q_rejected_trips(spark, sf):
    """Trip CSVs with bad times, bad stations and cut lines: accepted rows, and rejects by reason and folder."""
    path = shared_folder(spark, "checked_trips")
    dq._raw_trips_text(spark, sf).write.option("header", True).csv(f"{path}/full")
    events = fixtures.table(spark, sf, "events").filter(F.col("event_id") % SHORT_LINE_EVERY == 0)
    events.select(F.lit("1").alias("tripduration"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start_time"), F.lit("x").alias("stop_time")
                  ).write.option("header", True).csv(f"{path}/short")
    return _counted(*files.read_trips_checked(spark, f"{path}/*"))


def q_rejected_weather(spark, sf):
    """Hourly weather CSVs of which every seventh hour of the day cannot be read."""
    cols = {c: F.lit(None).cast("string") for c in files.WEATHER_COLUMNS}
    cols["hour"] = (F.when(F.hour("hour") % SPOILED_HOUR_EVERY == 3, F.lit("no hour"))
                    .otherwise(F.date_format("hour", files.WEATHER_TIME_FORMAT)))
    cols["avg_temp_f"] = F.when(F.hour("hour") == 5, F.lit("warm")).otherwise(F.col("avg_temp_f").cast("string"))
    path = shared_folder(spark, "checked_weather")
    fixtures.weather(spark, sf).select(*[v.alias(k) for k, v in cols.items()]).write.option("header", True).csv(f"{path}/full")
    return _counted(*files.read_weather_checked(spark, f"{path}/*"))


def q_created_tables(spark, sf):
    """Rentals of even stations as a table by name, replaced by all rentals; a persistent view
    of the stations' totals over it, and a temporary view of the busy ones, read back."""
    name = f"hourglass_{uuid.uuid4().hex}"
    rentals = dq.rentals(spark, sf)
    catalog.create_table_as(rentals.filter("station_id % 2 = 0"), name, shared_folder(spark, "even"), partition_by=["station_id"])
    catalog.create_table_as(rentals, name, shared_folder(spark, "all"), mode="replace")
    totals = catalog.create_view(spark, f"{name}_totals", f"SELECT station_id, SUM(rentals) AS rentals FROM {name} GROUP BY station_id")
    catalog.create_view(spark, f"{name}_busy", totals.filter(F.col("rentals") >= BUSY))
    return spark.sql(f"SELECT station_id, rentals FROM {name}_busy")


def q_upsert_partitions(spark, sf):
    """The attribution table partitioned by model; fresh Markov shares merged into their partition alone, read back."""
    t = aq.touches(spark, sf)
    prior = journeys.touch_attribution(t)
    stale = journeys.last_touch(t).withColumn("attribution_model", F.lit("markov_chain"))
    path = shared_folder(spark, "attribution")
    prior.unionByName(stale).write.partitionBy("attribution_model").parquet(path)
    return (sinks.upsert_partitions(aq.markov_shares(spark, sf), path, aq.ATTRIBUTION_KEYS, ["attribution_model"])
            .select("attribution_model", "channel", "attribution_percent"))


def q_activity_by_month_and_year(spark, sf):
    return profiles.activity_by_month_and_year(dq.history_rentals(spark, sf))


def q_lifespan_rentals(spark, sf):
    """Rentals by month on disk; of the stations whose numbers divide by 50, those of their first 40 days."""
    path, spans = shared_folder(spark, "by_month"), shared_folder(spark, "spans")
    sinks.write_by_month(dq.history_rentals(spark, sf), path)
    first = (dq.history_rentals(spark, sf).filter("station_id % 50 = 0").groupBy("station_id").agg(F.min("hour").alias("start_date"))
             .select("station_id", "start_date", (F.col("start_date") + F.expr("INTERVAL 40 DAYS")).alias("end_date")))
    first.write.parquet(spans)
    return sinks.read_lifespans(spark, path, spark.read.parquet(spans))


QUERIES = {
    "rejected_trips": q_rejected_trips,
    "rejected_weather": q_rejected_weather,
    "created_tables": q_created_tables,
    "upsert_partitions": q_upsert_partitions,
    "activity_by_month_and_year": q_activity_by_month_and_year,
    "lifespan_rentals": q_lifespan_rentals,
}
