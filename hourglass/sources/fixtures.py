"""Adapters from the shared test tables to the reference's input shapes.

The test data are TPC-H-like tables plus an ``events`` stream. Each adapter
is a projection or aggregate of a given table, so its work grows with the
data. The same derivations are written in SQL in ``hourglass.plans.oracles``.

* trips          <- events: station = user_id, start_time = ts
* history trips  <- orders: station = o_custkey, start_time = o_orderdate
                    (several years, for the yearly and monthly profiles)
* weather        <- events per hour: max/avg of value, precip = sum of
                    value over 'error' events (NULL when none)
* history weather<- orders per day: max_temp = max(o_totalprice),
                    precip = sum(o_totalprice) / 1e4
* touches        <- events: user-day journeys, channel from props.k (none for every fifth event)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.functions.time import hour_floor

# Fixed value: number of marketing channels the touches fixture derives.
N_CHANNELS = 6
# Fixed value: every so many-th event is a touch without a channel.
NO_CHANNEL_EVERY = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.select(F.col("user_id").cast("int").alias("station_id"),
                      F.col("ts").alias("start_time"))
            .filter(F.col("station_id").isNotNull() & F.col("start_time").isNotNull()))


def history_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.select(F.col("o_custkey").cast("int").alias("station_id"),
                     F.col("o_orderdate").cast("timestamp_ntz").alias("start_time"))
            .filter(F.col("station_id").isNotNull() & F.col("start_time").isNotNull()))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(hour_floor("ts").alias("hour")).agg(
        F.max("value").alias("max_temp_f"),
        F.avg("value").alias("avg_temp_f"),
        F.sum(F.when(F.col("event_type") == "error", F.col("value"))).alias("precip_in"),
    )


def history_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("hour")).agg(
        F.max("o_totalprice").alias("max_temp_f"),
        (F.sum("o_totalprice") / F.lit(1e4)).alias("precip_in"),
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return ev.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.date_format("ts", "yyyyMMdd")).alias("infinity_id"),
        F.when(F.col("event_id") % NO_CHANNEL_EVERY != 0,
               F.concat(F.lit("ch"), (k % N_CHANNELS).cast("string"))).alias("channelgrouping"),
        F.col("ts").alias("dt"),
        F.col("event_id").alias("tie"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("conversion"),
    )
