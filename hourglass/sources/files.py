"""File sources of the reference's raw inputs (CSV trips and weather)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourglass.operators.demand import clean_trips, trip_columns

# Column names of the raw trip files, in file order; all are
# read as text and parsed late.
TRIP_COLUMNS = [
    "tripduration", "start_time", "stop_time", "start_station_id",
    "start_station_name", "start_station_latitude", "start_station_longitude",
    "end_station_id", "end_station_name", "end_station_latitude",
    "end_station_longitude", "bike_id", "user_type", "birth_year", "user_gender",
]

TRIP_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TRIP_COLUMNS])

# The hourly weather file layout, in file order. The reference
# declared the metrics as 32-bit floats; doubles are used here so that sums
# agree with SQL engines to rounding.
_WEATHER_TEXT = {"address", "weather_type", "resolved_address", "name", "info",
                 "conditions", "contributing_stations"}
WEATHER_COLUMNS = [
    "address", "hour", "max_temp_f", "min_temp_f", "avg_temp_f", "dew_point_f",
    "relative_humidity_percent", "heat_index_f", "wind_speed_mph", "wind_gust_mph",
    "wind_direction", "wind_chill_f", "precip_in", "precip_cover_percent",
    "snow_depth_in", "visibility", "cloud_cover_percent", "sea_level_pressure",
    "weather_type", "latitude", "longitude", "resolved_address", "name", "info",
    "conditions", "contributing_stations",
]
WEATHER_SCHEMA = T.StructType([
    T.StructField(c, T.StringType() if c in _WEATHER_TEXT
                  else T.TimestampNTZType() if c == "hour" else T.DoubleType())
    for c in WEATHER_COLUMNS
])
WEATHER_TIME_FORMAT = "MM/dd/yyyy HH:mm:ss"


def read_raw_trips(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV directory, explicit all-string schema (no inference pass)."""
    return spark.read.schema(TRIP_SCHEMA).option("header", True).csv(path)


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """Raw trip CSVs -> cleaned ``(station_id, start_time)``; only 2 of 15 columns are parsed."""
    return clean_trips(read_raw_trips(spark, path))


CORRUPT = "_corrupt_record"
REJECT_COLUMNS = ["reason", "record", "input_file"]


def _read_checked(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """CSV rows with the text of malformed lines and the file each row came from."""
    # All columns are parsed: with fewer a line's number of fields is not seen.
    reader = (spark.read.schema(T.StructType(list(schema) + [T.StructField(CORRUPT, T.StringType())]))
              .option("header", True).option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    df = reader.options(**options).csv(path)
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[f.name for f in schema])))
    return df.select("*", record.alias("record"), F.col("_metadata.file_path").alias("input_file"))


def read_trips_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted trips, rejects): every raw row is in exactly one of the two.

    Accepted rows are those of ``read_trips``. Rejects are ``(reason, record,
    input_file)``: the line's text (a line that has another number of fields
    as it stands, else its fields again) and why its trip cannot be read:
    ``fields``, ``station_id``, ``start_time`` or ``station_id, start_time``.
    """
    raw = _read_checked(spark, path, TRIP_SCHEMA)
    parsed = trip_columns(raw, "record", "input_file", CORRUPT)
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("station_id", "start_time")])
    reason = F.when(missing == "", None).when(F.col(CORRUPT).isNotNull(), F.lit("fields")).otherwise(missing)
    judged = parsed.withColumn("reason", reason)
    return (judged.filter(F.col("reason").isNull()).select("station_id", "start_time"),
            judged.filter(F.col("reason").isNotNull()).select(*REJECT_COLUMNS))


def read_weather_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted hours, rejects): rows without a readable hour are rejects, with reason ``hour``.

    A malformed number is NULL in an accepted row, as in ``read_weather``.
    """
    raw = _read_checked(spark, path, WEATHER_SCHEMA, timestampNTZFormat=WEATHER_TIME_FORMAT, timestampFormat=WEATHER_TIME_FORMAT)
    return (raw.filter(F.col("hour").isNotNull()).select(*WEATHER_COLUMNS),
            raw.filter(F.col("hour").isNull()).select(F.lit("hour").alias("reason"), "record", "input_file"))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Hourly weather CSV; malformed fields become NULL and rows without an hour are dropped."""
    df = (spark.read.schema(WEATHER_SCHEMA)
          .option("header", True)
          .option("mode", "PERMISSIVE")
          .option("timestampNTZFormat", WEATHER_TIME_FORMAT)
          .option("timestampFormat", WEATHER_TIME_FORMAT)
          .csv(path))
    return df.filter(F.col("hour").isNotNull())
