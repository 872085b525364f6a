"""Column-level helpers (pure JVM expressions, no Python UDFs)."""

from hourglass.functions.time import (  # noqa: F401
    day_of_week, day_start, hour_bucket, hour_floor, parse_timestamps,
    to_ntz, whole_days_between,
)
