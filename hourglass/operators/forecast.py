"""Forecast models over the dense panel, and ensemble prediction intervals.

* ``ensemble_interval`` - percentile band of per-member predictions, per row,
  with numpy's default linear interpolation, as array expressions (no
  explode, no shuffle).
* ``profile_forecast`` - a transparent baseline (mean of the station's
  history at the same hour of day); SQL-expressible, used to check the
  metrics end to end.
* ``forest_forecast`` - per-station random forest fitted inside
  ``applyInPandas`` (module ``hourglass.operators.forest``).
* ``additive_forecast`` - per-station additive model fitted inside
  ``applyInArrow`` (module ``hourglass.operators.additive``).
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourglass.session import reliable_checkpoint


def _checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared storage): survives executor loss, cuts lineage."""
    return reliable_checkpoint(df)


def _percentile_sorted(sorted_arr: Column, q: float) -> Column:
    """Linear-interpolated q-quantile of an ascending array (numpy 'linear')."""
    n = F.size(sorted_arr)
    pos = (n - 1).cast("double") * F.lit(q)
    lo = F.floor(pos).cast("int")
    frac = pos - lo
    a = F.element_at(sorted_arr, lo + 1)
    b = F.element_at(sorted_arr, F.least(lo + 2, n))
    return a + frac * (b - a)


def interval_bounds(interval_width: float = 0.80) -> tuple[float, float]:
    """Lower / upper quantiles of a central interval: 0.80 -> (0.10, 0.90)."""
    tail = (1.0 - interval_width) / 2.0
    return tail, 1.0 - tail


def ensemble_interval(df: DataFrame, members_col: str, interval_width: float = 0.80,
                      prefix: str = "yhat") -> DataFrame:
    """Add ``yhat`` (member mean) and ``yhat_lower`` / ``yhat_upper``
    (percentiles (100-w)/2 and 100-(100-w)/2 of the members) to each row."""
    lo_q, hi_q = interval_bounds(interval_width)
    s = F.sort_array(F.col(members_col))
    mean = F.aggregate(F.col(members_col), F.lit(0.0), lambda acc, x: acc + x) / F.size(members_col)
    return df.select("*", mean.alias(prefix),
                     _percentile_sorted(s, lo_q).alias(f"{prefix}_lower"),
                     _percentile_sorted(s, hi_q).alias(f"{prefix}_upper"))


def profile_forecast(panel: DataFrame, places: int = 8) -> DataFrame:
    """Baseline: yhat = mean of the station's historical y at the same hour
    of day; band = min / max of those values. Future y is NULL.

    One window partitioned by (station, hour of day): each group holds at
    most one row per calendar day.
    """
    w = Window.partitionBy("station_id", F.hour("ds"))
    hist_y = F.when(F.col("is_historical") == 1, F.col("y"))
    return panel.select(
        "station_id", "ds",
        F.when(F.col("is_historical") == 1, F.col("y")).cast("double").alias("y"),
        F.round(F.avg(hist_y).over(w), places).alias("yhat"),
        F.min(hist_y).over(w).cast("double").alias("yhat_lower"),
        F.max(hist_y).over(w).cast("double").alias("yhat_upper"))


def forest_forecast(features: DataFrame, feature_cols: list[str], num_trees: int = 100,
                    subsampling_rate: float = 0.6, seed: int = 42, interval_width: float = 0.80,
                    entity_col: str = "station_id") -> DataFrame:
    """Random-forest forecast with a per-row interval from the trees' spread.

    One forest per station, as in the reference, in one ``applyInPandas``
    call each (module ``operators.forest``); a station's rows are bounded by
    the calendar length. The features are the given ones alone. Each tree
    sees a 60 % bootstrap sample of the station's rows and all features; trees
    have no limit of depth, bins or rows in a leaf. The seed is fixed, and a
    station's forest does not depend on the other stations. Rows with a NULL
    feature are neither trained on nor forecast; a station without history
    gets the overall mean. Output: ``(station_id, ds, y, yhat, yhat_lower,
    yhat_upper)``; y is NULL for future rows.
    """
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    from hourglass.operators import forest

    parts = max(features.sparkSession.sparkContext.defaultParallelism, 1)
    names = [f"__x{i}" for i in range(len(feature_cols))]
    rows = _checkpoint(features.dropna(subset=feature_cols).select(
        entity_col, "ds", F.when(F.col("is_historical") == 1, F.col("y")).cast("double").alias("y"),
        *[F.col(c).cast("double").alias(n) for c, n in zip(feature_cols, names)]))
    overall = rows.agg(F.coalesce(F.avg("y"), F.lit(0.0))).scalar()
    members_of = forest.forest_members

    def per_entity(pdf):
        pdf = pdf.sort_values(["ds", "y", *names], ignore_index=True)
        out = pdf[[entity_col, "ds", "y"]].copy()
        x, y = pdf[names].to_numpy(float), pdf["y"].to_numpy(float)
        known = ~np.isnan(y)
        if known.any():
            out["members"] = list(members_of(x[known], y[known], x, num_trees, subsampling_rate,
                                             [seed, zlib.crc32(str(pdf[entity_col].iloc[0]).encode())]))
        else:
            out["members"] = None
        out["y"] = out["y"].astype(object).where(known, None)
        return out

    schema = StructType([rows.schema[entity_col], rows.schema["ds"], StructField("y", DoubleType()),
                         StructField("members", ArrayType(DoubleType()))])
    # One task per core, as for the additive model.
    forecast = rows.repartition(parts, entity_col).groupBy(entity_col).applyInPandas(per_entity, schema)
    members = F.coalesce("members", F.array(overall))
    scored = ensemble_interval(forecast.select(entity_col, "ds", "y", members.alias("__members")), "__members", interval_width)
    return scored.select(entity_col, "ds", "y", "yhat", "yhat_lower", "yhat_upper")


def additive_forecast(panel: DataFrame, holidays: DataFrame, regressors: tuple = (),
                      interval_width: float = 0.80, yearly: bool = True,
                      missing_future: str = "null") -> DataFrame:
    """Per-station additive model (27 output columns, see ``operators.additive``).

    Holidays enter as a per-row array of holiday names, joined on the date.
    One ``applyInArrow`` call per station; a station's rows are bounded by
    the calendar length. ``missing_future``: see ``additive.fit_table``.
    """
    from hourglass.operators import additive

    hd = holidays.groupBy(F.to_date("date").alias("__hd")).agg(
        F.array_sort(F.collect_set("holiday")).alias("holiday_names"))
    cols = ["station_id", "ds", "y", "is_historical", *regressors]
    p = (panel.select(*cols).join(hd, F.to_date(panel["ds"]) == hd["__hd"], "left").drop("__hd")
         .withColumn("y", F.col("y").cast("double")))
    seas = additive.SEASONALITIES if yearly else tuple(s for s in additive.SEASONALITIES if s[0] != "yearly")
    fit = additive.fit_table  # captured as a function: shipped by value
    regs = tuple(regressors)

    def per_station(table):
        return fit(table, regressors=regs, interval_width=interval_width, seasonalities=seas, missing_future=missing_future)

    # The fit is CPU work per station on little data: AQE would coalesce the
    # small shuffle into one task. An explicit hash repartition on the group
    # key keeps one task per core, and the grouped map reuses it (no second
    # exchange).
    parts = max(p.sparkSession.sparkContext.defaultParallelism, 1)
    return (p.repartition(parts, "station_id")
            .groupBy("station_id").applyInArrow(per_station, additive.OUTPUT_SCHEMA))
