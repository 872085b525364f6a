"""Consecutive-row pairs within ordered groups, safe under key skew.

``lead()`` over ``Window.partitionBy(group)`` puts every row of a group in
one task, so one very large group (a bot user holding a third of all rows)
serialises the job. Here a group is cut into (group, bucket) segments by a
bucket that never falls along the order, such as the hour of the first order
column; ``lead()`` runs inside a segment, and the pair that straddles two
segments comes from their first and last values: a window over one summary
row per segment. Everything stays in JVM expressions, and the cost does not
depend on the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacent_pair_counts(df: DataFrame, group_col: str, order_cols: list[str],
                         value_col: str, bucket: Column | None = None) -> DataFrame:
    """Counts of ``(a, b)`` where b follows a within a group ordered by ``order_cols``.

    Returns ``(a string, b string, n long)``. The order columns should make
    the order total (add a unique tie-breaker), as equal keys have no
    defined order. ``bucket`` must not fall along the order; without it the
    first order column is a timestamp and its hour is taken.
    """
    from hourglass.operators.journeys import time_bucket

    s = df.select(group_col, *order_cols, F.col(value_col).cast("string").alias("__v"),
                  (time_bucket(order_cols[0]) if bucket is None else bucket).alias("__b"))
    w = Window.partitionBy(group_col, "__b").orderBy(*order_cols)
    inner = (s.select(F.col("__v").alias("a"), F.lead("__v").over(w).alias("b"),
                      F.lead(F.lit(1)).over(w).alias("__has_next"))
             .filter(F.col("__has_next").isNotNull())
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    # First and last value of each segment: same clustering as the window, so
    # the exchange is shared; one row per segment is then ordered per group.
    order = F.struct(*[F.col(c) for c in order_cols])
    ends = s.groupBy(group_col, "__b").agg(F.min_by("__v", order).alias("f"), F.max_by("__v", order).alias("l"))
    along = Window.partitionBy(group_col).orderBy("__b")
    stitched = (ends.select(F.col("l").alias("a"), F.lead("f").over(along).alias("b"),
                            F.lead(F.lit(1)).over(along).alias("__has_next"))
                .filter(F.col("__has_next").isNotNull())
                .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    return inner.unionByName(stitched).groupBy("a", "b").agg(F.sum("n").alias("n"))
