"""Property test: segmented (skew-safe) sequence operators equal plain windows."""

import datetime as dt
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourglass.operators import journeys
from hourglass.operators.sequence import adjacent_pair_counts

T0 = dt.datetime(2022, 3, 1)
TOUCHES = "infinity_id string, channelgrouping string, dt timestamp_ntz, tie long, conversion int"

touch_rows = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", "c"]),   # one user dominates
              st.sampled_from(["x", "y", "z"]),
              st.one_of(st.none(), st.integers(min_value=0, max_value=20))),   # few distinct times, some NULL: ties
    min_size=1, max_size=300)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=touch_rows, step=st.sampled_from([1, 17, 61]))
def test_segmented_operators_equal_windows(spark, rows, step):
    data = [(u, ch, None if m is None else T0 + dt.timedelta(minutes=m * step), i, 0) for i, (u, ch, m) in enumerate(rows)]
    t = spark.createDataFrame(data, TOUCHES)
    w = Window.partitionBy("infinity_id").orderBy("dt")
    ref = {(r[0], r[1]) for r in t.select("tie", F.dense_rank().over(w)).collect()}
    got = {(r[0], r[1]) for r in journeys.visit_order(t).select("tie", "visit_order").collect()}
    assert got == ref
    w2 = Window.partitionBy("infinity_id").orderBy("dt", "tie")
    ref_pairs = {(r[0], r[1]): r[2] for r in
                 t.select("channelgrouping", F.lead("channelgrouping").over(w2).alias("nx"))
                 .filter("nx IS NOT NULL").groupBy("channelgrouping", "nx").count().collect()}
    got_pairs = {(r.a, r.b): r.n for r in
                 adjacent_pair_counts(t, "infinity_id", ["dt", "tie"], "channelgrouping").collect()}
    assert got_pairs == ref_pairs


def test_null_times_rank_first_and_together(spark):
    data = [("u", "x", None, i, 0) for i in range(300)] + [("u", "y", T0 + dt.timedelta(minutes=i), 1000 + i, 0) for i in range(100)]
    got = {r.tie: r.visit_order for r in journeys.visit_order(spark.createDataFrame(data, TOUCHES)).collect()}
    assert {got[i] for i in range(300)} == {1} and [got[1000 + i] for i in range(100)] == list(range(2, 102))


@pytest.mark.parametrize("operator", ["visit_order", "pairs"])
def test_cost_does_not_grow_with_shuffle_partitions(spark, operator):
    rows = spark.range(30_000).select(
        (F.col("id") % 50).cast("string").alias("infinity_id"), F.concat(F.lit("c"), F.col("id") % 5).alias("channelgrouping"),
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") % 20_000).cast("int"))).alias("dt"),
        F.col("id").alias("tie"), F.lit(0).alias("conversion")).persist()
    rows.count()
    run = {"visit_order": lambda: journeys.visit_order(rows),
           "pairs": lambda: adjacent_pair_counts(rows, "infinity_id", ["dt", "tie"], "channelgrouping")}[operator]
    took, old = {}, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (8, 8, 400):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            t0 = time.time()
            run().write.format("noop").mode("overwrite").save()
            took[parts] = time.time() - t0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        rows.unpersist()
    # Only the scheduling of 400 small tasks a shuffle is added.
    assert took[400] < 10 * took[8] + 20
