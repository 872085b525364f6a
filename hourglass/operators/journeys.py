"""Customer journeys and heuristic (first / last touch) attribution.

Touch events: ``(user, channel, time, tie, conversion)``. ``tie`` is a
unique tie-breaker (an event id) so that the order of touches with the same
timestamp is defined; the reference left it to the engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, CONVERSION, NULL_STATE = "Start", "Conversion", "Null"
SEP = " > "


@dataclass(frozen=True)
class TouchCols:
    user: str = "infinity_id"
    channel: str = "channelgrouping"
    time: str = "dt"
    tie: str = "tie"
    conversion: str = "conversion"


DEFAULT = TouchCols()


def time_bucket(c) -> Column:
    """Whole hours since 1970 of a timestamp, as a long; NULL times come first, in a bucket of their own."""
    c = F.col(c) if isinstance(c, str) else c
    hours = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(c)
    return F.coalesce(hours, F.lit(-(1 << 62)))


def visit_order(touches: DataFrame, c: TouchCols = DEFAULT) -> DataFrame:
    """``dense_rank()`` of the touch time within the user: equal times share a rank, NULL times rank first.

    Skew-safe: a user's touches are cut into (user, hour) segments. The hour
    is a function of the time, so equal times never straddle a segment. Ranks
    are computed per segment and shifted by the distinct times of the user's
    earlier segments: a running sum over the per-segment summary, which holds
    at most one row per user and hour. The cost does not depend on the number
    of shuffle partitions. Rows without a time all rank 1, so they skip the
    window.
    """
    rows = touches.withColumn("__b", time_bucket(c.time))
    timed = rows.filter(F.col(c.time).isNotNull())
    ranked = timed.withColumn("__lr", F.dense_rank().over(Window.partitionBy(c.user, "__b").orderBy(c.time)))
    ranked = ranked.unionByName(rows.filter(F.col(c.time).isNull()).withColumn("__lr", F.lit(1)))
    summary = ranked.groupBy(c.user, "__b").agg(F.max("__lr").cast("long").alias("__n"))
    earlier = Window.partitionBy(c.user).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = summary.select(F.col(c.user).alias("__u"), F.col("__b").alias("__ub"),
                           F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    j = ranked.join(shift, F.col(c.user).eqNullSafe(F.col("__u")) & (F.col("__b") == F.col("__ub")))
    return j.select(*touches.columns, (F.col("__lr") + F.col("__off")).cast("int").alias("visit_order"))


def user_journeys(touches: DataFrame, c: TouchCols = DEFAULT) -> DataFrame:
    """One row per user: ``uid, path, first_interaction, last_interaction,
    conversion, visiting_order``.

    path = 'Start > c1 > ... > cn > Conversion' (or '> Null'); channels in
    (time, tie) order, NULL channels skipped (as collect_list does);
    conversion is the flag of the last touch that has one.

    The journey row holds the user's whole ordered history by definition;
    the attribution operators never build it.
    """
    r = visit_order(touches, c)
    touch = F.struct(F.col(c.time).alias("t"), F.col(c.tie).alias("k"), F.col(c.channel).alias("ch"),
                     F.col(c.conversion).alias("cv"), F.col("visit_order").alias("vo"))
    g = r.groupBy(F.col(c.user).alias("uid")).agg(F.array_sort(F.collect_list(touch)).alias("__t"))
    chans = F.filter(F.transform("__t", lambda x: x["ch"]), lambda x: x.isNotNull())
    convs = F.filter(F.transform("__t", lambda x: x["cv"]), lambda x: x.isNotNull())
    conversion = F.try_element_at(convs, F.lit(-1))
    tail = F.when(conversion == 1, F.lit(SEP + CONVERSION)).otherwise(F.lit(SEP + NULL_STATE))
    return g.select(
        "uid",
        F.concat(F.lit(START + SEP), F.array_join(chans, SEP), tail).alias("path"),
        F.try_element_at(chans, F.lit(1)).alias("first_interaction"),
        F.try_element_at(chans, F.lit(-1)).alias("last_interaction"),
        conversion.alias("conversion"),
        F.transform("__t", lambda x: x["vo"]).alias("visiting_order"),
    )


def journey_ends(touches: DataFrame, c: TouchCols = DEFAULT) -> DataFrame:
    """Per user: first and last channel and the last conversion flag.

    Pure ``min_by`` / ``max_by`` aggregates: they combine map-side, so a
    user with millions of touches is reduced before the shuffle. A user
    without any channel stays, with NULL ends: their journey counts.
    """
    order = F.struct(F.col(c.time), F.col(c.tie))
    has_ch = F.col(c.channel).isNotNull()
    has_cv = F.col(c.conversion).isNotNull()
    return touches.groupBy(F.col(c.user).alias("uid")).agg(
        F.min_by(c.channel, F.when(has_ch, order)).alias("first_interaction"),
        F.max_by(c.channel, F.when(has_ch, order)).alias("last_interaction"),
        F.max_by(c.conversion, F.when(has_cv, order)).alias("conversion"),
    )


def _touch_share(ends: DataFrame, channel_col: str, model: str) -> DataFrame:
    conv = ends.filter(F.col("conversion") == 1)
    by_channel = conv.groupBy(F.col(channel_col).alias("channel")).agg(F.count(F.lit(1)).alias("__n"))
    # Total converted journeys = the sum over the (few) channel rows.
    total = F.sum("__n").over(Window.partitionBy())
    return by_channel.select(F.lit(model).alias("attribution_model"), "channel",
                             F.round(F.col("__n") / total, 2).alias("attribution_percent"))


def first_touch(touches: DataFrame, c: TouchCols = DEFAULT) -> DataFrame:
    """Share of converted journeys by their first channel (rounded to 2 places)."""
    return _touch_share(journey_ends(touches, c), "first_interaction", "first_touch")


def last_touch(touches: DataFrame, c: TouchCols = DEFAULT) -> DataFrame:
    """Share of converted journeys by their last channel (rounded to 2 places)."""
    return _touch_share(journey_ends(touches, c), "last_interaction", "last_touch")


def touch_attribution(touches: DataFrame, c: TouchCols = DEFAULT) -> DataFrame:
    """First- and last-touch rows together (model names differ, so no row is
    lost to the reference's UNION). One pass: each converted journey yields
    its first and its last channel, counted per model in one aggregate."""
    conv = journey_ends(touches, c).filter(F.col("conversion") == 1)
    both = conv.select(F.explode(F.array(
        F.struct(F.lit("first_touch").alias("m"), F.col("first_interaction").alias("ch")),
        F.struct(F.lit("last_touch").alias("m"), F.col("last_interaction").alias("ch")))).alias("x"))
    counts = both.groupBy(F.col("x.m").alias("attribution_model"), F.col("x.ch").alias("channel")).agg(
        F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy("attribution_model"))  # a few rows per model
    return counts.select("attribution_model", "channel",
                         F.round(F.col("__n") / total, 2).alias("attribution_percent"))
