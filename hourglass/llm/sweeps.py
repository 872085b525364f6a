"""Successor sweeps: best-fit matching of lengths with gaps, in supersteps on Spark.

The state is a table of runs. A run of pieces (length, first rank, how many)
stands for equal lengths with consecutive ranks, a run of sequences (gap,
first sequence, how many) for equal gaps with consecutive numbers, so the
table follows the capacity and the number of sweeps, not the documents.

One sweep:

1. Lengths and gaps are put together and cut into ranges of size. Going from
   large to small, a gap opens places and a length takes them; the running
   sum, held at zero where lengths find no place, is the depth. It is a sum
   within each range plus the sums of the ranges before it.
2. Each run covers an interval of depths. At one depth, a length's successor
   (the smallest gap free that holds it) is the last gap opened there: no two
   lengths want the same place, as their ranks set their depths. Depths are cut
   into ranges too, and each range matches its runs by itself.
3. Where lengths of a run found no place, its matched sequences take equal
   shares of the rest, as many as fit.
4. The gaps shrink, and the runs left over go on.

At first as many sequences are open as the sum of all lengths needs. Lengths
go in classes (down to ``CLASS`` of the longest left, at last all up to ``LAST``
of the capacity), so that short pieces do not take what long ones need; a class sweeps until it is placed, and where
no gap holds its lengths, sequences for their sum are opened. Each sweep's
table is written, so lost executors repeat one sweep at most; the write also
observes what the next sweep needs to know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from hourglass.llm.common import Scratch

CLASS = 0.5
LAST = 0.25
# Ranges of size, and of depth, that a sweep deals over tasks.
RANGES = 64
# Tasks of a sweep's stages: the runs follow the capacity, whatever the number
# of shuffle partitions, and the driver keeps something of every task.
TASKS = 8
GAP, PIECE, PLACED = 0, 1, 2
RUNS = "kind int, size long, first long, many long, seq long, offset long, per long"


def place_runs(counts: DataFrame, scratch: Scratch, capacity: int) -> tuple[DataFrame, int]:
    """Placements of ``counts`` (size, many) and the number of sequences.

    A placement (size, first, many, seq, offset, per) puts the ranks from
    ``first`` on into ``many`` sequences from ``seq`` on, ``per`` in each,
    the first at ``offset``. No sequence stays empty.
    """
    spark = counts.sparkSession
    counts = scratch.put(counts.filter("many > 0"), "lengths")
    total, least = counts.agg(F.sum(F.col("size") * F.col("many")), F.min("size")).first()
    if total is None:
        return spark.createDataFrame([], RUNS), 0
    opened = -(-total // capacity)
    gaps = _run(spark, capacity, 0, opened)
    placed, upper = [], capacity + 1
    while True:
        longest = counts.filter(F.col("size") < upper).agg(F.max("size")).first()[0]
        if longest is None:
            break
        lower = int(longest * CLASS) if longest > capacity * LAST else 1
        fresh = counts.filter(F.col("size").between(lower, upper - 1))
        state = gaps.unionByName(fresh.select(F.lit(PIECE).alias("kind"), "size", F.lit(0).cast("long").alias("first"), "many",
                                              *[F.lit(0).cast("long").alias(c) for c in ("seq", "offset", "per")]))
        # A table of bounded size: without a shuffle. After a sweep its write has seen what is left.
        left = state.coalesce(1).agg(*_left(least)).first().asDict()
        while left["shortest"] is not None:
            free = left["free"] or 0
            if (left["widest"] or 0) < left["shortest"]:
                more = -(-left["ids"] // capacity)
                state = state.unionByName(_run(spark, capacity, opened, more))
                opened, free = opened + more, free + more
            seen = Observation()
            swept = scratch.put(_sweep(state, free, capacity).observe(seen, *_left(least)), "sweep")
            placed.append(swept.filter(F.col("kind") == PLACED))
            state = swept.filter((F.col("kind") == PIECE) | (F.col("kind") == GAP) & (F.col("size") >= least))
            left = seen.get
        gaps, upper = state.filter(F.col("kind") == GAP), lower
    out = placed[0]
    for df in placed[1:]:
        out = out.unionByName(df)
    return out.drop("kind"), opened


def _run(spark, size: int, first: int, many: int) -> DataFrame:
    return spark.createDataFrame([(GAP, size, first, many, 0, 0, 0)], RUNS)


def _left(least: int) -> list:
    """Aggregates over a state: the shortest piece, the widest gap that can hold any, how many such gaps, the pieces' ids."""
    piece, gap = F.col("kind") == PIECE, (F.col("kind") == GAP) & (F.col("size") >= least)
    return [F.min(F.when(piece, F.col("size"))).alias("shortest"), F.max(F.when(gap, F.col("size"))).alias("widest"),
            F.sum(F.when(gap, F.col("many"))).alias("free"),
            F.sum(F.when(piece, F.col("size") * F.col("many"))).alias("ids")]


def _depths(state: DataFrame, capacity: int) -> DataFrame:
    """Each run's depth before it (``start``) and after it (``stop``), from large to small, gaps first."""
    order = [F.col("size").desc(), F.col("kind"), F.col("first")]
    here = Window.partitionBy("reach").orderBy(*order)
    # ``many`` is the size of ``n``: the sums by range and the runs then share one shuffle.
    runs = (state.select("size", "kind", "first", F.floor(F.col("size") * RANGES / (capacity + 1)).alias("reach"),
                         F.when(F.col("kind") == GAP, F.col("many")).otherwise(-F.col("many")).alias("n"))
            .withColumn("inner", F.sum("n").over(here.rowsBetween(Window.unboundedPreceding, 0))))
    # One row per range of size, RANGES at most.
    each = runs.groupBy("reach").agg(F.sum("n").alias("n"), F.min("inner").alias("low")).coalesce(TASKS)
    down = Window.orderBy(F.col("reach").desc()).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("reach", "low", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("base"))
    each = each.select("reach", "base", F.min(F.col("base") + F.col("low")).over(down).alias("floor"))
    runs = (runs.withColumn("low", F.min("inner").over(here.rowsBetween(Window.unboundedPreceding, -1)))
            .join(F.broadcast(each), "reach"))
    # The sum of all before, lifted by the lengths that found no place.
    sunk = F.least(F.lit(0), F.col("floor"), F.col("base") + F.col("low"))
    before = F.col("base") + F.col("inner") - F.col("n")
    return (runs.withColumn("many", F.abs("n")).withColumn("start", before - sunk)
            .withColumn("stop", F.greatest(F.col("start") + F.col("n"), F.lit(0))))


def _sweep(state: DataFrame, free: int, capacity: int) -> DataFrame:
    """Runs left over, gaps that shrank, and placements of one sweep over ``free`` open sequences."""
    width = max(1, -(-free // RANGES))
    took = F.expr("start - stop")
    runs = (_depths(state, capacity)
            .withColumn("took", F.when(F.col("kind") == PIECE, took).otherwise(F.lit(0)))
            .withColumn("stride", F.expr("if(took > 0, many div took, 1)"))
            .withColumn("lo", F.least("start", "stop")).withColumn("hi", F.greatest("start", "stop"))
            # Numbers rise as depths fall, for ranks and for sequences alike.
            .withColumn("parts", F.expr(f"""concat(
                if(hi > lo, transform(sequence(lo div {width}, (hi - 1) div {width}), r -> named_struct(
                    'span', r, 'lo', greatest(lo, r * {width}), 'hi', least(hi, (r + 1) * {width}),
                    'at', first + (hi - least(hi, (r + 1) * {width})) * stride, 'many', 0L)), array()),
                if(kind = {PIECE} and many > took * stride, array(named_struct(
                    'span', -1L, 'lo', 0L, 'hi', 0L, 'at', first + took * stride, 'many', many - took * stride)), array()))"""))
            .select("size", "kind", "stride", "first", F.explode("parts").alias("p"))
            .select("size", "kind", "stride", "first", "p.*").coalesce(TASKS))

    def match(pdf):
        import pandas as pd

        rows: list[tuple] = []
        if pdf["span"].iat[0] < 0:
            rows = [(PIECE, size, at, many, 0, 0, 0) for size, at, many in pdf[["size", "at", "many"]].itertuples(index=False)]
        else:
            pdf = pdf.sort_values(["size", "kind", "first"], ascending=[False, True, True])
            open_: list[list[int]] = []               # [gap, number at the top, lowest depth, top]
            for size, kind, stride, at, lo, hi in pdf[["size", "kind", "stride", "at", "lo", "hi"]].itertuples(index=False):
                if kind == GAP:
                    open_.append([size, at, lo, hi])
                while kind == PIECE and hi > lo:
                    gap, seq, bottom, _ = top = open_[-1]
                    many = min(hi - lo, hi - bottom)
                    per = min(gap // size, stride)
                    rows.append((PLACED, size, at, many, seq, capacity - gap, per))
                    if stride > per:
                        rows.append((PIECE, size, at + many * per, many * (stride - per), 0, 0, 0))
                    if gap > per * size:
                        rows.append((GAP, gap - per * size, seq, many, 0, 0, 0))
                    at, hi = at + many * stride, hi - many
                    top[1], top[3] = seq + many, hi
                    if hi == bottom:
                        open_.pop()
            rows += [(GAP, gap, seq, top - bottom, 0, 0, 0) for gap, seq, bottom, top in open_]
        return pd.DataFrame(rows, columns=["kind", "size", "first", "many", "seq", "offset", "per"])

    return runs.groupBy("span").applyInPandas(match, RUNS).coalesce(TASKS)
