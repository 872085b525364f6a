"""First-order Markov-chain attribution over customer journeys.

States are 'Start', the channels, and the absorbing 'Conversion' / 'Null'.
The matrix has at most (channels + 1) x (channels + 2) cells however many
touches produced it; joins with it carry no hint, adaptive execution sees its
size. A journey without any channel passes through the state ``NO_CHANNEL``.

Conversion probability from Start is computed two ways:

* ``simple_paths`` (default) - the sum, over paths from Start to Conversion
  that visit no state twice, of the product of transition probabilities.
  Paths that end in the same state after the same set of states go on alike,
  so the frontier holds one row per (state, visited set as bits of a long)
  with their summed probability: at most n * 2^n rows for n channels, not n!.
* ``absorbing`` - the absorption probability of the chain, by one solve of
  (I - Q) x = r in array expressions; cubic in the number of channels.

Removing channel c (the reference's rule): transitions out of c are dropped
and transitions into c go to 'Null'; nothing is renormalised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourglass.operators.journeys import (CONVERSION, DEFAULT, NULL_STATE, START, TouchCols,
                                          journey_ends)
from hourglass.operators.sequence import adjacent_pair_counts
from hourglass.session import reliable_checkpoint

NO_CHANNEL = "(no channel)"
TERMINAL = (CONVERSION, NULL_STATE)


def state_transitions(touches: DataFrame, c: TouchCols = DEFAULT) -> DataFrame:
    """Number of journeys' steps from each state to each next state.

    ``(start_state, end_state, transitions)`` - the reference's
    one-row-per-step view, aggregated. Steps between consecutive channels
    come from ``adjacent_pair_counts`` (skew-safe); the Start and terminal
    steps come from per-user ``min_by`` / ``max_by`` aggregates.
    """
    valid = touches.filter(F.col(c.channel).isNotNull())
    inner = adjacent_pair_counts(valid, c.user, [c.time, c.tie], c.channel).select(
        F.col("a").alias("start_state"), F.col("b").alias("end_state"), F.col("n"))
    ends = journey_ends(touches, c)
    end_state = F.when(F.col("conversion") == 1, F.lit(CONVERSION)).otherwise(F.lit(NULL_STATE))
    # Both edges of every journey from one pass over the per-user aggregate.
    edges = ends.select(F.explode(F.array(
        F.struct(F.lit(START).alias("start_state"), F.coalesce("first_interaction", F.lit(NO_CHANNEL)).alias("end_state")),
        F.struct(F.coalesce("last_interaction", F.lit(NO_CHANNEL)).alias("start_state"), end_state.alias("end_state")))).alias("x"))
    outer = edges.select("x.start_state", "x.end_state", F.lit(1).cast("long").alias("n"))
    return (inner.unionByName(outer)
            .groupBy("start_state", "end_state").agg(F.sum("n").alias("transitions")))


def transition_matrix(transitions: DataFrame) -> DataFrame:
    """P(end | start) = n(start -> end) / n(start -> any)."""
    total = F.sum("transitions").over(Window.partitionBy("start_state"))
    return transitions.select("start_state", "end_state",
                              (F.col("transitions") / total).alias("transition_probability"))


def transition_row_sums(matrix: DataFrame) -> DataFrame:
    """Check: each start state's probabilities sum to 1 (rounded to 2 places)."""
    return matrix.groupBy("start_state").agg(
        F.round(F.sum("transition_probability"), 2).alias("transition_probability_sum"))


def _only_listed(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """``df``, which raises where ``column`` holds a value (or a null) that is not listed."""
    listed = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    unknown = F.concat(F.lit(f"{column} is not listed: "), F.coalesce(F.col(column), F.lit("NULL")))
    return df.filter(F.when(listed, F.lit(True)).otherwise(F.raise_error(unknown).cast("boolean")))


def transition_pivot(matrix: DataFrame, end_states: list[str]) -> DataFrame:
    """Matrix as a table: one row per start state, one column per listed end state.

    An end state that is not listed raises: its column would be missing.
    """
    return _only_listed(matrix, "end_state", end_states).groupBy("start_state").pivot("end_state", end_states).agg(F.first("transition_probability"))


def removable_channels(matrix: DataFrame) -> DataFrame:
    """Every start state except Start."""
    return (matrix.select(F.col("start_state").alias("channel"))
            .filter(F.col("channel") != START).distinct())


def removed_matrix(matrix: DataFrame) -> DataFrame:
    """The matrix with each channel removed in turn, in long form.

    ``(removed_channel, start_state, end_state, transition_probability)``.
    The channel list is a scalar subquery (bounded by the state count), so
    each matrix row expands in place; no join with the channel table.
    """
    chans = (matrix.filter(F.col("start_state") != START)
             .agg(F.array_sort(F.collect_set("start_state"))).scalar())
    x = matrix.select("*", F.explode(chans).alias("removed_channel"))
    x = x.filter(F.col("start_state") != F.col("removed_channel"))
    return x.select("removed_channel", "start_state",
                    F.when(F.col("end_state") == F.col("removed_channel"), F.lit(NULL_STATE))
                    .otherwise(F.col("end_state")).alias("end_state"),
                    "transition_probability")


def _checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared storage): survives executor loss, cuts lineage."""
    return reliable_checkpoint(df)


# A visited set is the bits of a long; Start is not in it.
MASK_STATES = 62
# States of the one solve: its array holds twice their square in doubles.
SOLVE_STATES = 512


def _path_masks(matrix: DataFrame) -> tuple[DataFrame, list[str]]:
    """((visited long, probability double), states): simple paths to Conversion, merged by visited set.

    Bit i of ``visited`` is states[i]. States are numbered by one bounded
    sort; a path visits a state once, so as many steps as there are states
    reach every path. A step joins the frontier with the matrix, tests the
    next state's bit and sets it; paths that agree in (state, visited set) are
    merged at once, and those that have reached Conversion pass through. All
    steps are one plan without a loop over jobs.
    """
    stored = _checkpoint(matrix.filter(F.col("end_state") != NULL_STATE).select("start_state", "end_state", "transition_probability"))
    names = (stored.select(F.explode(F.array("start_state", "end_state")).alias("s"))
             .filter(~F.col("s").isin(START, *TERMINAL)).distinct().orderBy("s").limit(MASK_STATES + 1).collect())
    states = [r["s"] for r in names]
    if len(states) > MASK_STATES:
        raise ValueError(f"simple paths are kept for at most {MASK_STATES} states; use method='absorbing'")
    number = F.create_map(*[F.lit(x) for i, s in enumerate([*states, START, CONVERSION]) for x in (s, i)])
    goal, start = len(states) + 1, len(states)
    edges = stored.select(number[F.col("start_state")].alias("__from"), number[F.col("end_state")].alias("__to"),
                          F.col("transition_probability").alias("__p")).filter(f"__to <> {start}")
    bit = F.when(F.col("__to") == goal, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, __to)"))
    edges = edges.select("__from", "__to", bit.alias("__bit"), "__p").unionByName(
        matrix.sparkSession.createDataFrame([(goal, goal, 0, 1.0)], "__from int, __to int, __bit long, __p double"))
    frontier = edges.filter(F.col("__from") == start).select(
        F.col("__to").alias("state"), F.col("__bit").alias("visited"), F.col("__p").alias("probability"))
    for _ in states:
        frontier = (frontier.join(edges, F.col("state") == F.col("__from"))
                    .filter(F.col("visited").bitwiseAND(F.col("__bit")) == 0)
                    .groupBy(F.col("__to").alias("state"), F.col("visited").bitwiseOR(F.col("__bit")).alias("visited"))
                    .agg(F.sum(F.col("probability") * F.col("__p")).alias("probability")))
    return frontier.filter(F.col("state") == goal).select("visited", "probability"), states


def conversion_paths(matrix: DataFrame) -> DataFrame:
    """Simple paths Start -> ... -> Conversion, merged by the set of states they visit.

    ``(visited array<string>, probability double)``: the sorted states of the
    paths and their summed probability, at most 2^n rows for n states; raises
    above ``MASK_STATES`` states.
    """
    paths, states = _path_masks(matrix)
    seen = [F.when(F.expr(f"visited & shiftleft(1L, {i}) <> 0"), F.lit(s)) for i, s in enumerate(states)]
    return paths.select(F.array_sort(F.array_compact(F.array(F.lit(START), F.lit(CONVERSION), *seen))).alias("visited"), "probability")


def _conversion_total(paths: DataFrame) -> DataFrame:
    return paths.agg(F.coalesce(F.sum("probability"), F.lit(0.0)).alias("conversion_probability"))


def conversion_probability(matrix: DataFrame, method: str = "simple_paths") -> DataFrame:
    """One row: the probability of reaching Conversion from Start."""
    if method == "simple_paths":
        return _conversion_total(_path_masks(matrix)[0])
    if method == "absorbing":
        a = absorption_probabilities(matrix)
        return a.filter(F.col("removed_channel").isNull()).select("conversion_probability")
    raise ValueError(f"unknown method {method!r}")


def removal_effects(matrix: DataFrame, method: str = "simple_paths") -> DataFrame:
    """``(channel, removal_effect)``: relative drop in conversion probability
    when the channel is removed, rounded to 2 places.

    With simple paths, removing c deletes exactly the conversion paths
    through c (moves into c now end in Null), so the effect is the
    probability of the paths whose visited set has c's bit over the total: one
    aggregate over the path table, all channels at once.
    """
    if method == "simple_paths":
        matrix = _checkpoint(matrix)  # read by the numbering, the steps and the channel list
        paths, states = _path_masks(matrix)
        through = [F.sum(F.when(F.expr(f"visited & shiftleft(1L, {i}) <> 0"), F.col("probability"))).alias(f"__{i}") for i in range(len(states))]
        sums = paths.agg(F.sum("probability").alias("__total"), *through)
        pairs = F.array(*[F.struct(F.lit(s).alias("channel"), F.coalesce(f"__{i}", F.lit(0.0)).alias("part")) for i, s in enumerate(states)])
        per = sums.select("__total", F.explode(pairs).alias("x")).select("x.channel", F.try_divide("x.part", "__total").alias("effect")) if states else None
        chans = removable_channels(matrix)
        if per is None:
            return chans.select("channel", F.lit(None).cast("double").alias("removal_effect"))
        return chans.join(per, "channel", "left").select("channel", F.round("effect", 2).alias("removal_effect"))
    if method == "absorbing":
        a = _absorption(matrix).filter(F.col("removed_channel").isNotNull())
        return a.select(F.col("removed_channel").alias("channel"), F.round(F.try_divide(
            F.col("full") - F.col("conversion_probability"), F.col("full")), 2).alias("removal_effect"))
    raise ValueError(f"unknown method {method!r}")


def markov_attribution(effects: DataFrame) -> DataFrame:
    """Share of each channel: effect / sum of effects, rounded to 2 places.

    Shares are taken on the rounded effects, as the reference does, and in
    exact integer hundredths so that the rounding of a tie is well defined.
    """
    cents = F.round(F.col("removal_effect") * 100).cast("long")
    total = F.sum("__c").over(Window.partitionBy())  # one row per channel
    e = effects.select("channel", cents.alias("__c"))
    return e.select(F.lit("markov_chain").alias("attribution_model"), "channel",
                    F.round(F.try_divide(F.col("__c"), total), 2).alias("attribution_percent"))


def _absorption(matrix: DataFrame) -> DataFrame:
    """``(removed_channel, conversion_probability, full)``: one solve for the chain and all removals.

    With Q the moves between transient states and r the moves to Conversion,
    N = (I - Q)^-1 holds the expected visits and a = N r the absorption
    probabilities. Without channel c the probability from Start is
    a_Start - N_Start,c / N_c,c * a_c, as a path to Conversion through c
    passes its first visit. The matrix becomes one row (at most
    ``SOLVE_STATES`` states, else it raises); Gauss-Jordan elimination, the
    products and the removals are array expressions of that row.
    """
    rows = (matrix.groupBy("start_state", "end_state").agg(F.sum("transition_probability").alias("p"))
            .groupBy("start_state").agg(F.map_from_entries(F.collect_list(F.struct("end_state", "p"))).alias("to")))
    one = rows.agg(F.map_from_entries(F.collect_list(F.struct("start_state", "to"))).alias("m"))
    ends = F.flatten(F.transform(F.map_values("m"), F.map_keys))
    named = one.select("m", F.array_sort(F.array_except(F.array_distinct(F.concat(F.map_keys("m"), ends)),
                                                        F.array(*[F.lit(t) for t in TERMINAL]))).alias("states"))
    named = named.filter(F.when(F.size("states") > SOLVE_STATES, F.raise_error(F.lit(
        f"the chain has more than {SOLVE_STATES} states")).cast("boolean")).otherwise(F.size("states") > 0))
    p = lambda s, e: F.coalesce(F.try_element_at(F.try_element_at(F.col("m"), s), e), F.lit(0.0))
    unit = lambda i: lambda _, j: F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0))
    square = F.transform("states", lambda s, i: F.concat(
        F.transform("states", lambda e, j: F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0)) - p(s, e)),
        F.transform("states", unit(i))))
    start = named.select("m", "states", square.alias("a"), F.transform("states", lambda s: p(s, F.lit(CONVERSION))).alias("r"))

    def eliminate(a, k):
        pivot = F.when(F.get(F.get(a, k), k) > 1e-12, F.get(F.get(a, k), k)).otherwise(
            F.raise_error(F.lit("a state never leads to Conversion or Null: no absorption")).cast("double"))
        lead = F.transform(F.get(a, k), lambda x: x / pivot)
        return F.transform(a, lambda row, i: F.when(i == k, lead).otherwise(F.zip_with(row, lead, lambda x, y: x - F.get(row, k) * y)))

    solved = start.select("m", "states", "r", F.aggregate(F.sequence(F.lit(0), F.size("states") - 1), F.col("a"), eliminate).alias("a"))
    visits = solved.select("m", "states", "r", F.transform("a", lambda row: F.slice(row, F.size("states") + 1, F.size("states"))).alias("n"))
    dot = lambda row: F.aggregate(F.zip_with(row, F.col("r"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    reached = visits.select("m", "states", "n", F.transform("n", dot).alias("a"), (F.array_position("states", START) - 1).cast("int").alias("s"))
    full = F.coalesce(F.get("a", F.col("s")), F.lit(0.0))
    without = F.transform("states", lambda c, i: F.struct(
        c.alias("removed_channel"), (full - F.coalesce(F.get(F.get(F.col("n"), F.col("s")), i), F.lit(0.0))
                                     / F.get(F.get(F.col("n"), i), i) * F.get(F.col("a"), i)).alias("p")))
    removable = F.filter(without, lambda x: (x["removed_channel"] != START) & F.map_contains_key(F.col("m"), x["removed_channel"]))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("removed_channel"), full.alias("p")))
    return (reached.select(full.alias("full"), F.explode(F.concat(whole, removable)).alias("x"))
            .select("x.removed_channel", F.greatest(F.col("x.p"), F.lit(0.0)).alias("conversion_probability"), "full"))


def absorption_probabilities(matrix: DataFrame) -> DataFrame:
    """P(absorbed in Conversion | Start) for the full chain and for each
    channel removed: ``(removed_channel, conversion_probability)``, with
    ``removed_channel`` NULL for the full chain. One job; raises where a
    state leads to neither Conversion nor Null, or above ``SOLVE_STATES`` states.
    """
    return _absorption(matrix).select("removed_channel", "conversion_probability")


MODELS = ("first_touch", "last_touch", "markov_chain")


def attribution_compare(attribution: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """The listed models side by side: one row per channel, one column per model; another model raises."""
    return _only_listed(attribution, "attribution_model", list(models)).groupBy("channel").pivot("attribution_model", list(models)).agg(F.first("attribution_percent"))
