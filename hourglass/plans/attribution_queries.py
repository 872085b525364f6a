"""Registered queries of the attribution side (pipeline B) over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourglass.operators import journeys, markov
from hourglass.plans.prepared import base_table
from hourglass.sources import fixtures
from hourglass.sources.sinks import upsert

PROB_PLACES = 10
ATTRIBUTION_KEYS = ["attribution_model", "channel"]


def touches(spark, sf):
    return fixtures.touches(spark, sf)


def transitions(spark, sf):
    """Transition counts (a few dozen rows; built once where the build step is run)."""
    return base_table(spark, sf, "transitions", lambda: markov.state_transitions(touches(spark, sf)))


def matrix(spark, sf):
    return markov.transition_matrix(transitions(spark, sf))


def q_visit_order(spark, sf):
    return journeys.visit_order(touches(spark, sf))


def q_user_journeys(spark, sf):
    return journeys.user_journeys(touches(spark, sf))


def q_first_touch(spark, sf):
    return journeys.first_touch(touches(spark, sf))


def q_last_touch(spark, sf):
    return journeys.last_touch(touches(spark, sf))


def q_touch_attribution(spark, sf):
    return journeys.touch_attribution(touches(spark, sf))


def q_state_transitions(spark, sf):
    return markov.state_transitions(touches(spark, sf))


def q_transition_matrix(spark, sf):
    return matrix(spark, sf)


def q_transition_row_sums(spark, sf):
    return markov.transition_row_sums(matrix(spark, sf))


END_STATES = [f"ch{i}" for i in range(fixtures.N_CHANNELS)] + [markov.NO_CHANNEL, markov.CONVERSION, markov.NULL_STATE]


def q_transition_pivot(spark, sf):
    return markov.transition_pivot(matrix(spark, sf), END_STATES)


def q_removed_matrix(spark, sf):
    return markov.removed_matrix(matrix(spark, sf))


def _probability(method):
    def q(spark, sf):
        p = markov.conversion_probability(matrix(spark, sf), method)
        return p.select(F.round("conversion_probability", PROB_PLACES).alias("conversion_probability"))
    return q


def _effects(method):
    def q(spark, sf):
        return markov.removal_effects(matrix(spark, sf), method)
    return q


def markov_shares(spark, sf):
    return markov.markov_attribution(markov.removal_effects(matrix(spark, sf)))


def q_markov_attribution(spark, sf):
    return markov_shares(spark, sf)


def upserted(spark, sf):
    """Prior table = heuristic rows + stale 'markov_chain' rows (the last-touch
    shares relabelled); the fresh Markov shares are merged into it."""
    t = touches(spark, sf)
    prior = journeys.touch_attribution(t)
    stale = journeys.last_touch(t).withColumn("attribution_model", F.lit("markov_chain"))
    return upsert(prior.unionByName(stale), markov_shares(spark, sf), ATTRIBUTION_KEYS)


def q_upsert_attribution(spark, sf):
    return upserted(spark, sf)


def q_attribution_compare(spark, sf):
    return markov.attribution_compare(upserted(spark, sf))


QUERIES = {
    "visit_order": q_visit_order,
    "user_journeys": q_user_journeys,
    "first_touch": q_first_touch,
    "last_touch": q_last_touch,
    "touch_attribution": q_touch_attribution,
    "state_transitions": q_state_transitions,
    "transition_matrix": q_transition_matrix,
    "transition_row_sums": q_transition_row_sums,
    "transition_pivot": q_transition_pivot,
    "removed_matrix": q_removed_matrix,
    "conversion_probability": _probability("simple_paths"),
    "conversion_probability_absorbing": _probability("absorbing"),
    "removal_effects": _effects("simple_paths"),
    "removal_effects_absorbing": _effects("absorbing"),
    "markov_attribution": q_markov_attribution,
    "upsert_attribution": q_upsert_attribution,
    "attribution_compare": q_attribution_compare,
}
