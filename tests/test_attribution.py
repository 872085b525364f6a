"""Journeys, heuristic shares and the Markov chain: invariants and edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from hourglass.operators import journeys, markov
from hourglass.operators.sequence import adjacent_pair_counts
from hourglass.plans import attribution_queries as aq
from hourglass.sources.sinks import upsert


def _touches(spark, rows):
    return spark.createDataFrame(rows, "infinity_id string, channelgrouping string, dt timestamp_ntz, "
                                       "tie long, conversion int")


T0 = dt.datetime(2021, 7, 1)


def test_journey_paths_order_ties_and_nulls(spark):
    rows = [("u1", "b", T0, 2, 0), ("u1", "a", T0, 1, 0), ("u1", None, T0.replace(hour=1), 3, 0),
            ("u1", "c", T0.replace(hour=2), 4, 1),
            ("u2", "a", T0, 5, 0)]
    j = {r.uid: r for r in journeys.user_journeys(_touches(spark, rows)).collect()}
    assert j["u1"].path == "Start > a > b > c > Conversion"
    assert j["u1"].first_interaction == "a" and j["u1"].last_interaction == "c"
    assert j["u1"].conversion == 1 and j["u1"].visiting_order == [1, 1, 2, 3]   # equal times share a rank
    assert j["u2"].path == "Start > a > Null"          # single-touch journey


def test_transitions_match_journey_paths(spark):
    t = aq.touches(spark, SF_SMALL)
    st = {(r.start_state, r.end_state): r.transitions for r in markov.state_transitions(t).collect()}
    expect = {}
    for r in journeys.user_journeys(t).collect():
        s = [x.strip() or markov.NO_CHANNEL for x in r.path.split(">")]
        for a, b in zip(s, s[1:]):
            expect[(a, b)] = expect.get((a, b), 0) + 1
    assert st == expect


def test_adjacent_pairs_under_skew(spark):
    # one user holds most rows and is spread over many range partitions
    rows = [("hot", f"c{i % 3}", T0 + dt.timedelta(minutes=i), i, 0) for i in range(3000)]
    rows += [(f"u{i}", f"c{i % 2}", T0 + dt.timedelta(minutes=i), 10_000 + i, 0) for i in range(200)]
    rows += [(f"u{i}", "c9", T0 + dt.timedelta(minutes=i, seconds=1), 20_000 + i, 0) for i in range(200)]
    t = _touches(spark, rows)
    got = {(r.a, r.b): r.n for r in adjacent_pair_counts(t, "infinity_id", ["dt", "tie"], "channelgrouping").collect()}
    w = Window.partitionBy("infinity_id").orderBy("dt", "tie")
    ref = (t.withColumn("nx", F.lead("channelgrouping").over(w)).filter(F.col("nx").isNotNull())
           .groupBy("channelgrouping", "nx").count().collect())
    assert got == {(r[0], r[1]): r[2] for r in ref}


def test_matrix_rows_sum_to_one_and_absorbing_equals_conversion_share(spark):
    t = aq.touches(spark, SF_SMALL)
    m = markov.transition_matrix(markov.state_transitions(t))
    sums = m.groupBy("start_state").agg(F.sum("transition_probability").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-12 for r in sums)
    ab = markov.conversion_probability(m, "absorbing").first()[0]
    sp = markov.conversion_probability(m, "simple_paths").first()[0]
    ends = journeys.journey_ends(t)
    share = ends.filter(F.col("conversion") == 1).count() / ends.count()
    assert abs(ab - share) < 1e-12
    assert sp <= ab + 1e-15


def test_removal_effects_and_shares(spark):
    m = aq.matrix(spark, SF_SMALL)
    eff = markov.removal_effects(m).collect()
    assert eff and all(0.0 <= r.removal_effect <= 1.0 for r in eff)
    shares = markov.markov_attribution(markov.removal_effects(m)).collect()
    assert abs(sum(r.attribution_percent for r in shares) - 1.0) <= 0.01 * len(shares)


def test_simple_paths_on_small_graph_by_hand(spark):
    # Start->A .5, Start->B .5, A->B .5, A->Conv .5, B->A .5, B->Null .5
    m = spark.createDataFrame([("Start", "A", .5), ("Start", "B", .5), ("A", "B", .5), ("A", "Conversion", .5),
                               ("B", "A", .5), ("B", "Null", .5)],
                              "start_state string, end_state string, transition_probability double")
    p = markov.conversion_probability(m).first()[0]
    assert abs(p - 0.375) < 1e-15                           # simple-path sum
    assert abs(markov.conversion_probability(m, "absorbing").first()[0] - 0.5) < 1e-12
    eff = {r.channel: r.removal_effect for r in markov.removal_effects(m).collect()}
    # without A nothing converts; without B only Start->A->Conv (.25)
    assert eff == {"A": 1.0, "B": round((0.375 - 0.25) / 0.375, 2)}


def test_first_last_shares_sum_to_one_before_rounding(spark):
    t = aq.touches(spark, SF_SMALL)
    ends = journeys.journey_ends(t).filter(F.col("conversion") == 1)
    n = ends.count()
    for col in ("first_interaction", "last_interaction"):
        assert sum(r[1] for r in ends.groupBy(col).count().collect()) == n


def test_upsert_semantics(spark):
    schema = "attribution_model string, channel string, attribution_percent double"
    target = spark.createDataFrame([("m", "a", 0.1), ("m", "b", 0.2), ("other", "a", 0.9)], schema)
    source = spark.createDataFrame([("m", "a", 0.5), ("m", "c", 0.3)], schema)
    keys = ["attribution_model", "channel"]
    out = {(r[0], r[1]): r[2] for r in upsert(target, source, keys).collect()}
    assert out == {("m", "a"): 0.5, ("m", "b"): 0.2, ("m", "c"): 0.3, ("other", "a"): 0.9}
    again = {(r[0], r[1]): r[2] for r in upsert(upsert(target, source, keys), source, keys).collect()}
    assert again == out                                          # idempotent
    dup = spark.createDataFrame([("m", "a", 0.5), ("m", "a", 0.6)], schema)
    with pytest.raises(Exception):
        upsert(target, dup, keys).collect()


def test_segmented_ranks_and_journeys_under_skew(spark):
    # a hot user over many range partitions, with equal times straddling them
    rows = [("hot", f"c{i % 4}", T0 + dt.timedelta(minutes=i // 3), i, int(i == 2999)) for i in range(3000)]
    rows += [(f"u{i}", "c1", T0 + dt.timedelta(minutes=i), 10_000 + i, 0) for i in range(300)]
    t = _touches(spark, rows)
    w = Window.partitionBy("infinity_id").orderBy("dt")
    ref = {(r.tie, r.vo) for r in t.select("tie", F.dense_rank().over(w).alias("vo")).collect()}
    got = {(r.tie, r.visit_order) for r in journeys.visit_order(t).collect()}
    assert got == ref
    j = {r.uid: r for r in journeys.user_journeys(t).collect()}
    hot = j["hot"]
    assert hot.visiting_order == [i // 3 + 1 for i in range(3000)]
    assert hot.path == "Start > " + " > ".join(f"c{i % 4}" for i in range(3000)) + " > Conversion"
    assert hot.first_interaction == "c0" and hot.last_interaction == f"c{2999 % 4}" and hot.conversion == 1
    assert j["u7"].path == "Start > c1 > Null" and j["u7"].visiting_order == [1]


def test_users_without_channels_count_in_the_shares(spark):
    rows = [("u1", "a", T0, 1, 1), ("u2", None, T0, 2, 1)]
    t = _touches(spark, rows)
    for shares in (journeys.first_touch(t), journeys.last_touch(t)):
        assert {r.channel: r.attribution_percent for r in shares.collect()} == {"a": 0.5, None: 0.5}
    steps = {(r.start_state, r.end_state): r.transitions for r in markov.state_transitions(t).collect()}
    assert steps == {("Start", "a"): 1, ("a", "Conversion"): 1, ("Start", markov.NO_CHANNEL): 1, (markov.NO_CHANNEL, "Conversion"): 1}


def _full_graph(spark, n):
    states = [f"c{i}" for i in range(n)]
    rows = [("Start", s, 1 / n) for s in states]
    for i, s in enumerate(states):
        others = [x for x in states if x != s] + ["Conversion", "Null"]
        weight = [1 + (i * 7 + k * 3) % 5 for k in range(len(others))]
        rows += [(s, x, w / sum(weight)) for x, w in zip(others, weight)]
    return rows, spark.createDataFrame(rows, "start_state string, end_state string, transition_probability double")


def _walk(matrix, removed=None):
    out = {}
    for a, b, p in matrix:
        if a != removed:
            out.setdefault(a, []).append(("Null" if b == removed else b, p))

    def go(state, seen):
        if state == "Conversion":
            return 1.0
        return sum(p * go(b, seen | {b}) for b, p in out.get(state, ()) if b not in seen)
    return go("Start", {"Start"})


def test_merged_paths_equal_plain_enumeration(spark):
    rows, m = _full_graph(spark, 6)
    full = _walk(rows)
    assert abs(markov.conversion_probability(m).first()[0] - full) < 1e-12
    effects = {r.channel: r.removal_effect for r in markov.removal_effects(m).collect()}
    for c, e in effects.items():
        assert abs(e - (full - _walk(rows, c)) / full) <= 0.005 + 1e-9


def test_twelve_channels_finish(spark):
    _, m = _full_graph(spark, 12)
    p = markov.conversion_probability(m).first()[0]
    assert 0 < p <= 1 and markov.conversion_paths(m).count() < 12 * 2 ** 12


def test_fifteen_channels_by_bit_sets(spark):
    rows, m = _full_graph(spark, 15)
    n = [f"c{i}" for i in range(15)]
    p = {(a, b): x for a, b, x in rows}
    # The same sums over subsets, state by state: f[set][last].
    f = {(1 << i, i): p[("Start", c)] for i, c in enumerate(n)}
    total = 0.0
    for size in range(15):
        step = {}
        for (mask, i), x in f.items():
            total += x * p[(n[i], "Conversion")]
            for j in range(15):
                if not mask >> j & 1:
                    key = (mask | 1 << j, j)
                    step[key] = step.get(key, 0.0) + x * p[(n[i], n[j])]
        f = step
    assert abs(markov.conversion_probability(m).first()[0] - total) < 1e-10


def test_too_many_states_for_bit_sets_raise(spark):
    m = spark.range(70).selectExpr("'Start' AS start_state", "concat('c', id) AS end_state", "1 / 70D AS transition_probability")
    m = m.unionByName(spark.range(70).selectExpr("concat('c', id) AS start_state", "'Conversion' AS end_state", "1D AS transition_probability"))
    with pytest.raises(ValueError, match="at most 62"):
        markov.conversion_probability(m)
    assert abs(markov.conversion_probability(m, "absorbing").first()[0] - 1) < 1e-9


def test_one_solve_equals_chains_with_a_channel_removed(spark):
    rows, m = _full_graph(spark, 30)
    got = {r.removed_channel: r.conversion_probability for r in markov.absorption_probabilities(m).collect()}
    names = ["Start"] + [f"c{i}" for i in range(30)]
    for removed in (None, "c0", "c17", "c29"):
        kept = [s for s in names if s != removed]
        at = {s: i for i, s in enumerate(kept)}
        q, r = np.zeros((len(kept), len(kept))), np.zeros(len(kept))
        for a, b, x in rows:
            if a in at and b in at:
                q[at[a], at[b]] += x
            elif a in at and b == "Conversion":
                r[at[a]] += x
        assert abs(np.linalg.solve(np.eye(len(kept)) - q, r)[0] - got[removed]) < 1e-12
    assert len(got) == 31


def test_chain_without_absorption_raises(spark):
    m = spark.createDataFrame([("Start", "A", 1.0), ("A", "B", 1.0), ("B", "A", 1.0)],
                              "start_state string, end_state string, transition_probability double")
    with pytest.raises(Exception, match="no absorption"):
        markov.absorption_probabilities(m).collect()
    assert markov.conversion_probability(m).first()[0] == 0.0
    assert markov.absorption_probabilities(m.limit(0)).collect() == []
    assert markov.removal_effects(m.limit(0)).collect() == []


def test_pivots_raise_on_values_that_are_not_listed(spark):
    m = spark.createDataFrame([("Start", "A", 1.0), ("A", "Conversion", 1.0)], "start_state string, end_state string, transition_probability double")
    assert markov.transition_pivot(m, ["A", "Conversion", "Null"]).count() == 2
    with pytest.raises(Exception, match="not listed: Conversion"):
        markov.transition_pivot(m, ["A"]).collect()
    shares = spark.createDataFrame([("first_touch", "a", 1.0), ("own_model", "a", 1.0)], "attribution_model string, channel string, attribution_percent double")
    with pytest.raises(Exception, match="not listed: own_model"):
        markov.attribution_compare(shares).collect()
    assert markov.attribution_compare(shares, ("first_touch", "own_model")).first().own_model == 1.0


def test_upsert_check_cannot_be_pruned_and_is_merge_exact(spark, scratch_dir):
    from hourglass.sources.sinks import upsert_table

    schema = "k string, v int, p double"
    target = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.2)], schema)
    clash = spark.createDataFrame([("a", 2, 0.5), ("a", 3, 0.6)], schema)
    for act in (lambda d: d.count(), lambda d: d.select("p").collect(), lambda d: d.select(F.lit(1)).collect()):
        with pytest.raises(Exception, match="several source rows"):
            act(upsert(target, clash, ["k"]))
    twice = spark.createDataFrame([("new", 2, 0.5), ("new", 3, 0.6)], schema)
    assert upsert(target, twice, ["k"]).count() == 4            # no target row matches: both are inserted
    path = f"{scratch_dir}/t"
    target.write.parquet(path)
    source = spark.createDataFrame([("b", 9, 0.9), ("c", 9, 0.9)], schema)
    assert {(r.k, r.v) for r in upsert_table(source, path, ["k"]).collect()} == {("a", 1), ("b", 9), ("c", 9)}
    assert {(r.k, r.v) for r in upsert_table(source, path, ["k"]).collect()} == {("a", 1), ("b", 9), ("c", 9)}
