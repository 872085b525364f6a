
import datetime as dt
import math

import pandas as pd

from hourglass.operators import additive, demand, journeys, markov, metrics

T0 = dt.datetime(2021, 7, 1)


def test_mae_is_signed_and_mape_skips_zero_y(spark):
    fc = spark.createDataFrame([(1, T0, 2.0, 3.0), (1, T0.replace(hour=1), 2.0, 1.0),
                                (1, T0.replace(hour=2), 0.0, 1.0)],
                               "station_id int, ds timestamp_ntz, y double, yhat double")
    st = spark.createDataFrame([(1, T0, T0.replace(hour=23))],
                               "station_id int, start_date timestamp_ntz, end_date timestamp_ntz")
    r = metrics.forecast_errors(fc, st).first()
    assert abs(r.MAE - (1 - 1 + 1) / 3) < 1e-12          # mean signed error
    assert abs(r.MAD - 1.0) < 1e-12
    assert abs(r.MAPE - (0.5 + 0.5) / 3) < 1e-12         # y = 0 term skipped, still in n


def test_conversion_is_last_non_null_flag(spark):
    rows = [("u", "a", T0, 1, 1), ("u", "b", T0.replace(hour=1), 2, None)]
    t = spark.createDataFrame(rows, "infinity_id string, channelgrouping string, dt timestamp_ntz, "
                                    "tie long, conversion int")
    j = journeys.user_journeys(t).first()
    assert j.conversion == 1 and j.path == "Start > a > b > Conversion"
    e = journeys.journey_ends(t).first()
    assert e.conversion == 1 and e.last_interaction == "b"


def test_additive_group_with_one_row_gives_null_forecast():
    pdf = pd.DataFrame({"station_id": [7, 7], "ds": pd.to_datetime(["2021-01-01 00:00", "2021-01-01 01:00"]),
                        "y": [3.0, 0.0], "is_historical": [1, 0]})
    out = additive.fit_predict(pdf)
    assert len(out) == 2 and out["yhat"].isna().all()


def test_empty_inputs_give_empty_results(spark):
    trips = spark.createDataFrame([], "station_id int, start_time timestamp_ntz")
    r = demand.hourly_rentals(trips)
    st = demand.stations(r)
    assert r.count() == 0 and demand.stations_most_active(r, demand.stations_active(st, 7)).count() == 0


def test_channel_never_on_a_conversion_path_has_zero_effect(spark):
    m = spark.createDataFrame([("Start", "A", .5), ("Start", "B", .5), ("A", "Conversion", 1.0),
                               ("B", "Null", 1.0)],
                              "start_state string, end_state string, transition_probability double")
    eff = {r.channel: r.removal_effect for r in markov.removal_effects(m).collect()}
    assert eff == {"A": 1.0, "B": 0.0}
    shares = {r.channel: r.attribution_percent for r in markov.markov_attribution(markov.removal_effects(m)).collect()}
    assert shares == {"A": 1.0, "B": 0.0}
    assert not any(math.isnan(v) for v in eff.values())


def test_results_do_not_depend_on_session_time_zone(spark):
    from conftest import SF_SMALL
    from hourglass.plans import demand_queries as dq

    names = ["hourly_rentals", "stations", "sparsity_4h", "per_station_holiday"]

    def snapshot():
        return {n: sorted(tuple(r) for r in dq.QUERIES[n](spark, SF_SMALL).collect()) for n in names}

    utc = snapshot()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        other = snapshot()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == other
