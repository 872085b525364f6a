"""All registered queries and their oracle SQL, keyed by name."""

from __future__ import annotations

from hourglass.plans import (attribution_oracles, attribution_queries, demand_oracles,
                             demand_queries, forecast_oracles, forecast_queries,
                             storage_oracles, storage_queries)

QUERIES = {}
QUERIES.update(demand_queries.QUERIES)
QUERIES.update(forecast_queries.QUERIES)
QUERIES.update(attribution_queries.QUERIES)
QUERIES.update(storage_queries.QUERIES)

ORACLES = {}
ORACLES.update(demand_oracles.ORACLES)
ORACLES.update(forecast_oracles.ORACLES)
ORACLES.update(attribution_oracles.ORACLES)
ORACLES.update(storage_oracles.ORACLES)

# The base tables, in the order in which the build step writes them.
BASE_TABLES = {
    "rentals": demand_queries.rentals,
    "history_rentals": demand_queries.history_rentals,
    "stations": demand_queries.stations,
    "periods": demand_queries.periods,
    "weather": forecast_queries.weather,
    "most_active": forecast_queries.most_active,
    "transitions": attribution_queries.transitions,
}
