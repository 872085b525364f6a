"""DuckDB oracles of the storage queries: what must be read back."""

from __future__ import annotations

from hourglass.plans import attribution_oracles
from hourglass.plans.demand_oracles import HIST, RENTALS, TRIPS, with_
from hourglass.plans.demand_queries import BAD_STATION_EVERY, BAD_TIME_EVERY
from hourglass.plans.storage_queries import BUSY, SHORT_LINE_EVERY, SPOILED_HOUR_EVERY

ORACLES = {
    "rejected_trips": f"""
WITH judged AS (
    SELECT event_id % {BAD_TIME_EVERY} = 0 OR ts IS NULL AS no_time, event_id % {BAD_STATION_EVERY} = 0 OR user_id IS NULL AS no_station FROM events
), named AS (
    SELECT CASE WHEN no_time AND no_station THEN 'station_id, start_time' WHEN no_time THEN 'start_time'
                WHEN no_station THEN 'station_id' ELSE 'accepted' END AS reason FROM judged
)
SELECT reason, CASE WHEN reason = 'accepted' THEN '' ELSE 'full' END AS folder, count(*) AS n FROM named GROUP BY reason
UNION ALL
SELECT 'fields', 'short', count(*) FROM events WHERE event_id % {SHORT_LINE_EVERY} = 0""",
    "rejected_weather": f"""
WITH hours AS (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events)
SELECT CASE WHEN spoiled THEN 'hour' ELSE 'accepted' END AS reason, CASE WHEN spoiled THEN 'full' ELSE '' END AS folder, count(*) AS n
FROM (SELECT hour(hour) % {SPOILED_HOUR_EVERY} = 3 AS spoiled FROM hours) x GROUP BY spoiled""",
    "created_tables": with_([TRIPS, RENTALS], f"SELECT station_id, SUM(rentals) AS rentals FROM rentals GROUP BY 1 HAVING SUM(rentals) >= {BUSY}"),
    "upsert_partitions": attribution_oracles.ORACLES["upsert_attribution"],
    "activity_by_month_and_year": with_(HIST, """
SELECT period, first_day, count(DISTINCT station_id) AS active_stations, sum(rentals) AS rentals FROM (
    SELECT unnest(['month', 'year']) AS period, unnest([CAST(date_trunc('month', hour) AS DATE), CAST(date_trunc('year', hour) AS DATE)]) AS first_day,
           station_id, rentals FROM rentals) x GROUP BY 1, 2"""),
    "lifespan_rentals": with_(HIST, """
SELECT r.* FROM rentals r JOIN (SELECT station_id, min(hour) AS start FROM rentals WHERE station_id % 50 = 0 GROUP BY 1) s
ON s.station_id = r.station_id AND r.hour BETWEEN s.start AND s.start + INTERVAL 40 DAY"""),
}
