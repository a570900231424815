"""Independent DuckDB SQL for the queries that run streams, over the whole tables at once."""

from __future__ import annotations

from pricewright.plans import oracles as o


def oracle_sql() -> dict[str, str]:
    results = "['WIN', 'LOSS', 'PUSH', 'VOID'][(bet_id // 2) % 4 + 1]"
    bets = f"SELECT bet_id, user_id, cents, american, CASE WHEN bet_id % 2 = 1 THEN 'PENDING' WHEN bet_id % 10 = 0 THEN 'PUSH' ELSE {results} END AS result, {results} AS first FROM positions"
    delta = o._delta("cents", "american", "result")
    paid = f"CASE WHEN result = 'WIN' THEN {o._cents('cents + ' + delta)} WHEN result IN ('PUSH', 'VOID') THEN {o._cents('cents')} WHEN result = 'LOSS' THEN 0 END"
    batch = o.batch_sql()
    feeds = "SELECT event_id AS id, event_type AS feed, ts - to_minutes(event_id % 5) AS source_updated_at, ts AS observed_at, ts + to_hours(event_id * 31 % 73) AS ingested_at FROM events"
    shown = "max(observed_at) OVER (PARTITION BY feed ORDER BY ingested_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    judged = f"SELECT *, coalesce(observed_at < {shown} - INTERVAL 12 HOUR, FALSE) AS late FROM ({feeds})"
    seconds = lambda a, b: f"max(epoch_us({a}) - epoch_us({b})) / 1e6"
    return {
        "incremental_recommendations": batch["recommendations"],
        "late_rows": f"SELECT id, feed, late FROM ({judged})",
        "feed_clocks": f"SELECT feed, count(*) AS n, count(*) FILTER (late) AS n_late, 0 AS n_clock_faults, {seconds('observed_at', 'source_updated_at')} AS source_lag, {seconds('ingested_at', 'observed_at')} AS ingest_lag FROM ({judged}) GROUP BY feed",
        "feed_sessions": "SELECT feed, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY feed ORDER BY ts, event_id) AS session FROM ("
            "SELECT event_type AS feed, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY feed, session",
        "update_guard_stream": o._sql(
            "SELECT bet_id, 'identity changed' AS violation, 'american' AS changed FROM positions WHERE result = 'PENDING' AND bet_id % 4 = 0 "
            "UNION ALL SELECT bet_id, 'settled without correction', 'result' FROM positions WHERE result NOT IN ('PENDING', 'VOID') AND bet_id % 3 = 0 AND NOT (bet_id % 6 = 0 AND bet_id % 11 <= 5)", "positions"),
        "ledger_stream": o._sql(f"SELECT bet_id, result, (bet_id % 10 = 0 AND first <> 'PUSH')::INT AS corrections, {delta}::DOUBLE AS delta, ({paid})::DOUBLE AS payout FROM ({bets})", "positions"),
        "ledger_stream_balances": o._sql(f"SELECT user_id, (10000 + sum(({delta})::DECIMAL(18, 2)))::DOUBLE AS balance FROM ({bets}) GROUP BY user_id", "positions"),
    }
