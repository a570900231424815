"""Independent DuckDB SQL for the queries of the catalogue.

Each statement is written from the definition of the result, mostly by another route than the
Spark plan: correlated subqueries, windows, ASOF joins and recursive sums instead of
``max_by`` aggregates, hash-aggregated outcomes and two-level sums.
"""

from __future__ import annotations

from pricewright.sources.reference import STADIUMS, TEAMS

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_CUT = "TIMESTAMP '2024-01-16 00:00:00'"


def _dec(a: str) -> str:
    return f"(CASE WHEN {a} > 0 THEN 1 + {a} / 100.0::DOUBLE ELSE 1 + 100.0::DOUBLE / abs({a}) END)"


def _imp(a: str) -> str:
    return f"(CASE WHEN {a} > 0 THEN 100.0::DOUBLE / ({a} + 100) ELSE abs({a})::DOUBLE / (abs({a}) + 100) END)"


def _fair(p: str) -> str:
    return f"(CASE WHEN {p} <= 0.5 THEN floor(100 * (1 - {p}) / {p} + 0.5) ELSE floor(-100 * {p} / (1 - {p}) + 0.5) END)::BIGINT"


def _cents(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def _delta(stake: str, a: str, result: str) -> str:
    return f"(CASE {result} WHEN 'WIN' THEN {_cents(f'{stake} * ({_dec(a)} - 1)')} WHEN 'LOSS' THEN -({stake}) ELSE 0 END)"


def _erf(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({z})))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"(sign({z}) * (1 - {poly} * exp(-({z}) * ({z}))))"


def _above_zero(mu: str, sd: str) -> str:
    """Probability that a normal variable is above zero."""
    return f"(0.5 * (1 + {_erf(f'(({mu}) / ({sd}) / sqrt(2.0))')}))"


def _age(at: str) -> str:
    return f"(epoch_us({_NOW} - {at}) / 6e7)"


_BOOST = "(CASE abs(v) WHEN 3 THEN 2.1 WHEN 7 THEN 1.75 WHEN 6 THEN 1.35 WHEN 10 THEN 1.3 WHEN 4 THEN 1.2 WHEN 14 THEN 1.2 WHEN 17 THEN 1.1 ELSE 1 END)"
_OUTCOMES = "range(1, 46) || list_transform(range(1, 46), lambda x: -x)"


def _pdf(v: str, mu: str, sd: str) -> str:
    return f"(exp(-0.5 * (({v} - {mu}) / {sd}) * (({v} - {mu}) / {sd})) / ({sd} * sqrt(2 * pi())))"


_VIEWS = {
    "quotes": """
      SELECT user_id AS game_id, CASE event_type WHEN 'click' THEN 'SPREAD' WHEN 'view' THEN 'TOTAL' ELSE 'MONEYLINE' END AS market,
             ts AS observed_at, event_id AS seq, floor(value / 10 * 2 + 0.5) / 2 - 10 AS line,
             CASE WHEN k < 50 THEN -(100 + k) ELSE 50 + k END AS home_american,
             CASE WHEN 99 - k < 50 THEN -(199 - k) ELSE 149 - k END AS away_american,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS is_opening
      FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k FROM events)
      WHERE event_type IN ('click', 'view', 'purchase')""",
    "projection": """
      SELECT p_partkey AS part_id, (p_size - 25) / 3.0::DOUBLE AS mu, 10 + (p_retailprice - 900) / 20 AS sd, 38 + p_size / 3.0::DOUBLE AS total
      FROM part""",
    "margins": f"""
      SELECT part_id, v, w / sum(w) OVER (PARTITION BY part_id) AS probability
      FROM (SELECT part_id, v, {_pdf('v', 'mu', 'sd')} * {_BOOST} AS w FROM (SELECT *, unnest({_OUTCOMES}) AS v FROM projection))""",
    "totals": f"""
      SELECT part_id, v, w / sum(w) OVER (PARTITION BY part_id) AS probability
      FROM (SELECT part_id, v, {_pdf('v', 'total', 'sd')} AS w FROM (SELECT *, unnest(range(10, 91)) AS v FROM projection))""",
    "predictions": f"""
      SELECT part_id AS game_id, part_id % 5 AS model_id, mu, sd, total, sd * 0.75 AS total_sd,
             (80 + p_size % 20) / 100.0::DOUBLE AS completeness, {_above_zero('mu', '13.2')} AS home_win
      FROM projection JOIN part ON part_id = p_partkey""",
    "games": """
      SELECT p_partkey AS game_id, p_partkey % 25 AS home_team, (p_partkey + 7) % 25 AS away_team,
             ['OUTDOOR', 'RETRACTABLE_OPEN', 'DOME', 'RETRACTABLE_CLOSED'][p_size % 4 + 1] AS roof,
             TIMESTAMP '2024-01-31 00:00:00' + to_hours(p_size) AS kickoff
      FROM part WHERE p_partkey IN (SELECT game_id FROM quotes)""",
    "manual": """
      SELECT o_orderkey AS seq, o_custkey AS game_id, ['SPREAD', 'TOTAL', 'MONEYLINE'][o_orderkey % 3 + 1] AS market,
             CASE WHEN o_orderkey % 3 = 1 THEN ['OVER', 'UNDER'][(o_orderkey // 3) % 2 + 1] ELSE ['HOME', 'AWAY'][(o_orderkey // 3) % 2 + 1] END AS selection,
             CASE WHEN o_orderkey % 2 = 0 THEN -(100 + o_orderkey % 60) ELSE 100 + o_orderkey % 60 END AS american,
             TIMESTAMP '2024-01-31 00:00:00' - to_minutes(o_orderkey % 240) AS entered_at, o_orderstatus <> 'P' AS confirmed
      FROM orders""",
    "availability": """
      SELECT l_partkey AS game_id, l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS player_id, ['QB', 'LT', 'C', 'WR', 'RB', 'TE', 'CB'][l_linenumber] AS position,
             CASE WHEN l_quantity > 49 THEN 1 - l_discount * 9 ELSE 1.0::DOUBLE END AS p, l_quantity / 10 AS impact
      FROM lineitem""",
    "weather": f"""
      SELECT s_suppkey AS game_id, floor(abs(s_acctbal) / 400) AS wind,
             CASE WHEN floor(abs(s_acctbal) / 400) >= 18 THEN 'HIGH'
                  WHEN floor(abs(s_acctbal) / 400) >= 12 OR (s_suppkey % 10) / 10.0::DOUBLE > 0.4 THEN 'MODERATE' ELSE 'LOW' END AS severity
      FROM supplier""",
    "failures": "SELECT DISTINCT user_id AS game_id FROM events WHERE event_type = 'error' AND value > 200",
    "injuries": """
      SELECT event_id AS report_id, user_id AS game_id, event_id % 50 AS team_id, value / 500 AS p,
             ['QB', 'LT', 'C', 'WR', 'RB', 'TE', 'CB'][event_id % 7 + 1] AS position, value
      FROM events WHERE event_type = 'signup'""",
    "forecasts": f"""
      SELECT seq, segment, p, (s = 'F')::INT AS outcome, s = 'P' AS push, american, edge, ((seq % 21) - 10) / 10.0::DOUBLE AS clv,
             CASE WHEN edge > 0 THEN cents ELSE 0 END::DECIMAL(18,2) AS stake,
             CASE WHEN edge > 0 THEN {_delta('cents', 'american', "CASE s WHEN 'P' THEN 'PUSH' WHEN 'F' THEN 'WIN' ELSE 'LOSS' END")} ELSE 0 END::DECIMAL(18,2) AS profit,
             seq % 5 <> 0 AS within80,
             CASE WHEN edge >= 0.03 THEN 'BET' WHEN edge >= 0.01 THEN 'WATCH' WHEN seq % 12 = 0 THEN 'DATA INCOMPLETE' ELSE 'PASS' END AS status
      FROM (SELECT *, p - 1 / {_dec('american')} AS edge FROM (
        SELECT o_orderkey AS seq, c_mktsegment AS segment, greatest(0.1, least(0.9, o_totalprice / 500000)) AS p, o_orderstatus AS s,
               CASE WHEN o_orderkey % 2 = 0 THEN -(100 + o_orderkey % 60) ELSE 100 + o_orderkey % 60 END AS american,
               floor(o_totalprice / 1000 * 100 + 0.5) / 100 AS cents
        FROM orders JOIN customer ON o_custkey = c_custkey))""",
    "positions": f"""
      SELECT *, coalesce({_delta('cents', 'american', 'result')}, 0)::DECIMAL(18,2) AS delta, cents::DECIMAL(18,2) AS stake FROM (
        SELECT o_orderkey AS bet_id, o_custkey AS user_id, o_custkey AS game_id, ['SPREAD', 'TOTAL', 'MONEYLINE'][(o_orderkey // 2) % 3 + 1] AS market,
               CASE WHEN o_orderkey % 2 = 0 THEN -(100 + o_orderkey % 60) ELSE 100 + o_orderkey % 60 END AS american,
               floor(o_totalprice / 1000 * 100 + 0.5) / 100 AS cents, c_nationkey AS team, n_regionkey AS cluster, o_orderdate AS settled_at,
               CASE o_orderstatus WHEN 'F' THEN CASE WHEN (o_orderkey // 7) % 2 = 0 THEN 'WIN' ELSE 'LOSS' END WHEN 'P' THEN 'PUSH' ELSE 'PENDING' END AS result
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "latest": f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, market ORDER BY observed_at DESC, seq DESC) AS rn FROM quotes WHERE observed_at <= {_NOW}) WHERE rn = 1""",
    "latest_manual": f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, market, selection ORDER BY entered_at DESC, seq DESC) AS rn
                     FROM manual WHERE confirmed AND entered_at <= {_NOW}) WHERE rn = 1""",
    "sides": f"""
      SELECT l.game_id, l.market, s.selection, s.rank, CASE WHEN l.market = 'SPREAD' AND l.line = 0 THEN 0 WHEN l.market = 'SPREAD' THEN l.line * s.direction WHEN l.market = 'TOTAL' THEN l.line + 45 END AS line,
             (CASE WHEN s.first THEN l.home_american ELSE l.away_american END)::BIGINT AS quoted,
             CASE WHEN s.first THEN {_imp('l.home_american')} ELSE {_imp('l.away_american')} END / ({_imp('l.home_american')} + {_imp('l.away_american')}) AS market_p,
             CASE l.market WHEN 'MONEYLINE' THEN CASE WHEN s.first THEN home_win ELSE 1 - home_win END
               WHEN 'SPREAD' THEN CASE WHEN s.first THEN m.up ELSE greatest(0, 1 - m.up - m.at) END
               ELSE CASE WHEN s.first THEN t.up ELSE greatest(0, 1 - t.up - t.at) END END AS model_p,
             CASE l.market WHEN 'MONEYLINE' THEN 0 WHEN 'SPREAD' THEN m.at ELSE t.at END AS push_p
      FROM latest l JOIN predictions p USING (game_id)
      JOIN (VALUES ('SPREAD', 'HOME', 0, true, 1), ('SPREAD', 'AWAY', 1, false, -1), ('TOTAL', 'OVER', 2, true, 1), ('TOTAL', 'UNDER', 3, false, 1),
                   ('MONEYLINE', 'HOME', 4, true, 1), ('MONEYLINE', 'AWAY', 5, false, 1)) s(market, selection, rank, first, direction) USING (market)
      LEFT JOIN (SELECT q.game_id, sum(w) FILTER (v + q.line > 1e-9) / sum(w) AS up, coalesce(sum(w) FILTER (abs(v + q.line) < 1e-9), 0) / sum(w) AS at
                 FROM (SELECT game_id, unnest({_OUTCOMES}) AS v, mu, sd FROM predictions) o JOIN latest q ON q.game_id = o.game_id AND q.market = 'SPREAD',
                      LATERAL (SELECT {_pdf('v', 'mu', 'sd')} * {_BOOST} AS w) GROUP BY q.game_id) m ON m.game_id = l.game_id
      LEFT JOIN (SELECT q.game_id, coalesce(sum(w) FILTER (v - q.line - 45 > 1e-9), 0) / sum(w) AS up, coalesce(sum(w) FILTER (abs(v - q.line - 45) < 1e-9), 0) / sum(w) AS at
                 FROM (SELECT game_id, unnest(range(10, 91)) AS v, total, total_sd FROM predictions) o JOIN latest q ON q.game_id = o.game_id AND q.market = 'TOTAL',
                      LATERAL (SELECT {_pdf('v', 'total', 'total_sd')} AS w) GROUP BY q.game_id) t ON t.game_id = l.game_id
      WHERE l.market = 'MONEYLINE' OR l.line IS NOT NULL""",
    "priced": f"""
      SELECT *, conservative_p - break_even_p AS edge, conservative_p * ({_dec('american')} - 1) - (1 - conservative_p - push_p) AS ev,
             {_fair('least(0.985, greatest(0.015, conservative_p))')} AS fair_american
      FROM (SELECT *, model_p * 0.65 + market_p * 0.35 AS conservative_p, (1 - push_p) / {_dec('american')} AS break_even_p
            FROM (SELECT s.*, coalesce(m.american, s.quoted)::BIGINT AS american, m.seq AS manual_id, m.entered_at AS manual_at
                  FROM sides s LEFT JOIN latest_manual m USING (game_id, market, selection)))""",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY edge DESC, rank) AS rn FROM priced) WHERE rn = 1",
    "movement": """
      SELECT game_id, market, n.line - o.line AS line_move,
             coalesce(n.seq <> o.seq AND CASE market WHEN 'MONEYLINE' THEN nh < oh - 0.003 WHEN 'SPREAD' THEN n.line - o.line >= 0.5 ELSE n.line - o.line <= -0.5 END, false) AS toward_first,
             coalesce(n.seq <> o.seq AND CASE market WHEN 'MONEYLINE' THEN na < oa - 0.003 WHEN 'SPREAD' THEN n.line - o.line <= -0.5 ELSE n.line - o.line >= 0.5 END, false) AS toward_second
      FROM (SELECT DISTINCT game_id FROM upto) CROSS JOIN (VALUES ('SPREAD'), ('TOTAL'), ('MONEYLINE')) x(market)
      LEFT JOIN (SELECT *, {h} / ({h} + {a}) AS nh, {a} / ({h} + {a}) AS na FROM upto QUALIFY row_number() OVER (PARTITION BY game_id, market ORDER BY observed_at DESC, seq DESC) = 1) n USING (game_id, market)
      LEFT JOIN (SELECT *, {h} / ({h} + {a}) AS oh, {a} / ({h} + {a}) AS oa FROM upto WHERE is_opening) o USING (game_id, market)""".replace("{h}", _imp("home_american")).replace("{a}", _imp("away_american")),
    "upto_now": f"SELECT * FROM quotes WHERE observed_at <= {_NOW}",
    "upto_cut": f"SELECT * FROM quotes WHERE observed_at <= {_CUT}",
    "summary": """
      SELECT game_id, greatest(max((1 - p) * impact), 0) AS worst_impact, coalesce(sum(impact * (1 - p) * 0.4) FILTER (p < 0.9), 0) AS availability_impact,
             bool_or(position = 'QB' AND p > 0.15 AND p < 0.85) AS quarterback_unresolved, bool_or(p > 0.2 AND p < 0.9 AND impact >= 1.5) AS injury_uncertain
      FROM availability GROUP BY game_id""",
    "curve": """
      SELECT segment, 0 AS point, 10000.0::DOUBLE AS balance FROM forecasts GROUP BY segment
      UNION ALL
      SELECT segment, row_number() OVER w, (10000 + sum(profit) OVER w)::DOUBLE FROM forecasts WINDOW w AS (PARTITION BY segment ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
}

_NEEDS = {
    "margins": ["projection"], "totals": ["projection"], "predictions": ["projection"], "games": ["quotes"], "latest": ["quotes"],
    "latest_manual": ["manual"], "sides": ["latest", "predictions"], "priced": ["sides", "latest_manual"], "best": ["priced"],
    "upto_now": ["quotes"], "upto_cut": ["quotes"], "summary": ["availability"], "curve": ["forecasts"],
}


def _sql(body: str, *views: str, **renamed: str) -> str:
    """``body`` under the views it uses; ``upto`` names the cutoff that movement works on."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        found.setdefault(name, _VIEWS[name])

    for v in views:
        if v.startswith("movement"):
            add("upto_" + v[-3:])
            found["upto"] = f"SELECT * FROM upto_{v[-3:]}"
            found["movement"] = _VIEWS["movement"]
        else:
            add(v)
    ctes = ", ".join(f"{name} AS ({text})" for name, text in found.items())
    return (f"WITH {ctes} " if ctes else "") + body


_SEVERITY = "CASE WHEN {x} > 2.5 THEN 'HIGH' WHEN {x} > 1 THEN 'MODERATE' WHEN {x} > 0 THEN 'LOW' ELSE 'NONE' END"
_LOSS = "avg(-ln(CASE WHEN outcome = 1 THEN greatest(1e-12, least(1 - 1e-12, p)) ELSE 1 - greatest(1e-12, least(1 - 1e-12, p)) END))"
_BIN = "(SELECT max(i) FROM range(0, 10) r(i) WHERE p >= i / 10.0::DOUBLE)"
_RECS = f"""
, spread_at AS (SELECT game_id, observed_at AS spread_at, line AS market_line FROM latest WHERE market = 'SPREAD'),
open_game AS (SELECT game_id, sum(stake)::DOUBLE / 1e7 AS game_pct FROM positions WHERE result = 'PENDING' GROUP BY game_id),
open_team AS (SELECT team, sum(stake)::DOUBLE / 1e7 AS team_pct FROM positions WHERE result = 'PENDING' GROUP BY team),
component AS (SELECT part_id, mu + (part_id * (i + 1)) % 9 AS margin FROM projection, range(0, 4) r(i)),
disagree AS (SELECT part_id FROM component GROUP BY part_id HAVING count(*) >= 2 AND max(margin) - min(margin) > 6.5),
doubtful AS (SELECT DISTINCT ON (game_id) game_id, player_id, position, p FROM availability WHERE p < 0.9 ORDER BY game_id, seq),
team_name(team, team_name) AS (VALUES TEAM_NAMES),
facts AS (
  SELECT g.game_id, g.roof, p.completeness, p.mu, p.sd, b.market, b.selection, b.line, b.american, b.edge, b.ev, b.conservative_p, b.break_even_p, b.push_p, b.model_p, b.market_p,
         b.fair_american, b.manual_at, b.manual_id, w.severity, w.wind, coalesce(og.game_pct, 0) AS game_pct, coalesce(ot.team_pct, 0) AS team_pct,
         coalesce(s.quarterback_unresolved, false) AS qb, coalesce(s.injury_uncertain, false) AS uncertain,
         coalesce({_age('sa.spread_at')} <= 7200, false) AS fresh, r.r_regionkey IS NOT NULL AND r.r_regionkey <> 4 AS approved,
         f.game_id IS NOT NULL AS failed, g.game_id IN (SELECT part_id FROM disagree) AS disagree,
         EXISTS (SELECT 1 FROM injuries i WHERE i.game_id = g.game_id AND i.value > 100 AND i.report_id % 2 = 0) AS awaiting,
         coalesce(CASE WHEN b.selection IN ('HOME', 'OVER') THEN mv.toward_first ELSE mv.toward_second END, false) AS moving,
         tn.team_name, sa.market_line, FEED_DOWN AS feed_down,
         CASE WHEN d.game_id IS NOT NULL THEN 'Replacement-player concern: ' || coalesce(sp.s_name, 'starter') || ' (' || d.position || ') active probability ' || printf('%.0f%%', d.p * 100) END AS concern
  FROM games g LEFT JOIN predictions p USING (game_id) LEFT JOIN best b USING (game_id) LEFT JOIN weather w USING (game_id)
  LEFT JOIN summary s USING (game_id) LEFT JOIN spread_at sa USING (game_id) LEFT JOIN region r ON r.r_regionkey = p.model_id
  LEFT JOIN failures f ON f.game_id = g.game_id LEFT JOIN open_game og ON og.game_id = g.game_id
  LEFT JOIN open_team ot ON ot.team = CASE b.selection WHEN 'HOME' THEN g.home_team WHEN 'AWAY' THEN g.away_team END
  LEFT JOIN team_name tn ON tn.team = CASE b.selection WHEN 'HOME' THEN g.home_team WHEN 'AWAY' THEN g.away_team END
  LEFT JOIN movement mv ON mv.game_id = g.game_id AND mv.market = b.market
  LEFT JOIN doubtful d ON d.game_id = g.game_id LEFT JOIN supplier sp ON sp.s_suppkey = d.player_id
), reasons AS (
  SELECT *,
    list_filter([CASE WHEN qb THEN 'Starting quarterback identity unresolved' END, CASE WHEN feed_down THEN 'Critical injury feed missing' END, CASE WHEN NOT fresh THEN 'Market price stale' END,
      CASE WHEN roof IN ('OUTDOOR', 'RETRACTABLE_OPEN') AND severity IS NULL THEN 'Weather unavailable for outdoor game' END,
      CASE WHEN NOT approved THEN 'Model version not approved' END, CASE WHEN mu IS NULL THEN 'Prediction timestamp missing' END,
      CASE WHEN mu IS NULL THEN 'Feature snapshot missing' END, CASE WHEN failed THEN 'Critical provider failure' END,
      CASE WHEN coalesce(completeness, 0) < 0.85 THEN printf('Data-completeness score %.2f below minimum 0.85', coalesce(completeness, 0)) END], lambda x: x IS NOT NULL) AS inc,
    list_filter([CASE WHEN coalesce(ev, -1) <= 0 THEN 'Expected value is not positive' END,
      CASE WHEN coalesce(edge, -1) < 0.02 THEN printf('Edge %.1f%% below required threshold 2.0%% (demo threshold)', coalesce(edge, -1) * 100) END,
      CASE WHEN coalesce(sd, 99) > 15.5 THEN 'Uncertainty too high' END,
      CASE WHEN game_pct >= 0.01 OR team_pct >= 0.015 OR game_pct >= 0.0125 THEN 'Portfolio exposure would exceed a limit' END,
      CASE WHEN edge IS NULL OR abs(edge) < 0.005 THEN 'Model and market are effectively aligned' END,
      CASE WHEN disagree THEN 'Model components materially disagree' END], lambda x: x IS NOT NULL) AS pass,
    list_filter([CASE WHEN edge >= 0.02 * 0.6 AND edge < 0.02 THEN 'Selection would qualify at a better price' END,
      CASE WHEN uncertain THEN 'Injury uncertainty remains material' END, CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'Weather uncertainty remains material' END,
      CASE WHEN abs(edge - 0.02) < 0.005 THEN 'Line is close to the target threshold' END,
      CASE WHEN moving THEN 'Market moving toward an acceptable price' END, CASE WHEN awaiting THEN 'Required official update expected' END], lambda x: x IS NOT NULL) AS watch,
    ['All critical data complete', 'Manual price recently confirmed', 'Model approved', 'Edge exceeds demo threshold 2.0%',
     'Expected value positive after conservative adjustments', 'Uncertainty acceptable', 'Portfolio exposure within limits'] AS bet
  FROM facts
), first_pass AS (
  SELECT *, CASE WHEN len(inc) > 0 THEN 'DATA INCOMPLETE'
                 WHEN len(pass) > 0 THEN CASE WHEN len(watch) > 0 AND len(list_filter(pass, lambda x: NOT (x LIKE 'Edge%' OR x LIKE 'Expected value%'))) = 0 THEN 'WATCH' ELSE 'PASS' END
                 WHEN len(watch) > 0 THEN 'WATCH' ELSE 'BET' END AS s0,
            CASE WHEN len(inc) > 0 THEN inc
                 WHEN len(pass) > 0 THEN CASE WHEN len(watch) > 0 AND len(list_filter(pass, lambda x: NOT (x LIKE 'Edge%' OR x LIKE 'Expected value%'))) = 0 THEN watch || pass ELSE pass END
                 WHEN len(watch) > 0 THEN watch ELSE bet END AS r0
  FROM reasons
), second AS (
  SELECT *, CASE WHEN s0 = 'BET' AND NOT coalesce({_age('manual_at')} <= 60, false) THEN 'WATCH' ELSE s0 END AS s1,
            CASE WHEN s0 = 'BET' AND NOT coalesce({_age('manual_at')} <= 60, false)
                 THEN ['Qualifies on consensus pricing — awaiting recent manually confirmed bet365 price'] || r0 ELSE r0 END AS r1,
            greatest(0, (({_dec('american')} - 1) * (conservative_p / (1 - push_p)) - (1 - conservative_p / (1 - push_p))) / ({_dec('american')} - 1))
              * 0.25 * 0.85 * completeness * 0.9 AS kelly
  FROM first_pass
), staked AS (
  SELECT *, list_sort([{{'pct': kelly, 'i': 0, 'l': 'Risk-adjusted Kelly'}}, {{'pct': 0.005, 'i': 1, 'l': 'Per-bet cap'}},
    {{'pct': greatest(0, 0.01 - game_pct), 'i': 2, 'l': 'Same-game cap'}}, {{'pct': greatest(0, 0.015 - team_pct), 'i': 3, 'l': 'Team weekly cap'}},
    {{'pct': greatest(0, 0.0125 - game_pct), 'i': 4, 'l': 'Correlated-cluster cap'}}, {{'pct': greatest(0, 0.04 - 0.01), 'i': 5, 'l': 'Weekly open-stake cap'}}])[1] AS s
  FROM second
), final AS (
  SELECT *, {_cents('1e7 * s.pct')} AS amount, s1 = 'BET' AND {_cents('1e7 * s.pct')} < 1 AS small FROM staked
), decided AS (
  SELECT *, CASE WHEN small THEN 'PASS' ELSE s1 END AS status,
    array_to_string(CASE WHEN small THEN [printf('Remaining risk-limit room ($%.2f) is below the $1.00 minimum viable stake — %s is nearly exhausted', amount, s.l)] || r1 ELSE r1 END, '; ') AS reasons
  FROM final
)
"""


def _recs(down: bool = False) -> str:
    names = ", ".join(f"({i}, '{line.split('|')[1]}')" for i, line in enumerate(TEAMS.split("\n")[1:-1]))
    return _RECS.replace("TEAM_NAMES", names).replace("FEED_DOWN", str(down).lower())


def _texts(*texts: str) -> str:
    return "CASE WHEN market IS NULL THEN '' ELSE array_to_string(list_filter([" + ", ".join(texts) + "], lambda x: x IS NOT NULL), '; ') END"


_SUPPORTING = _texts(
    "CASE WHEN abs(mu) > 0.1 AND market = 'SPREAD' THEN 'Opponent-adjusted team strength favors ' || team_name || ' by ' || printf('%.1f', abs(mu)) || ' points vs market ' || replace(coalesce(market_line, 0)::DOUBLE::VARCHAR, '.0', '') END",
    "CASE WHEN edge > 0.015 THEN 'Market disagreement: conservative probability ' || printf('%.1f%%', conservative_p * 100) || ' vs break-even ' || printf('%.1f%%', break_even_p * 100) END",
)
_OPPOSING = _texts(
    "concern",
    "CASE WHEN severity NOT IN ('LOW', 'NONE') THEN 'Weather risk: wind ' || wind::BIGINT || ' mph, severity ' || severity END",
    "CASE WHEN manual_id IS NULL THEN 'Price is mock consensus, not a manually confirmed book price' END",
    "CASE WHEN game_pct > 0 THEN 'Existing exposure on this game: ' || printf('%.2f%%', game_pct * 100) || ' of bankroll (cap 1.00%)' END",
    "CASE WHEN team_pct > 0 AND team_name IS NOT NULL THEN 'Existing weekly exposure to ' || team_name || ': ' || printf('%.2f%%', team_pct * 100) || ' of bankroll (cap 1.50%)' END",
    "'Demo thresholds are not historically validated'",
)
_REC_VIEWS = ("games", "best", "projection", "availability", "weather", "summary", "failures", "injuries", "positions", "movement_now")


def oracle_sql() -> dict[str, str]:
    """SQL of every query, those that run streams included."""
    from pricewright.plans import live_oracles  # needs this module

    return batch_sql() | live_oracles.oracle_sql()


def batch_sql() -> dict[str, str]:
    """SQL of the queries of the catalogue."""
    ledger_pay = f"CASE WHEN result = 'WIN' THEN {_cents('cents + ' + _delta('cents', 'american', 'result'))} WHEN result IN ('PUSH', 'VOID') THEN {_cents('cents')} WHEN result = 'LOSS' THEN 0 END"
    settled = "SELECT bet_id, ['WIN', 'LOSS', 'PUSH', 'VOID'][(bet_id // 2) % 4 + 1] AS result, cents, american FROM positions WHERE bet_id % 2 = 0"
    every_settled = "SELECT bet_id, ['WIN', 'LOSS', 'PUSH', 'VOID'][(bet_id // 2) % 4 + 1] AS result, cents, american, CASE WHEN bet_id % 3 <> 0 THEN american - 5 + CASE WHEN american > 0 THEN 10 ELSE 0 END END AS closing FROM positions"
    slices = f"count(f.seq) AS n, round({_LOSS}, 6) AS log_loss, round(avg((p - outcome) * (p - outcome)), 6) AS brier, round(avg(clv), 6) AS mean_clv, round(avg(edge), 6) AS avg_edge"
    status = lambda aging, stale: f"CASE WHEN {_age('last_at')} < 0 THEN 'CONFLICTING' WHEN {_age('last_at')} <= {aging} THEN 'CURRENT' WHEN {_age('last_at')} <= {stale} THEN 'AGING' ELSE 'STALE' END"
    ago = f"floor({_age('last_at')} + 0.5)::BIGINT"
    names = ("full_kelly", "fraction_kelly", "after_uncertainty", "after_quality", "after_calibration")
    kelly = f"greatest(0, (({_dec('american')} - 1) * p - (1 - p)) / ({_dec('american')} - 1))"
    return {
        "watch_list": _sql("", *_REC_VIEWS).rstrip() + _recs() + "SELECT game_id, market, selection, round(edge, 6) AS edge, reasons FROM decided WHERE status = 'WATCH' ORDER BY edge DESC, game_id",
        "slate_sorted": _slate_sql("SELECT game_id, kickoff, kickoff_window, round(edge, 6) AS edge FROM slate"),
        "total_distribution": _sql("SELECT part_id, v AS value, round(probability, 6) AS probability FROM totals", "totals"),
        "total_ladder": _sql("SELECT part_id, line::INT AS line, round(sum(CASE WHEN v > line THEN probability ELSE 0 END), 6) AS over FROM totals, range(37, 54) r(line) GROUP BY part_id, line", "totals"),
        "distribution_points": _sql("SELECT part_id, v::INT AS x, round(probability * 100, 4) AS y FROM margins WHERE probability >= 0.01", "margins"),
        "scenario_interval": f"""
WITH s AS (SELECT p_partkey AS part_id, (p_size - 25) / 3.0::DOUBLE - CASE WHEN p_partkey % 2 = 0 THEN 4.5 ELSE 0 END AS mu, 10 + (p_retailprice - 900) / 20 AS sd,
           38 + p_size / 3.0::DOUBLE - CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END - 0.6 AS total FROM part),
m AS (SELECT part_id, v, w / sum(w) OVER (PARTITION BY part_id) AS p FROM (SELECT part_id, v, {_pdf('v', 'mu', '(sd + 0.6)')} * {_BOOST} AS w FROM (SELECT *, unnest({_OUTCOMES}) AS v FROM s))),
t AS (SELECT part_id, v, w / sum(w) OVER (PARTITION BY part_id) AS p FROM (SELECT part_id, v, {_pdf('v', 'total', '(sd + 0.5)')} AS w FROM (SELECT *, unnest(range(10, 91)) AS v FROM s))),
mi AS (SELECT part_id, min(v) FILTER (up >= 0.1) AS lo, max(v) FILTER (down >= 0.1) AS hi FROM (SELECT *, sum(p) OVER (PARTITION BY part_id ORDER BY v) AS up, sum(p) OVER (PARTITION BY part_id ORDER BY v DESC) AS down FROM m) GROUP BY part_id),
ti AS (SELECT part_id, min(v) FILTER (up >= 0.1) AS lo, max(v) FILTER (down >= 0.1) AS hi FROM (SELECT *, sum(p) OVER (PARTITION BY part_id ORDER BY v) AS up, sum(p) OVER (PARTITION BY part_id ORDER BY v DESC) AS down FROM t) GROUP BY part_id)
SELECT part_id, '80% margin ' || mi.lo || ' to ' || mi.hi || ', total ' || ti.lo || ' to ' || ti.hi AS text FROM mi JOIN ti USING (part_id)""",
        "display_factors": _sql(
            "SELECT part_id, CASE WHEN mu > 0.3 THEN 'HOME' WHEN mu < -0.3 THEN 'AWAY' ELSE 'NEUTRAL' END AS favours, round(-(part_id % 30 - 8) * 0.12::DOUBLE, 6) AS weather_adjustment, "
            f"{_fair('q')} AS price, -220 - (-115 + part_id % 11) AS second_price FROM (SELECT *, least(0.985, greatest(0.015, {_above_zero('mu', '13.2')} + 0.02)) AS q FROM projection)", "projection"),
        "age_tiers": _sql(
            f"SELECT 'manual' AS kind, seq, CASE WHEN {_age('entered_at')} <= 45 THEN 'ok' WHEN {_age('entered_at')} <= 60 THEN 'warn' ELSE 'bad' END AS tier FROM manual UNION ALL "
            f"SELECT 'quote', seq, CASE WHEN {_age('observed_at')} <= 30 THEN 'ok' WHEN {_age('observed_at')} <= 120 THEN 'warn' ELSE 'bad' END FROM latest", "manual", "latest"),
        "kickoff_labels": _sql("SELECT game_id, strftime(kickoff, '%a, %b %-d, %-I:%M %p') AS label, 'game_' || substr(sha256(game_id || '|' || home_team), 1, 16) AS id FROM games", "games"),
        "feed_health": f"""
WITH f(feed, event, aging, stale) AS (VALUES ('schedule', 'error', 1440, 4320), ('roster', NULL, 720, 2880), ('depthChart', NULL, 1440, 4320), ('injury', 'signup', 360, 1440),
  ('weather', 'view', 180, 720), ('odds', 'click', 30, 120), ('manualPrice', 'purchase', 30, 60)
), r AS (
  SELECT event_type AS event, user_id, max(ts) AS last_at, count(*) AS n, bool_or(event_type = 'signup' AND event_id % 11 = 0) AS conflict FROM events WHERE ts <= {_NOW} GROUP BY ALL
), h AS (
  SELECT feed, aging, stale, max(last_at) AS last_at, coalesce(sum(n), 0)::BIGINT AS records, bool_or(conflict) AS conflict, count(*) FILTER (conflict OR {_age('last_at')} > stale) AS impacted
  FROM f LEFT JOIN r USING (event) GROUP BY feed, aging, stale
), s AS (
  SELECT *, CASE WHEN conflict THEN 'CONFLICTING' WHEN last_at IS NULL THEN 'MISSING' WHEN {_age('last_at')} <= aging THEN 'CURRENT' WHEN {_age('last_at')} <= stale THEN 'AGING' ELSE 'STALE' END AS status FROM h
)
SELECT feed, status, last_at AS last_success_at, records, round({_age('last_at')}, 6) AS freshness_minutes, impacted AS impacted_games,
       CASE status WHEN 'MISSING' THEN 'FAILED' WHEN 'STALE' THEN 'DEGRADED' WHEN 'CURRENT' THEN 'OK' ELSE 'INVESTIGATING' END AS resolution FROM s""",
        "kickoff_in_zones": _sql(
            "SELECT game_id, ['America/Phoenix', 'Asia/Tokyo', 'Mars/Base', NULL][game_id % 4 + 1] AS zone, strftime(kickoff + to_hours([-7, 9, 0, 0][game_id % 4 + 1]), '%a, %b %-d, %-I:%M %p') AS label FROM games", "games"),
        "freshness_of_texts": f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'CONFLICTING' WHEN event_id % 11 = 0 THEN 'MISSING' WHEN {_age('ts')} < 0 THEN 'CONFLICTING' WHEN {_age('ts')} <= 1440 THEN 'CURRENT' WHEN {_age('ts')} <= 14400 THEN 'AGING' ELSE 'STALE' END AS status FROM events",
        "games_of_week": _sql("SELECT game_id, 2023 + game_id % 2 AS season, (game_id // 2) % 18 + 1 AS week, kickoff FROM games WHERE game_id % 2 = 1 AND (game_id // 2) % 18 = 4 ORDER BY kickoff, game_id LIMIT 20", "games"),
        "exported_state": _sql(
            "SELECT 'bet' AS kind, bet_id AS key, result AS value FROM positions UNION ALL SELECT 'price', o_orderkey, ['SPREAD', 'TOTAL', 'MONEYLINE'][o_orderkey % 3 + 1] || ' ' || "
            "CASE WHEN o_orderkey % 2 = 0 THEN -(100 + o_orderkey % 60) ELSE 100 + o_orderkey % 60 END FROM orders", "positions"),
        "mutation_audit_digests": _sql(
            "SELECT bet_id, CASE WHEN bet_id % 11 = 0 THEN 'deleted' ELSE 'updated' END AS mutation FROM positions WHERE bet_id % 5 = 0 AND (bet_id % 11 = 0 OR bet_id % 13 = 0 AND result <> 'VOID')", "positions"),
        "policy_rows": _sql(
            "SELECT 'bets' AS rows_of, count(*) FILTER (user_id = 7) AS n FROM positions UNION ALL SELECT 'bet_events', count(*) FILTER (user_id = 7) FROM positions "
            "UNION ALL SELECT 'recommendations', count(*) FILTER (user_id = 7 OR user_id % 10 = 0) FROM positions UNION ALL SELECT 'odds_snapshots', count(*) FROM quotes UNION ALL SELECT 'nobody', 0 UNION ALL SELECT 'unknown', 0 "
            "UNION ALL SELECT 'prices to insert', count(*) FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'P' UNION ALL SELECT 'bets refused', count(*) FILTER (user_id <> 7) FROM positions", "positions", "quotes"),
        "opening_flagged": _sql("SELECT game_id, market, min(seq) AS seq, arg_min(line, seq) AS line FROM quotes WHERE seq % 4 = 1 AND observed_at <= TIMESTAMP '2024-01-16 00:00:00' GROUP BY game_id, market", "quotes"),
        "feed_impact": _sql(
            "SELECT game_id, count(i.g) AS n, coalesce(bool_or(value > 200), false) AS failed FROM games LEFT JOIN (SELECT value, unnest([user_id, user_id + 3]) AS g FROM events WHERE event_type = 'error') i ON i.g = game_id GROUP BY game_id", "games"),
        "incidents_of_game": "SELECT event_id AS incident_id, CASE WHEN value > 200 THEN 'FAILED' ELSE 'OPEN' END AS resolution FROM events WHERE event_type = 'error' AND user_id IN (7, 4)",
        "game_factors": _sql(
            "SELECT game_id, coalesce(n_name, '—') AS crew, stadium, surface, altitude FROM games LEFT JOIN nation ON n_nationkey = game_id % 25 AND game_id % 9 <> 0 "
            "LEFT JOIN (VALUES " + _stadium_values() + ") x(id, stadium, surface, altitude) ON x.id = home_team", "games"),
        "games_with_prior": _sql(
            "SELECT p_partkey AS game_id, coalesce(team_name, 'Unknown') AS home_name FROM part LEFT JOIN (VALUES " + _team_values() + ") x(id, abb, team_name) "
            "ON x.id = CASE WHEN p_partkey IN (SELECT game_id FROM quotes) THEN p_partkey % 25 ELSE p_partkey % 40 END", "quotes"),
        "bets_on_slate": _sql("SELECT bet_id, game_id FROM positions WHERE game_id IN (SELECT game_id FROM games)", "positions", "games"),
        "picks_union": _sql(
            "SELECT 'live' AS source, market, count(*) AS n, sum(game_id)::BIGINT AS games FROM best GROUP BY market UNION ALL "
            "SELECT 'recorded', market, count(*), sum(game_id)::BIGINT FROM positions WHERE game_id NOT IN (SELECT game_id FROM best) GROUP BY market", "best", "positions"),
        "submitted_prices": _sql(
            "SELECT seq, game_id::VARCHAR AS game_id, market, line, home_american::DOUBLE AS american FROM quotes WHERE seq % 13 <> 0 AND seq % 17 <> 0 AND seq % 5 <> 0 AND seq % 7 <> 0 AND seq % 300 <= 240 AND seq % 3 <> 0", "quotes"),
        "injury_conflicts": "SELECT user_id AS game_id, bool_or(event_id % 11 = 0) AS any_conflict FROM events WHERE event_type = 'signup' GROUP BY user_id",
        "injury_board": _sql(
            "SELECT report_id, i.game_id, s_name AS player, CASE WHEN report_id % 2 = 0 THEN 'QUESTIONABLE' ELSE 'OUT' END AS designation, round(a.p, 6) AS active_probability "
            "FROM injuries i LEFT JOIN (SELECT game_id, player_id, arg_max(p, seq) AS p FROM availability GROUP BY ALL) a ON a.game_id = i.game_id AND a.player_id = report_id % 100 + 1 "
            "LEFT JOIN supplier ON s_suppkey = report_id % 100 + 1", "injuries", "availability"),
        "activity_windows": _sql("SELECT date_trunc('day', observed_at)::TIMESTAMP AS start, market, count(*) AS n, arg_max(line, (observed_at, seq)) AS last_line FROM quotes GROUP BY ALL", "quotes"),
        "pricing_convert": _sql(
            f"SELECT seq, round(d, 6) AS decimal, round(p, 6) AS implied, {_fair('p')} AS fair, CASE WHEN home_american = -100 THEN 100 ELSE home_american END::BIGINT AS american "
            f"FROM (SELECT *, {_dec('home_american')} AS d, {_imp('home_american')} AS p FROM quotes)", "quotes"),
        "novig_market": _sql(
            f"SELECT seq, round(h / (h + a), 6) AS home, round(a / (h + a), 6) AS away, round(h + a - 1, 6) AS overround "
            f"FROM (SELECT seq, {_imp('home_american')} AS h, {_imp('away_american')} AS a FROM quotes)", "quotes"),
        "breakeven_ev_kelly": _sql(
            "SELECT seq, round((1 - q) / d, 6) AS break_even, CASE WHEN p + q <= 1 + 1e-12 THEN round(p * (d - 1) - (1 - p - q), 6) END AS ev, "
            "round(k, 6) AS kelly, round(k * 0.25, 6) AS quarter_kelly, round(p - (1 - q) / d, 6) AS edge FROM (SELECT *, "
            "greatest(0, ((d - 1) * (p / (1 - q)) - (1 - p / (1 - q))) / (d - 1)) AS k "
            f"FROM (SELECT seq, p, CASE WHEN push THEN 0.05::DOUBLE ELSE 0 END AS q, {_dec('american')} AS d FROM forecasts))", "forecasts"),
        "slate_games": _sql(
            "SELECT game_id, t2.abb || ' @ ' || t1.abb AS label, t2.team_name || ' at ' || t1.team_name AS long_label, t1.team_name AS home_name, "
            "CASE roof WHEN 'OUTDOOR' THEN 'Outdoor' WHEN 'DOME' THEN 'Dome' WHEN 'RETRACTABLE_OPEN' THEN 'Retractable (open)' ELSE 'Retractable (closed)' END AS roof_label, "
            "lower(r_name) || ' 0.' || r_regionkey || '.0-demo' AS model FROM games JOIN (VALUES " + _team_values() + ") t1(id, abb, team_name) ON t1.id = home_team "
            "JOIN (VALUES " + _team_values() + ") t2(id, abb, team_name) ON t2.id = away_team JOIN region ON r_regionkey = game_id % 5", "games"),
        "asof_filter": _sql("SELECT seq, game_id, market, line FROM upto_cut", "upto_cut"),
        "latest_quote": _sql(
            "SELECT game_id, market, seq, line, home_american FROM upto_cut u WHERE NOT EXISTS (SELECT 1 FROM upto_cut v WHERE v.game_id = u.game_id AND v.market = u.market "
            "AND (v.observed_at, v.seq) > (u.observed_at, u.seq))", "upto_cut"),
        "latest_record": f"SELECT event_type AS feed, max(event_id::VARCHAR) AS id FROM events e WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events x "
            f"WHERE x.event_type = e.event_type AND date_trunc('day', ts) <= {_CUT}) GROUP BY event_type",
        "opening_quote": _sql("SELECT game_id, market, seq, line FROM upto_cut WHERE is_opening", "upto_cut"),
        "manual_price_latest": _sql("SELECT game_id, market, selection, seq, american FROM latest_manual", "latest_manual"),
        "asof_join_split": _sql(
            "SELECT e.event_id AS probe, e.user_id AS game_id, arg_max(q.seq, (q.observed_at, q.seq)) AS quote_seq, arg_max(q.line, (q.observed_at, q.seq)) AS line FROM events e "
            "LEFT JOIN quotes q ON q.game_id = e.user_id AND q.market = 'SPREAD' AND q.observed_at <= e.ts WHERE e.event_type = 'error' GROUP BY ALL", "quotes"),
        "bitemporal_quotes": _sql(
            "SELECT probe, e.grp, arg_max(q.seq, (q.observed_at, q.ingested_at, q.seq)) AS quote_seq, arg_max(q.line, (q.observed_at, q.ingested_at, q.seq)) AS line "
            "FROM (SELECT event_id AS probe, CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id % 50 END AS grp, ts FROM events WHERE event_type = 'error') e LEFT JOIN "
            "(SELECT CASE WHEN game_id % 2 = 0 THEN 0 ELSE game_id % 50 END AS grp, observed_at, observed_at + to_hours(seq % 97) AS ingested_at, seq, line FROM quotes) q "
            "ON q.grp = e.grp AND q.observed_at <= e.ts AND q.ingested_at <= e.ts GROUP BY ALL", "quotes"),
        "asof_join_quotes": _sql(
            "SELECT e.event_id AS probe, e.user_id AS game_id, q.seq AS quote_seq, q.line FROM events e ASOF LEFT JOIN (SELECT * FROM quotes WHERE market = 'SPREAD') q "
            "ON q.game_id = e.user_id AND e.ts >= q.observed_at WHERE e.event_type = 'error'", "quotes"),
        "lookahead_violations": _sql(
            f"SELECT game_id, count(*) AS violations, 'odds snapshots for ' || game_id || ': record observed at ' || strftime(arg_min(observed_at, seq), '%Y-%m-%dT%H:%M:%S.%gZ') || ' is after prediction cutoff 2024-01-16T00:00:00.000Z. Future information must never enter a historical prediction.' AS message FROM quotes WHERE observed_at > {_CUT} GROUP BY game_id", "quotes"),
        "usable_forecasts": "SELECT p_partkey AS game_id, (p_partkey % 5 + 30) >= 15 AS model_ok, p_partkey % 5 >= 2 AS forecast_ok, p_partkey % 3 <> 0 AND p_partkey % 5 >= 1 AS result_ok, p_partkey % 5 >= 2 AS as_of_ok FROM part",
        "line_movement": _sql("SELECT game_id, market, toward_first, toward_second, line_move FROM movement", "movement_cut"),
        "margin_distribution": _sql("SELECT part_id, v AS value, round(probability, 6) AS probability FROM margins", "margins"),
        "spread_outcomes": _sql(
            "SELECT part_id, round(c, 6) AS cover, round(q, 6) AS push, round(greatest(0, 1 - c - q), 6) AS lose FROM (SELECT part_id, sum(CASE WHEN v + l > 1e-9 THEN probability ELSE 0 END) AS c, "
            "sum(CASE WHEN abs(v + l) < 1e-9 THEN probability ELSE 0 END) AS q FROM (SELECT *, (part_id % 15 - 7) / 2.0 AS l FROM margins) GROUP BY part_id)", "margins"),
        "total_outcomes": _sql(
            "SELECT part_id, round(c, 6) AS over, round(q, 6) AS push, round(greatest(0, 1 - c - q), 6) AS under FROM (SELECT part_id, sum(CASE WHEN v > part_id % 17 + 36 THEN probability ELSE 0 END) AS c, "
            "sum(CASE WHEN v = part_id % 17 + 36 THEN probability ELSE 0 END) AS q FROM totals GROUP BY part_id)", "totals"),
        "win_probability": _sql(f"SELECT part_id, round({_above_zero('mu', '13.2')}, 6) AS home_win, round({_pdf('0', 'mu', 'sd')}, 6) AS density FROM projection", "projection"),
        "key_number_mass": _sql(
            "SELECT part_id, round(sum(probability) FILTER (v > 0), 6) AS home_win, " + ", ".join(f"round(sum(probability) FILTER (abs(v) = {k}), 6) AS at_{k}" for k in (3, 6, 7, 10)) + " FROM margins GROUP BY part_id", "margins"),
        "central_interval": _sql(
            "SELECT part_id, min(v) FILTER (up >= (1 - 0.8) / 2) AS low, max(v) FILTER (down >= (1 - 0.8) / 2) AS high FROM (SELECT *, sum(probability) OVER (PARTITION BY part_id ORDER BY v) AS up, "
            "sum(probability) OVER (PARTITION BY part_id ORDER BY v DESC) AS down FROM margins) GROUP BY part_id", "margins"),
        "line_ladder": _sql("SELECT part_id, line::INT AS line, round(sum(CASE WHEN v + line > 0 THEN probability ELSE 0 END), 6) AS cover FROM margins, range(-7, 8) r(line) GROUP BY part_id, line", "margins"),
        "scenario_adjustments": _sql(
            "SELECT part_id, round(mu - CASE part_id % 4 WHEN 0 THEN imp WHEN 1 THEN imp * 0.4 ELSE 0 END + (part_id % 11 - 5) * 0.05, 6) AS margin, "
            "round(total - CASE part_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0.8 ELSE 0 END - (part_id % 5) * 0.12 + CASE part_id % 6 WHEN 0 THEN 0.8 WHEN 1 THEN -0.4 ELSE 0 END, 6) AS total, "
            "round(sd + CASE WHEN act THEN 0.6 ELSE 0 END, 6) AS margin_std, round(sd * 0.75 + CASE WHEN act THEN 0.5 ELSE 0 END, 6) AS total_std FROM (SELECT *, "
            "CASE WHEN part_id % 3 = 0 THEN 4.5 ELSE part_id % 7 END AS imp, part_id % 4 < 2 OR part_id % 5 <> 0 OR part_id % 6 < 2 OR part_id % 11 <> 5 AS act FROM projection)", "projection"),
        "candidates": _sql(
            "SELECT game_id, market, selection, line, american, manual_id, round(model_p, 6) AS model_p, round(conservative_p, 6) AS conservative_p, round(edge, 6) AS edge, round(ev, 6) AS ev, fair_american FROM priced", "priced"),
        "best_candidate": _sql("SELECT game_id, market, selection, round(edge, 6) AS edge FROM best", "best"),
        "recommendations": _sql("", *_REC_VIEWS).rstrip() + _recs() + f"""
SELECT game_id, CASE WHEN mu IS NULL THEN 'missing' ELSE 'pred_' || game_id END AS prediction_id, manual_id AS manual_price_id, status, reasons,
       coalesce(market, 'SPREAD') AS market, coalesce(selection, 'HOME') AS selection, team_name AS team, line, coalesce(american, -110) AS american,
       round(coalesce(model_p, 0), 6) AS model_p, round(coalesce(conservative_p, 0), 6) AS conservative_p, round(coalesce(market_p, 0), 6) AS market_p,
       round(coalesce(break_even_p, 0), 6) AS break_even_p, round(coalesce(edge, 0), 6) AS edge, round(coalesce(ev, 0), 6) AS ev, round(coalesce(push_p, 0), 6) AS push_p,
       coalesce(fair_american, 0) AS fair_american,
       CASE WHEN completeness > 0.92 AND edge > 0.03 THEN 'HIGH' WHEN edge > 0.015 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
       CASE WHEN status = 'BET' THEN round(s.pct, 6) END AS stake_pct, CASE WHEN status = 'BET' THEN amount END AS stake_amount, CASE WHEN status = 'BET' THEN s.l END AS stake_bound,
       greatest(fair_american, -125) AS target_price, american - 10 AS invalidation_price,
       {_SUPPORTING} AS supporting, {_OPPOSING} AS opposing, CASE WHEN status = 'PASS' THEN reasons ELSE '' END AS reasons_to_pass,
       'Starting quarterback status changes; Line moves past ' || CASE WHEN market = 'TOTAL' THEN 'total' ELSE 'spread' END ||
       ' target; Manual price confirmation older than 60 minutes at decision time; Any critical feed failure affecting this game' AS invalidation
FROM decided""",
        "recommendations_feed_outage": _sql("", *_REC_VIEWS).rstrip() + _recs(down=True) + "SELECT game_id, status, reasons FROM decided",
        "top_picks": _sql("", *_REC_VIEWS).rstrip() + _recs() + """
SELECT row_number() OVER (ORDER BY edge DESC, game_id) AS rank, game_id,
       CASE market WHEN 'MONEYLINE' THEN team_name || ' to win' WHEN 'SPREAD' THEN team_name || ' ' || CASE WHEN line = 0 THEN 'PK' WHEN line > 0 THEN '+' || replace(line::VARCHAR, '.0', '') ELSE replace(line::VARCHAR, '.0', '') END
         ELSE CASE selection WHEN 'OVER' THEN 'Over ' ELSE 'Under ' END || replace(line::VARCHAR, '.0', '') END AS label,
       CASE WHEN completeness > 0.92 AND edge > 0.03 THEN 'Strong pick' WHEN edge > 0.015 THEN 'Solid pick' ELSE 'Modest edge' END AS confidence
FROM decided WHERE status IN ('BET', 'WATCH') ORDER BY edge DESC, game_id LIMIT 10""",
        "slate_rows": _slate_sql(
            "SELECT game_id, kickoff_window, injury_severity, weather_severity, round(spread_diff, 6) AS spread_diff, round(total_diff, 6) AS total_diff, best_market FROM slate "
            "WHERE roof IN ('OUTDOOR', 'RETRACTABLE_OPEN') AND completeness < 0.9"),
        "slate_board": _slate_sql(
            "SELECT * REPLACE (round(model_spread, 6) AS model_spread, round(spread_diff, 6) AS spread_diff, round(model_total, 6) AS model_total, round(total_diff, 6) AS total_diff, "
            "round(home_win, 6) AS home_win, round(edge, 6) AS edge), spread_diff NOT BETWEEN -1.4999999 AND 1.4999999 AS spread_stands_out, "
            "total_diff NOT BETWEEN -1.9999999 AND 1.9999999 AS total_stands_out, edge > 0.02 AS edge_stands_out FROM slate"),
        "slate_facets": _slate_sql(
            "SELECT count(*) FILTER (status = 'WATCH') AS status, count(*) FILTER (best_market IN ('SPREAD HOME', 'SPREAD AWAY')) AS market, count(*) FILTER (edge * 100 >= 1) AS min_edge_pct, "
            "count(*) FILTER (completeness >= 0.9) AS completeness, count(*) FILTER (injury_severity = 'HIGH') AS injury, count(*) FILTER (weather_severity = 'MISSING') AS weather, "
            "count(*) FILTER (kickoff_window = 'SUN_LATE') AS \"window\", count(*) FILTER (roof LIKE '%D%' AND roof NOT LIKE '%OUT%' AND roof NOT LIKE '%OPEN') AS roof, "
            "count(*) FILTER (coalesce(consensus_spread, 0) <= 0) AS side, "
            "count(*) FILTER (best_market LIKE 'TOTAL%' AND roof IN ('OUTDOOR', 'RETRACTABLE_OPEN') AND consensus_spread > 0) AS market_roof_side FROM slate"),
        "market_monitor": _sql("", *_REC_VIEWS, "upto_now").rstrip() + _recs() + """
, price AS (
  SELECT game_id, max(line) FILTER (market = 'SPREAD' AND is_opening) AS so, max(line) FILTER (market = 'SPREAD' AND newest) AS s, 45 + max(line) FILTER (market = 'TOTAL' AND is_opening) AS o,
         45 + max(line) FILTER (market = 'TOTAL' AND newest) AS c, max(home_american) FILTER (market = 'MONEYLINE' AND newest) AS h, max(away_american) FILTER (market = 'MONEYLINE' AND newest) AS a
  FROM (SELECT *, row_number() OVER (PARTITION BY game_id, market ORDER BY observed_at DESC, seq DESC) = 1 AS newest FROM upto_now) GROUP BY game_id)
SELECT g.game_id, t2.abb || ' @ ' || t1.abb AS label, so AS spread_open, s AS spread, coalesce(round(s - so, 1), 0) AS spread_move, coalesce(abs(s - so) >= 1, false) AS spread_moved,
       o AS total_open, c AS total, coalesce(round(c - o, 1), 0) AS total_move, coalesce(abs(c - o) >= 1, false) AS total_moved, coalesce(printf('%s / %s', AWAY, HOME), '—') AS moneyline,
       coalesce(TARGET, '—') AS target, CASE WHEN d.status = 'WATCH' THEN 'qualify ≥ ' || TARGET || '; pass ≤ ' || PASS ELSE '—' END AS watch_band, coalesce(s, 0) AS shown_spread, coalesce(c, 45) AS shown_total
FROM games g LEFT JOIN price USING (game_id) LEFT JOIN (SELECT game_id, status, CASE WHEN fair_american IS NOT NULL THEN greatest(fair_american, -125) END AS target, american - 10 AS stop FROM decided) d USING (game_id)
JOIN (VALUES TEAMS) t1(id, abb, full_name) ON t1.id = home_team JOIN (VALUES TEAMS) t2(id, abb, full_name) ON t2.id = away_team""".replace("TEAMS", _team_values()).replace("AWAY", _signed("a"))
        .replace("HOME", _signed("h")).replace("TARGET", _signed("d.target")).replace("PASS", _signed("d.stop")),
        "nested_state": "SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 5 = 0 THEN 3 ELSE -1 END AS version, "
            "CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 = 0 THEN event_id % 4 ELSE 25 END::INT AS unit, "
            "CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 <> 0 THEN ('0.' || (event_id % 9 + 1))::DOUBLE ELSE 0.005 END AS per_bet, 0.01::DOUBLE AS per_game FROM events",
        "mode_gate": "SELECT o_orderkey AS seq, concat_ws('; ', CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 5 < 2 THEN 'Set a positive monthly loss budget before enabling real tracking.' END, "
            "CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 3 = 0 THEN 'You must acknowledge the risk statement.' END) AS errors FROM orders",
        "stake_breakdown": _sql(
            "SELECT seq, " + ", ".join(f"round({c}, 6) AS {n}" for c, n in zip(("k", "k * 0.25", "k * 0.25 * 0.85", "k * 0.25 * 0.85 * 0.95", "k * 0.25 * 0.85 * 0.95 * 0.9"), names, strict=True))
            + f", round(s.v, 6) AS pct, round({_cents('10000 * s.v')}, 6) AS amount, CASE WHEN s.v = 0 AND k = 0 THEN 'No positive Kelly stake' ELSE s.l END AS bound FROM (SELECT *, list_sort(["
            "{'v': k * 0.25 * 0.85 * 0.95 * 0.9, 'i': 0, 'l': 'Risk-adjusted Kelly'}, {'v': 0.005::DOUBLE, 'i': 1, 'l': 'Per-bet cap'}, {'v': greatest(0, 0.01::DOUBLE - (seq % 5) / 400.0::DOUBLE), 'i': 2, 'l': 'Same-game cap'}, "
            "{'v': greatest(0, 0.015::DOUBLE - (seq % 7) / 500.0::DOUBLE), 'i': 3, 'l': 'Team weekly cap'}, {'v': greatest(0, 0.0125::DOUBLE - (seq % 3) / 200.0::DOUBLE), 'i': 4, 'l': 'Correlated-cluster cap'}, "
            f"{{'v': greatest(0, 0.04::DOUBLE - (seq % 11) / 250.0::DOUBLE), 'i': 5, 'l': 'Weekly open-stake cap'}}])[1] AS s FROM (SELECT seq, {kelly} AS k FROM forecasts))", "forecasts"),
        "freshness": f"SELECT event, CASE event WHEN 'click' THEN 'odds' WHEN 'view' THEN 'weather' WHEN 'purchase' THEN 'manualPrice' WHEN 'signup' THEN 'injury' WHEN 'error' THEN 'schedule' END AS feed, round({_age('last_at')}, 6) AS age_minutes, "
            f"CASE event WHEN 'click' THEN {status(30, 120)} WHEN 'view' THEN {status(180, 720)} WHEN 'purchase' THEN {status(30, 60)} WHEN 'signup' THEN {status(360, 1440)} WHEN 'error' THEN {status(1440, 4320)} END AS status, strftime(last_at, '%Y-%m-%d %H:%MZ') AS at_utc, "
            f"CASE WHEN {ago} < 1 THEN 'just now' WHEN {ago} < 60 THEN {ago} || 'm ago' WHEN {ago} // 60 < 48 THEN ({ago} // 60) || 'h ' || ({ago} % 60) || 'm ago' ELSE ({ago} // 1440) || 'd ago' END AS ago "
            "FROM (SELECT event_type AS event, max(ts) AS last_at FROM events GROUP BY event_type)",
        "worst_feed": f"SELECT game_id, ['CURRENT', 'AGING', 'STALE', 'CONFLICTING', 'MISSING'][max(list_position(['CURRENT', 'AGING', 'STALE', 'CONFLICTING', 'MISSING'], s))] AS worst, count(*) FILTER (s IN ('STALE', 'CONFLICTING', 'MISSING')) AS degraded "
            f"FROM (SELECT game_id, {status(1440, 7200)} AS s FROM (SELECT user_id AS game_id, event_type, max(ts) AS last_at FROM events GROUP BY ALL)) GROUP BY game_id",
        "log_loss_brier": _sql(f"SELECT segment, round({_LOSS}, 6) AS log_loss, round(avg((p - outcome) ** 2), 6) AS brier FROM forecasts GROUP BY segment", "forecasts"),
        "calibration_bins": _sql(
            f"SELECT i::INT AS bin, round(i / 10.0, 6) AS low, round((i + 1) / 10.0, 6) AS high, count(p) AS n, round(coalesce(avg(p), (i + 0.5) / 10), 6) AS mean_predicted, round(avg(outcome), 6) AS observed "
            "FROM range(0, 10) b(i) LEFT JOIN forecasts ON p >= i / 10.0::DOUBLE AND (p < (i + 1) / 10.0::DOUBLE OR (i = 9 AND p <= 1)) GROUP BY i", "forecasts"),
        "calibration_labels": "SELECT i::INT AS bin, count(p) AS n, round(coalesce(avg(p), (i + 0.5) / 10), 6) AS mean_predicted, round(avg(quality), 6) AS observed FROM range(0, 10) b(i) LEFT JOIN "
            "(SELECT quality, greatest(0.01, least(0.99, n_chars / 35000.0::DOUBLE)) AS p FROM labels JOIN documents USING (doc_id)) ON p >= i / 10.0::DOUBLE AND p < (i + 1) / 10.0::DOUBLE GROUP BY i",
        "ece": _sql(f"SELECT segment, round(sum(n * abs(o - m)) / sum(n), 6) AS ece FROM (SELECT segment, {_BIN} AS b, count(*) AS n, avg(outcome) AS o, avg(p) AS m FROM forecasts GROUP BY ALL) GROUP BY segment", "forecasts"),
        "calibration_line": _sql(
            "SELECT segment, round(sxy / sxx, 6) AS slope, round(my - sxy / sxx * mp, 6) AS intercept FROM (SELECT segment, sum((p - mp) * (outcome - my)) AS sxy, sum((p - mp) ** 2) AS sxx, any_value(mp) AS mp, any_value(my) AS my FROM "
            "(SELECT *, avg(p) OVER (PARTITION BY segment) AS mp, avg(outcome) OVER (PARTITION BY segment) AS my FROM forecasts) GROUP BY segment)", "forecasts"),
        "metric_bundle": _sql(
            f"SELECT b.*, ece, max_drawdown FROM (SELECT segment, round({_LOSS}, 6) AS log_loss, round(avg((p - outcome) ** 2), 6) AS brier, round(regr_slope(outcome, p), 6) AS slope, round(regr_intercept(outcome, p), 6) AS intercept, round(avg(clv), 6) AS mean_clv, "
            "round(sum(profit)::DOUBLE / sum(stake)::DOUBLE, 6) AS roi, round(avg(outcome) FILTER (stake > 0 AND NOT push), 6) AS win_rate, round(avg(push::INT), 6) AS push_rate, round(avg(edge), 6) AS avg_edge, count(*) AS n_recs, "
            "count(*) FILTER (stake > 0) AS n_wagers, round(sum(stake)::DOUBLE / count(*) FILTER (stake > 0), 6) AS avg_stake, round(avg(within80::INT), 6) AS coverage80 FROM forecasts GROUP BY segment) b "
            f"JOIN (SELECT segment, round(sum(n * abs(o - m)) / sum(n), 6) AS ece FROM (SELECT segment, {_BIN} AS b, count(*) AS n, avg(outcome) AS o, avg(p) AS m FROM forecasts GROUP BY ALL) GROUP BY segment) USING (segment) "
            "JOIN (SELECT segment, round(max((peak - balance) / peak), 6) AS max_drawdown FROM (SELECT *, max(balance) OVER (PARTITION BY segment ORDER BY point) AS peak FROM curve) WHERE peak > 0 GROUP BY segment) USING (segment)", "curve"),
        "performance_filtered": _sql(
            "SELECT seq % 18 + 1 AS week, count(*) AS n, round(avg(edge), 6) AS avg_edge, sum(profit)::DOUBLE AS profit FROM forecasts WHERE status IN ('BET', 'WATCH') AND seq % 3 = 0 AND seq % 4 <> 0 AND seq % 72 >= 24 "
            "AND seq % 20 >= 10 GROUP BY week", "forecasts"),
        "performance_cube": _sql(" UNION ALL ".join(_bundle(f"'{facet}' AS facet, g::VARCHAR AS value", value) for facet, value in _FACETS.items()), "forecasts"),
        "performance_tier_side_week": _sql(_bundle("", "1", "WHERE edge >= 0.03 AND seq % 2 = 0 AND seq % 18 + 1 = 5"), "forecasts"),
        "edge_tier_slices": _sql(
            f"SELECT 'edge' AS slice, d.name, {slices} FROM (VALUES ('<1%', -9, 0.01::DOUBLE), ('1–3%', 0.01::DOUBLE, 0.03::DOUBLE), ('≥3%', 0.03::DOUBLE, 9)) d(name, lo, hi) LEFT JOIN forecasts f ON edge >= lo AND edge < hi GROUP BY d.name "
            f"UNION ALL SELECT 'status', d.name, {slices} FROM (VALUES ('BET'), ('WATCH'), ('PASS'), ('DATA INCOMPLETE')) d(name) LEFT JOIN forecasts f ON status = d.name GROUP BY d.name", "forecasts"),
        "bankroll_curve": _sql("SELECT segment, point::INT AS point, round(balance, 2) AS balance FROM curve", "curve"),
        "settled_curve": _sql(
            "SELECT bet_id, user_id, (10000 + (SELECT sum(delta) FROM positions b WHERE b.user_id = a.user_id AND b.result <> 'PENDING' AND (b.settled_at, b.bet_id) <= (a.settled_at, a.bet_id)))::DOUBLE AS balance FROM positions a WHERE result <> 'PENDING'", "positions"),
        "max_drawdown": _sql("SELECT segment, round(max((peak - balance) / peak), 6) AS max_drawdown FROM (SELECT *, max(balance) OVER (PARTITION BY segment ORDER BY point) AS peak FROM curve) WHERE peak > 0 GROUP BY segment", "curve"),
        "drawdown_curve": _sql(
            "SELECT segment, point::INT AS point, round(peak, 2) AS peak, round(CASE WHEN peak > 0 THEN (balance - peak) / peak * 100 ELSE 0 END, 6) AS drawdown_pct FROM (SELECT *, max(balance) OVER (PARTITION BY segment ORDER BY point) AS peak FROM curve)", "curve"),
        "running_clv": _sql("SELECT segment, seq, row_number() OVER w AS n, floor((sum(seq % 21 - 10) OVER w)::DOUBLE / (10 * row_number() OVER w) * 1e6 + 0.5) / 1e6 AS mean_clv FROM forecasts WINDOW w AS (PARTITION BY segment ORDER BY seq)", "forecasts"),
        "closing_line_value": _sql(
            f"SELECT g.game_id, round(({_imp('n.home_american')} - {_imp('o.home_american')}) * 100, 6) AS clv FROM (SELECT DISTINCT game_id FROM quotes) g LEFT JOIN latest n ON n.game_id = g.game_id AND n.market = 'MONEYLINE' "
            "LEFT JOIN quotes o ON o.game_id = g.game_id AND o.market = 'MONEYLINE' AND o.is_opening", "latest"),
        "global_balance": _sql("SELECT seq, (sum(profit) OVER (ORDER BY seq))::DOUBLE AS total FROM forecasts", "forecasts"),
        "vintage_delta": _sql(
            "SELECT part_id, vintage, round(dm, 6) AS margin_delta, round(dp, 6) AS probability_delta, CASE WHEN dm IS NULL THEN 'baseline' WHEN abs(dm) > 0.5 OR abs(dp) > 0.01 THEN 'moved' ELSE 'stable' END AS note FROM (SELECT part_id, vintage, "
            "m - lag(m) OVER w AS dm, pr - lag(pr) OVER w AS dp FROM (SELECT part_id, vintage, m, " + _above_zero("m", "13.2") + " AS pr FROM (SELECT part_id, vintage, mu * f AS m FROM projection, (VALUES (0, 0.45::DOUBLE), (1, 0.7::DOUBLE), (2, 1.0::DOUBLE)) v(vintage, f))) "
            "WINDOW w AS (PARTITION BY part_id ORDER BY vintage))", "projection"),
        "exposure_grouping_sets": _sql(
            " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c}::VARCHAR AS key, sum(stake)::DOUBLE AS stake FROM positions WHERE result = 'PENDING' GROUP BY {c}" for c in ("game_id", "team", "cluster")), "positions"),
        "open_exposure": _sql(
            "SELECT user_id, coalesce(sum(stake) FILTER (result = 'PENDING'), 0)::DOUBLE AS open_stake, round(coalesce(sum(stake) FILTER (result = 'PENDING'), 0)::DOUBLE / 1e7, 9) AS open_pct, count(*) FILTER (result = 'PENDING') AS n_open, "
            "count(*) FILTER (result <> 'PENDING') AS n_settled FROM positions GROUP BY user_id", "positions"),
        "realized_pnl": _sql("SELECT team, coalesce(sum(delta) FILTER (result <> 'PENDING'), 0)::DOUBLE AS realized, 1e7 - coalesce(sum(stake) FILTER (result = 'PENDING'), 0)::DOUBLE AS available FROM positions GROUP BY team", "positions"),
        "balance_reconciliation": _sql("SELECT user_id, (10000 + sum(delta))::DOUBLE AS balance FROM positions GROUP BY user_id", "positions"),
        "settlement_ledger": _sql(
            f"SELECT bet_id, result AS new_result, error, CASE WHEN error IS NULL THEN CASE result WHEN 'VOID' THEN 'VOIDED' ELSE 'SETTLED' END END AS event_type, CASE WHEN error IS NULL THEN {_delta('cents', 'american', 'result')}::DOUBLE END AS delta, "
            f"CASE WHEN error IS NULL THEN ({ledger_pay})::DOUBLE END AS payout, CASE WHEN error IS NULL THEN round(({_imp('closing')} - {_imp('american')}) * 100, 6) END AS clv "
            f"FROM ({every_settled}), (VALUES (NULL), ('already settled')) e(error) WHERE error IS NULL OR bet_id % 5 = 0", "positions"),
        "mean_clv_settled": _sql(f"SELECT result AS new_result, count(closing) AS n, round(avg(({_imp('closing')} - {_imp('american')}) * 100), 4) AS mean_clv FROM ({every_settled}) GROUP BY result", "positions"),
        "events_newest": _sql("SELECT bet_id, result, settled_at FROM positions WHERE result <> 'PENDING' ORDER BY settled_at DESC, bet_id DESC", "positions"),
        "placed_bets": _sql(
            "SELECT seq, CASE WHEN ok THEN id END AS bet_id, CASE WHEN ok THEN 'bev_' || substr(sha256(id || '|PLACED'), 1, 16) END AS event_id, "
            "CASE WHEN ok THEN printf('PAPER bet placed: %s %s @ %d, stake %.2f', side, market, american, v) WHEN v <= 0 THEN 'Stake must be positive.' ELSE 'Stake exceeds available bankroll.' END AS detail FROM ("
            "SELECT *, v > 0 AND v <= 300 AS ok, 'bet_' || substr(sha256(concat_ws('|', user_id, game_id, market, side, strftime(settled_at, '%Y-%m-%d'), seq)), 1, 16) AS id FROM ("
            "SELECT *, bet_id AS seq, CASE WHEN bet_id % 10 = 0 THEN 0 ELSE cents END AS v, CASE market WHEN 'TOTAL' THEN 'OVER' ELSE 'HOME' END AS side FROM positions))", "positions"),
        "stake_inputs": _sql(
            "SELECT seq, array_to_string(list_filter([CASE WHEN seq % 13 > 10 THEN 'uncertaintyMultiplier' END, CASE WHEN seq % 4 = 0 THEN 'calibrationMultiplier' END, "
            "CASE WHEN seq % 7 = 0 THEN 'bankroll' END], lambda x: x IS NOT NULL), ',') AS errors FROM forecasts", "forecasts"),
        "correction_fold": _sql(
            f"SELECT bet_id, result, corrections, {_delta('cents', 'american', 'result')}::DOUBLE AS delta, ({ledger_pay})::DOUBLE AS payout FROM (SELECT p.bet_id, p.cents, p.american, "
            "CASE WHEN s.bet_id IS NULL THEN 'PENDING' WHEN p.bet_id % 5 = 0 THEN 'PUSH' ELSE s.result END AS result, (s.bet_id IS NOT NULL AND p.bet_id % 5 = 0 AND s.result <> 'PUSH')::BIGINT AS corrections "
            f"FROM positions p LEFT JOIN ({settled}) s USING (bet_id))", "positions"),
        "correction_amounts": _sql(
            f"SELECT bet_id, CASE result WHEN 'PENDING' THEN 'not settled' WHEN 'PUSH' THEN 'no change' END AS error, CASE WHEN result NOT IN ('PENDING', 'PUSH') THEN -{_delta('cents', 'american', 'result')} END AS reversal, "
            "CASE WHEN result NOT IN ('PENDING', 'PUSH') THEN 0.0 END AS applied FROM positions", "positions"),
        "vintage_conflicts": "SELECT 'p' || (p_partkey * 2) AS prediction_id, p_partkey AS game_id, CASE WHEN p_partkey * 2 IN (SELECT p_partkey FROM part) THEN 'prediction exists' ELSE 'vintage exists' END AS conflict "
            "FROM part WHERE p_partkey * 2 IN (SELECT p_partkey FROM part) OR p_partkey % 4 = p_partkey % 5",
        "append_vintages": "SELECT model, count(*) AS n FROM (SELECT p_partkey % 5 AS model FROM part UNION ALL SELECT p_partkey % 4 FROM part WHERE p_partkey * 2 NOT IN (SELECT p_partkey FROM part) AND p_partkey % 4 <> p_partkey % 5) GROUP BY model",
        "invalidate_recs": _sql(
            "SELECT seq AS rec_id, status, CASE WHEN hit THEN 'Feed failed; first reason' ELSE 'first reason' END AS reasons, CASE WHEN hit THEN '2024-01-16' WHEN seq % 10 = 0 THEN '2024-01-31' END AS invalidated "
            "FROM (SELECT *, status IN ('BET', 'WATCH') AND seq % 10 <> 0 AND seq % 150 IN (SELECT game_id FROM failures) AS hit FROM forecasts)", "forecasts", "failures"),
        "rls_filter": _sql(
            "SELECT bet_id, CASE WHEN user_id % 10 <> 0 THEN user_id::VARCHAR END AS owner, result, 'shared' AS via FROM positions WHERE user_id = 7 OR user_id % 10 = 0 UNION ALL SELECT bet_id, '7', result, 'child' FROM positions WHERE user_id = 7", "positions"),
        "constraint_report": _sql(
            "SELECT x.c AS \"check\", count(*) AS rows, sum((NOT x.ok)::INT)::BIGINT AS failures FROM (SELECT unnest([{'c': 'stake_positive', 'ok': cents > 0}, {'c': 'probability_range', 'ok': cents / 500 BETWEEN 0 AND 1}, "
            "{'c': 'odds_magnitude', 'ok': abs(american) >= 100}, {'c': 'even_bet', 'ok': bet_id % 2 = 0}]) AS x FROM positions) GROUP BY x.c", "positions"),
        "key_report": "SELECT 'duplicate' AS kind, l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'orphan', o_custkey, count(*) FROM orders "
            "WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) GROUP BY o_custkey",
        "price_form": _sql(
            "SELECT seq, array_to_string(list_filter([CASE WHEN seq % 13 = 0 THEN 'book' END, CASE WHEN seq % 17 = 0 THEN 'selection' END, CASE WHEN seq % 5 = 0 THEN 'line' END, CASE WHEN seq % 7 = 0 THEN 'american' END, "
            "CASE WHEN seq % 300 > 240 THEN 'age' END, CASE WHEN seq % 3 = 0 THEN 'confirmed' END], lambda x: x IS NOT NULL), ',') AS errors FROM quotes", "quotes"),
        "update_guard": _sql(
            "SELECT bet_id, 'identity changed' AS violation, 'american' AS changed FROM positions WHERE result = 'PENDING' AND bet_id % 4 = 0 UNION ALL "
            "SELECT bet_id, 'settled without correction', 'result' FROM positions WHERE result <> 'PENDING' AND bet_id % 3 = 0 AND bet_id % 6 <> 0", "positions"),
        "mutation_audit": _sql("SELECT bet_id, CASE WHEN bet_id % 11 = 0 THEN 'deleted' ELSE 'updated' END AS mutation FROM positions WHERE bet_id % 11 = 0 OR bet_id % 13 = 0", "positions"),
        "injury_clusters": _sql("SELECT team_id, CASE WHEN position IN ('LT', 'C') THEN 'OL' ELSE position END AS position_group, game_id, count(*) AS n FROM injuries GROUP BY ALL HAVING count(*) >= 2", "injuries"),
        "injury_highlights": _sql(
            "SELECT report_id, 'Quarterback uncertainty' AS label FROM injuries WHERE position = 'QB' AND p > 0.15 AND p < 0.85 UNION ALL SELECT report_id, 'Offensive-line continuity' FROM injuries WHERE position IN ('LT', 'C') AND p < 0.9 "
            "UNION ALL SELECT report_id, 'Conflicting reports' FROM injuries WHERE report_id % 11 = 0 UNION ALL SELECT report_id, 'Practice-status deterioration' FROM injuries WHERE report_id % 6 = 0", "injuries"),
        "availability_summary": _sql(
            "SELECT game_id, round(worst_impact, 6) AS worst_impact, " + _SEVERITY.replace("{x}", "worst_impact") + " AS injury_severity, round(availability_impact, 6) AS availability_impact, quarterback_unresolved, injury_uncertain FROM summary", "summary"),
        "component_disagreement": _sql(
            "SELECT part_id, greatest(a, b, c, d) - least(a, b, c, d) > 6.5 AS components_disagree FROM (SELECT part_id, mu + part_id % 9 AS a, mu + (part_id * 2) % 9 AS b, mu + (part_id * 3) % 9 AS c, mu + (part_id * 4) % 9 AS d FROM projection)", "projection"),
        "dedupe_last_wins": _sql("SELECT game_id, market, selection, max(seq) AS seq FROM manual GROUP BY ALL", "manual"),
        "union_prices": _sql(
            "SELECT 'manual' AS source, market, count(*) AS n, min(american) AS low, max(american) AS high, count(DISTINCT game_id) AS games FROM manual GROUP BY market UNION ALL "
            "SELECT 'consensus', market, count(*), min(home_american), max(home_american), count(DISTINCT game_id) FROM quotes GROUP BY market", "manual", "quotes"),
        "append_missing": _sql("SELECT DISTINCT game_id, market FROM manual", "manual"),
        "recorded_not_live": _sql("SELECT bet_id, game_id FROM positions WHERE game_id NOT IN (SELECT game_id FROM games)", "positions", "games"),
        "correlated_positions": _sql(
            "SELECT game_id, market FROM best b WHERE market <> 'MONEYLINE' AND EXISTS (SELECT 1 FROM positions p WHERE p.result = 'PENDING' AND p.game_id = b.game_id AND p.market <> b.market)", "best", "positions"),
        "odds_board": _sql(
            "SELECT game_id, max(line) FILTER (market = 'SPREAD' AND is_opening) AS spread_open, max(line) FILTER (market = 'SPREAD' AND newest) AS spread, max(line) FILTER (market = 'TOTAL' AND is_opening) AS total_quote_open, "
            "max(line) FILTER (market = 'TOTAL' AND newest) AS total_quote, max(home_american) FILTER (market = 'MONEYLINE' AND newest) AS moneyline FROM "
            "(SELECT *, row_number() OVER (PARTITION BY game_id, market ORDER BY observed_at DESC, seq DESC) = 1 AS newest FROM upto_now) GROUP BY game_id", "upto_now"),
        "kickoff_window": "SELECT CASE WHEN isodow(ts) IN (5, 1, 2) THEN 'PRIMETIME' WHEN hour(ts) < 19 THEN 'SUN_EARLY' ELSE 'SUN_LATE' END AS \"window\", count(*) AS n FROM events GROUP BY 1",
        "formatted_quotes": _sql(
            f"SELECT seq, CASE WHEN home_american > 0 THEN '+' ELSE '' END || home_american AS american, printf('%.2f', {_dec('home_american')}) AS decimal, "
            "CASE WHEN market <> 'TOTAL' AND line = 0 THEN 'PK' ELSE CASE WHEN market <> 'TOTAL' AND line > 0 THEN '+' ELSE '' END || regexp_replace(line::VARCHAR, '\\.0$', '') END AS line, strftime(observed_at, '%Y-%m-%d %H:%MZ') AS at, "
            "seq || CASE WHEN seq % 100 BETWEEN 11 AND 13 THEN 'th' WHEN seq % 10 = 1 THEN 'st' WHEN seq % 10 = 2 THEN 'nd' WHEN seq % 10 = 3 THEN 'rd' ELSE 'th' END AS nth, "
            "CASE WHEN line >= 0 THEN '+' ELSE '' END || printf('%.1f', line) AS signed FROM quotes", "quotes"),
        "formatted_money": _sql(
            "SELECT bet_id, CASE WHEN delta >= 0 THEN '+' ELSE '−' END || '$' || format('{:,.2f}', abs(delta)::DOUBLE) AS signed, '$' || format('{:,.2f}', abs(delta)::DOUBLE) AS money, "
            "abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(bet_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296) - 2147483648)) AS seed FROM positions", "positions"),
        "json_state": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE regexp_extract(props, '\"k\": *([0-9]+)', 1)::INT END AS k, 'PAPER' AS mode FROM events",
    }


def _signed(a: str) -> str:
    return f"(CASE WHEN {a} > 0 THEN '+' ELSE '' END || {a})"


def _slate_sql(body: str) -> str:
    """``body`` over the display rows of the slate."""
    return _sql("", *_REC_VIEWS).rstrip() + _recs() + f"""
, slate AS (
  SELECT g.game_id, kickoff, CASE WHEN dayname(kickoff) IN ('Friday', 'Monday', 'Tuesday') THEN 'PRIMETIME' WHEN hour(kickoff) < 19 THEN 'SUN_EARLY' ELSE 'SUN_LATE' END AS kickoff_window,
         t2.abb AS away, t1.abb AS home, st.stadium, g.roof, a.line AS consensus_spread, 0 - p.mu AS model_spread, coalesce(0 - p.mu - a.line, 0) AS spread_diff,
         b.line + 45 AS consensus_total, p.total AS model_total, coalesce(p.total - (b.line + 45), 0) AS total_diff, p.home_win,
         coalesce(d.market, 'SPREAD') || ' ' || coalesce(d.selection, 'HOME') AS best_market, coalesce(d.edge, 0) AS edge, d.status,
         {_SEVERITY.replace("{x}", "s.worst_impact")} AS injury_severity, CASE WHEN g.roof IN ('DOME', 'RETRACTABLE_CLOSED') THEN 'NONE' ELSE coalesce(w.severity, 'MISSING') END AS weather_severity,
         p.completeness, {_NOW} - to_days((p.model_id + 13)::INT) AS prediction_at, lower(r.r_name) || ' 0.' || r.r_regionkey || '.0-demo' AS model
  FROM games g JOIN predictions p USING (game_id) JOIN decided d USING (game_id) LEFT JOIN summary s USING (game_id) LEFT JOIN weather w USING (game_id)
  LEFT JOIN latest a ON a.game_id = g.game_id AND a.market = 'SPREAD' LEFT JOIN latest b ON b.game_id = g.game_id AND b.market = 'TOTAL' LEFT JOIN region r ON r.r_regionkey = p.model_id
  LEFT JOIN (VALUES {_team_values()}) t1(id, abb, full_name) ON t1.id = g.home_team LEFT JOIN (VALUES {_team_values()}) t2(id, abb, full_name) ON t2.id = g.away_team
  LEFT JOIN (VALUES {_stadium_values()}) st(id, stadium, surface, altitude) ON st.id = g.home_team)
""" + body


def _stadium_values() -> str:
    rows = [line.replace("'", "''").split("|") for line in STADIUMS.split("\n")[1:-1]]
    return ", ".join(f"({i}, '{r[1]}', '{r[4]}', {r[6]})" for i, r in enumerate(rows))


_FACETS = {
    "status": "status", "market": "['SPREAD', 'TOTAL', 'MONEYLINE'][seq % 3 + 1]", "tier": "CASE WHEN edge < 0.01 THEN '<1%' WHEN edge < 0.03 THEN '1–3%' ELSE '≥3%' END",
    "venue": "CASE WHEN seq % 4 = 0 THEN 'INDOOR' ELSE 'OUTDOOR' END", "side": "CASE WHEN seq % 2 = 0 THEN 'FAVORITES' ELSE 'UNDERDOGS' END",
    "horizon": "CASE WHEN seq % 72 < 24 THEN '<24h' ELSE '≥24h' END", "data": "CASE WHEN seq % 20 >= 10 THEN 'HIGH' ELSE 'LOW' END", "week": "(seq % 18 + 1)",
}


def _bundle(names: str, by: str, where: str = "") -> str:
    """Metrics of the forecasts by an expression, straight from the rows."""
    rows = f"SELECT *, {by} AS g FROM forecasts {where}"
    return (
        f"SELECT {names + ', ' if names else ''}log_loss, brier, ece, slope, intercept, mean_clv, roi, win_rate, push_rate, avg_edge, n_recs, n_wagers, avg_stake, coverage80 FROM ("
        f"SELECT g, round({_LOSS}, 6) AS log_loss, round(avg((p - outcome) ** 2), 6) AS brier, "
        "round(regr_slope(outcome, p), 6) AS slope, round(regr_intercept(outcome, p), 6) AS intercept, round(avg(clv), 6) AS mean_clv, round(sum(profit)::DOUBLE / sum(stake)::DOUBLE, 6) AS roi, "
        "round(avg(outcome) FILTER (stake > 0 AND NOT push), 6) AS win_rate, round(avg(push::INT), 6) AS push_rate, round(avg(edge), 6) AS avg_edge, count(*) AS n_recs, count(*) FILTER (stake > 0) AS n_wagers, "
        f"coalesce(round(sum(stake)::DOUBLE / count(*) FILTER (stake > 0), 6), 0) AS avg_stake, round(avg(within80::INT), 6) AS coverage80 FROM ({rows}) GROUP BY g) JOIN "
        f"(SELECT g, round(sum(n * abs(o - m)) / sum(n), 6) AS ece FROM (SELECT g, {_BIN} AS b, count(*) AS n, avg(outcome) AS o, avg(p) AS m FROM ({rows}) GROUP BY ALL) GROUP BY g) USING (g)"
    )


def _team_values() -> str:
    rows = [line.split("|") for line in TEAMS.split("\n")[1:-1]]
    return ", ".join(f"({i}, '{r[0]}', '{r[1]}')" for i, r in enumerate(rows))
