"""DuckDB twins of ``loadscope.sources.views`` as CTE text for the oracle SQL.

Each oracle query names the views it uses; ``with_views`` prefixes their definitions
(with dependencies) so the SQL runs on the driver's pre-registered base tables.
"""

from __future__ import annotations

from loadscope.functions import fixed


def _case(col: str, pairs, default: str) -> str:
    arms = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in pairs)
    return f"CASE {arms} ELSE '{default}' END"


_ZONE_CASE = "CASE " + " ".join(
    f"WHEN event_id % 19 = {i} THEN '{z}'" for i, z in enumerate(fixed.BODY_ZONES)) + " END"

VIEWS: dict[str, tuple[list[str], str]] = {
    "v_sessions": ([], f"""
        SELECT event_id AS session_id, 'ATH-' || CAST(user_id AS VARCHAR) AS athlete_id, ts, CAST(ts AS DATE) AS d,
               {_case('event_type', fixed.EVENT_TYPE_SPORT, 'Fitness Training')} AS sport,
               30 + event_id % 70 AS duration, 4 + event_id % 5 AS rpe,
               (30 + event_id % 70) * (4 + event_id % 5) AS load
        FROM events"""),
    "v_daily": (["v_sessions"], """
        SELECT athlete_id, d, CAST(count(*) AS BIGINT) AS n_sessions,
               CAST(sum(load) AS BIGINT) AS load, CAST(sum(duration) AS BIGINT) AS duration
        FROM v_sessions GROUP BY athlete_id, d"""),
    "v_athletes": ([], """
        SELECT 'ATH-' || CAST(c_custkey AS VARCHAR) AS athlete_id FROM customer
        UNION SELECT 'ATH-' || CAST(user_id AS VARCHAR) FROM events"""),
    "v_record": ([], f"""
        SELECT o_orderkey AS record_id, 'ATH-' || CAST(o_custkey AS VARCHAR) AS athlete_id,
               CAST(o_orderdate AS DATE) AS date,
               {_case('c_mktsegment', fixed.SEGMENT_SPORT, 'Fitness Training')} AS sport,
               {_case('o_orderpriority', fixed.PRIORITY_POSITION, '')} AS position,
               CAST(15 + o_orderkey % 36 AS DOUBLE) AS age,
               CAST(40 + o_orderkey % 111 AS DOUBLE) AS weight_kg,
               CAST(140 + o_orderkey % 81 AS DOUBLE) AS height_cm,
               CAST(o_orderkey % 401 AS DOUBLE) / 10.0 AS weekly_volume_hrs,
               CAST(o_orderkey % 101 AS DOUBLE) / 10.0 AS weekly_intensity_score,
               CAST(o_orderkey % 121 AS DOUBLE) / 10.0 AS sleep_hours,
               CAST((o_orderkey * 7) % 201 AS DOUBLE) AS hrv_ms,
               CAST((o_orderkey * 3) % 101 AS DOUBLE) / 10.0 AS soreness_score,
               CAST(o_orderkey % 8 AS INTEGER) AS rest_days,
               CAST(o_orderkey % 21 AS INTEGER) AS prior_injuries,
               CAST((o_orderkey * 13) % 400 AS DOUBLE) AS days_since_last_injury,
               CAST(40 + o_orderkey % 61 AS INTEGER) AS rhr,
               CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS injured
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "v_dirty0": (["v_record"], """
        SELECT record_id,
               CASE WHEN record_id % 23 = 0 THEN ' ath#' || substr(athlete_id, 5, 20) || '<x> '
                    ELSE athlete_id END AS athlete_id,
               date,
               CASE WHEN record_id % 31 = 0 THEN NULL ELSE sport END AS sport,
               position,
               CASE WHEN record_id % 29 = 0 THEN 200.0::DOUBLE ELSE age END AS age,
               weight_kg, height_cm, weekly_volume_hrs, weekly_intensity_score,
               CASE WHEN record_id % 17 = 0 THEN NULL ELSE sleep_hours END AS sleep_hours,
               CASE WHEN record_id % 19 = 0 THEN NULL ELSE hrv_ms END AS hrv_ms,
               soreness_score, rest_days, prior_injuries, days_since_last_injury, rhr,
               CASE WHEN record_id % 37 = 0 THEN NULL ELSE injured END AS injured
        FROM v_record"""),
    "v_dirty": (["v_dirty0"], """
        SELECT * FROM v_dirty0 UNION ALL SELECT * FROM v_dirty0 WHERE record_id % 50 = 0"""),
    "v_scored": ([], """
        SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS y,
               CAST(o_orderkey % 997 AS DOUBLE) / 997.0 AS p,
               CAST((o_orderkey * 31) % 983 AS DOUBLE) / 983.0 AS p2
        FROM orders"""),
    "v_discomfort": ([], f"""
        SELECT athlete_id, d, zone, max(severity) AS severity FROM (
          SELECT 'ATH-' || CAST(user_id AS VARCHAR) AS athlete_id, CAST(ts AS DATE) AS d,
                 {_ZONE_CASE} AS zone,
                 CAST(event_id % 4 AS INTEGER) AS severity
          FROM events) WHERE severity > 0 GROUP BY athlete_id, d, zone"""),
    "v_log_writes": ([], """
        SELECT event_id AS write_id, 'ATH-' || CAST(user_id AS VARCHAR) AS athlete_id, ts,
               CAST(ts AS DATE) AS d,
               CAST(20 + (event_id * 7) % 81 AS INTEGER) AS hrv,
               CAST(40 + (event_id * 3) % 41 AS INTEGER) AS rhr,
               4.0::DOUBLE + CAST(event_id % 61 AS DOUBLE) / 10.0 AS sleep_hours,
               CAST((event_id * 11) % 101 AS DOUBLE) / 10.0 AS soreness_score
        FROM events"""),
    "v_measures": (["v_sessions", "v_discomfort"], """
        WITH g AS (SELECT athlete_id, d, count(*) AS n_sessions, sum(duration) / 10.0 AS total_km,
                          sum(CASE WHEN rpe >= 7 THEN duration ELSE 0 END) / 10.0 AS z5_km,
                          sum(CASE WHEN rpe = 8 THEN duration ELSE 0 END) / 20.0 AS sprint_km,
                          avg(CAST(rpe AS DOUBLE)) AS exertion,
                          avg(CAST(1 + session_id % 9 AS DOUBLE)) AS recovery
                   FROM v_sessions GROUP BY athlete_id, d),
        b AS (SELECT athlete_id, min(d) AS lo, max(d) AS hi FROM g GROUP BY athlete_id),
        sp AS (SELECT athlete_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                      INTERVAL 1 DAY)) AS DATE) AS d FROM b),
        inj AS (SELECT DISTINCT athlete_id, d FROM v_discomfort WHERE severity = 3)
        SELECT sp.athlete_id, sp.d, coalesce(g.n_sessions, 0) AS n_sessions,
               coalesce(g.total_km, 0.0) AS total_km, coalesce(g.z5_km, 0.0) AS z5_km,
               coalesce(g.sprint_km, 0.0) AS sprint_km, g.exertion, g.recovery,
               CAST(CASE WHEN inj.athlete_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS injury
        FROM sp LEFT JOIN g ON sp.athlete_id = g.athlete_id AND sp.d = g.d
        LEFT JOIN inj ON sp.athlete_id = inj.athlete_id AND sp.d = inj.d"""),
    "v_players": (["v_record"], """
        SELECT record_id, age AS Player_Age, weight_kg AS Player_Weight, height_cm AS Player_Height,
               prior_injuries AS Previous_Injuries, weekly_intensity_score / 10.0 AS Training_Intensity,
               rest_days AS Recovery_Time, injured AS Likelihood_of_Injury FROM v_record"""),
    "v_users": ([], f"""
        SELECT 'user' || CAST(c_custkey AS VARCHAR) AS username,
               CASE WHEN c_custkey % 10 = 0 THEN 'Coach' WHEN c_custkey % 10 = 1 THEN 'Medical Staff'
                    WHEN c_custkey % 10 = 2 THEN 'Admin' ELSE 'Athlete' END AS role,
               CASE WHEN c_custkey % 10 > 2 THEN 'ATH-' || CAST(c_custkey AS VARCHAR) END AS athlete_id,
               CASE WHEN c_custkey % 10 = 0 THEN {_case('c_mktsegment', fixed.SEGMENT_SPORT, 'Fitness Training')} END
                 AS sport
        FROM customer"""),
    "v_chunks": ([], """
        SELECT conv_id AS id, turn AS seq, role, text AS content FROM conversations"""),
}


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(sql: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with CTEs for the named views (and any ``extra`` CTEs after them)."""
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in _order(list(names))]
    ctes += [f"{n} AS ({body})" for n, body in (extra or [])]
    if not ctes:
        return sql
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        # Merge the query's own CTE list after the view CTEs.
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
