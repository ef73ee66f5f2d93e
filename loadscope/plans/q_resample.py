"""Registered oversampling query."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope.operators import smote
from loadscope.plans.q_features import r6
from loadscope.plans.registry import register
from loadscope.sources import views

SEED, NEAR = 42, 5
_COLS = ["total_km", "z5_km", "sprint_km", "exertion", "recovery"]


def _share(what: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}|' || id || '|' || CAST(copy AS VARCHAR) || '|{what}'), 1, 8) AS BIGINT)"


_DISTANCE = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in _COLS)
_SAME = " AND ".join(f"r.{c} = p.{c}" for c in _COLS)
_POINT = ", ".join(f"q.{c}" for c in _COLS)

_SMOTE_SQL = f"""WITH r AS (SELECT athlete_id || '|' || CAST(d AS VARCHAR) AS id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _COLS)}, injury FROM v_measures),
few AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || id), id) AS hash_rank FROM r WHERE injury = 1),
c AS (SELECT count(*) AS n, (SELECT count(*) FROM r WHERE injury = 0) - count(*) AS need FROM few),
p AS (SELECT row_number() OVER () AS pid, * FROM (SELECT {", ".join(_COLS)}, count(*) AS n FROM few GROUP BY ALL)),
dist AS (SELECT p.pid, p.n AS own, q.n, {_POINT}, {_DISTANCE} AS d2 FROM p JOIN p AS q ON p.pid <> q.pid),
near AS (SELECT *, CAST(own - 1 + sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, row_number() OVER w AS place
         FROM dist AS q WINDOW w AS (PARTITION BY pid ORDER BY d2, {_POINT}) QUALIFY place <= {NEAR}),
made AS (SELECT r.*, p.pid, p.n AS own, unnest(range(1, CAST(c.need // c.n + CASE WHEN hash_rank <= c.need % c.n THEN 1 ELSE 0 END AS BIGINT) + 1)) AS copy
         FROM few AS r JOIN p ON {_SAME}, c),
drawn AS (SELECT *, {_share('neighbour')} % {NEAR} + 1 AS nth, CAST({_share('gap')} AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS way FROM made),
target AS (SELECT drawn.id, drawn.copy, {", ".join(f"arg_min(near.{c}, near.place) AS {c}" for c in _COLS)}
           FROM drawn JOIN near ON near.pid = drawn.pid AND near.upto >= drawn.nth WHERE drawn.nth > drawn.own - 1 GROUP BY drawn.id, drawn.copy)
SELECT id, {", ".join(f"round({c}, 6) AS {c}" for c in _COLS)}, injury, false AS synthetic FROM r
UNION ALL
SELECT s.id || '#' || CAST(s.copy AS VARCHAR), {", ".join(f"round(s.{c} + s.way * (coalesce(t.{c}, s.{c}) - s.{c}), 6)" for c in _COLS)}, 1, true
FROM drawn AS s LEFT JOIN target AS t ON t.id = s.id AND t.copy = s.copy"""


@register("r5_smote", _SMOTE_SQL, views=("v_measures",))
def r5_smote(spark, sf):
    days = views.daily_measures(spark, sf).withColumn("id", F.concat_ws("|", "athlete_id", F.col("d").cast("string")))
    return r6(smote.smote(days, _COLS, "injury", "id", NEAR, SEED))
