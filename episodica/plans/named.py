"""Queries that are SQL text over the functions of ``episodica.register``."""

from __future__ import annotations

from episodica.functions.named import register
from episodica.plans.registry import FRAMES_SQL, query
from episodica.sources.tables import table


def _sql(spark, sf_dir, text, *tables):
    register(spark)
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in tables})


@query("""WITH b AS (SELECT vec_id, [least(e[1], e[3]), least(e[2], e[4]), greatest(e[1], e[3]), greatest(e[2], e[4])]::DOUBLE[] AS a, [least(e[5], e[7]), least(e[6], e[8]), greatest(e[5], e[7]), greatest(e[6], e[8])]::DOUBLE[] AS b FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
i AS (SELECT *, greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0) AS i FROM b)
SELECT vec_id, round(i / nullif((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - i, 0), 9) AS overlap FROM i""")
def sql_box_overlap(spark, sf_dir):
    text = """SELECT vec_id, round(iou(array(least(e[0], e[2]), least(e[1], e[3]), greatest(e[0], e[2]), greatest(e[1], e[3])),
        array(least(e[4], e[6]), least(e[5], e[7]), greatest(e[4], e[6]), greatest(e[5], e[7]))), 9) AS overlap
        FROM (SELECT vec_id, cast(embedding AS ARRAY<DOUBLE>) AS e FROM {embeddings})"""
    return _sql(spark, sf_dir, text, "embeddings")


@query("""SELECT vec_id, 1.0::DOUBLE AS w, 0.0::DOUBLE AS rest FROM embeddings WHERE list_bool_or([v <> 0 FOR v IN embedding[1:4]])""")
def sql_quaternion_identity(spark, sf_dir):
    """A rotation and its inverse are none."""
    text = """SELECT vec_id, round(q[0], 9) AS w, round(abs(q[1]) + abs(q[2]) + abs(q[3]), 9) AS rest FROM (
        SELECT vec_id, quat_mul(e, quat_inv(e)) AS q FROM (SELECT vec_id, slice(cast(embedding AS ARRAY<DOUBLE>), 1, 4) AS e FROM {embeddings}) WHERE exists(e, x -> x <> 0))"""
    return _sql(spark, sf_dir, text, "embeddings")


@query("""SELECT vec_id, list_sort([v::DOUBLE FOR v IN embedding])[len(embedding) // 2 + 1] AS middle FROM embeddings""")
def sql_upper_median(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT vec_id, upper_median(cast(embedding AS ARRAY<DOUBLE>)) AS middle FROM {embeddings}", "embeddings")


_FRAMES = "frames AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM {events})"


@query(f"""WITH RECURSIVE {FRAMES_SQL},
s AS (SELECT user_id, 0::BIGINT AS i, 'above' AS kind, value AS level, NULL::BIGINT AS start, NULL::BIGINT AS opened, NULL::BIGINT AS closed FROM frames WHERE frame_index = 0
  UNION ALL SELECT s.user_id, f.frame_index, CASE WHEN c THEN 'below' WHEN o THEN 'above' ELSE kind END,
    CASE WHEN c OR o THEN f.value WHEN kind = 'above' THEN greatest(level, f.value) ELSE level END, CASE WHEN c THEN f.frame_index WHEN o THEN NULL ELSE start END, CASE WHEN o THEN start END, CASE WHEN o THEN f.frame_index END
  FROM s JOIN frames f ON f.user_id = s.user_id AND f.frame_index = s.i + 1,
    LATERAL (SELECT kind = 'above' AND greatest(level, f.value) - f.value > 40 AS c, kind = 'below' AND f.value > level + 40 AS o) t)
SELECT user_id::VARCHAR AS "group", opened AS start, closed AS "end" FROM s WHERE closed IS NOT NULL
UNION ALL SELECT user_id::VARCHAR, arg_max(start, i), -1 FROM s GROUP BY user_id HAVING arg_max(coalesce(start, -1), i) >= 0""")
def sql_hysteresis_runs(spark, sf_dir):
    """Cycles of a hysteresis of 40 by the table function; one that never opens again ends at -1."""
    text = f"""WITH {_FRAMES} SELECT `group`, start, coalesce(end, -1L) AS end FROM hysteresis_runs(
        TABLE(SELECT cast(user_id AS STRING) AS g, cast(frame_index AS LONG) AS i, value, 40D AS span FROM frames) PARTITION BY g ORDER BY i)"""
    return _sql(spark, sf_dir, text, "events")


@query(f"""WITH {FRAMES_SQL}, r AS (SELECT user_id, frame_index - row_number() OVER (PARTITION BY user_id ORDER BY frame_index) AS island, frame_index FROM frames WHERE value > 30),
runs AS (SELECT user_id, min(frame_index) AS start, max(frame_index) + 1 AS "end" FROM r GROUP BY user_id, island),
n AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY user_id ORDER BY start) < 3 THEN 0 ELSE 1 END AS new FROM runs),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start) AS k FROM n)
SELECT user_id::VARCHAR AS "group", min(start)::BIGINT AS start, max("end")::BIGINT AS "end" FROM g GROUP BY user_id, k""")
def sql_merge_runs(spark, sf_dir):
    """Near runs above 30 as one, by the table function."""
    text = f"""WITH {_FRAMES}, r AS (SELECT user_id, frame_index - row_number() OVER (PARTITION BY user_id ORDER BY frame_index) AS island, frame_index FROM frames WHERE value > 30),
        runs AS (SELECT cast(user_id AS STRING) AS g, cast(min(frame_index) AS LONG) AS start, cast(max(frame_index) + 1 AS LONG) AS end, 3L AS gap FROM r GROUP BY user_id, island)
        SELECT * FROM merge_runs(TABLE(SELECT g, start, end, gap FROM runs) PARTITION BY g ORDER BY start)"""
    return _sql(spark, sf_dir, text, "events")
