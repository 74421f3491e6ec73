"""SQL for the streaming queries: every window and session of the log."""

from __future__ import annotations

from . import steps  # noqa: F401 - registers the event views
from .views import with_views

SQL: dict[str, str] = {}


def add(name: str, views: str, body: str) -> None:
    SQL[name] = with_views(views.split(), body)


add("st1_first_answers", "", """
SELECT concat('m', user_id % 3) AS model, concat('q', event_id) AS uid, concat('first ', cast(floor(value) AS bigint)) AS answer FROM events""")
JUDGED = """
SELECT date_trunc('day', ts) AS period, concat('m', user_id % 3) AS model, x.task, event_type = 'error' OR event_id % 5 = 3 AS err,
  CASE event_id % 5 WHEN 0 THEN 'holding' WHEN 4 THEN 'holding' WHEN 1 THEN 'dropped' END AS ans, x.answer
FROM events v LEFT JOIN (SELECT * FROM exam_e WHERE item_no % 9 <> 4) x ON x.item_no = v.event_id"""
COUNTS = "count(*) AS n, count(*) FILTER (WHERE NOT err AND ans = answer) AS n_correct, count(*) FILTER (WHERE err) AS n_error"
PERIODS = f"SELECT period, model, task, {COUNTS} FROM ({JUDGED}) g GROUP BY period, model, task"
add("st2_totals_with_late_gold", "exam_e", f"SELECT model, task, {COUNTS} FROM ({JUDGED}) g GROUP BY model, task")
add("st2_running_accuracy", "exam_e", PERIODS)
add("st2_accuracy_so_far", "exam_e", f"""
SELECT period, model, task, n, n_correct, n_error, round(n_correct / n, 6) AS accuracy FROM (
 SELECT period, model, task, sum(n) OVER w AS n, sum(n_correct) OVER w AS n_correct, sum(n_error) OVER w AS n_error
 FROM ({PERIODS}) p WINDOW w AS (PARTITION BY model, task ORDER BY period)) s""")
add("st3_throughput_tumbling", "", """
SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", concat('m', user_id % 3) AS model, count(*) AS n_calls,
 count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM events GROUP BY ALL""")
add("st3_throughput_sliding", "", """
SELECT s AS start, s + INTERVAL 1 HOUR AS "end", model, count(*) AS n_calls, count(*) FILTER (WHERE NOT ok) AS n_errors
FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS s, concat('m', user_id % 3) AS model, event_type <> 'error' AS ok
      FROM events CROSS JOIN (SELECT unnest(range(4)) AS k) w) x GROUP BY ALL""")
add("st4_sessions", "", """
SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", user_id, count(*) AS n_calls
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
      FROM (SELECT ts, user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) a) b
GROUP BY user_id, s""")
add("st5_event_tracker", "carry_events", "SELECT group_id, t, kind, label FROM carry_events")
