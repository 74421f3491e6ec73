"""SQL for scene tables, scene scores, repairs and content duplicates."""

from __future__ import annotations

from .views import ORACLE_VIEWS as V, with_views

SQL: dict[str, str] = {}


def add(name: str, views: str, body: str) -> None:
    SQL[name] = with_views(views.split(), body)


KEY = "concat_ws('|', type, px, py, {c}, CASE WHEN type = 'door' THEN cast(state AS varchar) ELSE '-' END)"
V["gold_set"] = f"SELECT DISTINCT scene_id, {KEY.format(c='color')} AS k FROM {{scene_objects}}"
V["pred_set"] = f"""SELECT DISTINCT scene_id, {KEY.format(c="CASE WHEN recoloured_by_judge THEN 'grey' ELSE color END")} AS k
FROM {{scene_objects}} WHERE NOT dropped_by_judge"""
V["scene_sets"] = """
SELECT h.*, coalesce(g.n, 0) AS ng, coalesce(p.n, 0) AS np, coalesce(b.n, 0) AS nb
FROM {scene_heads} h LEFT JOIN (SELECT scene_id, count(*) AS n FROM {gold_set} GROUP BY ALL) g ON g.scene_id = h.scene_id
LEFT JOIN (SELECT scene_id, count(*) AS n FROM {pred_set} GROUP BY ALL) p ON p.scene_id = h.scene_id
LEFT JOIN (SELECT scene_id, count(*) AS n FROM (SELECT * FROM {gold_set} INTERSECT SELECT * FROM {pred_set}) GROUP BY ALL) b ON b.scene_id = h.scene_id
"""
V["scene_parts"] = """
SELECT *, CASE WHEN fmt IN (4, 5, 7) THEN false ELSE true END AS readable,
 CASE WHEN fmt IN (0, 1, 2, 3) AND scene_id % 13 <> 0 THEN 1.0 ELSE 0.0 END AS agent_pos,
 CASE WHEN fmt IN (0, 1, 2, 3) THEN 1.0 ELSE 0.0 END AS agent_dir,
 CASE WHEN fmt IN (0, 1, 2, 3) THEN CASE WHEN carry_type IS NOT NULL AND scene_id % 17 = 0 THEN 0.0 ELSE 1.0 END
      ELSE CASE WHEN carry_type IS NULL THEN 1.0 ELSE 0.0 END END AS carrying,
 CASE WHEN fmt IN (0, 1, 2, 3, 6) AND scene_id % 19 <> 0 THEN 1.0 ELSE 0.0 END AS front_cell,
 CASE WHEN fmt IN (4, 5, 7) THEN CASE WHEN ng = 0 THEN 1.0 ELSE 0.0 END
      WHEN ng = 0 AND np = 0 THEN 1.0 ELSE nb / (ng + np - nb) END AS objects_jaccard FROM {scene_sets}
"""

add("p12_view_coords", "scene_heads scene_objects", """
SELECT scene_id, type, across + 4 AS vx, along + 1 AS vy, color, CASE WHEN type = 'door' THEN state END AS state, 3 AS view_dir
FROM (SELECT o.*, ax, CASE dir WHEN 0 THEN py - ay WHEN 1 THEN ax - px WHEN 2 THEN ay - py ELSE px - ax END AS across,
             CASE dir WHEN 0 THEN px - ax WHEN 1 THEN py - ay WHEN 2 THEN ax - px ELSE ay - py END AS along
      FROM (SELECT DISTINCT scene_id, type, px, py, color, state FROM scene_objects) o JOIN scene_heads h ON h.scene_id = o.scene_id) x
WHERE across + 4 BETWEEN 1 AND 7 AND along + 1 BETWEEN 1 AND 7 AND NOT (across = 0 AND along = 1)
 AND scene_id % 29 <> 5 AND (scene_id % 16 <> 3 OR across + 3 <= 4) AND (scene_id * (across + 5) + ax + 3 * (6 - along)) % 10 <> 0""")
OBJ = """(SELECT scene_id, count(*) AS n, string_agg(concat_ws('|', type, px, py, color, coalesce(st, '-')), ';' ORDER BY type, px, py, color, st NULLS FIRST) AS s,
 string_agg(concat_ws('|', type, px, py, color, coalesce(st, '-')), ';' ORDER BY concat_ws('|', type, px, py, color, coalesce(st, '-'))) AS ks
 FROM (SELECT DISTINCT scene_id, type, px, py, color, CASE WHEN type = 'door' THEN cast(state AS varchar) END AS st FROM scene_objects) d GROUP BY scene_id)"""
add("p13_canonical_scene", "scene_heads scene_objects", f"""
SELECT uid, coalesce(n, 0) AS n_objects, coalesce(s, '') AS objects FROM scene_heads h LEFT JOIN {OBJ} o ON o.scene_id = h.scene_id""")
add("p14_state_signature", "scene_heads scene_objects", f"""
SELECT uid, md5(concat_ws('|', ax, ay, dir, coalesce(carry_type, '-'), coalesce(carry_color, '-'), front_type, front_state, coalesce(ks, ''))) AS signature
FROM scene_heads h LEFT JOIN {OBJ} o ON o.scene_id = h.scene_id""")
add("x5_scene_json", "scene_sets", """
SELECT uid, CASE fmt WHEN 0 THEN 'strict' WHEN 6 THEN 'strict' WHEN 1 THEN 'recoverable' WHEN 2 THEN 'recoverable' WHEN 3 THEN 'recoverable' ELSE 'fail_json' END AS p_mode,
 fmt = 1 AS p_fence, CASE WHEN fmt < 4 THEN CASE WHEN scene_id % 13 = 0 THEN ax + 1 ELSE ax END END AS px, CASE WHEN fmt < 4 THEN dir END AS p_dir,
 CASE WHEN fmt < 4 AND scene_id % 17 <> 0 THEN carry_type END AS carry_type,
 CASE WHEN fmt < 4 OR fmt = 6 THEN CASE WHEN scene_id % 19 = 0 THEN 'lava' ELSE front_type END END AS front_type,
 CASE WHEN (fmt < 4 OR fmt = 6) AND scene_id % 19 <> 0 AND front_type = 'door' THEN cast(front_state AS varchar) END AS front_state,
 CASE WHEN fmt < 4 OR fmt = 6 THEN np ELSE 0 END AS n_objects, fmt < 4 AS p_has_carry FROM scene_sets""")
add("x5_mode_report", "scene_heads", """
SELECT CASE WHEN fmt IN (0, 6) THEN 'strict' WHEN fmt IN (1, 2, 3) THEN 'recoverable' ELSE 'fail_json' END AS parse_mode,
 fmt = 1 AS has_fence, count(*) AS n FROM scene_heads GROUP BY ALL""")
add("a4_scene_score", "scene_parts", """
SELECT uid, agent_pos, agent_dir, carrying, front_cell, round(objects_jaccard, 6) AS objects_jaccard,
 CASE WHEN readable THEN round(s, 6) ELSE 0 END AS score, readable AND s >= 0.9 AS correct,
 CASE WHEN NOT readable THEN 'B_json_parse_error' WHEN fmt = 6 THEN 'B_missing_agent_pos' END AS failure,
 CASE WHEN readable THEN CASE WHEN fmt = 6 THEN 'B_missing_agent_pos,B_missing_carrying,B_partial_schema' ELSE '' END END AS failure_tags,
 ng AS n_gold_objects, CASE WHEN readable THEN np ELSE 0 END AS n_pred_objects
FROM (SELECT *, (0.3::double * agent_pos + 0.15::double * carrying + 0.25::double * front_cell + 0.2::double * objects_jaccard) / 0.9::double AS s FROM scene_parts) x""")
V["scenes_scored"] = """
SELECT uid, model, env_task, mode, failure, ng, np, agent_pos, agent_dir, carrying, front_cell, objects_jaccard, fmt,
 failure IS NULL OR failure = 'B_missing_agent_pos' AS judged,
 CASE WHEN failure IS NULL OR failure = 'B_missing_agent_pos' THEN s ELSE 0 END AS score,
 (failure IS NULL OR failure = 'B_missing_agent_pos') AND s >= 0.9 AS correct
FROM (SELECT *, CASE WHEN m = 1 AND scene_id % 5 = 0 THEN 'missing_response' WHEN m = 2 AND scene_id % 7 = 0 THEN 'api_error'
  WHEN NOT readable THEN 'B_json_parse_error' WHEN scene_id % 29 = 0 THEN 'B_missing_gold' WHEN fmt = 6 THEN 'B_missing_agent_pos' END AS failure,
  CASE WHEN fmt IN (0, 6) THEN 'strict' WHEN fmt IN (1, 2, 3) THEN 'recoverable' ELSE 'fail_json' END AS mode, concat('m', m) AS model,
  (0.3::double * agent_pos + 0.15::double * carrying + 0.25::double * front_cell + 0.2::double * objects_jaccard) / 0.9::double AS s
 FROM {scene_parts} CROSS JOIN (SELECT unnest(range(3)) AS m) each_m) x
"""
add("a4_scene_exam", "scenes_scored", """
SELECT uid, model, failure, CASE WHEN failure IN ('missing_response', 'api_error') THEN 'fail' ELSE mode END AS parse_mode, correct, round(score, 6) AS score,
 CASE WHEN judged THEN agent_pos END AS agent_pos, CASE WHEN judged THEN agent_dir END AS agent_dir, CASE WHEN judged THEN carrying END AS carrying,
 CASE WHEN judged THEN front_cell END AS front_cell, CASE WHEN judged THEN round(objects_jaccard, 6) END AS objects_jaccard,
 CASE WHEN judged THEN ng END AS n_gold_objects, CASE WHEN judged THEN np END AS n_pred_objects,
 CASE WHEN judged THEN CASE WHEN fmt = 6 THEN 'B_missing_agent_pos,B_missing_carrying,B_partial_schema' ELSE '' END END AS failure_tags FROM scenes_scored""")
add("a4_scene_score_custom", "scene_parts", """
SELECT env_task, count(*) AS n, round(avg(s), 6) AS mean_score, count(*) FILTER (WHERE s >= 0.8) AS n_correct
FROM (SELECT *, CASE WHEN readable THEN (0.4::double * agent_pos + 0.1::double * agent_dir + 0.15::double * carrying + 0.25::double * front_cell
  + 0.3::double * objects_jaccard) / 1.2::double ELSE 0 END AS s FROM scene_parts) x GROUP BY env_task""")
add("u4_jaccard", "scene_sets", """
SELECT scene_id, ng AS n_left, np AS n_right, nb AS n_both, round(nb / (ng + np - nb), 6) AS jaccard FROM scene_sets WHERE ng + np > 0""")
add("w13_endpoint_picks", "scene_heads scene_objects", """
, o AS (SELECT DISTINCT scene_id, type, px, py, color, CASE WHEN type = 'door' THEN cast(state AS varchar) END AS st FROM scene_objects),
b AS (SELECT scene_id, min(px) AS mn, max(px) AS mx, count(*) AS n FROM o GROUP BY scene_id HAVING count(*) >= 3),
far AS (SELECT o.scene_id, count(*) AS nf FROM o JOIN b ON b.scene_id = o.scene_id AND o.px = b.mx GROUP BY o.scene_id),
cue AS (SELECT o.* FROM o JOIN b ON b.scene_id = o.scene_id AND o.px = b.mn QUALIFY row_number() OVER (PARTITION BY o.scene_id ORDER BY py, type, color) = 1),
tail AS (SELECT o.* FROM o JOIN b ON b.scene_id = o.scene_id JOIN far ON far.scene_id = o.scene_id WHERE nf < 2
         QUALIFY row_number() OVER (PARTITION BY o.scene_id ORDER BY px DESC, py DESC, type DESC, color DESC) <= 2),
cand AS (SELECT o.* FROM o JOIN b ON b.scene_id = o.scene_id AND o.px = b.mx JOIN far ON far.scene_id = o.scene_id WHERE nf >= 2 UNION ALL SELECT * FROM tail),
e AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY py, type, color, px) AS r FROM cand)
SELECT h.uid, concat_ws('|', c.type, c.color, c.px, c.py) AS cue, concat_ws('|', x.type, x.color, x.px, x.py) AS a, concat_ws('|', y.type, y.color, y.px, y.py) AS b,
 CASE WHEN (x.type = c.type AND x.color = c.color) AND NOT (y.type = c.type AND y.color = c.color) THEN 'a'
      WHEN (y.type = c.type AND y.color = c.color) AND NOT (x.type = c.type AND x.color = c.color) THEN 'b'
      WHEN x.type = c.type AND y.type <> c.type THEN 'a' WHEN y.type = c.type AND x.type <> c.type THEN 'b' ELSE 'ambiguous' END AS good_end
FROM scene_heads h JOIN cue c ON c.scene_id = h.scene_id JOIN e x ON x.scene_id = h.scene_id AND x.r = 1 JOIN e y ON y.scene_id = h.scene_id AND y.r = 2""")
add("j8_repair", "scene_heads", """
SELECT uid, env_task, CASE WHEN scene_id % 10 = 0 THEN scene_id % 7 ELSE scene_id % 20 END AS step,
 CASE WHEN scene_id % 10 = 0 THEN 'repaired' ELSE front_type END AS answer, CASE WHEN scene_id % 10 = 0 THEN 'replaced' ELSE 'kept' END AS provenance FROM scene_heads""")
add("j8_repair_counts", "scene_heads", """
SELECT env_task, CASE WHEN scene_id % 10 = 0 THEN 'replaced' ELSE 'kept' END AS provenance, count(*) AS n FROM scene_heads GROUP BY ALL""")
add("j9_patch_subset", "exam_d", """
SELECT uid, env_task, variant, CASE WHEN env_task = 'memory' THEN n_frames + 1 ELSE n_frames END AS n_frames,
 CASE WHEN env_task = 'memory' THEN replace(image, '.png', '_hybrid.png') ELSE image END AS image,
 CASE WHEN env_task = 'memory' THEN true END AS hybrid_first_frame,
 CASE WHEN env_task = 'memory' THEN cast(ceil((n_frames + 1) / 4) AS bigint) END AS layout_rows FROM exam_d""")
add("v14_asset_duplicates", "", """
SELECT lang, sum(n)::bigint AS n_total, count(*) AS n_unique, coalesce(sum(n) FILTER (WHERE n > 1), 0)::bigint AS n_colliding
FROM (SELECT lang, md5(text) AS hash, count(*) AS n FROM documents GROUP BY ALL) x GROUP BY lang""")
add("v14_colliding_assets", "", """
SELECT * FROM (SELECT lang, doc_id, md5(text) AS hash, count(*) OVER (PARTITION BY lang, md5(text)) AS n_copies FROM documents) x WHERE n_copies > 1""")
TERMS = ("the", "reward", "que", "success", "terminated")
FOUND = "array_to_string(list_filter([" + ", ".join(f"'{t}'" for t in TERMS) + "], lambda w: contains(lower(text), w)), ',')"
add("v16_payload_scan", "", f"""
SELECT conv_id, turn, v AS violations, v <> '' AS blocked, CASE WHEN v <> '' THEN concat('D7_VIOLATION:', v) END AS error,
 CASE WHEN v <> '' THEN 'd7_rejected' END AS finish_reason FROM (SELECT conv_id, turn, {FOUND} AS v FROM conversations) x""")
add("v16_term_automaton", "", """
SELECT conv_id, turn, len(v) AS n_terms, array_to_string(v, ',') AS violations, len(v) > 0 AS blocked, CASE WHEN len(v) > 0 THEN 'd7_rejected' END AS finish_reason
FROM (SELECT conv_id, turn, list_filter(ws, lambda w: contains(lower(coalesce(text, '')), w)) AS v FROM conversations,
 (SELECT coalesce(list(DISTINCT w ORDER BY w), []) AS ws FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) x WHERE length(w) >= 5) t) y""")
add("v13_exam_gates", "exam_e", """
SELECT gate, n_bad, n_bad = 0 AS passed, sample FROM (
SELECT 'future_steps' AS gate, count(*) AS n_bad, min(uid) AS sample FROM exam_e WHERE anchor_step > query_step
UNION ALL SELECT 'answer_outside_space', count(*), min(uid) FROM exam_e WHERE answer NOT IN ('holding', 'dropped', 'key_red')
UNION ALL SELECT 'uid_unique', count(*), min(uid) FROM (SELECT uid FROM exam_e GROUP BY uid HAVING count(*) > 1)
UNION ALL SELECT 'asset_missing', count(*), min(image) FROM exam_e WHERE item_no % 101 = 0
UNION ALL SELECT 'duplicate_query', count(*), min(k) FROM (SELECT concat_ws('|', group_id, query_type, query_step) AS k FROM exam_e GROUP BY group_id, query_type, query_step HAVING count(*) > 1)) g""")
add("v18_filter_members", "exam_d", """
SELECT uid, env_task, variant, subtask FROM exam_d WHERE variant IN ('full', 'nocue') AND subtask IN ('BUILDING', 'MACHINERY', 'FURNITURE')
 AND NOT (env_task = 'memory' AND variant = 'nocue')""")
