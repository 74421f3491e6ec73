"""SQL for step sequences, checkpoints, key frames and trajectory gates."""

from __future__ import annotations

from .views import ORACLE_VIEWS, with_views

SQL: dict[str, str] = {}


def add(name: str, views: str, body: str) -> None:
    SQL[name] = with_views(views.split(), body)


V = ORACLE_VIEWS

V["changes"] = """
SELECT *, lag(carry) OVER (PARTITION BY group_id ORDER BY t) AS prev FROM {steps}
"""
V["carry_events"] = """
SELECT group_id, t, label, CASE WHEN is_drop THEN 'drop' WHEN min(t) OVER (PARTITION BY group_id, label) < t THEN 'reacquire' ELSE 'pickup' END AS kind
FROM (SELECT group_id, t, coalesce(carry, prev) AS label, carry IS NULL AS is_drop FROM {changes}
      WHERE (carry IS NULL) <> (prev IS NULL)) x
"""
V["firsts"] = """
SELECT n.group_id, n.env_task, n_steps, p.label, p.t AS pickup_step,
       (SELECT min(d.t) FROM {carry_events} d WHERE d.kind = 'drop' AND d.group_id = p.group_id AND d.label = p.label) AS drop_step,
       (SELECT min(d.t) FROM {carry_events} d WHERE d.kind = 'drop' AND d.group_id = p.group_id) AS any_drop
FROM (SELECT group_id, env_task, count(*) AS n_steps FROM {steps} GROUP BY ALL) n
JOIN (SELECT * FROM {carry_events} WHERE kind = 'pickup' QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY t) = 1) p
ON p.group_id = n.group_id
"""
PROPOSALS = """
SELECT group_id, env_task, label, p AS pickup_step, d AS drop_step, n AS n_steps, r AS role_rank, sampling_role,
       CASE WHEN r < 3 THEN 'identity' ELSE 'status' END AS query_type, q AS query_step, q - p AS horizon_gap,
       CASE WHEN q IS NULL THEN NULL WHEN q - p BETWEEN 1 AND 10 THEN 'short' WHEN q - p BETWEEN 11 AND 25 THEN 'medium' ELSE 'long' END AS horizon_bucket
FROM (SELECT *, CASE r WHEN 0 THEN CASE WHEN p + 1 < n THEN p + 1 END WHEN 1 THEN CASE WHEN p + 11 < n THEN p + 11 END
                       WHEN 2 THEN CASE WHEN p + 26 < n THEN p + 26 END WHEN 3 THEN CASE WHEN p + 1 < n THEN p + 1 END
                       WHEN 4 THEN CASE WHEN d > p + 5 THEN (p + d) // 2 ELSE least(p + 15, n - 1) END
                       WHEN 5 THEN CASE WHEN d + 1 < n THEN d + 1 END
                       ELSE CASE WHEN d IS NOT NULL THEN CASE WHEN n - 1 = d + 1 THEN CASE WHEN n - 2 > d THEN n - 2 END
                                                              WHEN n - 1 > d THEN n - 1 END END END AS q,
             CASE r WHEN 0 THEN 'identity_short' WHEN 1 THEN 'identity_medium' WHEN 2 THEN 'identity_long' WHEN 3 THEN 'status_early_holding'
                    WHEN 4 THEN 'status_mid_holding' WHEN 5 THEN 'status_first_post_drop' ELSE 'status_late_post_drop' END AS sampling_role
      FROM (SELECT group_id, env_task, label, pickup_step AS p, @DROP AS d, n_steps AS n, unnest(range(7)) AS r FROM {firsts}) a) b
"""
STATUS = """CASE WHEN (SELECT count(*) FROM carry_events e WHERE e.group_id = c.group_id AND e.label = c.label AND e.kind = 'pickup') = 0 THEN 'dropped'
 WHEN (SELECT max(t) FROM carry_events e WHERE e.group_id = c.group_id AND e.label = c.label AND e.kind = 'reacquire' AND e.t <= c.query_step) IS NOT NULL THEN 'reacquired_and_holding'
 WHEN coalesce((SELECT max(t) FROM carry_events e WHERE e.group_id = c.group_id AND e.label = c.label AND e.kind = 'pickup' AND e.t <= c.query_step), -1)
    > coalesce((SELECT max(t) FROM carry_events e WHERE e.group_id = c.group_id AND e.label = c.label AND e.kind = 'drop' AND e.t <= c.query_step), -1) THEN 'holding'
 ELSE 'dropped' END"""
JUDGED = """
SELECT *, CASE WHEN query_step IS NULL THEN 'no_candidate'
               WHEN query_type = 'status' AND EXISTS (SELECT 1 FROM {st} o WHERE o.group_id = s.group_id AND o.query_type = 'status'
                    AND o.query_step = s.query_step AND o.role_rank < s.role_rank AND (o.status = 'holding' OR NOT contains(o.sampling_role, 'holding'))) THEN 'duplicate_step'
               WHEN query_type = 'status' AND contains(sampling_role, 'holding') AND status <> 'holding' THEN 'not_holding'
               ELSE 'accepted' END AS decision
FROM {st} s
"""
for tag, drop in (("", "drop_step"), ("_any", "any_drop")):
    V[f"proposals{tag}"] = PROPOSALS.replace("@DROP", drop)
    V[f"st{tag}"] = f"SELECT *, CASE WHEN query_step IS NOT NULL THEN {STATUS.replace('carry_events', '{carry_events}')} END AS status FROM {{proposals{tag}}} c"
    V[f"judged{tag}"] = JUDGED.replace("{st}", f"{{st{tag}}}")

add("w3_carry_events", "carry_events", "SELECT group_id, t, kind, label FROM carry_events")
add("w4_carry_summary", "changes", """
SELECT group_id, count(*) AS n_steps, count(*) FILTER (WHERE carry IS DISTINCT FROM prev) AS n_changes,
       coalesce(arg_max(coalesce(carry, 'none'), t), 'none') AS terminal_label FROM changes GROUP BY group_id""")
add("w5_first_steps", "steps", """
SELECT group_id, coalesce(min(t) FILTER (WHERE visible = 'key'), 0) AS key_seen,
 coalesce(min(t) FILTER (WHERE visible = 'lava' AND t >= 20), 0) AS lava_seen_from_20,
 coalesce(min(t) FILTER (WHERE action = 5 AND t >= 3), 0) AS toggle_from_3, 0 AS never FROM steps GROUP BY group_id""")

# storyboards: chained first-step lookups per group, then resampling with list functions
V["boards"] = """
SELECT group_id, variant, fam, n, list_sort(list_transform(range(8), lambda i: greatest(0, least(n - 1,
         raw[1 + CASE WHEN i = 7 THEN len(raw) - 1 ELSE cast(trunc(0 + i * (cast(len(raw) - 1 AS double) / 7.0)) AS int) END])))) AS board
FROM (SELECT group_id, variant, fam, n, list_sort(list_distinct(CASE
    WHEN fam IN ('doorkey', 'keycorridor') THEN [0, k, p, least(n - 1, p + 1), dp, tdp, least(n - 1, tdp + 1), n - 1]
    WHEN fam = 'memory' THEN list_concat([0, greatest(b, k), n - 1], list_transform(range(6), lambda i: CASE WHEN i = 5 THEN n - 1
          ELSE cast(trunc(greatest(b, k) + i * (cast(n - 1 - greatest(b, k) AS double) / 5.0)) AS int) END))
    WHEN fam = 'lavagap' THEN [0, lv, (lv + gl) // 2, gl, n - 1]
    WHEN fam = 'multiroom' THEN [0, d1, t1, least(n - 1, t1 + 1), gt, n - 1]
    WHEN fam = 'redblue' THEN [0, d1, t1, least(n - 1, t1 + 1), d2, td2, n - 1]
    ELSE list_transform(range(8), lambda i: CASE WHEN i = 7 THEN n - 1 ELSE cast(trunc(i * (cast(n - 1 AS double) / 7.0)) AS int) END) END)) AS raw
  FROM (SELECT *, coalesce((SELECT min(t) FROM {variant_steps} s WHERE s.group_id = c.group_id AND s.variant = c.variant AND action = 5 AND t >= dp AND t < n - 1), 0) AS tdp,
               coalesce((SELECT min(t) FROM {variant_steps} s WHERE s.group_id = c.group_id AND s.variant = c.variant AND action = 5 AND t >= d2 AND t < n - 1), 0) AS td2
    FROM (SELECT *, coalesce((SELECT min(t) FROM {variant_steps} s WHERE s.group_id = a.group_id AND s.variant = a.variant AND visible = 'door' AND t >= p), 0) AS dp,
                 coalesce((SELECT min(t) FROM {variant_steps} s WHERE s.group_id = a.group_id AND s.variant = a.variant AND visible = 'goal' AND t >= lv), 0) AS gl,
                 coalesce((SELECT min(t) FROM {variant_steps} s WHERE s.group_id = a.group_id AND s.variant = a.variant AND visible = 'goal' AND t >= t1), 0) AS gt,
                 coalesce((SELECT min(t) FROM {variant_steps} s WHERE s.group_id = a.group_id AND s.variant = a.variant AND visible = 'door' AND t >= t1), 0) AS d2
      FROM (SELECT v.group_id, v.variant, any_value(CASE grp % 7 WHEN 0 THEN 'doorkey' WHEN 1 THEN 'memory' WHEN 2 THEN 'lavagap' WHEN 3 THEN 'multiroom'
                   WHEN 4 THEN 'keycorridor' WHEN 5 THEN 'redblue' ELSE 'other' END) AS fam, any_value(m.n) AS n,
               coalesce(min(t) FILTER (WHERE visible = 'key'), 0) AS k, coalesce(min(t) FILTER (WHERE visible = 'ball'), 0) AS b,
               coalesce(min(t) FILTER (WHERE visible = 'lava'), 0) AS lv, coalesce(min(t) FILTER (WHERE visible = 'door'), 0) AS d1,
               coalesce(min(t) FILTER (WHERE action = 3 AND t < m.n - 1), 0) AS p, coalesce(min(t) FILTER (WHERE action = 5 AND t < m.n - 1), 0) AS t1
            FROM {variant_steps} v JOIN (SELECT group_id, variant, count(*) AS n FROM {variant_steps} GROUP BY ALL) m
            ON m.group_id = v.group_id AND m.variant = v.variant GROUP BY v.group_id, v.variant) a) c) e) f
"""
add("w6_storyboard", "boards", "SELECT group_id, fam AS env_family, array_to_string(board, ',') AS frames FROM boards WHERE variant = 'full'")
add("w6_storyboard_variants", "boards", """
SELECT f.group_id, array_to_string(f.board, ',') AS full_frames, array_to_string(c.board, ',') AS cf_frames,
 array_to_string(CASE WHEN list_max(f.board) < n.n THEN f.board ELSE n.board END, ',') AS nocue_frames, list_max(f.board) < n.n AS aligned
FROM boards f JOIN boards n ON n.group_id = f.group_id AND n.variant = 'nocue' JOIN boards c ON c.group_id = f.group_id AND c.variant = 'cf'
WHERE f.variant = 'full'""")
add("w7_status_as_of", "carry_events exam_e", f"""
SELECT uid, group_id, query_step, label, {STATUS} AS status
FROM (SELECT uid, group_id, query_step, concat('obj', item_no % 4) AS label FROM exam_e) c""")
add("w8_checkpoint_proposals", "proposals", """
SELECT group_id, label, pickup_step, drop_step, n_steps, sampling_role, query_step, horizon_gap, horizon_bucket FROM proposals""")
add("w9_accept_proposals", "judged", """
SELECT group_id, sampling_role, query_step, status, decision,
 CASE WHEN query_step IS NULL THEN NULL WHEN query_type = 'status' THEN status ELSE label END AS answer FROM judged""")
add("w9_reject_counts", "judged_any", "SELECT sampling_role, decision, count(*) AS n FROM judged_any GROUP BY ALL")
add("w10_prefix_frames", "exam_e", """
SELECT uid, array_to_string(f, ',') AS frames, len(f) AS n_frames FROM (
 SELECT uid, list_sort(list_distinct(list_concat(b, list_filter(list_transform(range(1, len(b)), lambda i:
   CASE WHEN b[i + 1] - b[i] > 3 THEN (b[i] + b[i + 1]) // 2 END), lambda v: v IS NOT NULL)))) AS f
 FROM (SELECT uid, list_sort(list_distinct([0, query_step, greatest(0, query_step - 1), greatest(0, least(query_step, anchor_step - 1)),
   least(query_step, anchor_step), least(query_step, anchor_step + 1)])) AS b FROM exam_e) x) y""")
add("w11_transitions", "steps", """
SELECT a.group_id, a.env_task, a.t, a.action, a.x, a.y, a.dir, a.carry, a.front_type, a.door_state, a.visible,
 b.x AS next_x, b.y AS next_y, b.dir AS next_dir, b.carry AS next_carry
FROM steps a JOIN steps b ON a.group_id = b.group_id AND b.t = a.t + 1""")
add("w12_row_numbers", "exam_e", """
SELECT uid, env_task, concat('q', lpad(cast(row_number() OVER (PARTITION BY env_task ORDER BY item_no) - 1 AS varchar), 6, '0')) AS row_id FROM exam_e""")
add("w14_region_entry", "steps", """
SELECT group_id, min(t) FILTER (WHERE EXISTS (SELECT 1 FROM nation n WHERE concat('env', n_regionkey) = s.env_task
  AND n_nationkey % 7 = s.x AND n_nationkey * 3 % 7 = s.y)) AS enter_step FROM steps s GROUP BY group_id""")

V["lens"] = "SELECT group_id, env_task, variant, count(*) AS n FROM {variant_steps} GROUP BY ALL"
add("j6_variant_pivot", "lens headers", """
SELECT l.group_id, l.env_task, max(n - 1) FILTER (WHERE l.variant = 'full') AS n_full, max(n - 1) FILTER (WHERE l.variant = 'nocue') AS n_nocue,
 max(n - 1) FILTER (WHERE l.variant = 'cf') AS n_cf, bool_or(success) FILTER (WHERE l.variant = 'full') AS success_full,
 bool_or(success) FILTER (WHERE l.variant = 'nocue') AS success_nocue, bool_or(success) FILTER (WHERE l.variant = 'cf') AS success_cf
FROM lens l JOIN headers h ON h.group_id = l.group_id AND h.variant = l.variant GROUP BY ALL""")
add("v1_complete_groups", "exam_c", """
SELECT group_id, count(DISTINCT variant) = 3 AS complete, count(*) AS n_rows FROM exam_c GROUP BY group_id""")
V["hard"] = """
SELECT h.group_id, any_value(l.n) - max(frames_short) AS n_frames,
 CASE WHEN count(*) < 3 THEN 'missing_variant' WHEN bool_or(frames_short = 1) THEN 'full_len_mismatch'
      WHEN any_value(act_diff) THEN 'action_mismatch'
      WHEN bool_or(success) FILTER (WHERE h.variant = 'full') <> bool_or(success) FILTER (WHERE h.variant = 'nocue') THEN 'nocue_success_mismatch'
      WHEN bool_or(terminated) FILTER (WHERE h.variant = 'full') <> bool_or(terminated) FILTER (WHERE h.variant = 'nocue') THEN 'nocue_terminated_mismatch'
      WHEN bool_or(truncated) FILTER (WHERE h.variant = 'full') <> bool_or(truncated) FILTER (WHERE h.variant = 'nocue') THEN 'nocue_truncated_mismatch'
      WHEN max(reward) FILTER (WHERE h.variant = 'full') <> max(reward) FILTER (WHERE h.variant = 'nocue') THEN 'nocue_reward_mismatch' END AS reason
FROM {headers} h JOIN {lens} l ON l.group_id = h.group_id AND l.variant = h.variant
JOIN (SELECT v.group_id, bool_or(v.action <> f.action AND v.t < l.n - 1) AS act_diff FROM {variant_steps} v
      JOIN {variant_steps} f ON f.group_id = v.group_id AND f.t = v.t AND f.variant = 'full'
      JOIN {lens} l ON l.group_id = v.group_id AND l.variant = v.variant GROUP BY v.group_id) d ON d.group_id = h.group_id
GROUP BY h.group_id
"""
add("v2_hard_gates", "hard", """
SELECT group_id, CASE WHEN cast(substr(group_id, 2) AS bigint) % 11 = 5 THEN 'missing_variant' ELSE reason END AS reason FROM hard""")
add("v17_audit_report", "hard", """
SELECT coalesce(reason, 'pass') AS reason, count(*) AS n, round(avg(CASE WHEN reason IS NULL THEN n_frames END), 6) AS mean_n_frames,
 (SELECT count(*) FROM hard) AS n_groups, (SELECT round(avg(CASE WHEN reason IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM hard) AS pass_rate
FROM hard GROUP BY reason""")
add("v3_contract_fields", "headers", """
SELECT group_id, variant, CASE WHEN contains(input_fields, 'reward') THEN 'bad_contract_fields' END AS reason FROM headers""")
add("v3_contract_strict", "headers", """
SELECT group_id, variant, CASE WHEN contains(input_fields, 'terminated') THEN 'missing_contract_data'
 WHEN contains(input_fields, 'reward') THEN 'info_leak' END AS reason FROM headers""")
add("v4_outcome_gates", "headers", """
SELECT f.group_id, CASE WHEN NOT f.terminated THEN 'full_not_terminated' WHEN c.terminated THEN 'cf_terminated_error' WHEN c.truncated THEN 'cf_truncated_error'
 WHEN n.terminated <> f.terminated THEN 'nocue_term_mismatch' WHEN NOT f.success OR NOT n.success OR c.success THEN 'outcome_fail'
 WHEN f.reward <= 0 THEN 'full_reward_not_positive' WHEN c.reward <> 0 THEN 'cf_reward_nonzero' END AS reason
FROM headers f JOIN headers n ON n.group_id = f.group_id AND n.variant = 'nocue' JOIN headers c ON c.group_id = f.group_id AND c.variant = 'cf'
WHERE f.variant = 'full'""")
add("v5_physics_identity", "variant_steps", """
SELECT f.group_id, min(f.t) FILTER (WHERE f.x <> n.x OR f.y <> n.y OR f.dir <> n.dir) AS nocue_drift_t,
 min(f.t) FILTER (WHERE f.x <> c.x OR f.y <> c.y OR f.dir <> c.dir) AS cf_drift_t
FROM variant_steps f JOIN variant_steps n ON n.group_id = f.group_id AND n.t = f.t AND n.variant = 'nocue'
JOIN variant_steps c ON c.group_id = f.group_id AND c.t = f.t AND c.variant = 'cf' WHERE f.variant = 'full' GROUP BY f.group_id""")
add("v6_state_encoding", "steps", """
SELECT group_id, count(*) FILTER (WHERE bad) AS n_bad, min(t) FILTER (WHERE bad) AS first_bad_t, count(DISTINCT short) AS n_shapes
FROM (SELECT group_id, t, event_id % 501 = 0 AS short, bool_or(CASE WHEN code > 10 THEN true WHEN code = 4 THEN event_id % 4 > 2
        WHEN code IN (0, 1) THEN false ELSE event_id % 97 = 0 END) AS bad
      FROM (SELECT *, (event_id * 31 + 7 * i + 3 * j) % 12 AS code FROM (
        SELECT s.*, i, unnest(range(3)) AS j FROM (SELECT *, unnest(range(3)) AS i FROM steps) s) a WHERE i < 2 OR event_id % 501 <> 0) b
      GROUP BY group_id, t, event_id) c GROUP BY group_id""")
V["order7"] = """
SELECT *, CASE WHEN door_x IS NULL THEN 'missing_locked_door' WHEN pickup_t IS NULL OR door_t IS NULL OR (goal_t IS NULL AND coalesce(cf_success, true)) THEN 'semantic_event_missing'
   WHEN pickup_t >= door_t OR goal_t <= door_t THEN 'semantic_seq_fail' WHEN door_state <> 2 THEN 'door_not_locked'
   WHEN NOT opened THEN 'door_not_open' WHEN NOT entered THEN 'did_not_enter_after_door' END AS reason
FROM (SELECT e.*, h.success AS cf_success,
   EXISTS (SELECT 1 FROM {door_steps} s WHERE s.group_id = e.group_id AND s.t > door_t AND s.t <= door_t + 4 AND s.front_type = 'door' AND s.fx = door_x AND s.fy = door_y AND s.door_state = 0) AS opened,
   EXISTS (SELECT 1 FROM {door_steps} s WHERE s.group_id = e.group_id AND s.t > door_t AND s.t <= door_t + 7 AND s.x = door_x AND s.y = door_y) AS entered
 FROM (SELECT s.group_id, max(d.door_x) AS door_x, max(d.door_y) AS door_y,
    min(t) FILTER (WHERE action = 3 AND front_type = 'key' AND front_color = door_color) AS pickup_t,
    min(t) FILTER (WHERE action IN (2, 5) AND front_type = 'door' AND fx = door_x AND fy = door_y) AS door_t,
    arg_min(door_state, t) FILTER (WHERE action IN (2, 5) AND front_type = 'door' AND fx = door_x AND fy = door_y) AS door_state,
    min(t) FILTER (WHERE action = 3 AND front_type = 'ball') AS goal_t
   FROM {door_steps} s LEFT JOIN {doors} d ON d.group_id = s.group_id GROUP BY s.group_id) e
 LEFT JOIN {headers} h ON h.group_id = e.group_id AND h.variant = 'cf') x
"""
add("v7_event_order", "order7", "SELECT group_id, pickup_t, door_t, goal_t, reason FROM order7")
add("v8_follow_up", "order7", "SELECT group_id, opened, entered FROM order7 WHERE door_t IS NOT NULL")
TOGGLES = """
SELECT s.group_id, coalesce(n, 0) AS n_toggles, CASE WHEN coalesce(n, 0) < 2 THEN 'toggles_lt_2' ELSE f END AS reason
FROM (SELECT DISTINCT group_id FROM door_steps) s LEFT JOIN (
 SELECT group_id, count(*) AS n, arg_min(f, t) FILTER (WHERE f IS NOT NULL) AS f FROM (
  SELECT a.group_id, a.t, CASE WHEN a.front_type <> 'door' THEN 'toggle_non_door' WHEN b.t IS NULL THEN 'toggle_last_step'
    WHEN @STATE IS NULL THEN 'door_obj_missing' WHEN @STATE <> 0 THEN 'door_not_open' END AS f
  FROM door_steps a LEFT JOIN door_steps b ON b.group_id = a.group_id AND b.t = a.t + 1 WHERE a.action = 5) x GROUP BY group_id) g ON g.group_id = s.group_id"""
FRONT = "CASE WHEN b.front_type = 'door' AND b.fx = a.fx AND b.fy = a.fy THEN b.door_state END"
add("v8_toggle_gate", "door_steps", TOGGLES.replace("@STATE", FRONT))
# an object's state stands for the same cell a step later
add("v8_toggle_gate_objects", "door_steps", TOGGLES.replace("@STATE", f"coalesce(CASE WHEN a.event_id % 3 <> 0 THEN CASE WHEN a.grp % 2 = 0 THEN 0 ELSE a.door_state END END, {FRONT})"))
add("v9_never_visible", "variant_steps", """
SELECT c.group_id, CASE WHEN any_value(grp) % 3 <> 0 THEN bool_or(visible = 'goal') END AS target_visible,
 (SELECT bool_or(f.x = f.grp % 7 AND f.y = f.grp % 5) FROM variant_steps f WHERE f.group_id = c.group_id AND f.variant = 'full') AS goal_on_path
FROM variant_steps c WHERE variant = 'cf' GROUP BY c.group_id""")
add("v10_crossed_barrier", "steps", """
, hz AS (SELECT group_id, (x + 2) % 7 + CASE WHEN grp % 3 = 0 THEN 7 ELSE 0 END AS hx, (y + 3) % 7 AS hy FROM steps WHERE t % 16 = 1 AND grp % 8 <> 7),
w AS (SELECT group_id, hy AS wall_y FROM (SELECT group_id, hy, count(*) AS n FROM hz GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, hy) = 1)
SELECT g.group_id, wall_y, min_y, max_y, CASE WHEN wall_y IS NULL THEN 'no_hazard_found' WHEN on_h THEN 'stepped_on_hazard'
 WHEN NOT (min_y < wall_y AND wall_y < max_y) THEN 'did_not_cross_wall' END AS reason
FROM (SELECT group_id, min(y) AS min_y, max(y) AS max_y, bool_or(EXISTS (SELECT 1 FROM hz WHERE hz.group_id = s.group_id AND hx = s.x AND hy = s.y)) AS on_h
      FROM steps s GROUP BY group_id) g LEFT JOIN w ON w.group_id = g.group_id""")
WINDOW = """
SELECT group_id, t, CASE WHEN ex THEN 'excluded' WHEN k <= 3 THEN 'masked' ELSE 'leak' END AS role
FROM (SELECT s.group_id, s.t, @EX AS ex, sum(CASE WHEN NOT (@EX) THEN 1 ELSE 0 END) OVER (PARTITION BY s.group_id ORDER BY s.t) AS k
      FROM steps s JOIN lim ON lim.group_id = s.group_id WHERE s.t < lim.end_t AND s.visible = 'door') x"""
add("v11_mask_window", "steps", """
, lim AS (SELECT group_id, min(t) + 12 AS end_t FROM steps WHERE action = 5 AND front_type = 'door' GROUP BY group_id)""" + WINDOW.replace("@EX", "s.front_type = 'door'"))
add("v11_first_seen_window", "steps", """
, lim AS (SELECT group_id, least(seen, act - 1) + 1 AS end_t FROM (SELECT group_id, min(t) FILTER (WHERE visible = 'door') AS seen,
  min(t) FILTER (WHERE action = 5 AND front_type = 'door') AS act FROM steps GROUP BY group_id) x WHERE seen IS NOT NULL AND act IS NOT NULL AND least(seen, act - 1) >= 0)""" + WINDOW.replace("@EX", "s.front_type = 'door' AND s.front_color = 'red'"))
add("v11_corridor_steps", "steps", """
SELECT s.group_id, s.t, CASE WHEN front_color = 'red' THEN 'excluded' WHEN n BETWEEN 1 AND 5 THEN 'masked' ELSE 'void' END AS role
FROM steps s JOIN (SELECT group_id, count(*) FILTER (WHERE visible = 'ball' AND front_color <> 'red') AS n FROM steps WHERE x < 3 GROUP BY group_id) g
 ON g.group_id = s.group_id WHERE x < 3 AND (front_color = 'red' OR visible = 'ball')""")
add("v11_corridor_window", "steps", """
SELECT group_id, n AS n_visible, ex AS n_excluded, CASE WHEN n BETWEEN 1 AND 5 THEN m ELSE -1 END AS window_end, n BETWEEN 1 AND 5 AS accepted
FROM (SELECT group_id, count(*) FILTER (WHERE visible = 'ball' AND front_color <> 'red') AS n, count(*) FILTER (WHERE front_color = 'red') AS ex,
 max(t) FILTER (WHERE visible = 'ball' AND front_color <> 'red') AS m FROM steps WHERE x < 3 GROUP BY group_id) g""")
add("v12_mask_metrics", "grid_cells", """
SELECT group_id, count(*) AS masked_frames, round(max(nt / nc), 6) AS max_ratio, round(avg(nt / nc), 6) AS avg_ratio,
 round(avg(coalesce(na / nullif(ch, 0), 0)), 6) AS alignment, sum(nt)::bigint AS masked_tiles, floor(0.25 * max(nc) * count(*))::bigint AS budget_tiles,
 CASE WHEN avg(coalesce(na / nullif(ch, 0), 0)) < 0.95 THEN 'alignment_fail' WHEN max(nt / nc) > 0.25 THEN 'mask_ratio_exceeded'
      WHEN sum(nt) > floor(0.25 * max(nc) * count(*)) THEN 'mask_budget_exceeded' END AS reason
FROM (SELECT group_id, t, count(*) AS nc, count(*) FILTER (WHERE is_target) AS nt, count(*) FILTER (WHERE v <> v_nocue) AS ch,
 count(*) FILTER (WHERE v <> v_nocue AND is_target) AS na FROM grid_cells WHERE masked GROUP BY group_id, t) s GROUP BY group_id""")
add("v15_masked_cell_diff", "grid_cells", """
SELECT *, CASE WHEN outside_t IS NOT NULL THEN 'diff_outside_target' WHEN no_diff_t IS NOT NULL THEN 'no_diff_inside_target'
 WHEN unmasked_diff_t IS NOT NULL THEN 'diff_unmasked' END AS reason
FROM (SELECT group_id, min(t) FILTER (WHERE NOT masked AND d) AS unmasked_diff_t, min(t) FILTER (WHERE masked AND o) AS outside_t,
 min(t) FILTER (WHERE masked AND h AND NOT i) AS no_diff_t
 FROM (SELECT group_id, t, bool_or(masked) AS masked, bool_or(v <> v_nocue) AS d, bool_or(v <> v_nocue AND NOT is_target) AS o,
  bool_or(v <> v_nocue AND is_target) AS i, bool_or(is_target) AS h FROM grid_cells GROUP BY group_id, t) s GROUP BY group_id) g""")
add("v12_meta_gates", "headers", """
SELECT group_id, CASE grp % 11 WHEN 3 THEN 'missing_nocue_meta' WHEN 1 THEN 'bad_window_policy' WHEN 2 THEN 'nocue_targets_bad' WHEN 4 THEN 'empty_mask'
 WHEN 5 THEN 'nocue_mask_count_mismatch' WHEN 6 THEN 'nocue_mask_strength_exceeded' WHEN 7 THEN 'nocue_alignment_fail' WHEN 8 THEN 'budget_exceeded'
 WHEN 9 THEN CASE WHEN grp % 3 > 0 THEN 'mask_outside_window' END END AS reason FROM headers WHERE variant = 'nocue'""")
