"""SQL for exam dimensions, prompts, requests, probes, mock answers and reports."""

from __future__ import annotations

from . import steps  # noqa: F401 - registers the storyboard views
from .views import with_views

SQL: dict[str, str] = {}


def add(name: str, views: str, body: str) -> None:
    SQL[name] = with_views(views.split(), body)


CONTRACT = "Answer with ONLY the correct letter (A/B/C/D). Return exactly one uppercase letter and no other text."

add("p1_with_uid", "exam_c", """
SELECT item_no, CASE WHEN item_no % 3 <> 0 THEN uid WHEN item_no % 2 = 0 THEN concat('x', item_no)
 WHEN item_no % 9 = 3 THEN concat(family, '.t', item_no, '.', variant)
 ELSE concat('line one line two of ', item_no) END AS uid FROM exam_c""")
add("p2_exam_dims", "gold_rows exam_c", r"""
SELECT uid, split_part(uid, '.', 1) AS task, CASE WHEN task IN ('A', 'C') THEN split_part(uid, '.', 2) END AS env_task,
 CASE WHEN task IN ('A', 'C') THEN split_part(uid, '.', 3) ELSE 'row_group' END AS group_id, CASE WHEN task = 'C' THEN split_part(uid, '.', 4) END AS variant,
 CASE WHEN task = 'C' THEN split_part(uid, '.', 5) END AS temporal, CASE WHEN task = 'C' THEN split_part(uid, '.', 6) END AS visual,
 NULL AS framing, CASE WHEN task = 'A' THEN cast(substr(split_part(uid, '.', 4), 2) AS bigint) ELSE 7 END AS t, 'exam.v1' AS schema_version FROM gold_rows
UNION ALL SELECT concat(uid, '.', framing), 'C', env_task, group_id, variant, temporal, visual, framing, NULL, 'exam.v1' FROM exam_c""")
add("p3_normalise_gold", "gold", "SELECT uid, task, gold FROM gold")
add("p4_strip_privileged", "headers", "SELECT group_id, variant, 'Reach the goal.' AS mission FROM headers")
add("p4_leak_report", "headers", """
SELECT unnest(['success', 'reward', 'terminated', 'truncated', 'cf_meta', 'nocue_meta', 'seed']) AS field,
 unnest([n, r, n, n, 0, 0, s]) AS n_rows, n AS n_total
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE reward > 0) AS r, count(*) FILTER (WHERE grp % 2 = 0) AS s FROM headers) x""")
V_EXAM = """, ex AS (SELECT uid, task, prompt, CASE WHEN NOT ends_with(uid, '9') THEN image END AS image FROM (
 SELECT uid, task, prompt, image FROM exam_a UNION ALL SELECT uid, task, prompt, image FROM exam_d UNION ALL SELECT uid, task, prompt, image FROM exam_c
 UNION ALL SELECT uid, task, CASE WHEN item_no % 31 <> 0 THEN prompt END, image FROM exam_e) u),
req AS (SELECT uid, task, concat('root/', image) AS image, CASE WHEN task = 'A' THEN concat(trim(prompt), chr(10), '@C')
  ELSE regexp_replace(prompt, '^\\s+|\\s+$', '', 'g') END AS prompt FROM ex WHERE image IS NOT NULL AND (task <> 'E' OR prompt IS NOT NULL))""".replace("@C", CONTRACT)
add("p5_build_requests", "exam_a exam_c exam_d exam_e", V_EXAM + """
SELECT uid, CASE WHEN task = 'E' THEN 'E_v12' ELSE task END AS task, image, md5(prompt) AS prompt_md5 FROM req""")
add("p5_idempotent", "exam_a", f"SELECT uid, concat(prompt, chr(10), '{CONTRACT}') AS p, true AS stable FROM exam_a")
add("p6_adapt_prompt", "", r"""
SELECT conv_id, turn, md5(regexp_replace(CASE WHEN turn % 2 = 0 THEN concat('Frames in order.', chr(10), text)
 WHEN starts_with(lower(trim(string_split(text, chr(10))[1])), 'below is') THEN concat('Frames in order.', substr(text, length(string_split(text, chr(10))[1]) + 1))
 ELSE concat('Frames in order.', chr(10), chr(10), text) END, '^\s+|\s+$', '', 'g')) AS prompt_md5 FROM conversations""")
add("p7_fan_out_framing", "exam_d", """
SELECT concat(uid, '.', f) AS uid, f AS framing, CASE WHEN item_no % 4 <> 0 THEN concat(line, chr(10), prompt) ELSE concat(line, chr(10), chr(10), 'Answer Yes or No.') END AS prompt
FROM exam_d CROSS JOIN (SELECT unnest(['pos', 'neu', 'neg']) AS f, unnest(['The run seems to reach its goal.', 'Below are two runs of one task.', 'The run seems to miss its goal.']) AS line) p""")
add("p8_fan_out_probes", "boards headers", """
SELECT concat_ws('.', 'C', env_task, b.group_id, b.variant, temporal, visual) AS uid, temporal, visual,
 CASE WHEN temporal = 'rev' THEN board[8] ELSE board[1] END AS first_frame, CASE WHEN temporal = 'rev' THEN board[1] ELSE board[8] END AS last_frame
FROM boards b JOIN headers h ON h.group_id = b.group_id AND h.variant = b.variant
CROSS JOIN (SELECT unnest(['orig', 'rev']) AS temporal) t CROSS JOIN (SELECT unnest(['clean', 'noisy', 'style']) AS visual) v""")
add("p8_request_options", "exam_d", """
SELECT concat_ws('.', uid, content_order, image_detail) AS uid, image, content_order, image_detail FROM exam_d
CROSS JOIN (SELECT unnest(['image_first', 'text_first']) AS content_order) a CROSS JOIN (SELECT unnest(['low', 'high']) AS image_detail) b""")
add("p9_action_mask", "exam_a", """
SELECT uid, CASE WHEN item_no % 8 <> 0 THEN '[UNKNOWN]' END AS action, CASE WHEN item_no % 8 <> 0 THEN replace(prompt, action, '[UNKNOWN]') ELSE prompt END AS prompt,
 CASE WHEN item_no % 8 <> 0 THEN action END AS original_action, CASE WHEN item_no % 8 <> 0 THEN 'mask' END AS ablation_type FROM exam_a""")
add("p10_action_shuffle", "exam_a", """
SELECT uid, env_task, coalesce(new, action) AS action, CASE WHEN new IS NOT NULL THEN replace(prompt, action, new) ELSE prompt END AS prompt,
 CASE WHEN new IS NOT NULL THEN action END AS original_action, CASE WHEN new IS NOT NULL THEN 'shuffle' END AS ablation_type
FROM (SELECT uid, env_task, action, prompt, o[1 + cast(concat('0x', substr(md5(concat_ws('|', '11', uid)), 1, 8)) AS bigint) % len(o)] AS new
  FROM (SELECT e.*, list_filter(p.acts, lambda a: a <> e.action) AS o FROM exam_a e
        JOIN (SELECT env_task, list_sort(list(DISTINCT action)) AS acts FROM exam_a GROUP BY env_task) p ON p.env_task = e.env_task) x) y""")
add("p11_mask_secrets", "", """
SELECT o_orderkey, unnest(['api_key', 'Max_Tokens', 'contents', 'session-token', 'X-Authorization-Hint', 'status', 'monkey']) AS field,
 unnest(['***MASKED_SECRET***', '512', '***MASKED_CONTENT***', '***MASKED_SECRET***', '***MASKED_SECRET***', o_orderstatus, '***MASKED_SECRET***']) AS shown FROM orders""")
OLD = """(SELECT uid, CASE WHEN item_no % 3 = 0 OR item_no % 7 <> 0 THEN prompt ELSE '' END AS q FROM exam_d)"""
RULE = "chr(10) || chr(10) || 'Reply with {} and nothing else.'"
add("p5_two_letters", "exam_d", f"""
SELECT uid, 'Three pictures follow: the start, outcome A and outcome B.' || chr(10) || q || {RULE.format('one letter, A or B,')} AS built, true AS stable FROM {OLD}""")
add("p5_yes_no", "exam_d", f"SELECT uid, q || {RULE.format('Yes or No')} AS built FROM {OLD}")
add("p11_mask_nested", "", """
SELECT o_orderkey, o_orderstatus AS status, '***MASKED_SECRET***' AS access_token, '***MASKED_SECRET***' AS call_key, '64' AS call_tokens,
 '***MASKED_SECRET***' AS header_key, true AS auth_hidden, NULL AS secret, 'x' AS model FROM orders""")
add("p15_buckets", "exam_e", """
SELECT uid, CASE WHEN horizon_gap BETWEEN 1 AND 10 THEN 'short' WHEN horizon_gap BETWEEN 11 AND 25 THEN 'medium' ELSE 'long' END AS horizon,
 CASE WHEN contains(sampling_role, 'holding') THEN 'kept' WHEN contains(sampling_role, 'drop') THEN 'released' WHEN contains(sampling_role, 'long') THEN 'far' ELSE 'other' END AS source_bucket,
 CASE WHEN query_step % 3 = 0 THEN 'with_turn' ELSE 'straight' END AS turn, 'C' AS kind FROM exam_e""")
add("p15_task_kind", "gold_rows", """
SELECT uid, CASE WHEN line_no % 2 = 0 AND task IN ('A', 'C', 'D') THEN task WHEN line_no % 3 = 0 AND task IN ('A', 'C', 'D') THEN task
 WHEN upper(answer) IN ('A', 'B', 'C', 'D') THEN 'A' ELSE 'C' END AS kind FROM gold_rows""")
add("p16_request_budget", "gold_rows", """
SELECT task, CASE task WHEN 'A' THEN 512 WHEN 'C' THEN 256 ELSE 512 END AS budget, count(*) AS n FROM gold_rows GROUP BY ALL""")
add("p17_response_rows", "responses", """
SELECT uid, model AS m, attempt, CASE WHEN b THEN 0 ELSE length(raw) END AS pred_chars, NOT b AND ok AS ok,
 coalesce(error, CASE WHEN b THEN '429 rate limit' END) AS error, CASE WHEN b THEN 'error' END AS finish_reason, 'judge' AS model
FROM (SELECT *, starts_with(raw, '__ERR__:') AS b FROM responses) x""")
SPLIT_PROMPT = "concat('Image 1 is the current state; images 2-5 are the candidates A, B, C, D.', chr(10), 'Select the state after the action.', chr(10), 'Action: ', action)"
add("p18_split_exam", "exam_a", f"""
SELECT uid, concat(b, '_current.png;', b, '_choice_A.png;', b, '_choice_B.png;', b, '_choice_C.png;', b, '_choice_D.png') AS images,
 CASE upper(trim(answer)) WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 END AS label, label AS original_label, {SPLIT_PROMPT} AS prompt, 3 AS c_image
FROM (SELECT *, concat(env_task, '/', group_id) AS b FROM exam_a) x""")
add("a21_prompt_lengths", "exam_a", f"""
SELECT count(*) AS n, round(avg(length(prompt)), 6) AS mean_before, round(avg(length({SPLIT_PROMPT})), 6) AS mean_after FROM exam_a""")
DIMS = ["env_task", "query_type", "horizon_bucket", "sampling_role"]
add("a8_distribution", "exam_e", " UNION ALL ".join(
    f"SELECT '{'+'.join(s)}' AS breakdown, " + ", ".join(f"{d if d in s else 'NULL'} AS {d}" for d in DIMS) + f", count(*) AS n FROM exam_e GROUP BY {', '.join(s)}"
    for s in (["env_task"], ["query_type"], ["horizon_bucket"], ["sampling_role"], ["env_task", "sampling_role"], ["env_task", "query_type", "horizon_bucket"])))
add("a20_composition", "exam_a", " UNION ALL ".join(
    f"SELECT '{d}' AS dim, cast({d} AS varchar) AS value, count(*) AS n FROM exam_a GROUP BY {d}" for d in ("difficulty_bucket", "distractor_strategy", "action", "label")))
add("s9_manifest", "exam_c", """
SELECT 'exam.v1' AS schema_version, count(*) AS n_rows, count(DISTINCT env_task) AS n_env_task, count(DISTINCT group_id) AS n_group_id,
 count(DISTINCT variant) AS n_variant, count(DISTINCT family) AS n_family FROM exam_c""")
add("s9_manifest_written", "exam_c", """
SELECT 'build' AS section, 'schema_version' AS key, 'exam.v1' AS value UNION ALL SELECT 'build', 'n_rows', count(*)::varchar FROM exam_c
UNION ALL SELECT 'build', 'n_env_task', count(DISTINCT env_task)::varchar FROM exam_c UNION ALL SELECT 'build', 'n_family', count(DISTINCT family)::varchar FROM exam_c
UNION ALL SELECT 'family', family, count(*)::varchar FROM exam_c GROUP BY family
UNION ALL SELECT 'env_task+variant', concat_ws('|', env_task, variant), count(*)::varchar FROM exam_c GROUP BY env_task, variant""")
add("u6_other_labels", "exam_e", """
SELECT uid, array_to_string(list_filter(['holding', 'dropped', 'key_red', 'lost'], lambda a: a <> answer), ',') AS others FROM exam_e""")
add("i1_batch_infer", "exam_a exam_c exam_d exam_e responses", V_EXAM + """
SELECT uid, 'stub' AS model, CASE WHEN v <> '' OR ends_with(uid, '3') THEN '' ELSE concat(length(prompt), ' chars') END AS pred,
 v = '' AND NOT ends_with(uid, '3') AS ok, CASE WHEN v <> '' THEN concat('D7_VIOLATION:', v) WHEN ends_with(uid, '3') THEN 'TimeoutError: no answer' END AS error,
 CASE WHEN v <> '' THEN 'd7_rejected' WHEN ends_with(uid, '3') THEN 'error' END AS finish_reason
FROM (SELECT *, array_to_string(list_filter(['reward', 'widget', 'success'], lambda w: contains(lower(prompt), w)), ',') AS v FROM req) x
WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.uid = x.uid AND r.model = 'm2' AND r.attempt = 0)""")
add("p17_usage_records", "exam_a exam_c exam_d exam_e", V_EXAM + """
SELECT task, 'chat' AS protocol, finish_reason, count(*) AS n_calls, sum(p)::bigint AS prompt_tokens, sum(c)::bigint AS completion_tokens,
 sum(p + c)::bigint AS total_tokens, round(avg(CASE WHEN finish_reason = 'stop' THEN 1.0 ELSE 0.0 END), 6) AS ok_rate
FROM (SELECT substr(uid, 1, 1) AS task, CASE WHEN v <> '' THEN 'd7_rejected' WHEN ends_with(uid, '7') THEN 'length' ELSE 'stop' END AS finish_reason,
  CASE WHEN v = '' THEN length(prompt) END AS p, CASE WHEN v = '' THEN length(uid) END AS c
 FROM (SELECT *, array_to_string(list_filter(['reward', 'widget', 'success'], lambda w: contains(lower(prompt), w)), ',') AS v FROM req) x) y GROUP BY ALL""")
MOCK = """
, m AS (SELECT *, CASE WHEN hit THEN r WHEN task = 'E' THEN e[1 + p % len(e)] WHEN r = 'Success' THEN 'Fail' WHEN r = 'Fail' THEN 'Success'
   WHEN r IN ('A', 'B', 'C', 'D') THEN l[1 + p % len(l)] ELSE concat(r, '_wrong') END AS pred
 FROM (SELECT *, list_filter(['holding', 'dropped', 'key_red', 'lost'], lambda a: a <> r) AS e, list_filter(['A', 'B', 'C', 'D'], lambda a: a <> r) AS l,
        cast(concat('0x', substr(md5(concat_ws('|', '11', uid)), 1, 8)) AS bigint) / 4294967296.0 < 0.65 AS hit,
        cast(concat('0x', substr(md5(concat_ws('|', '11', uid, 'wrong')), 1, 8)) AS bigint) AS p
   FROM (SELECT *, coalesce(CASE WHEN task = 'A' THEN upper(trim(answer)) ELSE answer END, CASE WHEN label = 1 THEN 'Success' WHEN label IS NOT NULL THEN 'Fail' END, 'Success') AS r FROM gold_rows) a) b)"""
add("i2_mock_responses", "gold_rows", MOCK + """
SELECT uid, task, pred, CASE WHEN task = 'E' THEN concat('{"answer": "', pred, '"}') ELSE pred END AS raw, true AS ok FROM m""")
add("i2_mock_accuracy", "gold_rows", MOCK + """
SELECT env_task, count(*) AS n, round(avg(CASE WHEN pred = answer THEN 1.0 ELSE 0.0 END), 6) AS acc FROM m WHERE task = 'E' GROUP BY env_task""")
