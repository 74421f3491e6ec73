"""SQL for deduplication, joins, parsing and score tables."""

from __future__ import annotations

from .views import ORACLE_VIEWS as V, with_views

SQL: dict[str, str] = {}


def add(name: str, views: str, body: str) -> None:
    SQL[name] = with_views(views.split(), body)


STATS = """count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(cast(correct AS int)), 6) AS acc,
 round(avg(CASE WHEN failure = 'api_error' THEN 1.0 ELSE 0.0 END), 6) AS api_error_rate,
 round(avg(CASE WHEN failure = 'missing_response' THEN 1.0 ELSE 0.0 END), 6) AS missing_rate"""

add("w1_first_response", "readings", """
SELECT uid, model, attempt, ingest_seq, n_copies, verdict FROM (
 SELECT *, count(*) OVER (PARTITION BY uid, model) AS n_copies,
        row_number() OVER (PARTITION BY uid, model ORDER BY ingest_seq) AS rn FROM readings) WHERE rn = 1""")
add("w2_last_record", "responses", """
SELECT uid, model, attempt, ingest_seq, n_copies FROM (
 SELECT *, count(*) OVER (PARTITION BY uid, model) AS n_copies,
        row_number() OVER (PARTITION BY uid, model ORDER BY ingest_seq DESC) AS rn FROM responses) WHERE rn = 1""")
add("j1_gold_left_join", "gold first_resp", """
SELECT g.uid, m.model, task, gold, r.uid IS NOT NULL AS answered, r.attempt
FROM gold g CROSS JOIN (SELECT unnest(['m0', 'm1', 'm2']) AS model) m
LEFT JOIN first_resp r ON r.uid = g.uid AND r.model = m.model""")
add("j2_extra_responses", "gold_rows responses", """
SELECT DISTINCT uid FROM responses WHERE uid NOT IN (SELECT uid FROM gold_rows) ORDER BY uid LIMIT 50""")
add("j3_resume", "gold_rows responses", """
SELECT uid, task FROM gold_rows g WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.model = 'm1' AND r.uid = g.uid)""")
add("j3_resume_retry_errors", "gold_rows responses", """
SELECT uid, task FROM gold_rows g WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.model = 'm1' AND r.uid = g.uid AND r.ok)""")
PAIRS = """
pairs AS (SELECT a.uid, CASE WHEN NOT a.is_error THEN a.verdict END AS left_value,
                 CASE WHEN NOT b.is_error THEN b.verdict END AS right_value
          FROM first_readings a JOIN first_readings b ON a.uid = b.uid
          WHERE a.model = 'm0' AND b.model = 'm1' AND a.uid LIKE 'C.%')"""
SQL["j5_representation_pairs"] = with_views(["first_readings"], "").rstrip() + "," + PAIRS + "\nSELECT * FROM pairs"
SQL["a17_vcc"] = with_views(["first_readings"], "").rstrip() + "," + PAIRS + """
SELECT count(*) AS n_pairs, round(avg(CASE WHEN left_value = right_value THEN 1.0 ELSE 0.0 END), 6) AS vcc
FROM pairs WHERE left_value IS NOT NULL AND right_value IS NOT NULL"""
add("j7_pair_table", "scored_c", """
SELECT coalesce(o.model, r.model) AS model, coalesce(o.group_id, r.group_id) AS group_id,
       coalesce(o.variant, r.variant) AS variant, coalesce(o.visual, r.visual) AS visual,
       o.verdict AS verdict_orig, r.verdict AS verdict_rev
FROM (SELECT * FROM scored_c WHERE temporal = 'orig') o FULL JOIN (SELECT * FROM scored_c WHERE temporal = 'rev') r
ON o.model = r.model AND o.group_id = r.group_id AND o.variant = r.variant AND o.visual = r.visual""")
add("j11_enriched_export", "scored exam_e", """
SELECT e.uid, s.model, e.query_type, e.sampling_role, e.answer, s.failure, s.parse_mode, s.correct,
       cast(NULL AS varchar) AS gold_label
FROM exam_e e JOIN scored s ON s.uid = e.uid WHERE s.answered""")
add("j12_dimension_lookup", "exam_c", """
SELECT uid, family, CASE family WHEN 'fr' THEN 'French' WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE family END AS family_name,
       CASE family WHEN 'fr' THEN 1 WHEN 'en' THEN 2 WHEN 'de' THEN 3 ELSE 9 END AS family_rank FROM exam_c""")
IDR_PAIRS = """
SELECT f.model, f.group_id, f.verdict AS vf, c.verdict AS vc, f.correct AS kf, c.correct AS kc
FROM scored_c f JOIN scored_c c ON f.model = c.model AND f.group_id = c.group_id AND f.temporal = c.temporal AND f.visual = c.visual
WHERE f.variant = 'full' AND c.variant = 'cf'"""
IDR = """round(avg(CASE WHEN vf = 'Success' AND vc = 'Fail' THEN 1.0 ELSE 0.0 END), 6) AS idr"""
LES = """round(avg(CASE WHEN temporal = 'orig' THEN cast(correct AS int) END) /
 nullif(avg(CASE WHEN temporal = 'rev' THEN cast(correct AS int) END), 0), 6)"""
V["judges"] = """
SELECT *, CASE WHEN task = 'D' THEN concat(model, '-d') WHEN temporal = 'rev' AND task = 'C' AND visual = 'style' THEN concat(model, '-r') ELSE model END AS judge
FROM {scored} WHERE task IN ('C', 'D')
"""
JUDGE_PAIRS = """
SELECT f.judge, f.verdict AS vf, c.verdict AS vc FROM judges f JOIN judges c ON f.judge = c.judge AND f.group_id = c.group_id
 AND f.temporal IS NOT DISTINCT FROM c.temporal AND f.visual IS NOT DISTINCT FROM c.visual
WHERE f.variant = 'full' AND c.variant = 'cf'"""
add("j13_main_table", "judges", f"""
SELECT m.judge AS model, m.n, m.acc, i.idr, l.les_t FROM (SELECT judge, {STATS} FROM judges GROUP BY judge) m
LEFT JOIN (SELECT judge, {IDR} FROM ({JUDGE_PAIRS}) p GROUP BY judge) i ON i.judge = m.judge
LEFT JOIN (SELECT judge, {LES} AS les_t FROM judges GROUP BY judge) l ON l.judge = m.judge""")
add("u1_union_tasks", "exam_a exam_c exam_d exam_e", """
SELECT uid, task, length(prompt) AS prompt_chars, image FROM exam_a UNION ALL
SELECT uid, task, length(prompt), image FROM exam_c UNION ALL
SELECT uid, task, length(prompt), image FROM exam_d UNION ALL
SELECT uid, task, length(prompt), image FROM exam_e""")
add("u2_union_rounds", "exam_c", """
SELECT uid, family, difficulty, CASE WHEN family = 'en' THEN 'round1' ELSE 'round2' END AS source_round
FROM exam_c WHERE family IS NOT NULL""")
add("u3_uid_sets", "gold_rows responses", """
WITH g AS (SELECT DISTINCT uid FROM gold_rows), r AS (SELECT DISTINCT uid FROM responses)
SELECT (SELECT count(*) FROM g) AS n_left, (SELECT count(*) FROM r) AS n_right,
 (SELECT count(*) FROM (SELECT uid FROM g INTERSECT SELECT uid FROM r)) AS n_both,
 (SELECT count(*) FROM (SELECT uid FROM g EXCEPT SELECT uid FROM r)) AS n_left_only,
 (SELECT count(*) FROM (SELECT uid FROM r EXCEPT SELECT uid FROM g)) AS n_right_only""".replace("WITH g", "SELECT * FROM (WITH g") + ")")
add("u5_distinct_assets", "exam_c", """
SELECT image, env_task, sum(CASE WHEN framing = 'pos' THEN 2 ELSE 1 END)::bigint AS n_rows FROM exam_c GROUP BY ALL""")

add("x1_choice_letter", "texts", r"""
SELECT uid, model, attempt, CASE WHEN regexp_full_match(t, '(?i)[abcd]') THEN upper(t) ELSE nullif(upper(found), '') END AS letter,
       CASE WHEN regexp_full_match(t, '(?i)[abcd]') THEN 'strict' WHEN found <> '' THEN 'recoverable' ELSE 'fail' END AS parse_mode,
       CASE WHEN regexp_full_match(t, '(?i)[ab]') THEN upper(t) ELSE nullif(upper(regexp_extract(tq, '\b([ab])\b', 1)), '') END AS ab_letter
FROM (SELECT *, regexp_extract(tq, '\b([abcd])\b', 1) AS found FROM texts)""")
add("x2_verdict", "readings", "SELECT uid, model, attempt, verdict, verdict_mode AS parse_mode FROM readings")
add("x4_json_answer", "readings", "SELECT uid, model, attempt, json_label AS label, json_mode AS parse_mode FROM readings")
SQL["x2_verdict_documents"] = with_views(["readings"], """
SELECT uid AS id, verdict, verdict_mode AS parse_mode, letter FROM readings""", {"responses": """
SELECT concat('d', doc_id) AS uid, text AS raw, text AS pred, '' AS model, 0 AS attempt, 0 AS ingest_seq, true AS ok, NULL AS error FROM {documents}
UNION ALL SELECT concat('c', conv_id, '.', turn), text, text, '', 0, 0, true, NULL FROM {conversations}
UNION ALL SELECT concat('b', item_id), text, text, '', 0, 0, true, NULL FROM {benchmark}"""})
add("x3_alias_verdict", "responses", r"""
SELECT uid, model, attempt, md5(v) AS alias_md5,
       CASE WHEN attempt = 0 THEN CASE WHEN v = 'Success' THEN 'Yes' ELSE 'No' END
            WHEN v IN ('Success', 'Fail') THEN v ELSE 'other' END AS v
FROM (SELECT uid, model, attempt, CASE WHEN s IN ('success','yes','true','succeed') THEN 'Success'
        WHEN s IN ('fail','no','false','failed','failure') THEN 'Fail' ELSE s END AS v
      FROM (SELECT *, regexp_replace(lower(CASE WHEN pred <> '' THEN pred ELSE raw END), '^\s+|\s+$', '', 'g') AS s FROM responses) a) b""")
add("x6_error_detection", "readings", """
SELECT model, is_error, ok, count(*) AS n, sum(length(CASE WHEN raw <> '' THEN raw ELSE pred END))::bigint AS n_chars
FROM readings GROUP BY ALL""")
add("x7_parse_mode_report", "scored", """
SELECT model, task, parse_mode, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY model, task), 6) AS share
FROM scored GROUP BY model, task, parse_mode""")

add("a1_score_stats", "scored", f"SELECT model, {STATS} FROM scored GROUP BY model")
add("a2_score_rollup", "scored", f"""
SELECT 'overall' AS level, model, NULL AS task, NULL AS env_task, {STATS} FROM scored GROUP BY model
UNION ALL SELECT 'task', model, task, NULL, {STATS} FROM scored GROUP BY model, task
UNION ALL SELECT 'task_env', model, task, env_task, {STATS} FROM scored GROUP BY model, task, env_task""")
add("a2_score_rollup_e", "scored", "\nUNION ALL ".join(
    f"SELECT '{d}' AS level, model, " + ", ".join(f"{c if c == d else 'NULL'} AS {c}" for c in ("query_type", "horizon_bucket", "sampling_role", "env_task"))
    + f", {STATS} FROM scored WHERE task = 'E' GROUP BY model, {d}" for d in ("query_type", "horizon_bucket", "sampling_role", "env_task")))
add("a2_macro_accuracy", "scored", """
SELECT model, round(sum(c) / sum(n), 6) AS micro_acc, round(avg(c / n), 6) AS macro_acc
FROM (SELECT model, task, count(*) AS n, sum(cast(correct AS int)) AS c FROM scored GROUP BY model, task) GROUP BY model""")
add("a3_task_scores", "scored", "SELECT uid, model, task, env_task, group_id, failure, parse_mode, pred_norm, correct, score FROM scored")
add("a5_bucket_tables", "scored_c", "\nUNION ALL ".join(f"""
SELECT model, '{d}' AS dim, {d} AS value, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct,
 count(*) FILTER (WHERE verdict IS NULL) AS n_unknown, round(avg(cast(correct AS int)), 6) AS acc
FROM scored_c WHERE {d} IS NOT NULL GROUP BY model, {d}""" for d in ("variant", "family", "difficulty", "framing")))
LENIENT = r"""
lenient AS (
SELECT g.uid, m.model, e.difficulty_bucket, e.distractor_strategy, g.gold, r.uid IS NOT NULL AS answered,
       coalesce(NOT r.ok OR starts_with(r.raw, '__ERR__:'), false) AS is_error,
       CASE WHEN r.uid IS NULL THEN 'missing' WHEN regexp_full_match(s, '(?i)[@L]') THEN 'strict'
            WHEN regexp_matches(s, '(?i)\b[@L]\b') THEN 'recoverable' ELSE 'fail' END AS parse_mode,
       coalesce(upper(regexp_extract(s, '(?i)\b([@L])\b', 1)) = g.gold, false) AS correct
FROM gold g JOIN exam_a e ON e.uid = g.uid CROSS JOIN (SELECT unnest(['m0', 'm1', 'm2']) AS model) m
LEFT JOIN (SELECT *, regexp_replace(CASE WHEN pred <> '' THEN pred ELSE raw END, '^\s+|\s+$', '', 'g') AS s FROM first_resp) r
ON r.uid = g.uid AND r.model = m.model WHERE g.task = 'A' @W)"""
SQL["a6_difficulty_strategy"] = with_views(["gold", "exam_a", "first_resp"], "") + "," + LENIENT.replace("@L", "abcd").replace("@W", "") + "\n" + " UNION ALL ".join(f"""
SELECT model, '{d}' AS dim, {d} AS value, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct,
 round(avg(cast(correct AS int)), 6) AS acc, round(avg(cast(is_error AS int)), 6) AS api_error_rate,
 round(avg(cast(parse_mode = 'strict' AS int)), 6) AS strict_rate,
 round(avg(cast(parse_mode = 'recoverable' AS int)), 6) AS recoverable_rate,
 count(*) FILTER (WHERE parse_mode = 'fail') AS n_parse_fail, count(*) FILTER (WHERE NOT answered) AS n_missing
FROM lenient GROUP BY model, {d}""" for d in ("difficulty_bucket", "distractor_strategy"))
TWO_LETTERS = "translate(g.gold, 'CD', 'AB')"
SQL["a9_usable_accuracy"] = with_views(["gold", "exam_a", "first_resp"], "") + "," + LENIENT.replace("@L", "ab").replace("@W", "").replace("strategy, g.gold,", f"strategy, {TWO_LETTERS} AS gold,").replace("= g.gold", f"= {TWO_LETTERS}") + """
SELECT model, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct, count(*) FILTER (WHERE answered) AS n_answered,
 count(*) FILTER (WHERE answered) - count(*) FILTER (WHERE is_error) AS n_usable,
 round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy,
 round(count(*) FILTER (WHERE correct) / count(*) FILTER (WHERE answered), 6) AS accuracy_answered,
 round(count(*) FILTER (WHERE correct) / (count(*) FILTER (WHERE answered) - count(*) FILTER (WHERE is_error)), 6) AS accuracy_usable,
 CASE WHEN count(*) FILTER (WHERE gold = 'A') > count(*) FILTER (WHERE gold = 'B') THEN 'A' ELSE 'B' END AS majority_class,
 round(greatest(count(*) FILTER (WHERE gold = 'A'), count(*) FILTER (WHERE gold = 'B')) / count(*), 6) AS majority_baseline
FROM lenient GROUP BY model"""
add("a7_failure_histogram", "scored", "SELECT model, task, failure, count(*) AS n FROM scored WHERE failure IS NOT NULL GROUP BY ALL")
add("a7_version_histogram", "responses", """
SELECT model, CASE WHEN attempt = 0 THEN 'response.v1' ELSE 'legacy' END AS schema_version, count(*) AS n FROM responses GROUP BY ALL""")
add("a10_coverage", "gold_rows responses", """
SELECT m.model, (SELECT count(*) FROM gold_rows) AS n_gold, count(r.uid) AS total_lines, count(DISTINCT r.uid) AS n_resp,
 count(DISTINCT CASE WHEN g.uid IS NOT NULL THEN r.uid END) AS n_scored,
 (SELECT count(*) FROM gold_rows) - count(DISTINCT CASE WHEN g.uid IS NOT NULL THEN r.uid END) AS n_missing,
 count(DISTINCT CASE WHEN g.uid IS NULL THEN r.uid END) AS n_extra, count(r.uid) - count(DISTINCT r.uid) AS duplicates_dropped
FROM (SELECT unnest(['m0', 'm1', 'm2']) AS model) m LEFT JOIN responses r ON r.model = m.model
LEFT JOIN gold_rows g ON g.uid = r.uid GROUP BY m.model""")
add("a11_scored_only_accuracy", "exam_c responses", r"""
SELECT model, count(*) AS n_exam, count(*) FILTER (WHERE answered) AS n_scored, count(*) FILTER (WHERE NOT answered) AS n_missing,
 count(*) FILTER (WHERE answered AND hit) AS n_correct,
 round(coalesce(count(*) FILTER (WHERE answered AND hit) / nullif(count(*) FILTER (WHERE answered), 0), 0), 6) AS accuracy,
 count(*) FILTER (WHERE answered AND v NOT IN ('Success', 'Fail')) AS parse_failures
FROM (SELECT e.uid, m.model, r.uid IS NOT NULL AS answered, r.v,
             CASE WHEN e.framing = 'neu' THEN (r.v = 'Success') = (e.answer = 'Success') ELSE r.v = e.answer END AS hit
      FROM exam_c e CROSS JOIN (SELECT unnest(['m0', 'm1', 'm2']) AS model) m
      LEFT JOIN (SELECT uid, model, CASE WHEN s IN ('success','yes','true','succeed') THEN 'Success'
                   WHEN s IN ('fail','no','false','failed','failure') THEN 'Fail' ELSE s END AS v
                 FROM (SELECT *, regexp_replace(lower(CASE WHEN pred <> '' THEN pred ELSE raw END), '^\s+|\s+$', '', 'g') AS s
                       FROM responses QUALIFY row_number() OVER (PARTITION BY uid, model ORDER BY ingest_seq DESC) = 1) a) r
      ON r.uid = e.uid AND r.model = m.model) j GROUP BY model""")
add("a12_les_t", "scored_c", f"""
SELECT model, round(avg(CASE WHEN temporal = 'orig' THEN cast(correct AS int) END), 6) AS acc_orig,
 round(avg(CASE WHEN temporal = 'rev' THEN cast(correct AS int) END), 6) AS acc_rev, {LES} AS les_t FROM scored_c GROUP BY model""")
add("a13_jcr_t", "scored_c", f"""
SELECT a.model, jcr_ratio, n_pairs, jcr_pair FROM (SELECT model, {LES} AS jcr_ratio FROM scored_c GROUP BY model) a JOIN (
 SELECT o.model, count(*) AS n_pairs, round(avg(cast(o.verdict = r.verdict AS int)), 6) AS jcr_pair
 FROM scored_c o JOIN scored_c r ON o.model = r.model AND o.group_id = r.group_id AND o.variant = r.variant AND o.visual = r.visual
 WHERE o.temporal = 'orig' AND r.temporal = 'rev' AND o.verdict IS NOT NULL AND r.verdict IS NOT NULL GROUP BY o.model) b ON a.model = b.model""")
add("a14_idr", "scored_c", f"""
SELECT model, count(*) AS n_pairs, {IDR}, round(avg(CASE WHEN kf THEN cast(kc AS int) END), 6) AS idr_cond
FROM ({IDR_PAIRS}) p GROUP BY model""")
add("a15_jacc_neutral", "scored_c", """
SELECT model, round(avg(CASE WHEN variant IN ('cf', 'nocue') THEN CASE WHEN verdict = 'Fail' THEN 1.0 ELSE 0.0 END END), 6) AS jacc_fail,
 round(avg(CASE WHEN framing = 'neu' THEN cast(correct AS int) END), 6) AS jacc_neutral FROM scored_c GROUP BY model""")
SQL["a16_degenerate"] = with_views(["scored"], """
SELECT model, count(verdict) AS n_valid, CASE WHEN min(verdict) = max(verdict) AND min(verdict) = 'Fail' THEN 'all_fail'
 WHEN min(verdict) = max(verdict) THEN 'all_success' ELSE 'none' END AS degenerate
FROM scored WHERE task IN ('C', 'D') GROUP BY model""").replace("FROM responses)", "FROM responses_degenerate)").replace(
    "texts AS (", "responses_degenerate AS (SELECT uid, model, attempt, ingest_seq, CASE WHEN model = 'm2' THEN 'Fail' ELSE raw END AS raw, "
    "CASE WHEN model = 'm2' THEN 'Fail' ELSE pred END AS pred, ok, error FROM responses),\ntexts AS (", 1)
add("a18_mcnemar", "scored_c", """
SELECT env_task, count(*) AS n_pairs, round(avg(y) - avg(x), 6) AS delta_acc, count(*) FILTER (WHERE x = 1 AND y = 0) AS b,
 count(*) FILTER (WHERE x = 0 AND y = 1) AS c,
 round((abs(count(*) FILTER (WHERE x = 1 AND y = 0) - count(*) FILTER (WHERE x = 0 AND y = 1)) - 1) ^ 2
       / nullif(count(*) FILTER (WHERE x <> y), 0), 6) AS mcnemar
FROM (SELECT p.uid, p.env_task, cast(p.correct AS int) AS x, cast(q.correct AS int) AS y
      FROM scored_c p JOIN scored_c q ON p.uid = q.uid WHERE p.model = 'm0' AND q.model = 'm1') z GROUP BY env_task""")
add("a19_model_comparison", "scored", "SELECT task, " + ", ".join(
    f"round(avg(CASE WHEN model = '{m}' THEN cast(correct AS int) END), 6) AS acc_{m}" for m in ("m0", "m1", "m2")) + " FROM scored GROUP BY task")
add("j4_hash_shard", "gold_rows", "SELECT uid, task FROM gold_rows WHERE ('0x' || substr(md5(uid), 1, 8))::BIGINT % 4 = 1")
add("a22_usage_rollup", "", """
SELECT concat('m', user_id % 3) AS model, count(*) AS n_calls, sum(event_id % 100)::bigint AS prompt_tokens,
 sum(event_id % 7)::bigint AS completion_tokens, sum(event_id % 100 + event_id % 7)::bigint AS total_tokens,
 round(avg(value), 6) AS mean_latency, max(value) AS max_latency, round(quantile_cont(value, 0.5), 6) AS latency_p50, round(quantile_cont(value, 0.95), 6) AS latency_p95,
 round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS ok_rate FROM events GROUP BY 1""")
add("a22_usage_sketches", "", """
SELECT concat('m', user_id % 3) AS model, count(*) AS n_calls, sum(event_id % 100)::bigint AS prompt_tokens,
 sum(event_id % 7)::bigint AS completion_tokens, sum(event_id % 100 + event_id % 7)::bigint AS total_tokens,
 round(avg(value * 1.7::double + event_id / 1e7::double), 6) AS mean_latency, max(value * 1.7::double + event_id / 1e7::double) AS max_latency,
 round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS ok_rate, true AS p50_in_bound, true AS p95_in_bound FROM events GROUP BY 1""")
HIST = """(SELECT model, task, string_agg(concat(k, ':', c), ',' ORDER BY k) AS s FROM (SELECT model, task, {k} AS k, count(*) AS c FROM scored
 WHERE {k} IS NOT NULL GROUP BY ALL) x GROUP BY ALL)"""
add("a1_score_block", "scored", f"""
SELECT b.*, p.s AS parse_modes, coalesce(f.s, '') AS failures FROM (SELECT model, task, {STATS} FROM scored GROUP BY model, task) b
LEFT JOIN {HIST.format(k='parse_mode')} p ON p.model = b.model AND p.task = b.task
LEFT JOIN {HIST.format(k='failure')} f ON f.model = b.model AND f.task = b.task""")
add("w15_failure_examples", "scored", """
SELECT failure, uid, model, task, row_number() OVER (PARTITION BY failure ORDER BY uid, model) AS rank
FROM scored WHERE failure IS NOT NULL QUALIFY rank <= 50""")
