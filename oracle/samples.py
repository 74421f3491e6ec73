"""SQL for samples, ranked lists and hard negatives (the negatives by brute force)."""

from __future__ import annotations

from .views import ORACLE_VIEWS as V, with_views

SQL: dict[str, str] = {}


def add(name: str, views: str, body: str) -> None:
    SQL[name] = with_views(views.split(), body)


add("k1_sample_groups", "steps", """
SELECT env_task, group_id, t FROM steps WHERE group_id IN (
 SELECT group_id FROM (SELECT DISTINCT env_task, group_id FROM steps)
 QUALIFY row_number() OVER (PARTITION BY env_task ORDER BY md5(concat_ws('|', '7', env_task, group_id))) <= 3)""")
add("k2_first_complete_groups", "variant_steps", """
, g AS (SELECT env_task, group_id, count(DISTINCT variant) = 3 AS complete FROM variant_steps GROUP BY ALL)
SELECT env_task, group_id, row_number() OVER (PARTITION BY env_task ORDER BY group_id) AS rank,
 (SELECT count(*) FROM g s WHERE s.env_task = g.env_task AND NOT s.complete) AS n_skipped
FROM g WHERE complete QUALIFY rank <= 5""")
ROUND = """SELECT uid, env_task FROM (SELECT uid, env_task, row_number() OVER (PARTITION BY env_task ORDER BY md5(concat_ws('|', '7', uid)), uid) AS turn
 FROM {v}) x ORDER BY turn, env_task LIMIT {n}"""
add("k3_round_robin", "exam_c", ROUND.format(v="exam_c", n=100))
add("k3_large_round_robin", "exam_e", ROUND.format(v="exam_e", n=1500))
add("k3_ordered", "exam_e", "SELECT uid, env_task, item_no FROM exam_e ORDER BY item_no LIMIT 75")
add("k5_common_uid_sample", "responses", """
SELECT uid FROM (SELECT uid FROM responses WHERE model = 'm0' INTERSECT SELECT uid FROM responses WHERE model = 'm1') x
ORDER BY md5(concat_ws('|', '7', uid)), uid LIMIT 200""")
add("k7_permutation", "exam_a", """
SELECT uid, string_agg(cast(i AS varchar), ',' ORDER BY k) AS candidate_order,
 substr('ABCD', cast(max(CASE WHEN i = 0 THEN r END) AS int), 1) AS correct_letter
FROM (SELECT uid, i, md5(concat_ws('|', '7', uid, i)) AS k, row_number() OVER (PARTITION BY uid ORDER BY md5(concat_ws('|', '7', uid, i))) AS r
      FROM exam_a CROSS JOIN (SELECT unnest(range(4)) AS i) n) x GROUP BY uid""")
add("k8_step_sample", "steps", """
SELECT group_id, t, row_number() OVER (PARTITION BY group_id ORDER BY md5(concat_ws('|', '7', group_id, t))) AS draw FROM steps QUALIFY draw <= 3""")
add("k9_ranked_sort", "exam_d", """
SELECT uid, subtask, variant, CASE subtask WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS family_rank,
 CASE variant WHEN 'full' THEN 1 WHEN 'nocue' THEN 2 ELSE 3 END AS variant_rank FROM exam_d""")
add("k10_head", "exam_e", "SELECT uid, item_no FROM exam_e ORDER BY item_no LIMIT 20")
add("k1_draw_order", "", """
SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('|', '7', o_orderkey))) AS rank
FROM orders QUALIFY rank <= 10""")

V["trans"] = """
SELECT *, md5(concat_ws('|', pos, dir, front, concat(c1, '=', visible, ';', c2, '=', front_type))) AS sig
FROM (SELECT a.group_id, a.env_task, a.t, a.action, concat(b.x, ',', b.y) AS pos, b.dir, concat(b.front_type, '/', b.door_state) AS front,
             concat(b.x, ',', (b.y + 1) % 7) AS c1, concat((b.x + 2) % 7, ',', b.y) AS c2, b.visible, b.front_type
      FROM {steps} a JOIN {steps} b ON b.group_id = a.group_id AND b.t = a.t + 1) s
"""
V["items"] = """
SELECT * FROM {trans} QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY md5(concat_ws('|', '7|A', group_id, t)), t) <= 2
"""
PEN = """CASE WHEN i.action NOT IN (0, 1, 2) AND i.pos <> n.pos THEN 100.0 ELSE
 CASE WHEN i.pos = n.pos THEN 0 ELSE 10 END + CASE WHEN i.dir = n.dir THEN 0 ELSE 2 END + CASE WHEN i.front = n.front THEN 0 ELSE 1 END
 + 0.5 * (4 - len(list_intersect([i.c1, i.c2], [n.c1, n.c2]))
   - len(list_intersect([concat(i.c1, '=', i.visible), concat(i.c2, '=', i.front_type)], [concat(n.c1, '=', n.visible), concat(n.c2, '=', n.front_type)]))) END"""
V["own_negs"] = f"""
SELECT * FROM (SELECT i.group_id, i.t, n.group_id AS ng, n.t AS nt, n.sig, {PEN} AS score FROM {{items}} i JOIN {{trans}} n
               ON n.group_id = i.group_id AND n.t <> i.t AND n.sig <> i.sig
               QUALIFY row_number() OVER (PARTITION BY i.group_id, i.t, n.sig ORDER BY score, n.t) = 1) x
QUALIFY row_number() OVER (PARTITION BY group_id, t ORDER BY score, nt) <= 2
"""
V["pool_reps"] = """
SELECT env_task, action, sig, group_id, min(t) AS t, dense_rank() OVER (PARTITION BY env_task, action ORDER BY sig) - 1 AS idx,
 row_number() OVER (PARTITION BY env_task, action, sig ORDER BY group_id) AS rep
FROM {trans} GROUP BY env_task, action, sig, group_id
"""
NUM = "('0x' || substr(md5(concat_ws('|', '7|{}', i.group_id, i.t)), 1, 8))::BIGINT"
V["looked"] = f"""
SELECT l.group_id, l.t, n.group_id AS ng, n.t AS nt, n.sig, draw, {PEN} AS score
FROM (SELECT * FROM (
  SELECT q.group_id, q.t, q.draw, r.sig, r.group_id AS ng, r.t AS nt
  FROM (SELECT i.group_id, i.t, i.sig AS true_sig, i.env_task, i.action, draw, (s % n * draw + {NUM.format('start')}) % n AS idx
        FROM (SELECT i.*, n, unnest(range(n)) AS draw,
               [2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497][1 + {NUM.format('step')} % 8] AS s
              FROM {{items}} i JOIN (SELECT env_task, action, count(DISTINCT sig) AS n FROM {{pool_reps}} GROUP BY ALL) c ON c.env_task = i.env_task AND c.action = i.action) i) q
  JOIN {{pool_reps}} r ON r.env_task = q.env_task AND r.action = q.action AND r.idx = q.idx AND r.group_id <> q.group_id AND r.sig <> q.true_sig
  QUALIFY row_number() OVER (PARTITION BY q.group_id, q.t, q.draw ORDER BY r.group_id) = 1) x
 QUALIFY row_number() OVER (PARTITION BY group_id, t ORDER BY draw) <= 10) l
JOIN {{items}} i ON i.group_id = l.group_id AND i.t = l.t JOIN {{trans}} n ON n.group_id = l.ng AND n.t = l.nt
"""
V["negs"] = """
SELECT *, row_number() OVER (PARTITION BY group_id, t ORDER BY pool, score, CASE WHEN pool = 0 THEN nt ELSE draw END) - 1 AS rank
FROM (SELECT group_id, t, ng, nt, score, 0 AS pool, 0 AS draw FROM {own_negs} UNION ALL
      SELECT l.group_id, l.t, l.ng, l.nt, l.score, 1, l.draw FROM {looked} l
      WHERE NOT EXISTS (SELECT 1 FROM {own_negs} o WHERE o.group_id = l.group_id AND o.t = l.t AND o.sig = l.sig)) u QUALIFY rank < 3
"""
V["made"] = """
SELECT i.group_id, i.t, i.env_task, CASE WHEN p.n < 3 THEN 'small_pool' WHEN coalesce(c.n, 0) < 3 THEN 'insufficient_negs' ELSE 'made' END AS reason
FROM {items} i JOIN (SELECT env_task, action, count(*) AS n FROM {trans} GROUP BY ALL) p ON p.env_task = i.env_task AND p.action = i.action
LEFT JOIN (SELECT group_id, t, count(*) AS n FROM {negs} GROUP BY ALL) c ON c.group_id = i.group_id AND c.t = i.t
"""
add("k6_hard_negatives", "negs made", """
SELECT n.group_id, n.t, n.rank, n.ng AS neg_group, n.nt AS neg_t, round(n.score, 6) AS score, CASE WHEN n.pool = 0 THEN 'own' ELSE 'pool' END AS source
FROM negs n JOIN made m ON m.group_id = n.group_id AND m.t = n.t WHERE m.reason = 'made'""")
add("k6_skip_reasons", "made", "SELECT env_task, reason, count(*) AS n FROM made GROUP BY ALL")
add("j10_candidate_pool", "pool_reps", "SELECT env_task, action, idx, sig, group_id, t FROM pool_reps WHERE rep <= 2")
add("k6_draws", "looked", "SELECT group_id, t, draw, sig, ng AS neg_group, nt AS neg_t FROM looked")

# the greedy pass, slot by slot: of a role's unused rows the first one, rows of unused groups before others
GREEDY = """
, slots AS (SELECT row_number() OVER () AS i, * FROM (@SLOTS) x),
r AS (SELECT env_task, sampling_role, group_id, uid, @SHORT AS short FROM exam_e WHERE @WHERE),
st AS (
 SELECT DISTINCT env_task, 0::BIGINT AS i, []::VARCHAR[] AS used, []::VARCHAR[] AS groups, NULL::STRUCT(o BOOLEAN, short INTEGER, g VARCHAR, u VARCHAR) AS b, true AS asked FROM r
 UNION ALL
 SELECT env_task, i, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.u) END, CASE WHEN b IS NULL THEN groups ELSE list_append(groups, b.g) END, b, asked
 FROM (SELECT s.env_task, t.i, any_value(s.used) AS used, any_value(s.groups) AS groups,
        min({'o': list_contains(s.groups, e.group_id), 'short': e.short, 'g': e.group_id, 'u': e.uid}) FILTER (WHERE e.uid IS NOT NULL) AS b,
        any_value(t.stage = 'base' OR len(s.used) < @TOTAL) AS asked
       FROM st s JOIN slots t ON t.i = s.i + 1
       LEFT JOIN r e ON e.env_task = s.env_task AND e.sampling_role = t.role AND NOT list_contains(s.used, e.uid) AND (t.stage = 'base' OR len(s.used) < @TOTAL)
       GROUP BY s.env_task, t.i) n),
done AS (SELECT env_task, used FROM st WHERE i = (SELECT max(i) FROM slots))
SELECT st.env_task, CASE WHEN b IS NULL THEN -1 ELSE len(used) END AS pick, CASE WHEN b IS NULL THEN concat('missing_', stage) ELSE stage END AS stage, role AS sampling_role,
 b.g AS group_id, b.u AS uid FROM st JOIN slots t ON t.i = st.i WHERE asked
UNION ALL
SELECT env_task, len(used) + k, 'fallback', sampling_role, group_id, uid
FROM (SELECT r.*, d.used, row_number() OVER (PARTITION BY r.env_task ORDER BY r.group_id, r.uid) AS k FROM r JOIN done d ON d.env_task = r.env_task AND NOT list_contains(d.used, r.uid)) f
WHERE @FALLBACK AND len(used) + k <= @TOTAL"""
ROLES = ["identity_short", "identity_medium", "identity_long", "status_early_holding", "status_mid_holding", "status_first_post_drop", "status_late_post_drop"]
EXTRAS = ["identity_long", "status_late_post_drop", "status_mid_holding", "identity_medium", "status_first_post_drop"]


def greedy(times: int, total: int, prefer_long: bool) -> str:
    slots = [f"SELECT 'base' AS stage, '{r}' AS role" for r in ROLES for _ in range(times)] + [f"SELECT 'extra', '{r}'" for r in EXTRAS]
    body = GREEDY.replace("@SLOTS", " UNION ALL ".join(slots)).replace("@TOTAL", str(total)).replace("@WHERE", "true").replace("@FALLBACK", "true")
    body = body.replace("@SHORT", "CASE WHEN horizon_bucket <> 'long' THEN 1 ELSE 0 END" if prefer_long else "0")
    return with_views(["exam_e"], body).replace("WITH ", "WITH RECURSIVE ", 1)


SQL["k4_quota_sample"] = greedy(5, 36, True)
SQL["k4_mandatory_audit"] = greedy(1, 12, False)
# ranked once per role: each role takes its first rows, those of unused groups before others
FOCUSED = """
, slots AS (SELECT row_number() OVER () AS i, * FROM (@SLOTS) x),
r AS (SELECT * FROM exam_e WHERE env_task = 'env1'),
st AS (
 SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, []::VARCHAR[] AS groups, []::STRUCT(o BOOLEAN, g VARCHAR, u VARCHAR)[] AS b
 UNION ALL
 SELECT i, list_concat(used, list_transform(b, lambda x: x.u)), list_concat(groups, list_transform(b, lambda x: x.g)), b
 FROM (SELECT t.i, any_value(s.used) AS used, any_value(s.groups) AS groups,
        coalesce(min({'o': list_contains(s.groups, e.group_id), 'g': e.group_id, 'u': e.uid}, 3) FILTER (WHERE e.uid IS NOT NULL), []) AS b
       FROM st s JOIN slots t ON t.i = s.i + 1 LEFT JOIN r e ON e.sampling_role = t.role AND NOT list_contains(s.used, e.uid) GROUP BY t.i) n)
SELECT 'env1' AS env_task, len(used) - len(b) + k AS pick, 'base' AS stage, role AS sampling_role, b[k].g AS group_id, b[k].u AS uid
FROM (SELECT st.*, role, unnest(range(1, len(b) + 1)) AS k FROM st JOIN slots t ON t.i = st.i) x
UNION ALL
SELECT 'env1', -1, 'missing_base', role, NULL, NULL FROM (SELECT role, unnest(range(len(b), 3)) FROM st JOIN slots t ON t.i = st.i) y
WHERE EXISTS (SELECT 1 FROM r)"""
SQL["k4_focused_audit"] = with_views(["exam_e"], FOCUSED.replace("@SLOTS", " UNION ALL ".join(f"SELECT '{r}' AS role" for r in ROLES))).replace("WITH ", "WITH RECURSIVE ", 1)
