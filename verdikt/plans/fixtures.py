"""Views that shape the given tables into exams, responses, steps and scenes.

Each view is one SELECT, written in the SQL that Spark and DuckDB share, so the operators and the
oracle start from the same rows.  ``{name}`` refers to a table or to another view.
``@EACH(c, n)`` repeats a row for c = 0..n-1.

Everything except ``headers``, ``doors`` and ``door_steps`` is a projection: no shuffle, and no group that grows
with the data (an episode is a block of 64 consecutive event ids).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

MODELS = ["m0", "m1", "m2"]
EPISODE = 64

VIEWS: dict[str, str] = {}

# ---------------------------------------------------------------- exams

VIEWS["exam_c"] = """
SELECT doc_id AS item_no, concat('C.', env_task, '.', group_id, '.', variant, '.', temporal, '.', visual) AS uid,
       'C' AS task, env_task, group_id, variant, temporal, visual, framing, family, difficulty, prompt,
       CASE doc_id % 11 WHEN 3 THEN lower(base)
                        WHEN 5 THEN CASE WHEN base = 'Fail' THEN 'failed' ELSE 'succeeded' END
                        WHEN 7 THEN concat('  ', base, '  ')
                        WHEN 9 THEN 'maybe'
                        ELSE base END AS answer,
       CASE WHEN base = 'Success' THEN 1 ELSE 0 END AS label,
       concat('images/taskC/', env_task, '/', group_id, '/', variant, '_', temporal, '_', visual, '.png') AS image
FROM (SELECT doc_id, concat('env', grp % 6) AS env_task, concat('g', grp) AS group_id,
             CASE slot % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'nocue' ELSE 'cf' END AS variant,
             CASE WHEN slot % 6 < 3 THEN 'orig' ELSE 'rev' END AS temporal,
             CASE WHEN slot < 6 THEN 'clean' WHEN slot < 12 THEN 'noisy' ELSE 'style' END AS visual,
             CASE grp % 3 WHEN 0 THEN 'pos' WHEN 1 THEN 'neu' ELSE 'neg' END AS framing,
             lang AS family, source AS difficulty, text AS prompt,
             CASE WHEN slot % 3 = 2 THEN 'Fail' ELSE 'Success' END AS base
      FROM (SELECT *, cast(floor(doc_id / 18) AS bigint) AS grp, doc_id % 18 AS slot FROM {documents}) d) e
"""

VIEWS["exam_a"] = """
SELECT p_partkey AS item_no,
       concat('A.env', p_partkey % 6, '.g', cast(floor(p_partkey / 10) AS bigint), '.t', p_partkey % 10) AS uid,
       'A' AS task, concat('env', p_partkey % 6) AS env_task,
       concat('g', cast(floor(p_partkey / 10) AS bigint)) AS group_id, p_partkey % 10 AS t,
       p_type AS action, concat('Action: ', p_type, '. ', p_name) AS prompt,
       CASE WHEN p_partkey % 9 = 0 THEN NULL
            ELSE CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN ' b ' WHEN 2 THEN 'C' ELSE 'd' END END AS answer,
       p_size % 4 AS label, p_brand AS distractor_strategy,
       CASE WHEN p_size < 17 THEN 'easy' WHEN p_size < 34 THEN 'medium' ELSE 'hard' END AS difficulty_bucket,
       concat('images/taskA/', p_partkey, '.png') AS image
FROM {part}
"""

VIEWS["exam_d"] = """
SELECT c_custkey AS item_no,
       concat('D.env', grp % 6, '.g', grp, '.', variant, '.orig.clean') AS uid,
       'D' AS task, CASE WHEN grp % 6 = 5 THEN 'memory' ELSE concat('env', grp % 6) END AS env_task,
       concat('g', grp) AS group_id, variant, c_mktsegment AS subtask,
       CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN variant = 'cf' THEN 'Fail' ELSE 'Success' END AS answer,
       4 + c_custkey % 5 AS n_frames, c_name AS prompt,
       concat('images/taskD/', c_custkey, '.png') AS image
FROM (SELECT *, cast(floor(c_custkey / 3) AS bigint) AS grp,
             CASE c_custkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'nocue' ELSE 'cf' END AS variant
      FROM {customer}) c
"""

VIEWS["exam_e"] = """
SELECT event_id AS item_no,
       concat('E_v12.env', grp % 2, '.g', grp, '.e', event_id) AS uid,
       'E' AS task, concat('env', grp % 2) AS env_task, concat('g', grp) AS group_id,
       CASE WHEN role < 3 THEN 'identity' ELSE 'status' END AS query_type,
       CASE role WHEN 0 THEN 'identity_short' WHEN 1 THEN 'identity_medium' WHEN 2 THEN 'identity_long'
                 WHEN 3 THEN 'status_early_holding' WHEN 4 THEN 'status_mid_holding'
                 WHEN 5 THEN 'status_first_post_drop' ELSE 'status_late_post_drop' END AS sampling_role,
       CASE WHEN event_id % 40 <= 10 THEN 'short' WHEN event_id % 40 <= 25 THEN 'medium' ELSE 'long' END AS horizon_bucket,
       event_id % 40 AS query_step, event_id % 13 AS anchor_step, event_id % 40 - event_id % 13 AS horizon_gap,
       CASE event_id % 4 WHEN 0 THEN 'holding' WHEN 1 THEN 'dropped' WHEN 2 THEN 'key_red' ELSE 'lost' END AS answer,
       props AS prompt, concat('images/taskE/', event_id, '.png') AS image
FROM (SELECT *, cast(floor(event_id / 64) AS bigint) AS grp, event_id % 7 AS role FROM {events}) v
"""

VIEWS["gold_rows"] = """
SELECT uid, task, 'a' AS file_tag, 1 AS load_rank, item_no AS line_no, env_task, group_id, t, cast(NULL AS varchar(9)) AS variant,
       cast(NULL AS varchar(9)) AS temporal, cast(NULL AS varchar(9)) AS visual, answer, label,
       cast(NULL AS varchar(9)) AS query_type, cast(NULL AS varchar(9)) AS horizon_bucket, cast(NULL AS varchar(9)) AS sampling_role
FROM {exam_a}
UNION ALL
SELECT uid, task, 'd', 2, item_no, env_task, group_id, NULL, variant, NULL, NULL, answer, NULL, NULL, NULL, NULL FROM {exam_d}
UNION ALL
SELECT uid, task, 'c', 3, item_no, env_task, group_id, NULL, variant, temporal, visual, answer, label, NULL, NULL, NULL FROM {exam_c}
UNION ALL
SELECT uid, task, 'e', 4, item_no, env_task, group_id, NULL, NULL, NULL, NULL, answer, NULL, query_type, horizon_bucket, sampling_role
FROM {exam_e}
"""

# ---------------------------------------------------------------- responses

VIEWS["responses"] = """
SELECT uid, model, attempt, ingest_seq, raw,
       CASE WHEN raw = '' AND item_no % 2 = 0 THEN 'yes' ELSE raw END AS pred,
       CASE WHEN (item_no * 3 + m) % 23 = 7 THEN false ELSE true END AS ok,
       CASE WHEN (item_no * 3 + m) % 23 = 7 THEN 'timeout' ELSE NULL END AS error
FROM (SELECT CASE WHEN extra = 1 THEN concat('X.', uid) ELSE uid END AS uid, concat('m', m) AS model, m, item_no,
             attempt, 2 * item_no + attempt AS ingest_seq, h, extra,
             CASE WHEN attempt = 1 THEN 'Fail' ELSE
             CASE h WHEN 0 THEN 'Success' WHEN 1 THEN 'fail' WHEN 2 THEN 'Yes.' WHEN 3 THEN 'No'
                    WHEN 4 THEN 'The agent succeeded' WHEN 5 THEN 'It was unsuccessful'
                    WHEN 6 THEN 'successfully failed'
                    WHEN 7 THEN 'success at first, and much later on it would fail'
                    WHEN 8 THEN '' WHEN 9 THEN '__ERR__: 429 rate limit' WHEN 11 THEN txt
                    WHEN 12 THEN '{ "answer":"key_red" }' WHEN 13 THEN concat('```json', chr(10), '```{"answer": "holding"}```')
                    WHEN 14 THEN 'The answer is B' ELSE 'a' END END AS raw
      FROM (SELECT s.*, m, attempt, extra, (item_no * 7 + m * 5 + nch) % 16 AS h
            FROM (SELECT e.uid, e.item_no, e.prompt AS txt, length(e.prompt) AS nch FROM {exam_c} e
                  UNION ALL SELECT uid, item_no, prompt, 0 FROM {exam_a}
                  UNION ALL SELECT uid, item_no, prompt, 0 FROM {exam_d}
                  UNION ALL SELECT uid, item_no, prompt, 0 FROM {exam_e}) s
            @EACH(m, 3) @EACH(attempt, 2) @EACH(extra, 2)) r
      WHERE (attempt = 0 OR (item_no + m) % 10 = 0) AND (h <> 10 OR attempt = 1)
        AND (extra = 0 OR (item_no % 50 = 0 AND attempt = 0))) x
"""

# one model that always answers Fail, for degenerate-judge checks
VIEWS["responses_degenerate"] = """
SELECT uid, model, attempt, ingest_seq, CASE WHEN model = 'm2' THEN 'Fail' ELSE raw END AS raw,
       CASE WHEN model = 'm2' THEN 'Fail' ELSE pred END AS pred, ok, error
FROM {responses}
"""

# ---------------------------------------------------------------- trajectories in step form

VIEWS["steps"] = """
SELECT group_id, env_task, t, event_id, action, carry, x, y, dir, front_type, front_color, door_state, visible, grp
FROM (SELECT event_id, grp, concat('g', grp) AS group_id, concat('env', grp % 6) AS env_task, event_id % 64 AS t,
             CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 WHEN 'signup' THEN 5
                             WHEN 'click' THEN 2 ELSE 0 END AS action,
             CASE WHEN event_type = 'purchase' OR (event_id % 16 > 4 AND event_id % 16 < 12 AND event_type <> 'error')
                  THEN concat('obj', (blk + CASE WHEN iv % 7 = 0 THEN 1 ELSE 0 END) % 4) END AS carry,
             iv % 7 AS x, event_id % 7 AS y, event_id % 4 AS dir,
             CASE event_id % 4 WHEN 0 THEN 'key' WHEN 1 THEN 'door' WHEN 2 THEN 'empty' ELSE 'wall' END AS front_type,
             CASE iv % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'green' END AS front_color,
             iv % 3 AS door_state,
             CASE iv % 5 WHEN 0 THEN 'key' WHEN 1 THEN 'door' WHEN 2 THEN 'ball' WHEN 3 THEN 'lava' ELSE 'goal' END AS visible
      FROM (SELECT *, cast(floor(event_id / 64) AS bigint) AS grp, cast(floor(event_id / 16) AS bigint) AS blk,
                   cast(floor(value) AS bigint) AS iv FROM {events}) v) w
"""

# the same with the time of each step
VIEWS["timed_steps"] = VIEWS["steps"].replace("SELECT group_id,", "SELECT ts, group_id,").replace("SELECT event_id, grp,", "SELECT ts, event_id, grp,")

# the cell in front of the agent
VIEWS["front_steps"] = """
SELECT *, x + CASE dir WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS fx, y + CASE dir WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS fy FROM {steps}
"""

# the locked door of a group is the cell in front at one of its door steps; some groups have none
VIEWS["doors"] = """
SELECT group_id, t AS door_at, fx AS door_x, fy AS door_y, front_color AS door_color FROM {front_steps}
WHERE t = 21 + 4 * (grp % 5) AND grp % 9 <> 4
"""

# steps with a key, this door and the way through it; several other doors and keys are on the way
VIEWS["door_steps"] = """
SELECT s.group_id, env_task, grp, t, event_id,
       CASE WHEN t = door_at AND grp % 8 <> 5 THEN 5 WHEN t = door_at - 9 AND grp % 7 <> 1 THEN 3 WHEN t = door_at + 8 AND grp % 4 <> 3 THEN 3
            WHEN action = 3 AND front_type = 'key' AND grp % 11 <> 2 THEN 2 ELSE action END AS action,
       CASE WHEN t = door_at - 9 THEN 'key' WHEN t = door_at + 2 THEN 'door' WHEN t = door_at + 8 THEN 'ball' ELSE front_type END AS front_type,
       CASE WHEN t = door_at - 9 THEN door_color ELSE front_color END AS front_color,
       CASE WHEN t = door_at THEN CASE WHEN grp % 10 = 3 THEN 1 ELSE 2 END WHEN t = door_at + 2 THEN 0 ELSE door_state END AS door_state,
       CASE WHEN t = door_at + 2 AND grp % 6 <> 1 THEN door_x ELSE fx END AS fx, CASE WHEN t = door_at + 2 AND grp % 6 <> 1 THEN door_y ELSE fy END AS fy,
       CASE WHEN t = door_at + 5 AND grp % 5 <> 0 THEN door_x ELSE x END AS x, CASE WHEN t = door_at + 5 AND grp % 5 <> 0 THEN door_y ELSE y END AS y
FROM {front_steps} s LEFT JOIN {doors} d ON d.group_id = s.group_id
"""

# three variants of every step, with known faults by group number
VIEWS["variant_steps"] = """
SELECT group_id, env_task, t, event_id, grp, variant, front_type, front_color, door_state, visible, carry, x, y,
       CASE WHEN variant = 'cf' AND grp % 10 = 2 AND t = 11 THEN action + 1 ELSE action END AS action,
       CASE WHEN variant = 'cf' AND grp % 10 = 4 AND t >= 5 THEN (dir + 1) % 4 ELSE dir END AS dir
FROM (SELECT *, CASE v WHEN 0 THEN 'full' WHEN 1 THEN 'nocue' ELSE 'cf' END AS variant FROM {steps} @EACH(v, 3)) s
WHERE NOT (variant = 'cf' AND grp % 10 = 1)
"""

# header of the trajectory record: outcome fields and declared inputs
VIEWS["headers"] = """
SELECT DISTINCT group_id, env_task, variant, grp,
       CASE WHEN variant = 'cf' AND grp % 10 <> 6 THEN false ELSE true END AS success,
       CASE WHEN variant = 'cf' AND grp % 10 <> 6 THEN false ELSE true END AS terminated,
       CASE WHEN variant = 'cf' AND grp % 10 = 9 AND grp % 20 = 9 THEN true ELSE false END AS truncated,
       CASE WHEN variant = 'cf' THEN 0.0 WHEN variant = 'nocue' AND grp % 10 = 3 THEN 0.5 ELSE 1.0 END AS reward,
       CASE WHEN grp % 10 = 8 THEN 'frames,mission,reward' WHEN grp % 10 = 7 THEN 'frames,mission,terminated'
            ELSE 'frames,mission' END AS input_fields,
       CASE WHEN grp % 10 = 5 THEN 1 ELSE 0 END AS frames_short
FROM {variant_steps}
"""

VIEWS["grid_cells"] = """
SELECT group_id, env_task, t, cx, cy, grp, (event_id * 31 + 7 * cx + 3 * cy) % 11 AS v,
       CASE WHEN (event_id * 31 + 7 * cx + 3 * cy) % 11 <= 1 THEN true ELSE false END AS is_target,
       CASE WHEN t < 3 THEN true ELSE false END AS masked,
       CASE WHEN t < 3 AND (event_id * 31 + 7 * cx + 3 * cy) % 11 <= 1 THEN 99
            WHEN grp % 10 = 7 AND t = 2 AND cx = 1 AND cy = 1 AND (event_id * 31 + 7 * cx + 3 * cy) % 11 > 1 THEN 98
            WHEN grp % 10 = 6 AND t = 9 AND cx = 0 AND cy = 2 THEN 97
            ELSE (event_id * 31 + 7 * cx + 3 * cy) % 11 END AS v_nocue
FROM {steps} @EACH(cx, 3) @EACH(cy, 3)
"""

# ---------------------------------------------------------------- scenes

# one row per object occurrence; duplicates are possible and are removed by the set semantics
VIEWS["scene_objects"] = """
SELECT l_orderkey AS scene_id,
       CASE l_partkey % 4 WHEN 0 THEN 'key' WHEN 1 THEN 'door' WHEN 2 THEN 'ball' ELSE 'box' END AS type,
       l_suppkey % 7 AS px, cast(l_linenumber % 7 AS bigint) AS py,
       CASE cast(l_quantity AS bigint) % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' ELSE 'yellow' END AS color,
       cast(round(100 * l_tax) AS bigint) % 3 AS state,
       l_linenumber % 3 = 0 AS dropped_by_judge, l_partkey % 11 = 0 AS recoloured_by_judge
FROM {lineitem}
"""

VIEWS["scene_heads"] = """
SELECT o_orderkey AS scene_id, concat('B.env', o_custkey % 6, '.g', o_custkey, '.t', o_orderkey) AS uid,
       concat('env', o_custkey % 6) AS env_task, concat('g', o_custkey) AS group_id,
       o_custkey % 7 AS ax, o_orderkey % 7 AS ay, o_orderkey % 4 AS dir,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'key' ELSE 'ball' END AS carry_type,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 1 THEN 'red' ELSE 'blue' END AS carry_color,
       CASE o_orderkey % 5 WHEN 0 THEN 'door' WHEN 1 THEN 'wall' WHEN 2 THEN 'key' ELSE 'empty' END AS front_type,
       o_custkey % 3 AS front_state, o_orderkey % 8 AS fmt
FROM {orders}
"""


_EACH = re.compile(r"@EACH\((\w+),\s*(\d+)\)")


def _refs(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


class Fixtures:
    """Lazy DataFrames over one folder of tables: ``Fixtures(spark, dir).view('steps')``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """The table as it lies on disk, in the scan's own partitions."""
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._views and name in TABLES:
            self._views[name] = self.table(name)
        if name not in self._views:
            sql = _EACH.sub(
                lambda m: f"LATERAL VIEW explode(sequence(0L, {int(m[2]) - 1}L)) each_{m[1]} AS {m[1]}", VIEWS[name]
            )
            # the doubled braces keep JSON literals out of the formatter
            self._views[name] = self.spark.sql(
                re.sub(r"\{(?!\w+\})|(?<!\w)\}", lambda m: m[0] * 2, sql), **{r: self.view(r) for r in _refs(sql)}
            )
        return self._views[name]

    __call__ = view
