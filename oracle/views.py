"""Building blocks of the oracle: readings, score rows and events, written in plain SQL."""

from __future__ import annotations

import re

from verdikt.plans.fixtures import VIEWS, _EACH, _refs, TABLES

ORACLE_VIEWS: dict[str, str] = {}

WORDS = r"\b(succeed(?:ed)?|success(?:ful(?:ly)?)?|fail(?:ed|ure)?|yes|no)\b"
GOOD = "('succeed','succeeded','success','successful','successfully','yes')"
BAD = "('fail','failed','failure','no')"

ORACLE_VIEWS["first_resp"] = """
SELECT * FROM {responses} QUALIFY row_number() OVER (PARTITION BY uid, model ORDER BY ingest_seq) = 1
"""

# RE2 knows word boundaries of ASCII only, so other letters are replaced by one ASCII letter each
ORACLE_VIEWS["texts"] = r"""
SELECT *, lower(t) AS tl, regexp_replace(lower(t), '[^\x00-\x7F\PL]', 'q', 'g') AS tq
FROM (SELECT *, regexp_replace(CASE WHEN raw <> '' THEN raw ELSE pred END, '^\s+|\s+$', '', 'g') AS t FROM {responses}) x
"""

ORACLE_VIEWS["readings"] = (
    r"""
SELECT uid, model, attempt, ingest_seq, raw, pred, ok, error,
       CASE WHEN NOT ok OR error IS NOT NULL OR starts_with(raw, '__ERR__:') THEN true ELSE false END AS is_error,
       CASE WHEN regexp_full_match(t, '(?i)[abcd]') THEN upper(t)
            ELSE nullif(upper(regexp_extract(tq, '\b([abcd])\b', 1)), '') END AS letter,
       CASE WHEN regexp_full_match(t, '(?i)[abcd]') THEN 'strict'
            WHEN regexp_matches(tq, '\b([abcd])\b') THEN 'recoverable' ELSE 'fail' END AS letter_mode,
       CASE WHEN tl IN @GOOD THEN 'Success' WHEN tl IN @BAD THEN 'Fail'
            WHEN contains(tl, 'unsuccess') OR contains(tl, 'un-fail') OR contains(tl, 'unfail') THEN 'Fail'
            WHEN len(gs) > 0 AND len(bs) = 0 THEN 'Success' WHEN len(bs) > 0 AND len(gs) = 0 THEN 'Fail'
            WHEN len(gs) > 0 AND len(bs) > 0 THEN
              CASE WHEN len(list_filter(gs, lambda a: len(list_filter(bs, lambda b:
                        abs(st[a] - st[b]) <= 15 OR abs(st[a] + length(ws[a]) - st[b] - length(ws[b])) <= 15)) > 0)) > 0 THEN 'Fail'
                   WHEN ws[1] IN @GOOD THEN 'Success' ELSE 'Fail' END END AS verdict,
       CASE WHEN tl IN @GOOD OR tl IN @BAD THEN 'strict'
            WHEN contains(tl, 'unsuccess') OR contains(tl, 'un-fail') OR contains(tl, 'unfail') OR len(ws) > 0 THEN 'recoverable'
            ELSE 'fail' END AS verdict_mode,
       CASE WHEN json_whole IS NOT NULL THEN json_whole ELSE json_part END AS json_label,
       CASE WHEN json_whole IS NOT NULL THEN 'strict' WHEN json_part IS NOT NULL THEN 'recoverable' ELSE 'fail' END AS json_mode
FROM (SELECT *, list_transform(range(1, len(ws) + 1), lambda i:
                  coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
                  + coalesce(list_sum(list_transform(ws[1:i - 1], lambda w: length(w))), 0)) AS st,
             list_filter(range(1, len(ws) + 1), lambda i: ws[i] IN @GOOD) AS gs,
             list_filter(range(1, len(ws) + 1), lambda i: ws[i] IN @BAD) AS bs
      FROM (SELECT *, regexp_extract_all(tq, '@WORDS') AS ws, regexp_split_to_array(tq, '@WORDS') AS gaps,
                   CASE WHEN t LIKE '{%}' AND json_valid(t) THEN nullif(trim(json_extract_string(t, '$.answer')), '') END AS json_whole,
                   list_filter(list_transform(string_split(t, '```'), lambda p:
                     CASE WHEN trim(p) LIKE '{%}' AND json_valid(trim(p)) THEN nullif(trim(json_extract_string(trim(p), '$.answer')), '') END),
                     lambda a: a IS NOT NULL)[1] AS json_part
            FROM {texts}) y) z
""".replace("@GOOD", GOOD).replace("@BAD", BAD).replace("@WORDS", WORDS)
)

ORACLE_VIEWS["first_readings"] = """
SELECT * FROM {readings} QUALIFY row_number() OVER (PARTITION BY uid, model ORDER BY ingest_seq) = 1
"""

ORACLE_VIEWS["gold"] = r"""
SELECT *, CASE WHEN task = 'A' THEN CASE WHEN upper(trim(answer)) IN ('A','B','C','D') THEN upper(trim(answer))
                                         ELSE substr('ABCD', cast(label + 1 AS int), 1) END
               WHEN task IN ('C', 'D') THEN CASE WHEN lower(trim(answer)) IN ('success','succeed','succeeded') THEN 'Success'
                                                 WHEN lower(trim(answer)) IN ('fail','failure','failed') THEN 'Fail' END
               ELSE answer END AS gold
FROM {gold_rows}
"""

SCORED = """
SELECT uid, model, task, env_task, group_id, t, variant, temporal, visual, query_type, horizon_bucket, sampling_role, gold,
       answered, is_error, failure, failure IS NULL AS correct, CASE WHEN failure IS NULL THEN 1.0 ELSE 0.0 END AS score,
       CASE WHEN failure IN ('missing_response', 'api_error') THEN 'fail' ELSE mode END AS parse_mode,
       CASE WHEN failure IS NULL OR failure NOT IN ('missing_response', 'api_error') THEN val END AS verdict,
       CASE WHEN failure IS NULL OR failure LIKE '%_wrong' THEN val END AS pred_norm
FROM (SELECT *, CASE WHEN NOT answered THEN 'missing_response' WHEN is_error THEN 'api_error'
                     WHEN val IS NULL THEN CASE task WHEN 'A' THEN 'A_no_letter' WHEN 'C' THEN 'C_no_label'
                                                     WHEN 'D' THEN 'D_no_label' ELSE 'E_parse_error' END
                     WHEN gold IS NULL THEN concat(task, '_missing_gold')
                     WHEN val <> gold THEN concat(task, '_wrong') END AS failure
      FROM (SELECT g.*, m.model, r.uid IS NOT NULL AS answered, coalesce(r.is_error, false) AS is_error,
                   CASE task WHEN 'A' THEN letter WHEN 'E' THEN json_label ELSE r.verdict END AS val,
                   CASE task WHEN 'A' THEN letter_mode WHEN 'E' THEN json_mode ELSE verdict_mode END AS mode
            FROM @GOLD g CROSS JOIN (SELECT unnest(['m0', 'm1', 'm2']) AS model) m
            LEFT JOIN {first_readings} r ON r.uid = g.uid AND r.model = m.model) j) k
"""
ORACLE_VIEWS["scored"] = SCORED.replace("@GOLD", "{gold}")

# task C with the exam's own dimensions
ORACLE_VIEWS["scored_c"] = """
SELECT s.*, e.framing, e.family, e.difficulty FROM {scored} s JOIN {exam_c} e ON e.uid = s.uid WHERE s.task = 'C'
"""


def with_views(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """A complete statement: the views ``body`` needs, in order, then ``body``."""
    views = {**VIEWS, **ORACLE_VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(n: str) -> None:
        if n in TABLES or n in order:
            return
        for r in _refs(views[n]):
            visit(r)
        order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        sql = _EACH.sub(lambda m: f"CROSS JOIN (SELECT unnest(range({m[2]})) AS {m[1]}) AS each_{m[1]}", views[n])
        parts.append(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', sql).strip()})")
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + re.sub(r"[{](\w+)[}]", r"\1", body).strip()
