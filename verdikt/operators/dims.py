"""Identity and dimension columns of exam rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parse import gold_verdict
from ..functions.text import col, nonblank, strip, to_int

# Fixed values.
DEFAULT_SCHEMA_VERSION = "exam.v1"
ID_FIELDS = ["uid", "exam_id", "item_id", "id"]
DIM_FIELDS = ["task", "env_task", "group_id", "variant", "temporal", "visual", "framing"]


def _have(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def with_uid(df: DataFrame, fallback: bool = False) -> DataFrame:
    """Canonical uid: the first id field with text in it.

    ``fallback`` adds family.template[.variant] and then the head of the prompt, which is what names a
    row that carries no id of its own.
    """
    uid = F.coalesce(*[nonblank(f) for f in ID_FIELDS if f in df.columns], F.lit(None).cast("string"))
    if fallback:
        template = nonblank(_have(df, "template_id").cast("string"))
        named = F.when(
            template.isNotNull(),
            F.concat_ws(
                ".", F.coalesce(_have(df, "family"), F.lit("")), template, nonblank(_have(df, "variant").cast("string"))
            ),
        )
        head = F.replace(F.substring(F.coalesce(_have(df, "prompt"), F.lit("")), 1, 50), F.lit("\n"), F.lit(" "))
        uid = F.coalesce(uid, named, head)
    return df.withColumn("uid", uid)


def with_exam_dims(df: DataFrame, schema_version: str | None = None) -> DataFrame:
    """Split the dotted uid into its dimensions; fields of the row fill what the uid does not say."""
    uid = strip("uid")
    p = F.split(uid, r"\.", -1)
    n = F.size(p)
    task = F.when(n >= 2, F.get(p, F.lit(0)))
    ab = task.isin("A", "B") & (n >= 4)
    c = (task == "C") & (n >= 5)
    tpart = F.get(p, F.lit(3))
    from_uid = {
        "task": task,
        "env_task": F.when(ab | c, F.get(p, F.lit(1))),
        "group_id": F.when(ab | c, F.get(p, F.lit(2))),
        "variant": F.when(c, F.get(p, F.lit(3))),
        "temporal": F.when(c, F.get(p, F.lit(4))),
        "visual": F.when(c & (n >= 6), F.get(p, F.lit(5))),
        "framing": F.when(c & (n >= 7), F.get(p, F.lit(6))),
    }
    t = F.coalesce(
        F.when(ab & tpart.startswith("t"), to_int(F.substr(tpart, F.lit(2)))),
        to_int(_have(df, "t").cast("string")),
        to_int(_have(df, "frame_idx").cast("string")),
    )
    out = {k: F.coalesce(v, _have(df, k).cast("string")) for k, v in from_uid.items()}
    version = F.coalesce(
        F.lit(schema_version), nonblank(_have(df, "schema_version").cast("string")), F.lit(DEFAULT_SCHEMA_VERSION)
    )
    return df.withColumns({**out, "t": t, "schema_version": version})


def normalise_gold(df: DataFrame) -> DataFrame:
    """``gold``: letter (or letter of the label) for A, Success/Fail for C and D, the label text for E."""
    letter = F.upper(strip("answer"))
    by_label = F.when(F.col("label").between(0, 3), F.substring(F.lit("ABCD"), F.col("label").cast("int") + 1, F.lit(1)))
    gold = (
        F.when(F.col("task") == "A", F.when(letter.isin("A", "B", "C", "D"), letter).otherwise(by_label))
        .when(F.col("task").isin("C", "D"), gold_verdict("answer"))
        .otherwise(F.col("answer"))
    )
    return df.withColumn("gold", gold)


# ---------------------------------------------------------------- buckets

# Fixed values.
HORIZON_BUCKETS = [("short", 1, 10), ("medium", 11, 25)]
LAST_HORIZON = "long"
TOKEN_BUDGET = {"A": 512, "B": 2048, "C": 256}
DEFAULT_BUDGET = 512


def horizon_bucket(gap: str | Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, lo, hi in HORIZON_BUCKETS:
        out = out.when(col(gap).between(lo, hi), F.lit(name))
    return out.otherwise(F.lit(LAST_HORIZON))


def first_match_bucket(text: str | Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Bucket of the first rule ``(substring, bucket)`` found in the text."""
    out = F.when(F.lit(False), F.lit(""))
    for part, bucket in rules:
        out = out.when(F.contains(col(text), F.lit(part)), F.lit(bucket))
    return out.otherwise(F.lit(default))


def turn_bucket(plan: str | Column) -> Column:
    return F.when(F.contains(F.lower(F.coalesce(col(plan), F.lit(""))), F.lit("turn")), F.lit("with_turn")).otherwise(
        F.lit("straight")
    )


def task_kind(df: DataFrame) -> Column:
    """Which scorer a row needs: by task name, then by schema name and uid, then by the answer's form."""
    task = F.coalesce(_have(df, "task").cast("string"), F.lit(""))
    schema = F.coalesce(_have(df, "schema_version").cast("string"), F.lit(""))
    uid = F.coalesce(_have(df, "uid").cast("string"), F.lit(""))
    answer = F.upper(F.coalesce(_have(df, "answer").cast("string"), F.lit("")))
    by_uid = F.contains(schema, F.lit("mw_exam"))
    return (
        F.when(task.isin("A", "A-MW", "B", "B-MW"), F.lit("A"))
        .when(task.isin("C", "C-MW", "C-MW-formal"), F.lit("C"))
        .when(task.startswith("D") | F.contains(task, F.lit("D-MW")), F.lit("D"))
        .when(by_uid & F.substring(uid, 1, 1).isin("A", "C", "D"), F.substring(uid, 1, 1))
        .when(answer.isin("A", "B", "C", "D"), F.lit("A"))
        .otherwise(F.lit("C"))
    )


def request_budget(
    task: str | Column, budgets: Mapping[str, int] = TOKEN_BUDGET, default: int = DEFAULT_BUDGET
) -> Column:
    m = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col(task)), F.lit(default))
