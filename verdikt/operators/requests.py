"""Exam rows → inference requests → response rows, and the prompt variants used as probes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.parse import ERROR_PREFIX
from ..functions.text import col, first_line, n_where, nonblank, stable_int, strip
from ..session import landed
from .dims import with_exam_dims, with_uid
from .gates import payload_scan
from .joins import shard as hash_shard, spread_join, unanswered
from .sequence import number_rows

# Answer contracts, visual and temporal probes, privileged columns.
LETTER_CONTRACT = "Answer with ONLY the correct letter (A/B/C/D). Return exactly one uppercase letter and no other text."
VERDICT_PROMPT = "Determine whether the agent accomplished its goal. Answer with ONLY: Yes or No."
TEMPORALS = ["orig", "rev"]
VISUALS = ["clean", "noisy", "style"]
PRIVILEGED = ["success", "reward", "terminated", "truncated", "cf_meta", "nocue_meta", "seed"]
CONTENT_KEYS = ["messages", "contents"]
SECRET_KEYS = ["api_key", "apikey", "access_token", "refresh_token", "id_token", "authorization", "auth", "secret", "password", "x-api-key", "x-goog-api-key"]
HARMLESS_KEYS = ["maxtokens", "maxcompletiontokens", "maxoutputtokens"]
MASKED_CONTENT, MASKED_SECRET = "***MASKED_CONTENT***", "***MASKED_SECRET***"
LETTERS = ["A", "B", "C", "D"]
#: Default question for scenes; the exam builder may bring another one.
SCENE_PROMPT = (
    "Describe the scene as one JSON object with the keys agent (pos, dir, carrying), front_cell (pos, type, state) and objects "
    "(a list of type, pos, color, state). Write nothing else."
)


# ---------------------------------------------------------------- prompt-safe columns


def strip_privileged(df: DataFrame, allow: Sequence[str]) -> DataFrame:
    """Only the columns that may be shown to a judge."""
    return df.select(*[c for c in allow if c in df.columns and c not in PRIVILEGED])


def leak_report(df: DataFrame, privileged: Sequence[str] = PRIVILEGED) -> DataFrame:
    """Rows that carry a value in each privileged column; a column that is not there counts 0."""
    counts = [n_where(F.col(c).isNotNull()).alias(c) if c in df.columns else F.lit(0).cast("bigint").alias(c) for c in privileged]
    row = df.agg(F.count("*").alias("_n"), *counts)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_rows")) for c in privileged]))
    return row.select(pairs.alias("p"), F.col("_n").alias("n_total")).select("p.*", "n_total")


# ---------------------------------------------------------------- requests


def with_contract(prompt: Column, contract: str) -> Column:
    """Prompt with the answer contract at its end, added only if it is not there already."""
    p = strip(F.coalesce(prompt, F.lit("")))
    return F.when(F.contains(p, F.lit(contract)), p).when(p == "", F.lit(contract)).otherwise(F.concat(p, F.lit("\n" + contract)))


def exam_prompt(prompt: Column, contract: str, preface: str = "", old_tail: str | None = None) -> Column:
    """Prompt of an exam with its own rules: preface, the question without an old answer rule, and the answer contract.

    ``old_tail`` is a pattern at the end of the question.  A prompt that was built before is taken apart first, so
    building it again changes nothing.
    """
    p = strip(F.coalesce(prompt, F.lit("")))
    if preface:
        p = F.when(F.startswith(p, F.lit(preface)), F.substr(p, F.lit(len(preface) + 1))).otherwise(p)
    p = F.when(F.endswith(p, F.lit(contract)), F.substr(p, F.lit(1), F.length(p) - len(contract))).otherwise(p)
    if old_tail:
        p = F.regexp_replace(strip(p), rf"(?s)(?:{old_tail})\s*$", "")
    return F.concat(F.lit(preface), strip(p), F.lit(contract))


def request_prompt(task: Column, prompt: Column, scene_prompt: str = SCENE_PROMPT) -> Column:
    """Prompt text by task: letters get their contract, scenes and verdicts a default question, labels stay as they are."""
    own = strip(F.coalesce(prompt, F.lit("")))
    return (
        F.when(task == "A", with_contract(prompt, LETTER_CONTRACT))
        .when(task == "B", F.when(own == "", F.lit(scene_prompt)).otherwise(own))
        .when(task.isin("C", "D"), F.when(prompt.isNull(), F.lit(VERDICT_PROMPT)).otherwise(own))
        .otherwise(own)
    )


def build_requests(
    exam: DataFrame, image_root: str = "", options: Mapping[str, str] | None = None, scene_prompt: str = SCENE_PROMPT, extras: Sequence[str] = ()
) -> DataFrame:
    """Request rows of an exam: uid, prompt, images and the exam's dimensions.

    Rows without uid or image are left out, and rows of task E without a prompt.  ``extras`` names further exam columns
    that go along.
    """
    # the exam's own task decides the prompt; the uid only fills the dimensions
    d = with_uid(exam).withColumns(
        {"_prompt": request_prompt(F.col("task"), F.col("prompt"), scene_prompt), "_image": F.concat(F.lit(image_root), nonblank("image"))}
    )
    d = d.filter(F.col("uid").isNotNull() & F.col("_image").isNotNull() & ((F.col("task") != "E") | (F.col("_prompt") != "")))
    d = with_exam_dims(d)
    meta = F.struct(*[F.col(c) for c in ("uid", "task", "env_task", "group_id", "variant", "temporal", "visual", "framing", "t", "schema_version", *extras)])
    out = d.select(
        "uid", F.col("uid").alias("exam_id"), "schema_version", F.array("_image").alias("images"), F.col("_prompt").alias("prompt"), meta.alias("exam")
    )
    return out.withColumns({k: F.lit(v) for k, v in (options or {}).items()})


def adapt_prompt(prompt: str | Column, first: str) -> Column:
    """Swap the first line if it introduces a composite ("below is …"), else put a new one in front."""
    p = F.coalesce(col(prompt), F.lit(""))
    p = F.replace(F.replace(p, F.lit('{{"answer":'), F.lit('{"answer":')), F.lit('>"}}'), F.lit('>"}'))
    head = F.lower(strip(first_line(p)))
    rest = F.substring(p, F.length(first_line(p)) + 1, F.length(p))
    return strip(F.when(head.startswith("below is"), F.concat(F.lit(first), rest)).otherwise(F.concat(F.lit(first + "\n\n"), p)))


def fan_out_framing(exam: DataFrame, preambles: Mapping[str, str], body: str) -> DataFrame:
    """Each row once per framing: first prompt line swapped, uid with the framing at its end."""
    f = F.explode(F.array(*[F.struct(F.lit(k).alias("framing"), F.lit(v).alias("line")) for k, v in preambles.items()]))
    base = strip(F.coalesce(F.col("prompt"), F.lit("")))
    rest = F.substring(F.col("_base"), F.length(first_line("_base")) + 1, F.length("_base"))
    text = F.when(F.col("_base") == "", F.concat(F.col("_f.line"), F.lit("\n\n" + body))).otherwise(F.concat(F.col("_f.line"), rest))
    uid = F.concat_ws(".", "uid", "_f.framing")
    return (
        exam.withColumn("_base", base)
        .withColumn("_f", f)
        .withColumns({"prompt": text, "framing": F.col("_f.framing"), "uid": uid, "exam_id": uid})
        .drop("_f", "_base")
    )


def fan_out_probes(boards: DataFrame, frames: str = "board") -> DataFrame:
    """Variant rows → orig/rev × clean/noisy/style probes; ``rev`` shows the frames backwards."""
    combos = [F.struct(F.lit(t).alias("temporal"), F.lit(v).alias("visual")) for t in TEMPORALS for v in VISUALS]
    d = boards.withColumn("_p", F.explode(F.array(*combos))).select("*", "_p.*").drop("_p")
    shown = F.when(F.col("temporal") == "rev", F.reverse(frames)).otherwise(F.col(frames))
    uid = F.concat_ws(".", F.lit("C"), "env_task", "group_id", "variant", "temporal", "visual")
    return d.withColumns({frames: shown, "uid": uid})


def fan_out_options(requests: DataFrame, options: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each request once per combination of request options."""
    for name, values in options.items():
        requests = requests.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return requests.withColumn("uid", F.concat_ws(".", "uid", *options))


# ---------------------------------------------------------------- ablations


def action_mask(exam: DataFrame, token: str = "[UNKNOWN]") -> DataFrame:
    """Hide the action in the prompt and keep it aside."""
    has = nonblank("action").isNotNull()
    return exam.withColumns(
        {
            "original_action": F.when(has, F.col("action")),
            "prompt": F.when(has, F.replace("prompt", F.col("action"), F.lit(token))).otherwise(F.col("prompt")),
            "action": F.when(has, F.lit(token)).otherwise(F.col("action")),
            "ablation_type": F.when(has, F.lit("mask")),
        }
    )


def action_pool(exam: DataFrame, env: str = "env_task") -> DataFrame:
    """The different actions of each environment with their place (``place``, from 0, by text).

    Actions may be free texts, so a pool may be as long as an environment has rows: it is numbered range by range, and the
    ranges are fixed by writing them once.
    """
    rows = exam.filter(nonblank("action").isNotNull() & F.col(env).isNotNull()).select(env, "action").distinct()
    ranges = landed(rows.repartitionByRange(env, "action").withColumn("_range", F.spark_partition_id()), "actions")
    return number_rows(ranges, [env], ["action"], F.col("_range"), "place").select(env, "action", "place")


def action_shuffle(exam: DataFrame, seed: object, env: str = "env_task") -> DataFrame:
    """Replace the action by another one of the same environment, drawn by seed.

    The draw is arithmetic: a number among the other actions, which skips the row's own place.  Rows meet the pool by place,
    salted, because one environment or action may hold most of the rows.  A row without environment, or without another
    action to take, stays as it is; one without an action may get any.
    """
    pool = action_pool(exam, env)
    sizes = pool.groupBy(env).agg(F.count("*").alias("_n"))
    spread = F.col("uid")
    d = spread_join(exam, sizes, [env], spread, "left")
    d = spread_join(d, pool.withColumnRenamed("place", "_own"), [env, "action"], spread, "left")
    others = F.col("_n") - F.when(F.col("_own").isNotNull(), 1).otherwise(0)
    at = F.when(others > 0, stable_int(F.concat_ws("|", F.lit(str(seed)), "uid")) % others)
    d = d.withColumn("_place", at + F.when(at >= F.col("_own"), 1).otherwise(0))
    d = spread_join(d, pool.select(env, F.col("place").alias("_place"), F.col("action").alias("_new")), [env, "_place"], spread, "left")
    new = F.col("_new")
    return d.select(
        *[c for c in exam.columns if c not in ("prompt", "action", "original_action", "ablation_type")],
        F.when(new.isNotNull(), F.col("action")).alias("original_action"),
        F.when(new.isNotNull(), F.replace("prompt", F.col("action"), new)).otherwise(F.col("prompt")).alias("prompt"),
        F.coalesce(new, F.col("action")).alias("action"),
        F.when(new.isNotNull(), F.lit("shuffle")).alias("ablation_type"),
    )


def split_exam(exam: DataFrame) -> DataFrame:
    """Composite rows → rows with one current and four candidate images and the label as image number."""
    base = F.concat_ws("/", F.get(F.split("uid", r"\."), F.lit(1)), F.get(F.split("uid", r"\."), F.lit(2)))
    images = F.array(F.concat(base, F.lit("_current.png")), *[F.concat(base, F.lit(f"_choice_{x}.png")) for x in LETTERS])
    prompt = F.concat(
        F.lit("Image 1 is the current state; images 2-5 are the candidates A, B, C, D.\nSelect the state after the action.\nAction: "),
        F.coalesce("action", F.lit("unknown")),
    )
    label_map = F.create_map(*[x for i, c in enumerate(LETTERS) for x in (F.lit(c), F.lit(i + 1))])
    return exam.withColumns(
        {
            "original_image": F.col("image"),
            "original_label": F.col("label"),
            "original_prompt": F.col("prompt"),
            "images": images,
            "prompt": prompt,
            "label_map": label_map,
            "label": F.try_element_at(label_map, F.col("answer")),
        }
    )


def prompt_lengths(df: DataFrame, before: str = "original_prompt", after: str = "prompt") -> DataFrame:
    return df.agg(
        F.count("*").alias("n"), F.round(F.avg(F.length(before)), 6).alias("mean_before"), F.round(F.avg(F.length(after)), 6).alias("mean_after")
    )


def _secret(key: Column) -> Column:
    """Mask text for a key that looks like a secret or holds message contents, else null."""
    low = F.lower(key)
    bare = F.regexp_replace(low, "[_-]", "")
    secret = low.isin(SECRET_KEYS) | low.endswith("token") | low.endswith("key") | F.contains(low, F.lit("authorization"))
    return F.when(~bare.isin(HARMLESS_KEYS), F.when(low.isin(CONTENT_KEYS), F.lit(MASKED_CONTENT)).when(secret, F.lit(MASKED_SECRET)))


def mask_secret_fields(fields: str | Column) -> Column:
    """Hide the values of a map of texts whose key looks like a secret or holds message contents."""
    return F.transform_values(col(fields), lambda k, v: F.coalesce(_secret(k), v))


def mask_secrets(value: str | Column, kind: T.DataType) -> Column:
    """The same at any depth: structs by field name, maps by key, lists element by element.

    A hidden text becomes the mask; hidden values of other types become null.
    """
    value = col(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: mask_secrets(x, kind.elementType))
    if isinstance(kind, T.MapType):
        if isinstance(kind.valueType, T.StringType):
            return mask_secret_fields(value)
        return F.transform_values(value, lambda k, v: F.when(_secret(k).isNull(), mask_secrets(v, kind.valueType)))
    if isinstance(kind, T.StructType):
        shown = []
        for f in kind.fields:
            mask, inner = _secret(F.lit(f.name)), mask_secrets(value.getField(f.name), f.dataType)
            hidden = F.coalesce(mask, inner) if isinstance(f.dataType, T.StringType) else F.when(mask.isNull(), inner)
            shown.append(hidden.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*shown))
    return value


# ---------------------------------------------------------------- responses


def to_response_rows(df: DataFrame, model: str, prefix: str = ERROR_PREFIX) -> DataFrame:
    """Response rows from uid, raw and optional pred, ok, error, finish_reason columns.

    A sentinel answer is an error: ok is false, pred empty, and the sentinel's text the error.
    """
    have = lambda c, t: F.col(c) if c in df.columns else F.lit(None).cast(t)
    raw = F.coalesce("raw", F.lit(""))
    bad = raw.startswith(prefix)
    message = strip(F.substr(raw, F.lit(len(prefix) + 1)))
    return df.withColumns(
        {
            "pred": F.when(bad, F.lit("")).otherwise(F.coalesce(have("pred", "string"), raw)),
            "ok": ~bad & F.coalesce(have("ok", "boolean"), F.lit(True)),
            "error": F.coalesce(nonblank(have("error", "string")), F.when(bad, F.coalesce(nonblank(message), raw))),
            "finish_reason": F.coalesce(have("finish_reason", "string"), F.when(bad, F.lit("error"))),
            "model": F.lit(model),
            "raw": raw,
        }
    )


# The token counts of a response record.
USAGE = ["prompt_tokens", "completion_tokens", "total_tokens"]
RESPONSE_SCHEMA = "uid string, raw string, ok boolean, error string, finish_reason string, latency_ms double, " + ", ".join(f"{u} bigint" for u in USAGE)

#: What a client gives for a prompt: a text, or a mapping with ``text``, ``finish_reason`` and ``usage`` (token counts).
Reply = str | Mapping[str, object]
Client = Callable[[list[str], list[str]], list[Reply]]


def _whole(n: object) -> int | None:
    return int(n) if isinstance(n, (int, float)) and n == n and abs(n) < 2**63 else None


def _record(reply: object, prefix: str) -> dict[str, object] | None:
    """Text, finish reason and token counts of a reply, None if it is none; a mapping without text is an error with its usage."""
    if isinstance(reply, str):
        return {"raw": reply, "finish": None}
    if not isinstance(reply, Mapping):
        return None
    text, finish = reply.get("text"), reply.get("finish_reason")
    usage = reply.get("usage") if isinstance(reply.get("usage"), Mapping) else {}
    counts = {u: _whole(usage.get(u)) for u in USAGE}
    if counts["total_tokens"] is None and None not in (counts["prompt_tokens"], counts["completion_tokens"]):
        counts["total_tokens"] = counts["prompt_tokens"] + counts["completion_tokens"]
    finish = None if finish is None else str(finish)
    raw = text if isinstance(text, str) and text else f"{prefix} empty answer (finish_reason={finish})"
    return {"raw": raw, "finish": finish, **counts}


def _answers(client: Client, uids: list[str], prompts: list[str], prefix: str) -> list[dict[str, object]]:
    """Records of one batch; if the batch fails or answers with anything but replies, of its rows one by one."""
    try:
        records = [_record(r, prefix) for r in client(uids, prompts)]
        if len(records) == len(uids) and None not in records:
            return records
    except Exception:  # noqa: BLE001 - the batch is tried again row by row
        pass
    records = []
    for u, p in zip(uids, prompts):
        try:
            (reply,) = client([u], [p])
            records.append(_record(reply, prefix) or {"raw": f"{prefix} no text: {reply!r}", "finish": None})
        except Exception as e:  # noqa: BLE001 - a failed call is a row, never a failed task
            records.append({"raw": f"{prefix} {type(e).__name__}: {e}", "finish": None})
    return records


def _call_batches(frames: Iterator[pd.DataFrame], make_client: Callable[[], Client], prefix: str, batch: int) -> Iterator[pd.DataFrame]:
    try:
        client = make_client()
    except Exception as e:  # noqa: BLE001 - without a client every row is an error row
        failure = f"{prefix} {type(e).__name__}: {e}"
        client = lambda uids, prompts: [failure] * len(uids)
    for pdf in frames:
        rows = {i: {"uid": u, "raw": "", "ok": False, "error": e, "finish_reason": f, "latency_ms": 0.0} for i, u, e, f in zip(pdf.index, pdf["uid"], pdf["error"], pdf["finish_reason"])}
        send = pdf[~pdf["blocked"]]
        for k in range(0, len(send), batch):
            part = send.iloc[k : k + batch]
            began = time.perf_counter()
            records = _answers(client, list(part["uid"]), list(part["prompt"]), prefix)
            took = (time.perf_counter() - began) * 1000 / len(part)
            for i, r in zip(part.index, records):
                rows[i].update(raw=r["raw"], ok=not r["raw"].startswith(prefix), finish_reason=r["finish"], latency_ms=took, **{u: r.get(u) for u in USAGE})
        out = pd.DataFrame(list(rows.values()), columns=["uid", "raw", "ok", "error", "finish_reason", "latency_ms", *USAGE])
        yield out.astype({u: "Int64" for u in USAGE})


def batch_infer(
    requests: DataFrame,
    make_client: Callable[[], Client],
    model: str,
    log: DataFrame | None = None,
    terms: Sequence[str] = (),
    shard: tuple[int, int] | None = None,
    prefix: str = ERROR_PREFIX,
    batch: int = 64,
    provider: str | None = None,
    backend: str | None = None,
    protocol: str | None = None,
) -> DataFrame:
    """Response rows of the requests that are still open, with the columns of the response record.

    Answered uids drop out, refused prompts become error rows without a call, and the rest goes to the caller's client
    in batches of ``batch`` prompts; the client is made once per task.  Whatever a client does is a row, never a failed task.
    Token counts that a client reports are in the row (null where it does not), so ``scoring.usage_rollup`` runs on the log.
    """
    todo = unanswered(requests, log) if log is not None else requests
    if shard is not None:
        todo = hash_shard(todo, *shard)
    meta = [c for c in ("exam_id", "schema_version", "exam") if c in requests.columns]
    scanned = payload_scan(todo.select("uid", "prompt"), terms)
    sent = scanned.select("uid", "prompt", "blocked", "error", "finish_reason").mapInPandas(
        lambda frames: _call_batches(frames, make_client, prefix, batch), RESPONSE_SCHEMA
    )
    rows = to_response_rows(sent, model, prefix).select("uid", "model", "pred", "raw", "ok", "error", "finish_reason", "latency_ms", *USAGE)
    given = {"provider": provider, "backend": backend, "protocol": protocol}
    rows = rows.withColumns({"shard": F.lit(shard[0] if shard else 0), **{c: F.lit(v).cast("string") for c, v in given.items()}})
    return rows.join(requests.select("uid", *meta).dropDuplicates(["uid"]).withColumnRenamed("schema_version", "exam_schema_version"), "uid", "left") if meta else rows


def mock_responses(exam: DataFrame, rate: float, seed: object, label_space: Sequence[str]) -> DataFrame:
    """Answers that are right with a given rate; wrong ones depend on the task.  Task E answers in JSON."""
    u = stable_int(F.concat_ws("|", F.lit(str(seed)), "uid")) / float(1 << 32)
    pick = stable_int(F.concat_ws("|", F.lit(str(seed)), "uid", F.lit("wrong")))
    right = F.coalesce(F.col("answer"), F.when(F.col("label") == 1, F.lit("Success")).when(F.col("label").isNotNull(), F.lit("Fail")), F.lit("Success"))
    d = exam.withColumns({"_right": right, "_hit": u < rate, "_pick": pick})
    others = lambda xs: F.array_except(F.array(*[F.lit(x) for x in xs]), F.array("_right"))
    one_of = lambda a: F.get(a, (F.col("_pick") % F.size(a)).cast("int"))
    wrong = (
        F.when(F.col("task") == "E", one_of(others(label_space)))
        .when(F.col("_right") == "Success", F.lit("Fail"))
        .when(F.col("_right") == "Fail", F.lit("Success"))
        .when(F.col("_right").isin(LETTERS), one_of(others(LETTERS)))
        .otherwise(F.concat("_right", F.lit("_wrong")))
    )
    d = d.withColumn("pred", F.when(F.col("_hit"), F.col("_right")).otherwise(wrong))
    raw = F.when(F.col("task") == "E", F.concat(F.lit('{"answer": "'), "pred", F.lit('"}'))).otherwise(F.col("pred"))
    return d.select("uid", "task", "pred", raw.alias("raw"), F.lit(True).alias("ok"))
