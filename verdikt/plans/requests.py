"""Queries: exam dimensions, prompts, requests, probes, mock answers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import round6
from ..operators import dims as D, reports as M, requests as R, sequence as Q
from ..operators.sets import other_labels
from ..session import scratch_dir
from .fixtures import Fixtures
from .registry import query
from .steps import trajectories

SEED = 11
LABELS = ["holding", "dropped", "key_red"]
TERMS = ["reward", "widget", "success"]
PREAMBLES = {"pos": "The run seems to reach its goal.", "neu": "Below are two runs of one task.", "neg": "The run seems to miss its goal."}


@query("p1_with_uid")
def _(fx):
    d = fx("exam_c").select(
        F.when(F.col("item_no") % 3 == 0, F.lit("  ")).otherwise(F.col("uid")).alias("uid"),
        F.when(F.col("item_no") % 2 == 0, F.concat(F.lit(" x"), "item_no", F.lit("\n"))).alias("exam_id"),
        F.when(F.col("item_no") % 9 == 3, F.concat(F.lit("t"), "item_no")).alias("template_id"),
        F.when(F.col("item_no") % 2 == 1, F.col("variant")).alias("variant"),
        "family", F.concat(F.lit("line one\nline two of "), "item_no").alias("prompt"), "item_no",
    )
    return D.with_uid(d, fallback=True).select("item_no", "uid")


@query("p2_exam_dims")
def _(fx):
    rows = fx("gold_rows").select("uid", F.lit(None).cast("string").alias("env_task"), F.lit("row_group").alias("group_id"), F.lit("7").alias("frame_idx"))
    extra = fx("exam_c").select(F.concat_ws(".", "uid", "framing").alias("uid"), "env_task", "group_id", F.lit(None).cast("string").alias("frame_idx"))
    d = D.with_exam_dims(rows.unionByName(extra))
    return d.select("uid", "task", "env_task", "group_id", "variant", "temporal", "visual", "framing", "t", "schema_version")


@query("p3_normalise_gold")
def _(fx):
    return D.normalise_gold(fx("gold_rows")).select("uid", "task", "gold")


@query("p4_strip_privileged")
def _(fx):
    t = trajectories(fx)
    return R.strip_privileged(t, ["group_id", "variant", "mission", "success"]).distinct()


@query("p4_leak_report")
def _(fx):
    t = trajectories(fx).withColumn("reward", F.when(F.col("reward") > 0, F.col("reward"))).withColumn("seed", F.when(F.col("grp") % 2 == 0, F.col("grp")))
    return R.leak_report(t)


def _exam(fx: Fixtures) -> DataFrame:
    cols = ["uid", "task", "env_task", "group_id", "prompt", "image"]
    e = fx("exam_a").select(*cols).unionByName(fx("exam_d").select(*cols)).unionByName(fx("exam_c").select(*cols))
    e = e.unionByName(fx("exam_e").select("uid", "task", "env_task", "group_id", F.when(F.col("item_no") % 31 != 0, F.col("prompt")).alias("prompt"), "image"))
    return e.withColumn("image", F.when(~F.col("uid").endswith("9"), F.col("image")))


@query("p5_build_requests")
def _(fx):
    r = R.build_requests(_exam(fx), "root/")
    return r.select("uid", F.col("exam.task").alias("task"), F.get("images", F.lit(0)).alias("image"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query("p5_idempotent")
def _(fx):
    """Building a request from its own prompt changes nothing."""
    a = fx("exam_a").select("uid", R.with_contract(F.col("prompt"), R.LETTER_CONTRACT).alias("p"))
    return a.select("uid", "p", (R.with_contract(F.col("p"), R.LETTER_CONTRACT) == F.col("p")).alias("stable"))


TWO_LETTERS = "\n\nReply with one letter, A or B, and nothing else."
YES_NO = "\n\nReply with Yes or No and nothing else."
ORDER_NOTE = "Three pictures follow: the start, outcome A and outcome B.\n"
OLD_RULE = r"\n\nChoose A or B\."


def _old_prompts(fx: Fixtures) -> DataFrame:
    """Questions of which some end with an older answer rule and some have none."""
    text = F.when(F.col("item_no") % 3 == 0, F.concat(F.lit("  "), "prompt", F.lit("\n\nChoose A or B.  "))).when(F.col("item_no") % 7 != 0, F.col("prompt"))
    return fx("exam_d").select("uid", text.alias("prompt"))


@query("p5_two_letters")
def _(fx):
    built = R.exam_prompt(F.col("prompt"), TWO_LETTERS, ORDER_NOTE, OLD_RULE)
    d = _old_prompts(fx).withColumn("built", built)
    return d.select("uid", "built", (R.exam_prompt(F.col("built"), TWO_LETTERS, ORDER_NOTE, OLD_RULE) == F.col("built")).alias("stable"))


@query("p5_yes_no")
def _(fx):
    return _old_prompts(fx).select("uid", R.exam_prompt(F.col("prompt"), YES_NO, old_tail=OLD_RULE).alias("built"))


@query("p11_mask_nested")
def _(fx):
    """A request with options in options and lists of them."""
    o = fx("orders")
    options = F.create_map(F.lit("x-api-key"), F.col("o_clerk") if "o_clerk" in o.columns else F.col("o_orderpriority"), F.lit("max_tokens"), F.lit("64"))
    call = F.struct(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("access_token"), F.array(options).alias("calls"),
        F.create_map(F.lit("headers"), options, F.lit("auth_token"), options).alias("extra"), F.struct(F.lit(1).alias("secret"), F.lit("x").alias("model")).alias("inner"),
    )
    d = o.select("o_orderkey", call.alias("c"))
    d = d.withColumn("c", R.mask_secrets("c", d.schema["c"].dataType))
    return d.select(
        "o_orderkey", "c.status", "c.access_token", F.col("c.calls")[0]["x-api-key"].alias("call_key"), F.col("c.calls")[0]["max_tokens"].alias("call_tokens"),
        F.col("c.extra")["headers"]["x-api-key"].alias("header_key"), F.col("c.extra")["auth_token"].isNull().alias("auth_hidden"), "c.inner.secret", "c.inner.model",
    )


@query("p6_adapt_prompt")
def _(fx):
    c = fx("conversations").withColumn("prompt", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" BELOW is a picture\n"), "text")).otherwise(F.col("text")))
    return c.select("conv_id", "turn", F.md5(R.adapt_prompt("prompt", "Frames in order.").cast("binary")).alias("prompt_md5"))


@query("p7_fan_out_framing")
def _(fx):
    e = fx("exam_d").select("uid", F.when(F.col("item_no") % 4 != 0, F.concat(F.lit("old line\n"), "prompt")).alias("prompt"))
    return R.fan_out_framing(e, PREAMBLES, "Answer Yes or No.").select("uid", "framing", "prompt")


@query("p8_fan_out_probes")
def _(fx):
    t = Q.with_storyboard(trajectories(fx), 8)
    p = R.fan_out_probes(t.select("env_task", "group_id", "variant", "board"))
    return p.select("uid", "temporal", "visual", F.get("board", F.lit(0)).alias("first_frame"), F.get("board", F.lit(7)).alias("last_frame"))


@query("p8_request_options")
def _(fx):
    r = fx("exam_d").select("uid", "image")
    return R.fan_out_options(r, {"content_order": ["image_first", "text_first"], "image_detail": ["low", "high"]})


@query("p9_action_mask")
def _(fx):
    e = fx("exam_a").select("uid", F.when(F.col("item_no") % 8 != 0, F.col("action")).alias("action"), "prompt")
    return R.action_mask(e)


@query("p10_action_shuffle")
def _(fx):
    return R.action_shuffle(fx("exam_a").select("uid", "env_task", "action", "prompt"), SEED)


@query("p11_mask_secrets")
def _(fx):
    o = fx("orders")
    keys = ["api_key", "Max_Tokens", "contents", "session-token", "X-Authorization-Hint", "status", "monkey"]
    vals = [F.col("o_custkey").cast("string"), F.lit("512"), F.col("o_orderpriority"), F.lit("abc"), F.lit("b"), F.col("o_orderstatus"), F.lit("x")]
    m = F.create_map(*[x for k, v in zip(keys, vals) for x in (F.lit(k), v)])
    return o.select("o_orderkey", F.explode(R.mask_secret_fields(m)).alias("field", "shown"))


@query("p15_buckets")
def _(fx):
    e = fx("exam_e")
    kinds = D.task_kind(e.withColumn("task", F.when(F.col("item_no") % 2 == 0, F.col("task"))).withColumn("uid", F.lit("z")))
    rules = [("holding", "kept"), ("drop", "released"), ("long", "far")]
    return e.select(
        "uid", D.horizon_bucket("horizon_gap").alias("horizon"), D.first_match_bucket("sampling_role", rules, "other").alias("source_bucket"),
        D.turn_bucket(F.when(F.col("query_step") % 3 == 0, F.lit("Turn left"))).alias("turn"), kinds.alias("kind"),
    )


@query("p15_task_kind")
def _(fx):
    g = fx("gold_rows").select("uid", "answer", F.when(F.col("line_no") % 2 == 0, F.col("task")).alias("task"), F.when(F.col("line_no") % 3 == 0, F.lit("v.mw_exam.1")).alias("schema_version"))
    return g.select("uid", D.task_kind(g).alias("kind"))


@query("p16_request_budget")
def _(fx):
    return fx("gold_rows").groupBy("task", D.request_budget("task").alias("budget")).agg(F.count("*").alias("n"))


@query("p17_response_rows")
def _(fx):
    r = fx("responses").select("uid", F.col("model").alias("m"), "attempt", "raw", "ok", "error")
    out = R.to_response_rows(r, "judge")
    return out.select("uid", "m", "attempt", F.length("pred").alias("pred_chars"), "ok", "error", "finish_reason", "model")


@query("p18_split_exam")
def _(fx):
    s = R.split_exam(fx("exam_a").withColumn("answer", F.upper(F.trim("answer"))))
    return s.select("uid", F.array_join("images", ";").alias("images"), "label", "original_label", "prompt", F.try_element_at("label_map", F.lit("C")).alias("c_image"))


@query("a21_prompt_lengths")
def _(fx):
    return R.prompt_lengths(R.split_exam(fx("exam_a")))


@query("a8_distribution")
def _(fx):
    dims = [["env_task"], ["query_type"], ["horizon_bucket"], ["sampling_role"], ["env_task", "sampling_role"], ["env_task", "query_type", "horizon_bucket"]]
    return M.distribution(fx("exam_e"), dims)


@query("a20_composition")
def _(fx):
    return M.composition(fx("exam_a"), ["difficulty_bucket", "distractor_strategy", "action", "label"])


@query("s9_manifest")
def _(fx):
    return M.manifest(fx("exam_c"), ["env_task", "group_id", "variant", "family"], schema_version="exam.v1")


@query("s9_manifest_written")
def _(fx):
    path = scratch_dir(fx.spark, "manifest")
    M.manifest_rows(fx("exam_c"), ["env_task", "family"], [["family"], ["env_task", "variant"]], schema_version="exam.v1").write.json(path)
    return fx.spark.read.schema("section string, key string, value string").json(path)


@query("u6_other_labels")
def _(fx):
    space = F.array(*[F.lit(x) for x in [*LABELS, "lost"]])
    return fx("exam_e").select("uid", F.array_join(other_labels(space, "answer"), ",").alias("others"))


@query("i1_batch_infer")
def _(fx):
    """Open requests against a stub that fails some batches and some single calls."""
    requests = R.build_requests(_exam(fx), "root/")
    log = fx("responses").filter("model = 'm2' AND attempt = 0")
    return R.batch_infer(requests, stub_client, "stub", log, TERMS).select("uid", "model", "pred", "ok", "error", "finish_reason")


def stub_client():
    def call(uids: list[str], prompts: list[str]) -> list[str]:
        if any(u.endswith("3") for u in uids):
            raise TimeoutError("no answer")
        return [f"{len(p)} chars" for p in prompts]

    return call


def metered_client():
    """A stub that reports its use; it gives no text for some prompts."""

    def call(uids: list[str], prompts: list[str]) -> list[dict]:
        return [
            {"text": "" if u.endswith("7") else "Yes", "finish_reason": "length" if u.endswith("7") else "stop", "usage": {"prompt_tokens": len(p), "completion_tokens": len(u)}}
            for u, p in zip(uids, prompts)
        ]

    return call


@query("p17_usage_records")
def _(fx):
    """Usage by exam from the log that the inference job itself writes."""
    from ..operators import scoring as S

    log = R.batch_infer(R.build_requests(_exam(fx), "root/"), metered_client, "stub", terms=TERMS, protocol="chat")
    use = S.usage_rollup(log.withColumn("task", F.substring("uid", 1, 1)), ["task", "protocol", "finish_reason"])
    return use.select("task", "protocol", "finish_reason", "n_calls", "prompt_tokens", "completion_tokens", "total_tokens", "ok_rate")


@query("i2_mock_responses")
def _(fx):
    g = fx("gold_rows").withColumn("answer", F.when(F.col("task") == "A", F.upper(F.trim("answer"))).otherwise(F.col("answer")))
    return R.mock_responses(g, 0.65, SEED, [*LABELS, "lost"])


@query("i2_mock_accuracy")
def _(fx):
    """Mock answers scored by the pipeline: the accuracy is the mock rate."""
    from ..operators import scoring as S

    e = fx("gold_rows").filter("task = 'E'")
    m = R.mock_responses(e, 0.65, SEED, [*LABELS, "lost"]).select(
        "uid", F.lit("mock").alias("model"), "raw", "pred", "ok", F.lit(None).cast("string").alias("error"), F.lit(0).alias("ingest_seq")
    )
    s = S.score(D.normalise_gold(e), m, ["mock"])
    return s.groupBy("env_task").agg(F.count("*").alias("n"), round6(F.avg("score")).alias("acc"))
