"""Queries: deduplication, gold/response joins, parsing and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import parse as P

from ..operators import dims as D, joins as J, metrics as M, scoring as S
from .fixtures import MODELS, Fixtures
from .registry import query

SCORE_COLS = "uid model task env_task group_id failure parse_mode pred_norm correct score".split()
C_DIMS = ["variant", "family", "difficulty", "framing"]


def gold(fx: Fixtures) -> DataFrame:
    return D.normalise_gold(fx("gold_rows"))


def scored(fx: Fixtures, responses: str = "responses") -> DataFrame:
    return S.score(gold(fx), fx(responses), MODELS)


def scored_c(fx: Fixtures, responses: str = "responses") -> DataFrame:
    """Task C only, with framing, family and difficulty from the exam."""
    g = D.normalise_gold(fx("exam_c")).drop("prompt", "image", "item_no")
    r = fx(responses).filter(F.col("uid").startswith("C."))
    return S.score(g, r, MODELS)


def exam_a_gold(fx: Fixtures) -> DataFrame:
    return D.normalise_gold(fx("exam_a")).select("uid", "gold", "difficulty_bucket", "distractor_strategy")


# ---------------------------------------------------------------- W1, W2, J*, U*


@query("w1_first_response")
def _(fx):
    r = S.dedupe(S.parse_responses(fx("responses")))
    return r.select("uid", "model", "attempt", "ingest_seq", "n_copies", F.col("as_verdict.value").alias("verdict"))


@query("w2_last_record")
def _(fx):
    r = J.last_per_key(fx("responses").select("uid", "model", "attempt", "ingest_seq"), ["uid", "model"], "ingest_seq")
    return r.select("uid", "model", "attempt", "ingest_seq", "n_copies")


@query("j1_gold_left_join")
def _(fx):
    r = S.dedupe(fx("responses").select("uid", "model", "ingest_seq", "attempt"))
    return J.gold_left_join(gold(fx).select("uid", "task", "gold"), r, MODELS).select(
        "uid", "model", "task", "gold", "answered", "attempt"
    )


@query("j2_extra_responses")
def _(fx):
    return J.extra_responses(fx("gold_rows"), fx("responses"))


@query("j3_resume")
def _(fx):
    log = fx("responses").filter(F.col("model") == "m1")
    return J.unanswered(fx("gold_rows").select("uid", "task"), log)


@query("j3_resume_retry_errors")
def _(fx):
    log = fx("responses").filter(F.col("model") == "m1")
    return J.unanswered(fx("gold_rows").select("uid", "task"), log, retry_errors=True)


@query("j4_hash_shard")
def _(fx):
    return J.shard(fx("gold_rows").select("uid", "task"), 4, 1)


def _c_pairs(fx: Fixtures) -> DataFrame:
    r = fx("responses").filter(F.col("uid").startswith("C."))
    p = S.dedupe(S.parse_responses(r))
    value = F.when(~F.col("is_error"), F.col("as_verdict.value"))
    return J.representation_pairs(p, "m0", "m1", value)


@query("j5_representation_pairs")
def _(fx):
    return _c_pairs(fx)


@query("j7_pair_table")
def _(fx):
    s = scored_c(fx)
    return J.pair_table(s, ["model", "group_id", "variant", "visual"], "temporal", ["orig", "rev"], ["verdict"])


@query("j11_enriched_export")
def _(fx):
    s = S.enriched_export(fx("exam_e").select("uid", "task", "query_type", "sampling_role", "answer"), scored(fx))
    return s.select("uid", "model", "query_type", "sampling_role", "answer", "failure", "parse_mode", "correct", "gold_label")


@query("j12_dimension_lookup")
def _(fx):
    ranks = [("fr", "French", 1), ("en", "English", 2), ("de", "German", 3)]
    return J.with_lookup(fx("exam_c").select("uid", "family"), "family", ranks)


@query("j13_main_table")
def _(fx):
    # judges of task D have no temporal pairs, those of the reversed style set no plain ones
    kind = F.when(F.col("task") == "D", "-d").when((F.col("temporal") == "rev") & (F.col("visual") == "style"), "-r").otherwise("")
    s = scored(fx).filter(F.col("task").isin("C", "D")).withColumn("model", F.concat("model", kind))
    level = S.score_stats(s, ["model"]).select("model", "n", "acc")
    idr = M.intervention_rate(s, ["group_id", "temporal", "visual"]).select("model", "idr")
    les = M.temporal_ratio(s).select("model", "les_t")
    return J.main_table(level, idr, les)


@query("u1_union_tasks")
def _(fx):
    cols = ["uid", "task", "prompt", "image"]
    parts = [fx(v).select(*cols) for v in ("exam_a", "exam_d", "exam_c", "exam_e")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("uid", "task", F.length("prompt").cast("bigint").alias("prompt_chars"), "image")


@query("u2_union_rounds")
def _(fx):
    from ..operators.sets import union_rounds

    e = fx("exam_c").select("uid", "family", "difficulty")
    return union_rounds({"round1": e.filter("family = 'en'"), "round2": e.filter("family <> 'en'")}, "source_round")


@query("u3_uid_sets")
def _(fx):
    from ..operators.sets import uid_membership

    return uid_membership(fx("gold_rows"), fx("responses"))


@query("u5_distinct_assets")
def _(fx):
    from ..operators.sets import distinct_assets

    return distinct_assets(fx("exam_c").unionByName(fx("exam_c").filter("framing = 'pos'")), "image", ["env_task"])


# ---------------------------------------------------------------- X*


@query("x1_choice_letter")
def _(fx):
    t = P.scored_text("raw", "pred")
    r = fx("responses").select("uid", "model", "attempt", P.letter_answer(t).alias("a"), P.letter_answer(t, "AB").alias("b"))
    return r.select(
        "uid", "model", "attempt", F.col("a.value").alias("letter"), F.col("a.mode").alias("parse_mode"),
        F.col("b.value").alias("ab_letter"),
    )


@query("x2_verdict")
def _(fx):
    v = P.verdict(P.scored_text("raw", "pred")).alias("v")
    r = fx("responses").select("uid", "model", "attempt", v)
    return r.select("uid", "model", "attempt", F.col("v.value").alias("verdict"), F.col("v.mode").alias("parse_mode"))


@query("x2_verdict_documents")
def _(fx):
    """Verdict and letter of every whole document, conversation turn and benchmark text."""
    texts = (
        fx("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
        .unionByName(fx("conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), "text"))
        .unionByName(fx("benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text"))
    )
    r = P.read_answers(texts, F.col("text"), ["verdict", "letter"])
    return r.select(
        "id", F.col("as_verdict.value").alias("verdict"), F.col("as_verdict.mode").alias("parse_mode"), F.col("as_letter.value").alias("letter")
    )


@query("x3_alias_verdict")
def _(fx):
    t = P.scored_text("raw", "pred", "pred")
    prompt = F.when(F.col("attempt") == 0, F.lit("Did it work? Answer Yes or No.")).otherwise(F.lit("Judge it."))
    return fx("responses").select(
        "uid", "model", "attempt", F.md5(P.alias_verdict(t).cast("binary")).alias("alias_md5"), P.alias_verdict(t, prompt).alias("v")
    ).withColumn("v", F.when(F.col("v").isin("Yes", "No", "Success", "Fail"), F.col("v")).otherwise(F.lit("other")))


@query("x4_json_answer")
def _(fx):
    r = fx("responses").select("uid", "model", "attempt", P.json_answer(P.scored_text("raw", "pred")).alias("j"))
    return r.select("uid", "model", "attempt", F.col("j.value").alias("label"), F.col("j.mode").alias("parse_mode"))


@query("x6_error_detection")
def _(fx):
    r = fx("responses")
    return r.groupBy("model", P.is_error("ok", "error", "raw").alias("is_error"), "ok").agg(
        F.count("*").alias("n"), F.sum(F.length(P.scored_text("raw", "pred"))).alias("n_chars")
    )


@query("x7_parse_mode_report")
def _(fx):
    return S.parse_mode_report(scored(fx))


# ---------------------------------------------------------------- A*


@query("a1_score_stats")
def _(fx):
    return S.score_stats(scored(fx), ["model"])


@query("a1_score_block")
def _(fx):
    """The score block with its parse modes and failures as ``name:count`` texts."""
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias(c)
    b = S.score_block(scored(fx), ["model", "task"])
    return b.select("model", "task", "n", "mean_score", "acc", "api_error_rate", "missing_rate", text("parse_modes"), text("failures"))


@query("a2_score_rollup")
def _(fx):
    sets = [["model"], ["model", "task"], ["model", "task", "env_task"]]
    return S.score_rollup(scored(fx), sets, ["overall", "task", "task_env"])


@query("a2_score_rollup_e")
def _(fx):
    e = scored(fx).filter("task = 'E'")
    dims = ["query_type", "horizon_bucket", "sampling_role", "env_task"]
    return S.score_rollup(e, [["model", d] for d in dims], dims)


@query("a2_macro_accuracy")
def _(fx):
    return S.macro_accuracy(scored(fx))


@query("a3_task_scores")
def _(fx):
    return scored(fx).select(*SCORE_COLS)


@query("a5_bucket_tables")
def _(fx):
    return S.bucket_table(scored_c(fx), C_DIMS)


@query("a6_difficulty_strategy")
def _(fx):
    s = S.lenient_scores(exam_a_gold(fx), fx("responses").filter(F.col("uid").startswith("A.")), MODELS)
    return S.lenient_table(s, ["difficulty_bucket", "distractor_strategy"])


@query("a7_failure_histogram")
def _(fx):
    return S.histogram(scored(fx), "failure", ["model", "task"])


@query("a7_version_histogram")
def _(fx):
    r = fx("responses").withColumn("schema_version", F.when(F.col("attempt") == 0, F.lit("response.v1")))
    return S.histogram(r, "schema_version", ["model"], default="legacy")


@query("a9_usable_accuracy")
def _(fx):
    # a two-letter exam: C and D of the four-letter one stand for A and B
    g = exam_a_gold(fx).withColumn("gold", F.translate("gold", "CD", "AB"))
    s = S.lenient_scores(g, fx("responses").filter(F.col("uid").startswith("A.")), MODELS, "AB")
    return S.usable_accuracy(s)


@query("a10_coverage")
def _(fx):
    return S.coverage(fx("gold_rows"), fx("responses"), MODELS)


@query("a11_scored_only_accuracy")
def _(fx):
    exam = fx("exam_c").select(
        "uid", "answer", F.when(F.col("framing") == "neu", F.lit("Yes or No?")).otherwise(F.lit("Judge.")).alias("prompt")
    )
    return S.alias_scores(exam, fx("responses"), MODELS)


@query("a12_les_t")
def _(fx):
    return M.temporal_ratio(scored_c(fx))


@query("a13_jcr_t")
def _(fx):
    return M.temporal_consistency(scored_c(fx), ["group_id", "variant", "visual"])


@query("a14_idr")
def _(fx):
    return M.intervention_rate(scored_c(fx), ["group_id", "temporal", "visual"])


@query("a15_jacc_neutral")
def _(fx):
    return M.neutral_accuracy(scored_c(fx))


@query("a16_degenerate")
def _(fx):
    return M.degenerate(scored(fx, "responses_degenerate").filter("task in ('C', 'D')"))


@query("a17_vcc")
def _(fx):
    return M.agreement(_c_pairs(fx))


@query("a18_mcnemar")
def _(fx):
    s = scored_c(fx).withColumn("hit", F.col("correct").cast("int"))
    pairs = J.pair_table(s, ["uid", "env_task"], "model", ["m0", "m1"], ["hit"])
    return M.paired_delta(pairs, "hit_m0", "hit_m1", ["env_task"])


@query("a19_model_comparison")
def _(fx):
    return S.comparison_table(scored(fx), "task", MODELS)


@query("a22_usage_rollup")
def _(fx):
    calls = fx("events").select(
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("ok"),
        (F.col("event_id") % 100).alias("prompt_tokens"),
        (F.col("event_id") % 7).alias("completion_tokens"),
    )
    return S.usage_rollup(calls, ["model"])


@query("a22_usage_sketches")
def _(fx):
    """Usage by day as mergeable parts, put together per model; the percentiles are held against the ranks in all calls."""
    calls = fx("events").select(
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"),
        F.to_date("ts").alias("day"),
        (F.col("value") * 1.7 + F.col("event_id") / 1e7).alias("latency_ms"),
        (F.col("event_type") != "error").alias("ok"),
        (F.col("event_id") % 100).alias("prompt_tokens"),
        (F.col("event_id") % 7).alias("completion_tokens"),
    )
    usage = S.usage_from_parts(S.usage_parts(calls, ["model"], "day"), ["model"])
    errors = S.rank_errors(calls, usage, ["model"])
    near = [(F.col(f"error_p{q}") <= 0.01).alias(f"p{q}_in_bound") for q in (50, 95)]
    return usage.join(errors, "model").select("model", "n_calls", "prompt_tokens", "completion_tokens", "total_tokens", "mean_latency", "max_latency", "ok_rate", *near)


@query("w15_failure_examples")
def _(fx):
    return S.failure_examples(scored(fx))


