"""Gold + responses → one score row per uid and model, and the tables made from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parse as P
from ..functions.text import n_where, ratio, share
from . import scenes as C
from .joins import answers_left_join, each_model, first_per_key, gold_left_join, last_per_key, picked_left_join, spread_join

# Failure codes, by task, in order of precedence after missing and error.
UNPARSED = {"A": "A_no_letter", "C": "C_no_label", "D": "D_no_label", "E": "E_parse_error"}
MISSING_GOLD = {t: f"{t}_missing_gold" for t in "ACDE"}
WRONG = {t: f"{t}_wrong" for t in "ACDE"}
SCENE_UNPARSED, SCENE_MISSING_GOLD = "B_json_parse_error", "B_missing_gold"
COMPONENTS = ["agent_pos", "agent_dir", "carrying", "front_cell", "objects_jaccard"]


def parse_responses(responses: DataFrame, prefer: str = "raw", error_prefix: str = P.ERROR_PREFIX, scenes: bool = False) -> DataFrame:
    """Replace the answer text by its readings as letter, verdict and JSON label, and with ``scenes`` as scene.

    The task is only known after the join with gold.  Reading the text in all three ways first costs some
    CPU but keeps whole answer texts out of every shuffle that follows.
    """
    text = P.scored_text("raw", "pred", prefer)
    flagged = responses.withColumn("is_error", P.is_error("ok", "error", "raw", error_prefix))
    if scenes:
        flagged = C.read_scene(flagged, text)
    return P.read_answers(flagged, text).drop("raw", "pred", "error", "ok")


#: Tasks by the reading that they need; scenes (task B) are read by ``scenes.read_scene``.
READINGS = {"letter": ["A"], "verdict": ["C", "D"], "json": ["E"]}


def unread(responses: DataFrame, prefer: str = "raw", error_prefix: str = P.ERROR_PREFIX) -> DataFrame:
    """Responses with the one text that is judged (``_answer``) and ``is_error``, as the join with gold needs them."""
    flagged = responses.withColumns({"is_error": P.is_error("ok", "error", "raw", error_prefix), "_answer": P.scored_text("raw", "pred", prefer)})
    return flagged.drop("raw", "pred", "error", "ok")


def read_by_task(joined: DataFrame, scenes: bool = False) -> DataFrame:
    """Replace ``_answer`` by its reading for the row's task (``_read``), and with ``scenes`` by the scene of rows of task B.

    Other readings see an empty text, so a text is read once, the way its task asks for.  The reading comes out of a list of
    one, behind which Spark does not repeat it for a filter on what is made of it.
    """
    for_tasks = lambda tasks: F.when(F.col("task").isin(*tasks), F.col("_answer"))
    out = joined
    for kind, tasks in READINGS.items():
        out = P.read_answers(out, for_tasks(tasks), [kind])
    if scenes:
        out = C.read_scene(out, for_tasks(["B"]))
    reading = F.lit(None).cast(out.schema["as_letter"].dataType)
    for kind, tasks in READINGS.items():
        reading = F.when(F.col("task").isin(*tasks), F.col(f"as_{kind}")).otherwise(reading)
    return out.withColumn("_read", F.explode(F.array(reading))).drop("_answer", *[f"as_{k}" for k in READINGS])


def dedupe(parsed: DataFrame, keep: str = "first") -> DataFrame:
    pick = first_per_key if keep == "first" else last_per_key
    return pick(parsed, ["uid", "model"], "ingest_seq")


def _by_task(col: str, mapping: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(F.col(col) == k, F.lit(v)).otherwise(out)
    return out


def gold_scenes(gold: DataFrame) -> DataFrame:
    """The scene of ``answer_json`` as g_* columns."""
    read = C.read_scene(gold, F.col("answer_json"))
    return read.withColumnsRenamed({c: "g" + c[1:] for c in C.READ_COLUMNS})


def score(
    gold: DataFrame,
    responses: DataFrame,
    models: Sequence[str],
    keep: str = "first",
    prefer: str = "raw",
    error_prefix: str = P.ERROR_PREFIX,
    weights: Mapping[str, float] = C.WEIGHTS,
    pass_mark: float = C.PASS_MARK,
) -> DataFrame:
    """Score rows of all tasks.

    ``gold`` carries uid, task and the normalised ``gold`` answer, and for scenes (task B) ``answer_json``.  A row
    fails for the first of: no response, failed call, unreadable answer, no gold answer, wrong answer.  Scenes get a
    weighted score and their components.  An answer travels as its text, which is smaller than its readings and packs
    better, and is read after the join, where the task is known and copies and foreign uids are gone.  Where there are scenes,
    whose reading costs most, an answer that several models gave to a uid is read and scored once.
    """
    answers = unread(responses, prefer, error_prefix)
    if "answer_json" not in gold.columns:
        return grade(read_by_task(picked_left_join(gold, answers, models, "ingest_seq", keep)))
    read = read_by_task(answers_left_join(gold_scenes(gold).drop("answer_json"), answers, models, "ingest_seq", "_answer", keep), scenes=True)
    scored = C.score_scenes(read, weights, pass_mark).withColumnsRenamed({"score": "_b_score", "correct": "_b_correct", "failure": "_b_failure"})
    return grade(each_model(scored))


def grade(joined: DataFrame) -> DataFrame:
    """Failure code, score and normalised answer from ``answered``, ``is_error``, ``_read`` and ``gold``.

    Rows of task B need the columns of ``score_scenes``; without them the task is unknown.
    """
    pred = F.col("_read.value")
    scenes = "_b_score" in joined.columns
    is_scene = F.coalesce(F.col("task") == "B", F.lit(False)) if scenes else F.lit(False)
    known = F.coalesce(F.col("task").isin(*UNPARSED), F.lit(False)) | is_scene
    failure = (
        F.when(~F.col("answered"), F.lit("missing_response"))
        .when(F.col("is_error"), F.lit("api_error"))
        .when(~known, F.lit("unknown_task"))
    )
    if scenes:
        no_gold = ~F.coalesce(F.col("g_mode").isin("strict", "recoverable"), F.lit(False))
        scene_failure = (
            F.when(F.col("_b_failure") == SCENE_UNPARSED, F.col("_b_failure")).when(no_gold, F.lit(SCENE_MISSING_GOLD)).otherwise(F.col("_b_failure"))
        )
        failure = failure.when(is_scene, scene_failure)
    failure = (
        failure.when(pred.isNull(), _by_task("task", UNPARSED))
        .when(F.col("gold").isNull(), _by_task("task", MISSING_GOLD))
        .when(pred != F.col("gold"), _by_task("task", WRONG))
    )
    usable = F.col("answered") & ~F.coalesce(F.col("is_error"), F.lit(False)) & known
    readable = usable & pred.isNotNull() & F.col("gold").isNotNull()
    mode, correct, points = F.col("_read.mode"), F.col("failure").isNull(), F.when(F.col("failure").isNull(), 1.0).otherwise(0.0)
    extra = {}
    if scenes:
        judged = is_scene & usable & ~F.coalesce(F.col("failure").isin(SCENE_UNPARSED, SCENE_MISSING_GOLD), F.lit(False))
        mode = F.when(is_scene, F.col("p_mode")).otherwise(mode)
        correct = F.when(is_scene, judged & F.col("_b_correct")).otherwise(correct)
        points = F.when(is_scene, F.when(judged, F.col("_b_score")).otherwise(0.0)).otherwise(points)
        extra = {
            "b_components": F.when(judged, F.struct(*COMPONENTS, F.size("g_keys").alias("n_gold_objects"), F.size("p_keys").alias("n_pred_objects"))),
            "failure_tags": F.when(judged, F.col("failure_tags")),
        }
    drop = ["as_letter", "as_verdict", "as_json", "_read", "n_copies", "attempt", "answer", "label", "answer_json", "_b_score", "_b_correct", "_b_failure"]
    drop += [*COMPONENTS, *C.READ_COLUMNS, *("g" + c[1:] for c in C.READ_COLUMNS)] if scenes else []
    return (
        joined.withColumn("failure", failure)
        .withColumns(
            {
                "parse_mode": F.when(usable, mode).otherwise(F.lit("fail")),
                "verdict": F.when(usable & ~is_scene, pred),
                "pred_norm": F.when(readable & ~is_scene, pred),
                "correct": correct,
                "score": points,
                **extra,
            }
        )
        .drop(*[c for c in drop if c in joined.columns])
    )


# ---------------------------------------------------------------- summaries


def stat_columns() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(share(F.col("correct")), 6).alias("acc"),
        F.round(share(F.col("failure") == "api_error"), 6).alias("api_error_rate"),
        F.round(share(F.col("failure") == "missing_response"), 6).alias("missing_rate"),
    ]


def score_stats(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean score, accuracy and error rates per key; without keys one row, also over no rows."""
    out = scored.groupBy(*keys).agg(*stat_columns())
    return out if keys else out.na.fill(0.0)


def score_rollup(scored: DataFrame, sets: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """The same statistics for several breakdowns in one pass (grouping sets), labelled by ``level``."""
    dims = list(dict.fromkeys(d for s in sets for d in s))
    ids = [sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s) for s in sets]
    out = scored.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("_gid"), *stat_columns()
    )
    level = F.lit(None).cast("string")
    for i, name in zip(ids, names):
        level = F.when(F.col("_gid") == i, F.lit(name)).otherwise(level)
    return out.select(level.alias("level"), *dims, "n", "mean_score", "acc", "api_error_rate", "missing_rate")


def macro_accuracy(scored: DataFrame) -> DataFrame:
    """Per model: accuracy over all rows (micro) and mean of the task accuracies (macro)."""
    per_task = scored.groupBy("model", "task").agg(F.count("*").alias("n"), n_where(F.col("correct")).alias("c"))
    return per_task.groupBy("model").agg(
        F.round(ratio(F.sum("c"), F.sum("n")), 6).alias("micro_acc"), F.round(F.avg(ratio(F.col("c"), F.col("n"))), 6).alias("macro_acc")
    )


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), default: str | None = None) -> DataFrame:
    """Counts per value as rows; ``default`` names rows without one, else they are left out."""
    v = F.coalesce(F.col(value), F.lit(default)) if default is not None else F.col(value)
    out = df.withColumn(value, v)
    if default is None:
        out = out.filter(F.col(value).isNotNull())
    return out.groupBy(*keys, value).agg(F.count("*").alias("n"))


def with_share(counts: DataFrame, keys: Sequence[str], total: str = "n") -> DataFrame:
    """Share of each count in its keys' total.  The input is already one row per cell."""
    sums = counts.groupBy(*keys).agg(F.sum(total).alias("_sum"))
    return counts.join(sums, list(keys)).withColumn("share", F.round(ratio(F.col(total), F.col("_sum")), 6)).drop("_sum")


def parse_mode_report(scored: DataFrame, keys: Sequence[str] = ("model", "task")) -> DataFrame:
    return with_share(histogram(scored, "parse_mode", keys), keys)


def bucket_table(scored: DataFrame, dims: Sequence[str], keys: Sequence[str] = ("model",)) -> DataFrame:
    """n, correct, unknown and accuracy for each value of each dimension, all dimensions in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    return (
        scored.select(*keys, "correct", "verdict", pairs.alias("_p"))
        .select(*keys, "correct", "verdict", "_p.*")
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "dim", "value")
        .agg(
            F.count("*").alias("n"),
            n_where(F.col("correct")).alias("n_correct"),
            n_where(F.col("verdict").isNull()).alias("n_unknown"),
            F.round(share(F.col("correct")), 6).alias("acc"),
        )
    )


def lenient_scores(
    gold: DataFrame, responses: DataFrame, models: Sequence[str], letters: str = "ABCD", error_prefix: str = P.ERROR_PREFIX
) -> DataFrame:
    """Letter scores where failed calls are parsed as well and may count as correct."""
    parsed = responses.select(
        "uid",
        "model",
        "ingest_seq",
        P.is_error("ok", F.lit(None), "raw", error_prefix).alias("is_error"),
        P.letter_answer(P.scored_text("raw", "pred", "pred"), letters).alias("_read"),
    )
    j = gold_left_join(gold, dedupe(parsed), models)
    return j.withColumns(
        {
            "pred_norm": F.col("_read.value"),
            "parse_mode": F.coalesce(F.col("_read.mode"), F.lit("missing")),
            "correct": F.coalesce(F.col("_read.value") == F.col("gold"), F.lit(False)),
            "is_error": F.coalesce("is_error", F.lit(False)),
        }
    ).drop("_read")


def lenient_table(scores: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts and rates per dimension value over ``lenient_scores`` rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    return (
        scores.select("model", "correct", "is_error", "parse_mode", "answered", pairs.alias("_p"))
        .select("model", "correct", "is_error", "parse_mode", "answered", "_p.*")
        .groupBy("model", "dim", "value")
        .agg(
            F.count("*").alias("n"),
            n_where(F.col("correct")).alias("n_correct"),
            F.round(share(F.col("correct")), 6).alias("acc"),
            F.round(share(F.col("is_error")), 6).alias("api_error_rate"),
            F.round(share(F.col("parse_mode") == "strict"), 6).alias("strict_rate"),
            F.round(share(F.col("parse_mode") == "recoverable"), 6).alias("recoverable_rate"),
            n_where(F.col("answered") & (F.col("parse_mode") == "fail")).alias("n_parse_fail"),
            n_where(~F.col("answered")).alias("n_missing"),
        )
    )


def usable_accuracy(scores: DataFrame, classes: Sequence[str] = ("A", "B")) -> DataFrame:
    """Accuracy over all, answered and usable rows, and the majority-class baseline (a tie goes to the last class)."""
    answered = n_where(F.col("answered"))
    usable = answered - n_where(F.col("is_error"))
    hits = n_where(F.col("correct"))
    counts = [n_where(F.col("gold") == c) for c in classes]
    major = F.lit(classes[-1])
    for i in reversed(range(len(classes) - 1)):
        wins = counts[i] > F.greatest(*counts[i + 1 :]) if len(counts) - i > 2 else counts[i] > counts[i + 1]
        major = F.when(wins, F.lit(classes[i])).otherwise(major)
    return scores.groupBy("model").agg(
        F.count("*").alias("n"),
        hits.alias("n_correct"),
        answered.alias("n_answered"),
        usable.alias("n_usable"),
        F.round(ratio(hits, F.count("*")), 6).alias("accuracy"),
        F.round(ratio(hits, answered), 6).alias("accuracy_answered"),
        F.round(ratio(hits, usable), 6).alias("accuracy_usable"),
        major.alias("majority_class"),
        F.round(ratio(F.greatest(*counts), F.count("*")), 6).alias("majority_baseline"),
    )


def coverage(gold: DataFrame, responses: DataFrame, models: Sequence[str], file: str | Column | None = None) -> DataFrame:
    """Per model: gold, response lines, distinct uids, scored, missing, extra and duplicate counts.

    With ``file``, the file that a response was read from, also the number of files that have lines of the model.
    """
    if file is not None:
        at = F.col(file) if isinstance(file, str) else file
        files = responses.select("model", at.alias("_file")).distinct().groupBy("model").agg(F.count("_file").alias("n_files"))
        return coverage(gold, responses, models).join(files, "model", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    per_uid = responses.groupBy("uid", "model").agg(F.count("*").alias("_lines"))
    expected = gold.select("uid").withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).withColumn("_g", F.lit(1))
    both = expected.join(per_uid, ["uid", "model"], "full")
    return both.groupBy("model").agg(
        n_where(F.col("_g").isNotNull()).alias("n_gold"),
        F.coalesce(F.sum("_lines"), F.lit(0)).alias("total_lines"),
        n_where(F.col("_lines").isNotNull()).alias("n_resp"),
        n_where(F.col("_g").isNotNull() & F.col("_lines").isNotNull()).alias("n_scored"),
        n_where(F.col("_lines").isNull()).alias("n_missing"),
        n_where(F.col("_g").isNull()).alias("n_extra"),
        F.coalesce(F.sum(F.col("_lines") - 1), F.lit(0)).alias("duplicates_dropped"),
    )


def alias_scores(exam: DataFrame, responses: DataFrame, models: Sequence[str]) -> DataFrame:
    """Accuracy over scored rows only (missing ones left out), with the last response of a uid."""
    text = P.scored_text("raw", "pred", "pred")
    parsed = responses.select("uid", "model", "ingest_seq", text.alias("_text"))
    # the prompt decides the label set, so the text is read per set before the join
    parsed = parsed.withColumns(
        {"_alias": P.alias_verdict("_text"), "_yes": P.alias_verdict("_text", F.lit("yes or no"))}
    ).drop("_text")
    j = gold_left_join(exam, dedupe(parsed, "last"), models)
    yes_no = F.contains(F.lower(F.coalesce(F.col("prompt"), F.lit(""))), F.lit("yes or no"))
    gold = F.coalesce(F.col("answer"), F.lit("Success"))
    hit = F.when(
        yes_no, F.col("_yes") == F.when(gold == "Success", F.lit("Yes")).otherwise(F.lit("No"))
    ).otherwise(F.col("_alias") == gold)
    n_ok, n_scored = n_where(F.col("answered") & hit), n_where(F.col("answered"))
    return j.groupBy("model").agg(
        F.count("*").alias("n_exam"),
        n_scored.alias("n_scored"),
        n_where(~F.col("answered")).alias("n_missing"),
        n_ok.alias("n_correct"),
        F.round(F.coalesce(ratio(n_ok, n_scored), F.lit(0.0)), 6).alias("accuracy"),
        n_where(F.col("answered") & ~F.col("_alias").isin("Success", "Fail")).alias("parse_failures"),
    )


def comparison_table(scored: DataFrame, line: str, models: Sequence[str]) -> DataFrame:
    """Accuracy of each line (task, family …) with one column per model."""
    return scored.groupBy(line).agg(
        *[F.round(F.avg(F.when(F.col("model") == m, F.col("correct").cast("double"))), 6).alias(f"acc_{m}") for m in models]
    )


def failure_examples(scored: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` uids per failure code; the rank limit is applied before the shuffle as well."""
    from pyspark.sql import Window

    w = Window.partitionBy("failure").orderBy("uid", "model")
    return (
        scored.filter(F.col("failure").isNotNull())
        .select("failure", "uid", "model", "task", F.row_number().over(w).alias("rank"))
        .filter(F.col("rank") <= n)
    )


def enriched_export(gold: DataFrame, scored: DataFrame) -> DataFrame:
    """Score rows of answered uids with their exam columns; ``gold_label`` is not filled."""
    keep = [c for c in ("uid", "model", "failure", "parse_mode", "pred_norm", "correct", "score") if c in scored.columns]
    return gold.join(scored.filter(F.col("answered")).select(*keep), "uid").withColumn(
        "gold_label", F.lit(None).cast("string")
    )


def usage_rollup(calls: DataFrame, keys: Sequence[str], percentiles: Sequence[int] = (50, 95)) -> DataFrame:
    """Calls, tokens, latency with exact percentiles, and success rate per key.

    A percentile counts the different latencies of a key, so latencies in milliseconds keep it small.
    """
    return calls.groupBy(*keys).agg(
        F.count("*").alias("n_calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency"),
        F.max("latency_ms").alias("max_latency"),
        *[F.round(F.percentile("latency_ms", p / 100), 6).alias(f"latency_p{p}") for p in percentiles],
        F.round(share(F.col("ok")), 6).alias("ok_rate"),
    )


#: Size of a latency sketch; its rank error is below one hundredth.
SKETCH_K = 512


def usage_parts(calls: DataFrame, keys: Sequence[str], part: str, k: int = SKETCH_K) -> DataFrame:
    """Mergeable usage of each key and part (say, a day): sums, maximum and a KLL sketch of the latencies.

    A row has bounded size however many different latencies it stands for, so parts can be stored and later days added
    without reading the calls again.  Calls without latency, or with NaN, count as calls and are not in the sketch.
    """
    lat = F.col("latency_ms").cast("double")
    lat = F.when(~F.isnan(lat), lat)
    return calls.groupBy(*keys, part).agg(
        F.count("*").alias("n_calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.count(lat).alias("n_latency"),
        F.sum(lat).alias("sum_latency"),
        F.max(lat).alias("max_latency"),
        n_where(F.col("ok")).alias("n_ok"),
        F.kll_sketch_agg_double(lat, F.lit(k)).alias("latency_sketch"),
    )


def usage_from_parts(parts: DataFrame, keys: Sequence[str], percentiles: Sequence[int] = (50, 95)) -> DataFrame:
    """The usage table over all parts of a key; percentiles come from the merged sketches, null without a latency."""
    # an empty sketch has no quantile, so only sketches with values are merged
    sketch = F.kll_merge_agg_double(F.when(F.col("n_latency") > 0, F.col("latency_sketch")))
    g = parts.groupBy(*keys).agg(
        F.sum("n_calls").alias("n_calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("n_latency").alias("_n"),
        F.sum("sum_latency").alias("_sum"),
        F.max("max_latency").alias("max_latency"),
        F.sum("n_ok").alias("_ok"),
        sketch.alias("_sketch"),
    )
    return g.select(
        *keys,
        "n_calls",
        "prompt_tokens",
        "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.round(ratio(F.col("_sum"), F.col("_n")), 6).alias("mean_latency"),
        "max_latency",
        *[F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(q / 100))).alias(f"latency_p{q}") for q in percentiles],
        F.round(ratio(F.col("_ok"), F.col("n_calls")), 6).alias("ok_rate"),
    )


def rank_errors(calls: DataFrame, usage: DataFrame, keys: Sequence[str], percentiles: Sequence[int] = (50, 95)) -> DataFrame:
    """How far the rank of each percentile in ``usage`` is from the rank asked for, over all calls, as ``error_p…``.

    A value that occurs many times has a range of ranks; inside it the error is 0.
    """
    names = [f"latency_p{q}" for q in percentiles]
    lat = F.when(~F.isnan(F.col("latency_ms").cast("double")), F.col("latency_ms").cast("double"))
    d = spread_join(calls.select(*keys, lat.alias("_lat")), usage.select(*keys, *names), keys, F.col("_lat"))
    g = d.groupBy(*keys).agg(
        F.count("_lat").alias("_n"),
        *[n_where(F.col("_lat") < F.col(c)).alias(f"_below_{c}") for c in names],
        *[n_where(F.col("_lat") <= F.col(c)).alias(f"_upto_{c}") for c in names],
    )
    rank = lambda c: ratio(F.col(c), F.col("_n"))
    error = lambda q: F.greatest(rank(f"_below_latency_p{q}") - q / 100, q / 100 - rank(f"_upto_latency_p{q}"), F.lit(0.0))
    return g.select(*keys, *[error(q).alias(f"error_p{q}") for q in percentiles])


def score_block(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The score statistics with counts of parse modes and failures as maps; without keys one row, also over no rows.

    Rows without parse mode count as "fail", rows without failure are in no failure count.  Rows are first counted per mode
    and failure, of which there are a few, so the lists put together here are short.
    """
    mode = F.coalesce(F.col("parse_mode"), F.lit("fail")).alias("_mode")
    cells = scored.withColumn("_failure", F.col("failure")).groupBy(*keys, mode, "_failure").agg(
        F.count("*").alias("_n"), F.sum("score").alias("_score"), F.count("score").alias("_scored"), n_where(F.col("correct")).alias("_hits")
    )
    g = cells.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.round(ratio(F.sum("_score"), F.sum("_scored")), 6).alias("mean_score"),
        F.round(ratio(F.sum("_hits"), F.sum("_n")), 6).alias("acc"),
        F.round(ratio(F.sum(F.when(F.col("_failure") == "api_error", F.col("_n")).otherwise(0)), F.sum("_n")), 6).alias("api_error_rate"),
        F.round(ratio(F.sum(F.when(F.col("_failure") == "missing_response", F.col("_n")).otherwise(0)), F.sum("_n")), 6).alias("missing_rate"),
        F.collect_list(F.struct(F.col("_mode").alias("k"), F.col("_n").alias("n"))).alias("_modes"),
        F.collect_list(F.when(F.col("_failure").isNotNull(), F.struct(F.col("_failure").alias("k"), F.col("_n").alias("n")))).alias("_failures"),
    )
    out = g.withColumns({"parse_modes": _counts(F.col("_modes")), "failures": _counts(F.col("_failures"))}).drop("_modes", "_failures")
    return out if keys else out.na.fill(0.0)


def _counts(pairs: Column) -> Column:
    """Sums per name of (k, n) pairs, as a map in the order of names."""
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    total = lambda k: F.aggregate(F.filter(pairs, lambda p: p["k"] == k), F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    return F.map_from_arrays(names, F.transform(names, total))
