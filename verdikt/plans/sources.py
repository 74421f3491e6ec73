"""Queries: the given tables written as JSON lines or logs and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import joins as J, scoring as S
from ..operators.gates import audit_report, contract_fields
from ..session import scratch_dir
from ..sources import jsonl as L, log, sinks
from .fixtures import MODELS, Fixtures
from .registry import query
from .scenes import exam_b, responses_b
from .scores import scored
from .steps import trajectories

TORN = "uid string, model string, attempt bigint, ingest_seq bigint, ok boolean, raw string"
RESPONSE = "uid string, model string, attempt bigint, ingest_seq bigint, raw string, pred string, ok boolean, error string"


def _sorted_files(df: DataFrame, *key: str) -> DataFrame:
    """Rows in files whose name order and line order follow a key; their number grows with the rows, a file stays as large.

    A key that many rows share needs more columns, else they are one file.
    """
    files = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // sinks.FILE_ROWS))
    return df.repartitionByRange(files, *key).sortWithinPartitions(*key)


def _log(fx: Fixtures, more: DataFrame | None = None, in_order: bool = True) -> str:
    """Shards of responses; ``in_order`` for readers that go by the order of files and lines, others go by ``ingest_seq``."""
    path = scratch_dir(fx.spark, "responses")
    rows = fx("responses") if more is None else fx("responses").unionByName(more)
    # all scenes have one ingest_seq, so the uid and the model complete the order
    sinks.write_jsonl(_sorted_files(rows, "ingest_seq", "uid", "model") if in_order else rows, path, compression="gzip")
    return path


@query("s1_read_jsonl")
def _(fx):
    d = L.read_jsonl(fx.spark, _log(fx), RESPONSE)
    return d.select("uid", "model", "attempt", "ok", "error", F.md5(F.col("raw").cast("binary")).alias("raw_md5"))


def _torn(fx: Fixtures, whole: bool = False) -> str:
    """Sixteen files per model; some lines are cut in the middle, unless all shall be whole."""
    r = fx("responses")
    line = F.to_json(F.struct("uid", "model", "attempt", "ingest_seq", "ok", "raw"))
    # ingest_seq is shared by the exams, so the uid completes the line order
    cut = F.lit(False) if whole else (F.col("ingest_seq") > 300) & (F.col("ingest_seq") % 97 == 5)
    text = r.select("model", (F.col("ingest_seq") % 16).alias("part"), "ingest_seq", "uid", F.when(cut, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("value"))
    path = scratch_dir(fx.spark, "torn")
    # each file is a task of its own, where hashes put several into one
    file = (F.array_position(F.lit(MODELS), F.col("model")) - 1) * 16 + F.col("part")
    dealt = text.repartitionById(16 * len(MODELS), file.cast("int")).sortWithinPartitions("model", "part", "ingest_seq", "uid")
    dealt.select("model", "part", "value").write.partitionBy("model", "part").text(path)
    return path


@query("s2_tolerant_drop")
def _(fx):
    d = L.read_jsonl_tolerant(fx.spark, _torn(fx), TORN, "drop")
    return d.select("uid", "model", "attempt", "ok", F.md5(F.col("raw").cast("binary")).alias("raw_md5"))


@query("s2_tolerant_prefix")
def _(fx):
    d = L.read_jsonl_tolerant(fx.spark, _torn(fx), TORN, "prefix")
    return d.select("uid", "model", "attempt", "ok", F.md5(F.col("raw").cast("binary")).alias("raw_md5"))


@query("s3_read_shards")
def _(fx):
    """First answer per uid and model by file and line order."""
    d = L.read_shards(fx.spark, _log(fx), RESPONSE)
    # the shards lie in one folder, so their names order them as their whole paths do
    place = F.struct(F.element_at(F.split("ingest.file", "/"), -1).alias("name"), "ingest.block", "ingest.line")
    f = J.first_per_key(d.select("uid", "model", "attempt", "ingest_seq", place.alias("place")), ["uid", "model"], "place", keep_order=False)
    return f.select("uid", "model", "attempt", "ingest_seq", "n_copies")


@query("a10_coverage_files")
def _(fx):
    """Coverage of the exam by a log in many files, with their number."""
    answers = L.read_shards(fx.spark, _torn(fx, whole=True), TORN)
    return S.coverage(fx("gold_rows"), answers.select("uid", "model", "ingest.file"), MODELS, "file")


def _exam_dir(fx: Fixtures) -> str:
    """Exam files of all tasks; some uids are repeated in older E files and in the C file."""
    root = scratch_dir(fx.spark, "exam")
    g = fx("gold_rows").drop("file_tag", "load_rank", "line_no", "task")
    by_task = {"A": "a", "C": "c", "D": "d", "E": "e"}
    names = {"A": "task_a_exam.jsonl", "C": "task_c_exam.jsonl", "D": "task_d_exam.jsonl", "E": "task_e_exam_v13.jsonl"}
    rows = fx("gold_rows")
    for task in by_task:
        part = rows.filter(F.col("task") == task)
        if task == "C":
            again = rows.filter("task = 'D' AND line_no % 40 = 0").withColumn("answer", F.lit("Fail"))
            part = part.unionByName(again)
        sinks.write_jsonl(part.select(*g.columns), f"{root}/{names[task]}", compression="gzip")
    sinks.write_jsonl(exam_b(fx), f"{root}/task_b_exam.jsonl", compression="gzip")
    old = rows.filter("task = 'E' AND line_no % 50 = 0").withColumn("answer", F.lit("old_label"))
    sinks.write_jsonl(old.select(*g.columns), f"{root}/task_e_exam_v1.jsonl", compression="gzip")
    return root


@query("s4_load_gold")
def _(fx):
    return L.load_gold(fx.spark, _exam_dir(fx)).select("uid", "task", "source_file", "env_task", "answer", "label", "query_type")


@query("s5_latest_run")
def _(fx):
    """Each judge's log is a run; what the newest one holds is read back."""
    root = scratch_dir(fx.spark, "runs")
    for run, model in (("run_1", "m0"), ("_requests", "m1"), ("run_2", "m2")):
        fx("responses").filter(F.col("model") == model).select("uid", "model", "raw").write.json(f"{root}/{run}")
    newest = L.latest_run(fx.spark, root, "*.json").first()
    rows = fx.spark.read.schema("uid string, model string, raw string").json(newest.path.rsplit("/", 1)[0])
    return rows.groupBy(F.lit(newest.run).alias("run"), "model").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("n_uids"), F.sum(F.length("raw")).alias("chars"))


@query("s6_read_trajectories")
def _(fx):
    root = scratch_dir(fx.spark, "triplets")
    t = trajectories(fx)
    rec = t.select(
        "env_task", "group_id", "variant", "mission", F.col("actions").cast("array<int>").alias("actions_id"), "frames", "success", "terminated", "truncated",
        F.col("reward").cast("double").alias("reward"), F.col("input_fields").alias("model_input_fields"),
        F.transform("states", lambda s: F.struct(F.struct(F.array(s["x"], s["y"]).alias("pos"), s["dir"].alias("dir")).alias("agent"))).alias("state_seq"),
        F.when(F.col("cf_goal").isNotNull(), F.struct(F.lit("move").alias("cf_mode"), F.array("cf_goal.gx", "cf_goal.gy").alias("goal_to"))).alias("cf_meta"),
    )
    rec.write.partitionBy("env_task").json(root)
    d = L.read_trajectories(fx.spark, root)
    return d.select(
        "group_id", "variant", F.split("env_task", "=").getItem(1).alias("env_task"), F.size("actions_id").alias("n_actions"), F.size("frames").alias("n_frames"),
        F.size("state_seq").alias("n_states"), "success", "reward", F.get(F.element_at("state_seq", -1)["agent"]["pos"], F.lit(0)).alias("last_x"),
        F.get("cf_meta.goal_to", F.lit(1)).alias("goal_y"),
    )


def _written(fx: Fixtures, fmt: str) -> DataFrame:
    path = scratch_dir(fx.spark, f"scored-{fmt}")
    s = scored(fx).select("uid", "model", "task", "env_task", "failure", "parse_mode", "correct", "score")
    sinks.write_scored(s, path, fmt)
    schema = "uid string, model string, env_task string, failure string, parse_mode string, correct boolean, score double, task string"
    r = fx.spark.read.schema(schema).option("header", "true").format(fmt).load(path)
    return r.select("uid", "model", "task", "env_task", "failure", "parse_mode", "correct", "score")


@query("s7_scored_parquet")
def _(fx):
    return _written(fx, "parquet")


@query("s7_scored_csv")
def _(fx):
    return _written(fx, "csv")


@query("s7_scored_json")
def _(fx):
    return _written(fx, "json")


@query("s8_response_log")
def _(fx):
    """Two batches; the second one is the resumed rest, so every uid and model is in the log once, also after a retry and compaction."""
    path = scratch_dir(fx.spark, "log")
    schema = "uid string, model string, ingest_seq bigint, ok boolean"
    r = S.dedupe(fx("responses").select("uid", "model", "ingest_seq", "ok"))
    log.append_batch(r.filter("ingest_seq % 3 = 0"), path, "first")
    rest = J.unanswered(r, log.read_log(fx.spark, path, schema), ["uid", "model"])
    log.append_batch(rest, path, "rest")
    log.append_batch(r, path, "rest")
    log.compact(fx.spark, path, schema, fx.spark.sparkContext.defaultParallelism)
    again = log.read_log(fx.spark, path, schema)
    return again.groupBy("model").agg(F.count("*").alias("n_lines"), F.count_distinct("uid").alias("n_uids"), F.sum("ingest_seq").alias("seq_sum"))


@query("s7_model_scores")
def _(fx):
    """The table of models and tasks, written beside the score rows and read back."""
    path = scratch_dir(fx.spark, "model-scores")
    S.score_rollup(scored(fx), [["model"], ["model", "task"]], ["overall", "task"]).write.json(path)
    schema = "level string, model string, task string, n bigint, mean_score double, acc double, api_error_rate double, missing_rate double"
    return fx.spark.read.schema(schema).json(path)


BUNDLE = 64


@query("s10_file_inventory")
def _(fx):
    """The documents as assets, bundles of a few texts in a file each, with size and hash."""
    path = scratch_dir(fx.spark, "assets")
    d = fx("documents").select(F.floor(F.col("doc_id") / BUNDLE).alias("bundle"), "doc_id", "text")
    d.repartition("bundle").sortWithinPartitions("bundle", "doc_id").select("bundle", "text").write.partitionBy("bundle").text(path)
    files = L.file_inventory(fx.spark, path, "*.txt", with_hash=True)
    return files.select(F.regexp_extract("path", "bundle=(\\d+)", 1).cast("bigint").alias("bundle"), "length", "hash")


@query("v3_contract_report")
def _(fx):
    return audit_report(contract_fields(trajectories(fx)), ["variant"])


@query("e1_score_exam")
def _(fx):
    """Exam files and response shards from disk to the score rollup."""
    from ..operators.dims import normalise_gold

    gold = normalise_gold(L.load_gold(fx.spark, _exam_dir(fx), columns=["env_task", "answer", "answer_json", "label"]))
    r = L.read_shards(fx.spark, _log(fx, responses_b(fx), in_order=False), RESPONSE).drop("ingest")
    s = S.score(gold.select("uid", "task", "env_task", "gold", "answer_json"), r, MODELS)
    return S.score_rollup(s, [["model"], ["model", "task"]], ["overall", "task"])
