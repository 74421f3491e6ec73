"""Response log with a manifest, and digests of files read in chunks."""

import hashlib
import resource

import pytest
from pyspark.sql import functions as F

from verdikt.sources import jsonl, lines, log

SCHEMA = "uid string, n long"


def rows(spark, path):
    return sorted((r.uid, r.n) for r in log.read_log(spark, path, SCHEMA).collect())


def frame(spark, *uids):
    return spark.createDataFrame([(u, len(u)) for u in uids], SCHEMA)


def test_a_retried_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    assert rows(spark, path) == []
    assert log.append_batch(frame(spark, "a", "bb"), path, "1") and log.append_batch(frame(spark, "c", "c"), path, "2")
    assert not log.append_batch(frame(spark, "a", "bb"), path, "1")
    assert rows(spark, path) == [("a", 1), ("bb", 2), ("c", 1), ("c", 1)]


def test_rows_without_a_commit_do_not_count(spark, tmp_path):
    path = str(tmp_path / "log")
    log._write(frame(spark, "lost").withColumn("_batch", F.lit("1")), path, "json")
    assert rows(spark, path) == []
    log.append_batch(frame(spark, "a"), path, "1")
    assert rows(spark, path) == [("a", 1)]


def test_of_two_commits_the_first_counts(spark, tmp_path):
    path = str(tmp_path / "log")
    for uid, at in (("late", "2024-01-02"), ("early", "2024-01-01")):
        folder = log._write(frame(spark, uid).withColumn("_batch", F.lit("1")), path, "json")
        entry = spark.range(1).select(F.lit("1").alias("batch"), F.lit(folder).alias("folder"), F.lit(0).alias("level"), F.lit(at).cast("timestamp").alias("at"))
        entry.write.mode("append").json(f"{path}/manifest")
    assert rows(spark, path) == [("early", 5)]


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_compaction(spark, tmp_path, fmt):
    path = str(tmp_path / "log")
    read = lambda: sorted(r.uid for r in log.read_log(spark, path, SCHEMA, fmt).collect())
    assert log.compact(spark, path, SCHEMA, 1, fmt) is None
    for k in range(4):
        log.append_batch(frame(spark, f"{k}a", f"{k}b").repartition(2), path, str(k), fmt)
    want = sorted(f"{k}{x}" for k in range(4) for x in "ab")
    folder = log.compact(spark, path, SCHEMA, 1, fmt)
    assert read() == want and len(list((tmp_path / "log" / "rows" / f"folder={folder}").glob(f"*.{fmt}"))) == 1
    assert not log.append_batch(frame(spark, "again"), path, "2", fmt)
    log.append_batch(frame(spark, "new"), path, "new", fmt)
    assert log.replaced(spark, path).count() == 4 == log.drop_replaced(spark, path)
    assert read() == sorted([*want, "new"])
    log.compact(spark, path, SCHEMA, 2, fmt)
    assert read() == sorted([*want, "new"]) and {r.level for r in log.committed(spark, path).collect()} == {2}


def test_compactions_that_overlap_double_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    log.append_batch(frame(spark, "a"), path, "1")
    older = log.committed(spark, path).collect()
    log.append_batch(frame(spark, "b"), path, "2")
    log.compact(spark, path, SCHEMA, 1)
    # another compaction that began before the second append and ends now
    folder = log._write(frame(spark, "a").withColumn("_batch", F.lit("1")), path, "json")
    late = spark.createDataFrame([(r.batch, folder, r.level + 1) for r in older], "batch string, folder string, level int")
    late.withColumn("at", F.current_timestamp()).write.mode("append").json(f"{path}/manifest")
    assert rows(spark, path) == [("a", 1), ("b", 1)]


def test_names_of_the_log(spark, tmp_path):
    with pytest.raises(ValueError, match="_batch"):
        log.append_batch(frame(spark, "a").withColumn("_batch", F.lit(1)), str(tmp_path / "log"), "1")


def test_digests(spark, tmp_path):
    (tmp_path / "empty.bin").touch()
    data = {"a b.bin": b"a", "x%20y.bin": b"abc" * 7, "é.bin": bytes(range(256)) * 50}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    out = {r.name: r for r in jsonl.file_inventory(spark, str(tmp_path), "*.bin", with_hash=True).collect()}
    assert {n: (r.length, r.hash) for n, r in out.items()} == {n: (len(c), hashlib.md5(c).hexdigest()) for n, c in data.items()}
    assert "hash" not in jsonl.file_inventory(spark, str(tmp_path)).columns


def test_digest_of_a_large_file_takes_chunks(tmp_path):
    file = tmp_path / "large.bin"
    with open(file, "wb") as f:
        f.truncate(3 << 30)  # a hole, so it takes no disk
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    digest = lines.file_digest(str(file))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kilobytes
    assert digest == "c698c87fb53058d493492b61f4c74189"


def test_rows_that_share_their_order_are_many_packed_files(fx):
    from pyspark.sql import functions as F

    from verdikt.plans.scenes import responses_b
    from verdikt.plans.sources import _log

    lines = fx.spark.read.text(_log(fx, responses_b(fx))).groupBy(F.input_file_name().alias("file")).count().collect()
    assert max(r["count"] for r in lines) < sum(r["count"] for r in lines) / 2
    assert all(r.file.endswith(".gz") for r in lines)


def test_a_torn_file_is_written_by_a_task_of_its_own(fx, monkeypatch):
    from pyspark.sql import DataFrameWriter, functions as F

    from verdikt.plans.sources import _torn

    seen = []
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path: seen.append(self._df))
    _torn(fx)
    files = seen[0].groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("model", "part").alias("n")).collect()
    assert len(files) > 4 and max(r.n for r in files) == 1


def test_order_column_travels_once(spark):
    from verdikt.operators.joins import first_per_key

    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "uid string, place int, v string")
    out = first_per_key(df, ["uid"], "place", keep_order=False)
    assert sorted(map(tuple, out.collect())) == [("a", "y", 2), ("b", "z", 1)]
