"""Truth tables for the answer readers and a scan-based check of the nearness rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from verdikt.functions import parse as P

GOOD, BAD = set(P.SUCCESS_WORDS), set(P.FAIL_WORDS)


def read(spark, fn, texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn("t").alias("r"))
    return [(r.r["value"], r.r["mode"]) for r in sorted(d.collect(), key=lambda r: r.i)]


def verdict_by_scan(text):
    """The rules again, over match positions of a plain scan."""
    t = (text or "").strip().lower()
    if t in GOOD:
        return "Success", "strict"
    if t in BAD:
        return "Fail", "strict"
    if any(n in t for n in P.NEGATED):
        return "Fail", "recoverable"
    found = [(m.start(), m.end(), m.group() in GOOD) for m in re.finditer(P.VERDICT_PATTERN.replace("(?U)", ""), t)]
    kinds = {g for _, _, g in found}
    if not found:
        return None, "fail"
    if len(kinds) == 1:
        return ("Success" if kinds == {True} else "Fail"), "recoverable"
    near = any(a[2] != b[2] and (abs(a[0] - b[0]) <= 15 or abs(a[1] - b[1]) <= 15) for a in found for b in found)
    return ("Success" if found[0][2] and not near else "Fail"), "recoverable"


@pytest.mark.parametrize(
    "text,want",
    [
        ("Success", ("Success", "strict")),
        ("  failed\n", ("Fail", "strict")),
        ("It was unsuccessful", ("Fail", "recoverable")),
        ("un-failing", ("Fail", "recoverable")),
        ("successfully failed", ("Fail", "recoverable")),
        ("yes, and a good while afterwards it did fail", ("Success", "recoverable")),
        ("fail came first but much much later success", ("Fail", "recoverable")),
        ("nothing here", (None, "fail")),
        ("", (None, "fail")),
        (None, (None, "fail")),
        ("é no ñ", ("Fail", "recoverable")),
        ("éno", (None, "fail")),
    ],
)
def test_verdict_table(spark, text, want):
    assert read(spark, P.verdict, [text]) == [want]


def test_verdict_random(spark):
    rng = random.Random(3)
    words = ["success", "fail", "no", "yes", "failed", "succeeded", "and", "the", "éa", "x" * 9, "\n", "-", "successfulx", "don't"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    assert read(spark, P.verdict, texts) == [verdict_by_scan(t) for t in texts]


def test_staged_reading_equals_expression(spark):
    texts = ["success", "The answer is B", '{"answer": "x"}', "no way it was a success, though much later", ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in P.read_answers(d, F.col("t")).select("t", "as_letter", "as_verdict", "as_json", P.verdict("t").alias("v"), P.letter_answer("t").alias("l"), P.json_answer("t").alias("j")).collect():
        assert (r.as_letter, r.as_verdict, r.as_json) == (r.l, r.v, r.j)


@pytest.mark.parametrize(
    "text,want",
    [("B", ("B", "strict")), (" d ", ("D", "strict")), ("a cat", ("A", "recoverable")), ("option (C).", ("C", "recoverable")), ("E", (None, "fail")), ("abc", (None, "fail"))],
)
def test_letter(spark, text, want):
    assert read(spark, P.letter_answer, [text]) == [want]


def test_letter_strict_only(spark):
    assert read(spark, lambda c: P.letter_answer(c, strict_only=True), ["a cat", "a"]) == [(None, "fail"), ("A", "strict")]


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"answer": " key "}', ("key", "strict")),
        ('```json\n```{"answer": "a"}```', ("a", "recoverable")),
        ('thinking\n{"answer": "b"}\ndone', ("b", "recoverable")),
        ('{"answer": ""}', (None, "fail")),
        ('{"other": 1}', (None, "fail")),
        ('{"answer": "a"} junk', (None, "fail")),
        ('{"answer": "a"} {"b": 1}', (None, "fail")),
        ('{"answer": "a"}, {"b": 1}', (None, "fail")),
        ("plain", (None, "fail")),
    ],
)
def test_json_answer(spark, text, want):
    assert read(spark, P.json_answer, [text]) == [want]


def test_find_json_object(spark):
    texts = ['{"a": 1}', '```\n{"a": 1}\n```', 'x {"a": [1, 2,], } y', "[1]", '{"a": ', "", '{"a": 1} {"b": 2}']
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [(r.j_value and r.j_value.a, r.j_mode, r.j_fence) for r in P.find_json_object(d, F.col("t"), "a: string").orderBy("i").collect()]
    bad = (None, "fail_json", False)
    assert got == [
        ("1", "strict", False), ("1", "recoverable", True), ("[1,2]", "recoverable", False), bad, bad, bad, bad,
    ]


def test_errors(spark):
    d = spark.createDataFrame([(True, None, "ok"), (False, None, "x"), (None, "boom", "x"), (None, None, "__ERR__: 5"), (None, None, None)], "ok boolean, error string, raw string")
    assert [r.e for r in d.select(P.is_error("ok", "error", "raw").alias("e")).collect()] == [False, True, True, True, False]
