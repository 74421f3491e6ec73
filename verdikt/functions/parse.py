"""Answer parsing as column expressions: free text in, ``struct(value, mode)`` out.

Nothing here needs Python on the executors.  A response is parsed where it is read, so only the short
label and mode travel through later shuffles, never the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .text import Col, col, nonblank, strip

# Word lists, prefixes and the nearness limit that decide a verdict.  The pattern looks at the first letter of a word
# before it looks for an edge, which costs less at the many places where no word begins.
SUCCESS_WORDS = ["succeed", "succeeded", "success", "successful", "successfully", "yes"]
FAIL_WORDS = ["fail", "failed", "failure", "no"]
NEGATED = ["unsuccess", "un-fail", "unfail"]
VERDICT_PATTERN = r"(?U)(?=[sfyn])\b(succeed(?:ed)?|success(?:ful(?:ly)?)?|fail(?:ed|ure)?|yes|no)\b"
NEAR_CHARS = 15
ALIAS_SUCCESS = ["success", "yes", "true", "succeed"]
ALIAS_FAIL = ["fail", "no", "false", "failed", "failure"]
GOLD_SUCCESS = ["success", "succeed", "succeeded"]
GOLD_FAIL = ["fail", "failure", "failed"]
ERROR_PREFIX = "__ERR__:"


def _parsed(value: Column, mode: Column) -> Column:
    return F.struct(value.alias("value"), mode.alias("mode"))


def letter_answer(text: Col, letters: str = "ABCD", strict_only: bool = False, stripped: bool = False) -> Column:
    """A choice letter: alone is strict, the first free-standing one in a text is recoverable."""
    t = col(text) if stripped else strip(F.coalesce(col(text), F.lit("")))
    alone = t.rlike(f"(?i)^[{letters}]$")
    found = F.upper(F.regexp_extract(t, rf"(?iU)(?=[{letters}])\b([{letters}])\b", 1))
    if strict_only:
        return _parsed(F.when(alone, F.upper(t)), F.when(alone, F.lit("strict")).otherwise(F.lit("fail")))
    return _parsed(
        F.when(alone, F.upper(t)).when(found != "", found),
        F.when(alone, F.lit("strict")).when(found != "", F.lit("recoverable")).otherwise(F.lit("fail")),
    )


def _near_opposites(text: Column, words: Column) -> Column:
    """True if a success and a fail word start or end within NEAR_CHARS of each other.

    Word positions come from the lengths of the pieces between the words.  The words are in text order,
    so the closest opposite pair is a pair of neighbours and one pass is enough.
    """
    pieces = F.split(text, VERDICT_PATTERN, -1)
    marks = F.transform(
        words,
        lambda w, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), w.alias("word")),
    )

    def step(acc: Column, m: Column) -> Column:
        start = acc["pos"] + m["gap"]
        end = start + F.length(m["word"])
        good = m["word"].isin(SUCCESS_WORDS)
        opposite = acc["good"].isNotNull() & (acc["good"] != good)
        near = (start - acc["start"] <= NEAR_CHARS) | (end - acc["pos"] <= NEAR_CHARS)
        return F.struct(
            end.alias("pos"), start.alias("start"), good.alias("good"), (acc["hit"] | (opposite & near)).alias("hit")
        )

    zero = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("start"), F.lit(None).cast("boolean").alias("good"), F.lit(False).alias("hit")
    )
    return F.aggregate(marks, zero, step, lambda acc: acc["hit"])


def _verdict(t: Column, words: Column) -> Column:
    """Success/Fail reading of a stripped lower-case text and its verdict words."""
    has_good = F.exists(words, lambda w: w.isin(SUCCESS_WORDS))
    has_bad = F.exists(words, lambda w: w.isin(FAIL_WORDS))
    first_good = F.get(words, F.lit(0)).isin(SUCCESS_WORDS)
    negated = F.lit(False)
    for n in NEGATED:
        negated = negated | F.contains(t, F.lit(n))
    value = (
        F.when(t.isin(SUCCESS_WORDS), F.lit("Success"))
        .when(t.isin(FAIL_WORDS), F.lit("Fail"))
        .when(negated, F.lit("Fail"))
        .when(F.size(words) == 0, F.lit(None))
        .when(~has_bad, F.lit("Success"))
        .when(~has_good, F.lit("Fail"))
        .when(first_good & ~_near_opposites(t, words), F.lit("Success"))
        .otherwise(F.lit("Fail"))
    )
    mode = (
        F.when(t.isin(SUCCESS_WORDS + FAIL_WORDS), F.lit("strict"))
        .when(negated | (F.size(words) > 0), F.lit("recoverable"))
        .otherwise(F.lit("fail"))
    )
    return _parsed(value, mode)


def _words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(VERDICT_PATTERN), F.lit(1))


def verdict(text: Col) -> Column:
    """Success/Fail reading of a free text as one expression; ``read_answers`` shares its parts."""
    t = F.lower(strip(F.coalesce(col(text), F.lit(""))))
    return _verdict(t, _words(t))


def read_answers(df: DataFrame, text: Column, kinds: Sequence[str] = ("letter", "verdict", "json")) -> DataFrame:
    """Add the readings ``as_letter``, ``as_verdict`` and ``as_json`` of a text.

    The stripped text, its verdict words and its JSON labels are columns of their own, so each is worked out once per row.
    """
    out = df.withColumn("_text", strip(F.coalesce(text, F.lit(""))))
    if "verdict" in kinds:
        out = out.withColumn("_low", F.lower("_text")).withColumn("_words", _words(F.col("_low")))
    if "json" in kinds:
        out = out.withColumn("_whole", _answer_field(F.col("_text"))).withColumn("_label", F.coalesce("_whole", _part_answer(F.col("_text"))))
    made = {
        "letter": lambda: letter_answer("_text", stripped=True),
        "verdict": lambda: _verdict(F.col("_low"), F.col("_words")),
        "json": lambda: _json_answer(F.col("_whole"), F.col("_label")),
    }
    return out.withColumns({f"as_{k}": made[k]() for k in kinds}).drop("_text", "_low", "_words", "_whole", "_label")


def alias_verdict(text: Col, prompt: Col | None = None) -> Column:
    """Whole-text alias map; other texts stay as they are.  A yes/no prompt turns the result into Yes/No."""
    t = strip(F.lower(F.coalesce(col(text), F.lit(""))))
    v = F.when(t.isin(ALIAS_SUCCESS), F.lit("Success")).when(t.isin(ALIAS_FAIL), F.lit("Fail")).otherwise(t)
    if prompt is None:
        return v
    asks_yes_no = F.contains(F.lower(F.coalesce(col(prompt), F.lit(""))), F.lit("yes or no"))
    return F.when(asks_yes_no, F.when(v == "Success", F.lit("Yes")).otherwise(F.lit("No"))).otherwise(v)


def json_listed(t: Column, kind: str) -> Column:
    """The values of a text that is JSON objects, separated by commas, and nothing else; else null.

    Spark's JSON functions overlook what follows a complete value; as the only element of a list, the text has no
    room for more.  Single quotes and raw control characters are refused, as a strict parser does.
    """
    listed = F.from_json(F.concat(F.lit("["), t, F.lit("]")), f"array<{kind}>", {"allowSingleQuotes": "false"})
    return F.when(t.startswith("{") & t.endswith("}"), listed)


def json_fields(t: Column) -> Column:
    """Fields of a text that is one JSON object and nothing else, as a map of texts; else null."""
    listed = json_listed(t, "map<string,string>")
    return F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))


def _answer_field(t: Column) -> Column:
    """``answer`` of a text that is one JSON object, else null; of repeated fields the last one counts."""
    entries = F.filter(F.map_entries(json_fields(t)), lambda e: e["key"] == "answer")
    return nonblank(F.try_element_at(F.transform(entries, lambda e: e["value"]), F.lit(-1)))


def json_answer(text: Col, stripped: bool = False) -> Column:
    """Label in ``{"answer": …}``: the whole text is strict, a fenced part or a single line recoverable."""
    t = col(text) if stripped else strip(F.coalesce(col(text), F.lit("")))
    whole = _answer_field(t)
    return _json_answer(whole, F.coalesce(whole, _part_answer(t)))


def _part_answer(t: Column) -> Column:
    """The label in a fenced part of a stripped text, else in one of its lines."""

    def first_of(parts: Column) -> Column:
        return F.get(F.filter(F.transform(parts, lambda p: _answer_field(strip(p))), lambda a: a.isNotNull()), F.lit(0))

    fenced = F.when(F.contains(t, F.lit("```")), first_of(F.split(t, "```", -1)))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.contains(x, F.lit('"answer"')))
    by_line = F.when(F.contains(t, F.lit('"answer"')), first_of(lines))
    return F.coalesce(fenced, by_line)


def _json_answer(whole: Column, value: Column) -> Column:
    return _parsed(
        value,
        F.when(whole.isNotNull(), F.lit("strict")).when(value.isNotNull(), F.lit("recoverable")).otherwise(F.lit("fail")),
    )


def gold_verdict(answer: Col) -> Column:
    a = F.lower(strip(answer))
    return F.when(a.isin(GOLD_SUCCESS), F.lit("Success")).when(a.isin(GOLD_FAIL), F.lit("Fail"))


def is_error(ok: Col, error: Col, raw: Col, prefix: str = ERROR_PREFIX) -> Column:
    """A failed call: flagged, with an error text, or with the sentinel as its answer."""
    return (
        ~F.coalesce(col(ok), F.lit(True)) | col(error).isNotNull() | F.coalesce(col(raw).startswith(prefix), F.lit(False))
    )


def scored_text(raw: Col, pred: Col, prefer: str = "raw") -> Column:
    """The text that is judged: ``raw`` unless empty (or the other way round)."""
    a, b = (col(raw), col(pred)) if prefer == "raw" else (col(pred), col(raw))
    return F.coalesce(F.when(F.length(a) > 0, a), b)


# ---------------------------------------------------------------- scene objects

#: Parts of a scene.  Fields whose kind counts are variants; numbers may also be written as texts.
SCENE_PARTS = (
    "agent: struct<pos: array<string>, dir: string, carrying: variant>, "
    "front_cell: struct<pos: array<string>, type: variant, state: variant>, "
    "objects: array<struct<type: variant, pos: array<string>, color: variant, state: variant>>"
)

#: The same with leaves as texts, which are read faster; a text may have been a number, a truth value or an object.
SCENE_TEXTS = (
    "agent: struct<pos: array<string>, dir: string, carrying: variant>, "
    "front_cell: struct<pos: array<string>, type: string, state: string>, "
    "objects: array<struct<type: string, pos: array<string>, color: string, state: string>>"
)


def find_json_object(df: DataFrame, text: Column, parts: str = SCENE_PARTS, keep_text: bool = False) -> DataFrame:
    """``j_value``, ``j_mode``, ``j_fence``: the JSON object found in an answer, repaired if need be.

    A fence is opened first, then the part from the first to the last brace is taken; trailing commas are
    dropped only if it does not parse.  A text is parsed once (and once more if repaired) into the fields
    ``parts`` that are asked for.  Modes are strict, recoverable and fail_json.  ``keep_text`` adds ``j_text``, what was parsed.
    """
    t, bare, cand, fixed = (F.col(c) for c in ("_t", "_bare", "_cand", "_fixed"))
    pieces = F.split(t, "```", -1)
    d = df.withColumn("_raw", F.coalesce(text, F.lit(""))).withColumn("_t", strip("_raw"))
    d = d.withColumn(
        "_bare",
        F.when(~F.contains(t, F.lit("```")), t)
        .when(F.size(pieces) >= 3, strip(F.get(pieces, F.lit(1))))
        .otherwise(strip(F.replace(t, F.lit("```"), F.lit("")))),
    )
    whole = bare.startswith("{") & bare.endswith("}")
    d = d.withColumn("_cand", F.when(whole, bare).otherwise(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))
    # what is told by the whole text is worked out here, so that it is not carried on
    d = d.withColumns({"_same": cand == t, "j_fence": t.startswith("```")})
    # a comma before the last brace never parses, and a text without commas to drop does not parse the second time
    open_end = cand.rlike(r",\s*\}\z")
    d = d.withColumn("_first", F.when(~open_end, json_listed(cand, f"struct<{parts}>"))).withColumn("_ok", F.coalesce(F.size("_first") == 1, F.lit(False)))
    d = d.withColumn("_fixed", F.when(~F.col("_ok") & (cand != ""), F.regexp_replace(cand, r",(\s*[}\]])", "$1")))
    d = d.withColumn("_second", F.when(fixed != cand, json_listed(fixed, f"struct<{parts}>")))
    d = d.withColumn("j_value", F.when(F.col("_ok"), F.get("_first", F.lit(0))).when(F.size("_second") == 1, F.get("_second", F.lit(0))))
    d = d.withColumn(
        "j_mode",
        F.when(F.col("j_value").isNull(), F.lit("fail_json")).when(F.col("_ok") & F.col("_same"), F.lit("strict")).otherwise(F.lit("recoverable")),
    )
    if keep_text:
        d = d.withColumn("j_text", F.when(F.col("_ok"), cand).when(F.col("j_value").isNotNull(), fixed))
    return d.drop("_raw", "_t", "_bare", "_cand", "_same", "_first", "_ok", "_fixed", "_second")
