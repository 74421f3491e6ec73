"""Chat formatting in windows of a token budget, in SQL functions only.

The turns of a conversation are numbered; prefix sums of their tokens choose spans of whole turns that fit the budget
together with the system turn and a limited history before the span.  A window holds the system turn, the history and
the new turns; only new assistant texts are targets, so that each is learned once.

Numbers and sums are worked out in blocks of turns with a few turns of the blocks beside them: a conversation of any
length is spread over tasks, and a window never has more turns than its budget has tokens.  Windows run on across blocks:
a block tells, for each turn in which a window may enter it, where the first window behind it begins; these short lists
are chained, CHAIN blocks at a time, so that each block knows its first window.

Control strings inside texts are escaped by one backslash after the ``<``; that is undone by taking one away.

Defined results: null role and null text are empty; turns without number come first; turns of one number are ordered by
role and text, repeated rows included; rows without conv_id are one conversation; a single turn above the budget is a
window of its own, never cut; a conversation of a system turn alone is one window; an empty table gives an empty result;
other columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import landed
from .text import BLANK_RE, let

BUDGET = 512
HISTORY_TURNS = 2
HISTORY_TOKENS = 128
BLOCK = 1024
#: Blocks whose exits are put together into one.
CHAIN = 256
#: Tokens of the template around each turn.
TURN_TOKENS = 3

OPEN, CLOSE, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|newline|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns with ``key`` (of their conversation), ``idx`` from 0, escaped role and text, and tokens."""
    text = escaped(F.coalesce(F.col("text").cast("string"), F.lit("")))
    role = F.replace(escaped(F.coalesce(F.col("role").cast("string"), F.lit(""))), F.lit("\n"), F.lit(NEWLINE))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")
    )
    words = F.regexp_count("text", F.lit("[^" + BLANK_RE[1:] + "+")).cast("bigint")
    rows = rows.withColumns({"tokens": words + TURN_TOKENS, "part": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))})
    sizes = rows.groupBy("key", "part").agg(F.count("*").alias("size"))
    per_key = Window.partitionBy("key")
    before = per_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("key", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(per_key).alias("n_turns"))
    own = Window.partitionBy("key", "part").orderBy("turn", "role", "text")
    return rows.join(sizes, ["key", "part"]).select(
        "key", "conv_id", "n_turns", (F.col("start") + F.row_number().over(own) - 1).alias("idx"), "role", "text", "tokens"
    )


def crossings(maps: DataFrame, size: int, width: int) -> DataFrame:
    """(key, block, entry, stop): first window of each block after the first, and first window behind each before the last.

    ``maps``: key, block and exits; a window that begins ``i`` turns into a block is followed by one that begins
    ``exits[i]`` turns into the next block.
    """
    groups = maps.groupBy("key", F.floor(F.col("block") / CHAIN).alias("chain")).agg(F.sort_array(F.collect_list(F.struct("block", "exits"))).alias("maps"))
    through = F.aggregate("maps", F.sequence(F.lit(0), F.lit(width - 1)), lambda at, m: F.transform(at, lambda x: F.get(m["exits"], x)))
    chains = groups.select("key", "chain", through.alias("exits")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chain", "exits"))).alias("maps"))
    walk = lambda first, name: F.aggregate(
        "maps",
        F.struct(first.alias("at"), F.array().cast(f"array<struct<{name}:bigint,begin:int,exit:int>>").alias("all")),
        lambda acc, m: let(
            F.get(m["exits"], acc["at"]),
            lambda x: F.struct(x.alias("at"), F.concat(acc["all"], F.array(F.struct(m[name].alias(name), acc["at"].alias("begin"), x.alias("exit")))).alias("all")),
        ),
        lambda acc: acc["all"],
    )
    begins = chains.select("key", F.inline(walk(F.lit(0), "chain"))).select("key", "chain", "begin")
    exits = groups.join(begins, ["key", "chain"]).select("key", F.inline(walk(F.col("begin"), "block")))
    at = (F.col("block") + 1) * size + F.col("exit")
    none = F.lit(None).cast("bigint")
    sides = F.array(F.struct(F.col("block").alias("block"), none.alias("entry"), at.alias("stop")), F.struct((F.col("block") + 1).alias("block"), at.alias("entry"), none.alias("stop")))
    return exits.select("key", F.inline(sides)).groupBy("key", "block").agg(F.max("entry").alias("entry"), F.max("stop").alias("stop"))


def spans(turns: DataFrame, budget: int, history_turns: int, history_tokens: int) -> DataFrame:
    """(key, first, end, history, system): windows take turns ``first`` to ``end - 1``, after ``history`` repeated ones."""
    # a window has at most ``width`` turns, so it reaches into the next block and no further
    width = max(1, budget // TURN_TOKENS)
    size = max(BLOCK, width + 1, history_turns)
    system = turns.filter((F.col("idx") == 0) & (F.col("role") == "system")).select("key", F.col("tokens").alias("system"))
    block = F.floor(F.col("idx") / size)
    place = F.pmod("idx", F.lit(size))
    none = F.array().cast("array<bigint>")
    at = F.concat(
        F.array(block),
        F.when(place >= size - history_turns, F.array(block + 1)).otherwise(none),
        F.when((place < width) & (block > 0), F.array(block - 1)).otherwise(none),
    )
    rows = turns.select("key", "n_turns", "idx", "tokens", F.explode(at).alias("block"))
    rows = rows.withColumn("upto", F.sum("tokens").over(Window.partitionBy("key", "block").orderBy("idx")))
    blocks = rows.groupBy("key", "block", "n_turns").agg(F.sort_array(F.collect_list(F.struct("idx", "tokens", "upto"))).alias("turns"))
    # the body starts behind a system turn, unless that is all there is
    blocks = blocks.join(system, "key", "left").withColumns(
        {"body": F.when(F.col("system").isNotNull() & (F.col("n_turns") > 1), 1).otherwise(0), "system": F.coalesce("system", F.lit(0).cast("bigint"))}
    )
    blocks = blocks.withColumn("system", F.when(F.col("body") == 1, F.col("system")).otherwise(F.lit(0).cast("bigint")))
    blocks = blocks.withColumn("known", F.filter("turns", lambda t: t["idx"] >= F.col("body")))

    def open_window(turn: Column, k: Column) -> Column:
        """History of a window that begins with the k-th known turn: as many turns before it as the limits allow."""
        fits = F.lit(0)
        choice = F.struct(F.lit(0).alias("turns"), F.lit(0).cast("bigint").alias("tokens"))
        total = F.lit(0).cast("bigint")
        for h in range(1, history_turns + 1):
            total = total + F.get("known", k - h)["tokens"]
            fits = (k >= h) & (total <= history_tokens) & (F.col("system") + total + turn["tokens"] <= budget)
            choice = F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(h).alias("turns"), total.alias("tokens"))).otherwise(choice)
        return choice

    def following(turn: Column, k: Column) -> Column:
        """First turn behind a window that begins with the k-th known turn: the last sum within the budget, by halves."""
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(width.bit_length()))])
        room = turn["upto"] - turn["tokens"] + budget - F.col("system") - open_window(turn, k)["tokens"]
        fits = let(room, lambda r: F.aggregate(steps, F.lit(0), lambda n, x: F.when(F.coalesce(F.get("known", k + n + x - 1)["upto"] <= r, F.lit(False)), n + x).otherwise(n)))
        return turn["idx"] + F.greatest(fits, F.lit(1))

    # where windows that begin in a block leave it: every turn's next window, then twice as far in each round
    stop = (F.col("block") + 1) * size
    mapped = blocks.filter(stop < F.col("n_turns")).withColumn("base", F.greatest(F.col("block") * size, F.col("body")))
    next_of = F.transform("known", lambda t, k: F.when((t["idx"] >= F.col("base")) & (t["idx"] < stop), following(t, k)))
    mapped = mapped.withColumn("next", F.filter(next_of, lambda x: x.isNotNull()))
    rounds = F.sequence(F.lit(1), F.lit(size.bit_length()))
    ahead = F.aggregate(rounds, F.col("next"), lambda to, _: F.transform(to, lambda x: F.when(x >= stop, x).otherwise(F.get(to, (x - F.col("base")).cast("int")))))
    exits = F.transform(F.slice(ahead, 1, width), lambda x: (x - stop).cast("int"))
    blocks = blocks.join(crossings(mapped.select("key", "block", exits.alias("exits")), size, width), ["key", "block"], "left")

    window = "struct<first:bigint,history:int>"
    start = F.struct(F.array().cast(f"array<{window}>").alias("windows"), F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("k"))

    def step(acc: Column, turn: Column) -> Column:
        mine = (F.floor(turn["idx"] / size) == F.col("block")) & (turn["idx"] >= F.coalesce("entry", F.lit(0)))
        more = (F.size(acc["windows"]) > 0) & (acc["used"] + turn["tokens"] <= budget)
        opened = let(
            open_window(turn, acc["k"]),
            lambda h: F.struct(
                F.concat(acc["windows"], F.array(F.struct(turn["idx"].alias("first"), h["turns"].alias("history")).cast(window))).alias("windows"),
                (F.col("system") + h["tokens"] + turn["tokens"]).alias("used"),
                (acc["k"] + 1).alias("k"),
            ),
        )
        kept = F.struct(acc["windows"].alias("windows"), (acc["used"] + turn["tokens"]).alias("used"), (acc["k"] + 1).alias("k"))
        passed = F.struct(acc["windows"].alias("windows"), acc["used"].alias("used"), (acc["k"] + 1).alias("k"))
        return F.when(~mine, passed).when(more, kept).otherwise(opened)

    blocks = blocks.withColumn("windows", F.aggregate("known", start, step, lambda acc: acc["windows"]))
    last = F.coalesce("stop", "n_turns")
    ends = F.transform("windows", lambda w, i: F.struct(w["first"].alias("first"), F.coalesce(F.get("windows", i + 1)["first"], last).alias("end"), w["history"].alias("history")))
    return blocks.select("key", F.col("body").alias("system"), F.inline(ends))


def windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row per window: conv_id, key, first (number of its first new turn), repeated (turns before it), text, loss, tokens.

    ``loss`` lists (start, length) of the targets in ``text``, in characters.
    """
    turns = landed(numbered(conversations), "chat-turns")
    chosen = spans(turns, budget, history_turns, history_tokens)
    head = F.when((F.col("system") == 1), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    refs = chosen.select(
        "key", "first", F.when(F.col("first") == F.col("system"), 0).otherwise(F.col("system") + F.col("history")).alias("repeated"),
        F.explode(F.concat(head, F.sequence(F.col("first") - F.col("history"), F.col("end") - 1))).alias("idx"),
    )
    new = (F.col("idx") >= F.col("first")) & (F.col("role") == "assistant")
    front = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"))
    row = F.struct("idx", F.concat(front, "text", F.lit(CLOSE)).alias("out"), F.length(front).alias("skip"), F.length("text").alias("size"), new.alias("new"), "tokens")
    w = refs.join(turns, ["key", "idx"]).groupBy("key", "first", "repeated").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(row)).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["out"])).alias("at"),
        F.when(t["new"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + t["skip"]).alias("start"), t["size"].alias("length"))))).otherwise(acc["loss"]).alias("loss"),
    )
    return w.select(
        "conv_id", "key", "first", "repeated", F.array_join("turns.out", "").alias("text"), F.aggregate("turns", start, step, lambda acc: acc["loss"]).alias("loss"),
        F.aggregate("turns.tokens", F.lit(0).cast("bigint"), lambda n, x: n + x).alias("tokens"),
    )


def read_back(w: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its windows alone.

    A digest runs over a whole conversation, so the new turns of one meet here.
    """
    pieces = F.transform(F.slice(F.split("text", r"<\|im_start\|>"), F.col("repeated") + 2, F.lit(1 << 30)), lambda p: F.substr(p, F.lit(1), F.length(p) - len(CLOSE)))
    role = lambda p: unescaped(F.replace(F.substring_index(p, "\n", 1), F.lit(NEWLINE), F.lit("\n")))
    body = lambda p: unescaped(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2))
    turn = F.transform(pieces, lambda p: F.concat(role(p), F.lit("\n"), body(p), F.lit("\n")))
    loss = F.transform("loss", lambda x: unescaped(F.substr(F.col("text"), x["start"] + 1, x["length"])))
    row = F.struct("first", F.size(turn).cast("bigint").alias("n"), F.array_join(turn, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("text").cast("bigint").alias("chars"))
    c = w.select("conv_id", "key", row.alias("w")).groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("w")).alias("w"))
    total = lambda name: F.aggregate(f"w.{name}", F.lit(0).cast("bigint"), lambda a, x: a + x)
    digest = lambda name: F.sha2(F.array_join(f"w.{name}", "").cast("binary"), 256)
    return c.select(
        "conv_id", total("n").alias("n_turns"), digest("turns").alias("turns_sha256"), F.length(F.array_join("w.loss", "")).cast("bigint").alias("loss_chars"),
        digest("loss").alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )
