"""Inputs that are dense or long where the other tests are sparse or short, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.llm import chat, simhash, substrings

from . import brute


def signed(values):
    return [v - (1 << 64) if v >> 63 else v for v in values]


def classes_of(values, edges):
    """Smallest index of each value's class, from links between values."""
    at = {v: k for k, v in enumerate(values)}
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(values))]


@pytest.mark.parametrize("low", simhash.THIRDS)
def test_trie_rotation_brings_the_lead_to_the_top(low):
    left = simhash.TURNS[simhash.THIRDS.index(low)]
    v = np.array([((1 << simhash.START) - 1) << (low + (low == 42))], np.uint64)
    assert int(simhash.rotated(v, left)[0]) >> (64 - simhash.START) == (1 << simhash.START) - 1
    assert (simhash.rotated(simhash.rotated(v, left), 64 - left) == v).all()


@pytest.mark.parametrize("node_rows", [1 << 20, 3])
def test_dense_nodes_lose_no_link(spark, node_rows):
    rng = random.Random(node_rows)
    values = {0x8000000000000000, 0xC000020000000000, 0x4000020000200000}
    for low, size in ((42, 22), (21, 21), (0, 21)):
        # many fingerprints that share one third
        third = rng.getrandbits(size) << low
        dense = [(rng.getrandbits(64) & ~(((1 << size) - 1) << low)) | third for _ in range(150)]
        values |= set(dense)
        # pairs two bits apart, in two different thirds and in one
        others = [(a, b) for a, b in ((42, 22), (21, 21), (0, 21)) if a != low]
        for v in dense[:60]:
            (a, m), (b, n) = others
            values.add(v ^ (1 << (a + rng.randrange(m))) ^ (1 << (b + rng.randrange(n))))
        for v in dense[60:90]:
            a, m = rng.choice(others)
            values.add(v ^ (1 << (a + rng.randrange(m))) ^ (1 << (a + rng.randrange(m))))
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in signed(values)], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(frame, node_rows).collect()]
    assert classes_of(values, edges) == brute.components(values)


def plain_windows(tokens, system, budget, history_turns=2, history_tokens=128):
    """(first, history, end) over a whole conversation."""
    body = int(system and len(tokens) > 1)
    head, out, first = tokens[0] if body else 0, [], body
    while first < len(tokens):
        history = 0
        for h in range(1, history_turns + 1):
            if first - h >= body and sum(tokens[first - h : first]) <= history_tokens and head + sum(tokens[first - h : first + 1]) <= budget:
                history = h
        end, used = first + 1, head + sum(tokens[first - history : first + 1])
        while end < len(tokens) and used + tokens[end] <= budget:
            used, end = used + tokens[end], end + 1
        out.append((first, history, end))
        first = end
    return out


@pytest.mark.parametrize("budget, block, chain", [(512, 1024, 256), (512, 1024, 2), (60, 8, 3), (7, 8, 2)])
def test_windows_run_on_across_blocks(spark, monkeypatch, budget, block, chain):
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "CHAIN", chain)
    rng = random.Random(budget + chain)
    long = 5000 if budget == 512 else 300
    convs = {}
    for c, (n, most) in enumerate([(long, 60), (long, 1), (long + 7, 600), (1024, 30), (1025, 30), (2048, 9), (block, 30), (block + 1, 30), (5, 9), (1, 9)]):
        convs[c] = [(c, i, "system" if i == 0 and c % 2 == 0 else rng.choice(["user", "assistant"]), "w " * rng.randint(0, most)) for i in range(n)]
    frame = spark.createDataFrame([r for rows in convs.values() for r in rows], "conv_id long, turn long, role string, text string").repartition(3)
    w = chat.windows(frame, budget=budget)
    got = {}
    for r in w.collect():
        got.setdefault(r.conv_id, []).append((r["first"], r.repeated, len(r.text)))
    chars = {r.conv_id: r.formatted_chars for r in chat.read_back(w).collect()}
    for c, rows in convs.items():
        length = [len(f"{chat.OPEN}{role}\n{text}{chat.CLOSE}") for _, _, role, text in rows]
        system = int(rows[0][2] == "system" and len(rows) > 1)
        want = []
        for first, history, end in plain_windows([3 + len(text.split()) for *_, text in rows], rows[0][2] == "system", budget):
            repeated = 0 if first == system and not history else system + history
            want.append((first, repeated, system * length[0] + sum(length[first - history : end])))
        assert sorted(got[c]) == want
        assert chars[c] == sum(x for _, _, x in want)


@pytest.mark.parametrize("hot_entries", [substrings.HOT_ENTRIES, 6, 1])
def test_passage_of_many_documents_is_dealt(spark, hot_entries):
    rng = random.Random(hot_entries)
    some = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, other = some(75), some(60)
    texts = [" ".join(some(rng.randrange(45)) + (passage if k % 5 else other) + some(rng.randrange(45))) for k in range(80)]
    rows = [(rng.randrange(70), t) for t in texts] + [(90, texts[0]), (91, texts[1]), (91, texts[1]), (92, " ".join(some(200))), (None, texts[2]), (93, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.without_repeats(docs, hot_entries).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute.without_repeats(rows), key=key)
    # no task gets more distinct segments of an anchor than that
    found = docs.filter("doc_id is not null").na.fill("").mapInArrow(substrings._segment_rows, substrings.SEGMENTS)
    cold, hot = substrings.dealt(found, hot_entries)
    assert (cold.groupBy("anchor").count().agg(F.max("count")).first()[0] or 0) <= hot_entries
    assert (hot is not None) == (hot_entries < 50) and (hot is None or hot.count() > 0)
