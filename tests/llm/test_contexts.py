"""The distributed context tree against one written out node by node, at its full depth."""

import math
import random
from collections import defaultdict

import pytest

from verdikt.llm import ctw

from . import brute

DEPTH = ctw.DEPTH


def own(zero, one):
    return math.lgamma(zero + 0.5) + math.lgamma(one + 0.5) - math.lgamma(zero + one + 1) - math.log(math.pi)


def decisions(b):
    s = b"\0" * DEPTH + b + b"\0"
    for k in range(DEPTH, len(s)):
        for j in range(8):
            yield s[k - DEPTH : k], (1 << j) | (s[k] >> (8 - j)), s[k] >> (7 - j) & 1


def plain_score(train):
    counts, longer = defaultdict(lambda: [0, 0]), defaultdict(set)
    for b in train:
        for context, prefix, bit in decisions(b):
            for d in range(DEPTH + 1):
                counts[context[DEPTH - d :], prefix][bit] += 1
                if d:
                    longer[context[DEPTH - d + 1 :], prefix].add((context[DEPTH - d :], prefix))
    weighted = {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        a = own(*counts[node])
        if len(node[0]) < DEPTH:
            b = sum(weighted[x] for x in longer[node])
            a = max(a, b) + math.log1p(math.exp(-abs(a - b))) - math.log(2)
        weighted[node] = a

    def one(context, prefix, d=0):
        node = (context[DEPTH - d :], prefix)
        if node not in counts:
            return 0.5
        zero, ones = counts[node]
        p = (ones + 0.5) / (zero + ones + 1)
        if d == DEPTH:
            return p
        share = math.exp(own(zero, ones) - math.log(2) - weighted[node])
        return share * p + (1 - share) * one(context, prefix, d + 1)

    return lambda b: sum(math.log10(p if bit else 1 - p) for c, x, bit in decisions(b) for p in [one(c, x)])


def test_scores_of_the_whole_tree(spark):
    rng = random.Random(4)
    words = ["the", "cat", "sat", "on", "a", "mat", "Übel", "dog", "DOG", "x1"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(60)] + [(60, None), (61, ""), (62, "never \x00 seen ###")]
    low = {i: (t or "").translate(brute.LOWER).encode() for i, t in docs}
    score = plain_score([low[i] for i, _ in docs if brute.crc(i) % 5 != 1])
    got = ctw.scored(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert sorted(r.doc_id for r in got) == sorted(low)
    for r in got:
        assert r.score == pytest.approx(score(low[r.doc_id]), rel=1e-5)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (len(low[r.doc_id]) + 1))


def test_text_beats_its_words_with_letters_of_two_bytes_context(spark):
    """Both held-out texts have the same runs of three bytes almost everywhere; only one has the words that were learned."""
    line = "abxcd efxgh " * 20
    train = [(i, line) for i in range(40) if brute.crc(i) % 5 != 1]
    held = [i for i in range(1000, 1100) if brute.crc(i) % 5 == 1][:2]
    rows = train + [(held[0], "abxcd efxgh"), (held[1], "abxgh efxcd")]
    far = train + [(2000 + i, "qwabx yxghk") for i in range(40)]
    got = {r.doc_id: r.score for r in ctw.scored(spark.createDataFrame(rows + far, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 2
