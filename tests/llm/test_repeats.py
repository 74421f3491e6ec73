"""Sorted suffixes and repeated byte strings against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import DOC, same, sentence
from verdikt.llm import repeats, suffixes


def plain(docs, length=100):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in docs]
    for d, b in texts:
        for s in range(len(b) - length + 1):
            k, at = b[s : s + length], ((d is None, d or 0), s)
            first[k] = min(first.get(k, at), at)
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < ((d is None, d or 0), s):
                gone[s : s + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(d, t, "en", "s", 1, "r", 1, "k", "f", 1, "n", "p", "t") for d, t in docs], DOC).repartition(parts)


def found(spark, docs, parts=3):
    got = repeats.without_repeats(frame(spark, docs, parts)).collect()
    assert same(got, plain(docs))
    return got


# ---- suffixes


def test_cover_meets_every_pair():
    for a in range(suffixes.PERIOD):
        for b in range(suffixes.PERIOD):
            s = suffixes.SHIFT[a, b]
            assert {(a + s) % suffixes.PERIOD, (b + s) % suffixes.PERIOD} <= set(suffixes.COVER)


@pytest.mark.parametrize("make", [lambda r: r.randbytes(3000), lambda r: b"a" * 2000, lambda r: b"ab" * 900, lambda r: (b"\0" * 40 + b"\1") * 50, lambda r: bytes(r.choice(b"ab") for _ in range(4000)), lambda r: r.randbytes(150) * 20, lambda r: (r.randbytes(33) + b"x" * 90) * 8 + r.randbytes(100)])
@pytest.mark.parametrize("block", [50, 1 << 17])
def test_suffixes_in_order(make, block):
    text = make(random.Random(4))
    found = suffixes.Suffixes(np.frombuffer(text, np.uint8))
    starts = np.arange(len(text) - 100)
    order, different = [], []
    for at, new in found.blocks(starts, block):
        order += at.tolist()
        different += found.classes(at, new, 100).tolist()
    assert order == sorted(range(len(text) - 100), key=lambda i: text[i:])
    assert different == [True] + [text[a : a + 100] != text[b : b + 100] for a, b in zip(order, order[1:])]


def test_no_text():
    assert list(suffixes.Suffixes(np.zeros(0, np.uint8)).blocks(np.zeros(0, np.int64))) == []
    with pytest.raises(ValueError):
        suffixes.Suffixes(np.zeros(50, np.uint8)).classes(np.zeros(1, np.int64), np.ones(1, bool), 31)


# ---- repeated strings


def test_edge_cases(spark):
    rng = random.Random(12)
    base = [sentence(rng, n) for n in (60, 120, 300)]
    passage = sentence(rng, 40)
    docs = [(0, None), (1, ""), (2, "short"), *((3 + i, t) for i, t in enumerate(base)), (10, base[0]), (11, base[1]), (12, base[1][:150]), (13, base[2][7:99] + base[2][:300])]
    docs += [(20 + i, sentence(rng, 20) + passage + sentence(rng, 25)) for i in range(6)]
    docs += [(40, "x" * 99), (41, "x" * 100), (42, "x" * 101), (43, "x" * 120), (44, "ab" * 400), (45, "x" * 3000), (46, passage + "y" + passage), (47, "漢字 ünï " * 60), (48, "same line of a text\n" * 30)]
    docs += [docs[4], docs[4], (4, base[2]), (None, base[0]), (None, base[0]), (None, passage + " of no id " + passage), (-5, base[2][50:400]), (2**62, base[1])]
    found(spark, docs)
    found(spark, docs[::-1], 1)


def test_empty_table(spark):
    made = repeats.without_repeats(spark.createDataFrame([], DOC))
    assert made.collect() == [] and made.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_frequent_passage_in_many_surroundings(spark, monkeypatch):
    """One passage in every document is hot: its runs are demoted, and the result is the same."""
    rng = random.Random(3)
    passage = sentence(rng, 50)
    docs = [(i, sentence(rng, 12) + passage[: rng.choice([150, len(passage)])] + sentence(rng, 12)) for i in range(400)]
    monkeypatch.setattr(repeats, "HOT_SHARE", 1 / 1024)
    hot, size = repeats.frequent_hashes(frame(spark, docs))
    assert 0 < len(hot.values) <= 1024 and size == sum(len(t.encode()) for _, t in docs)
    found(spark, docs)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    rng = random.Random(8)
    long = sentence(rng, 3000, 5000)
    hot = repeats.Hot([])
    for text in (long, long[:799], long[:800], long[:100], long[:99]):
        batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
        seen = sum(int(repeats._segments(d, o, hot)[2].sum()) for d, o, _, _ in repeats._pieces(batch) if len(d) >= 100)
        assert seen == max(0, len(text.encode()) - 99)


def test_one_very_long_text(spark):
    """20 MB in one row: half of it is the other half again, but for one byte in the middle of the copy."""
    rng = random.Random(1)
    half = rng.randbytes(5_000_000).hex()
    middle = len(half) // 2
    text = half + half[:middle] + "_" + half[middle + 1 :]
    row = repeats.without_repeats(frame(spark, [(1, text), (2, half[1000:2000])], 1)).orderBy("doc_id").collect()
    assert tuple(row[0])[:4] == (1, len(text), len(half) - 1, 2) and tuple(row[1])[:4] == (2, 1000, 1000, 1)
    assert row[0].kept_sha256 == hashlib.sha256((half + "_").encode()).hexdigest()
