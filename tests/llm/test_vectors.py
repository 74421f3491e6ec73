"""Clusters and codes of vectors against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest

from tests.conftest import SF_DIR
from tests.llm.test_operators import same
from verdikt.llm import centroids, codes
from verdikt.llm.queries import QUERIES

VEC = "vec_id long, embedding array<float>, label int, cluster int, q array<int>, error string, distance long"


def usable(v, n=None):
    return v is not None and (n is None or len(v) == n) and all(x is not None and math.isfinite(x) for x in v)


def row(i, v, label=None):
    return (i, v, label, 7, [1], "e", 5)


def plain_clusters(rows, components=64, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if usable(v, components)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    mids = [q for _, q in start[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, m)), c) for c, m in enumerate(mids))

    for _ in range(rounds):
        mine = [near(q)[1] for _, q in kept]
        for c in range(len(mids)):
            own = [q for (_, q), m in zip(kept, mine) if m == c]
            if own:
                mids[c] = [sum(col) // len(own) for col in zip(*own)]
    found = [(i, *near(q)) for i, q in kept]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in mids]
    inertia = sum(d for _, d, _ in found)
    return [(i, c, d, sum(x for _, x, y in found if y == c), inertia, sha[c]) for i, d, c in found]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if usable(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1])
    fit = [r for r in kept if len(r[1]) == n]
    cut = [p * n // parts for p in range(parts + 1)]
    piece = lambda q, p: q[cut[p] : cut[p + 1]]
    books = [[piece(q, p) for _, q, _ in fit[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = [near(piece(q, p), book)[1] for _, q, _ in fit]
            books[p] = [
                [sum(col) // len(own) for col in zip(*own)] if (own := [piece(q, p) for (_, q, _), m in zip(fit, mine) if m == k]) else e for k, e in enumerate(book)
            ]
    out = []
    for i, q, label in kept:
        found = [near(piece(q, p), book) for p, book in enumerate(books)] if len(q) == n else None
        out.append((i, "".join(f"{k:02x}" for _, k in found) if found else None, sum(d for d, _ in found) if found else None, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = {}
    for *_, e, label in out:
        total[label] = e if total.get(label) is None else total[label] + (e or 0)
    return [(i, c, e, total[label], sha) for i, c, e, label in out]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vector = lambda n=64, s=1.0: [rng.uniform(-s, s) for _ in range(n)]
    out = [row(i, vector(), rng.choice([0, 1, None])) for i in range(3, 130)]
    out += [row(200 + i, out[0][1], 9) for i in range(40)]  # copies, with ties everywhere
    out += [row(300, None, 1), row(301, [], 1), row(302, vector(63), 1), row(303, [*vector(63), None], 1), row(304, [*vector(63), float("nan")], 1)]
    out += [row(305, [*vector(63), float("-inf")], 1), row(None, vector(), 2), row(None, vector(), 2), row(3, vector(), 0), out[1], out[1], row(306, [0.0] * 64, 4), row(307, [-0.001] * 64, 4)]
    return out


def test_clusters(spark, rows):
    got = centroids.clustered(spark.createDataFrame(rows, VEC).repartition(5)).collect()
    assert same(got, plain_clusters(rows))


def test_codes(spark, rows):
    got = codes.compressed(spark.createDataFrame(rows, VEC).repartition(5)).collect()
    assert same(got, plain_codes(rows))


def test_few_and_no_vectors(spark, rows):
    for part in (rows[:5], rows[127:140], rows[167:170]):
        df = spark.createDataFrame(part, VEC)
        want = plain_clusters(part)
        assert same(centroids.clustered(df).collect(), want)
        kept = [r for r in part if usable(r[1])]
        assert same(codes.compressed(df).collect(), plain_codes(part) if kept else [])
    empty = spark.createDataFrame([], VEC)
    for made, full in ((centroids.clustered(empty), centroids.clustered(spark.createDataFrame(rows[:5], VEC))), (codes.compressed(empty), codes.compressed(spark.createDataFrame(rows[:5], VEC)))):
        assert not made.collect() and made.dtypes == full.dtypes


def test_odd_lengths_and_large_components(spark):
    rng = random.Random(6)
    short = [row(i, [rng.uniform(-2, 2) for _ in range(21)], i % 3) for i in range(90)] + [row(100, [1.0] * 64, 0), row(101, [1.0] * 16, 0)]
    assert same(codes.compressed(spark.createDataFrame(short, VEC)).collect(), plain_codes(short))
    large = [row(1, [3e38] * 64, 0), row(2, [-3e38] * 64, 0), row(3, [0.5] * 64, 0)]
    got = {r.vec_id: r for r in centroids.clustered(spark.createDataFrame(large, VEC)).collect()}
    assert sorted(got) == [1, 2, 3] and {r.distance for r in got.values()} == {0}
    assert len(codes.compressed(spark.createDataFrame(large, VEC)).collect()) == 3


def test_orchard_search_measures_few_and_finds_all():
    rng = np.random.default_rng(3)
    entries = rng.integers(-40, 40, (64, 4))
    entries[10] = entries[3]
    x = np.vstack([rng.integers(-60, 60, (3000, 4)), entries, (entries[:30] + entries[30:60]) // 2])
    best, far = codes.Orchard(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(-1)
    assert (best == every.argmin(1)).all() and (far == every.min(1)).all()
    assert (codes.Orchard(entries[:1]).nearest(x)[0] == 0).all()


def test_registered_vector_queries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert same(QUERIES["op11_centroid_clustering"](spark, SF_DIR).collect(), plain_clusters(rows))
    assert same(QUERIES["op13_vector_codes"](spark, SF_DIR).collect(), plain_codes(rows))
