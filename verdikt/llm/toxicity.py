"""Toxicity by a support vector machine with a string kernel of gapped subsequences and Nyström landmarks.

A sentence is as toxic as the worst of its units (words, or letters written apart and put together), a document as its
worst sentence.  The kernel of two units counts the subsequences of four letters that they share; a subsequence may have
gaps of three letters in all and each gap lessens its weight, so that inserted or repeated letters keep most of an
insult.  Units are mapped to their kernel values with landmark units (Nyström), and a linear machine with squared hinge
loss is trained there.  Only documents are labelled, so the unit that stands for a toxic document is chosen anew with
each machine, among those that toxic documents have far oftener than others; all units of other documents are examples of
the other class, and altered spellings of the chosen ones of the toxic class.  A unit that some clean unit is as like as its own
altered spellings are has no such examples, for to tolerate them would mark the clean unit too.

The trained machine is one weight per subsequence (40^4 numbers), which is what landmarks and machine add up to; tasks
score each distinct unit once.  It is fitted on at most SAMPLE labelled documents of each class, the first ones by a
hash of their id; every text is scored as a whole.

Defined results: null and empty texts have no units and get the lowest score; rows without doc_id and repeated rows are
scored like others; without labels of both classes every score is zero; an empty table gives an empty result; other
columns are left behind.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .text import map_texts

#: Most labelled documents of one class that the machine is fitted on.
SAMPLE = 1500
LANDMARKS = 160
GAP = 0.6
SPAN = 7
LONGEST = 24
SYMBOLS = 40
#: Distinct units whose scores a task remembers.
REMEMBERED = 400_000
LOWEST = -3.0
#: Units whose subsequences are in memory together (some ten thousand numbers a unit at most).
AT_ONCE = 2048
#: Letters tried at each place of a unit, as altered spellings to learn from.
INSERTED = 3
#: Weight of all altered spellings of a unit together, the unit itself being 1.
ALTERED = 4.0
#: Log of how much oftener toxic documents than others have a unit that may stand for them.
MARKED = 1.5

_SPELLING = {**{ord(c): None for c in "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~$"}, **{ord(a): ord(b) for a, b in zip("0134578@", "oieastba")}}
_APART = re.compile(r"(?<!\S)[^\W_](?:[ .*_-][^\W_]){2,}(?!\S)")


def unit(word: str) -> str:
    """A lower-cased word without punctuation, digits read as the letters they stand for."""
    return word.translate(_SPELLING)


def words_of(text: str) -> set[str]:
    """Distinct words of a text, and runs of single letters put together."""
    low = text.lower()
    out = set(low.split())
    for m in _APART.finditer(low):
        out.add("".join(c for c in m[0] if c.isalnum()))
    return out


def codes_of(units: Iterable[str]) -> list[np.ndarray]:
    """Letters as numbers below SYMBOLS, with a sign before and after."""
    out = []
    for u in units:
        c = [27, *(ord(x) - 96 if "a" <= x <= "z" else 29 + ord(x) % (SYMBOLS - 29) for x in u), 28]
        out.append(np.array(c, np.int64))
    return out


@cache
def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of four among n letters within SPAN, and their weights."""
    at = np.array([(i, *r) for i in range(n - 3) for r in combinations(range(i + 1, min(n, i + SPAN)), 3)], np.int64)
    return at, GAP ** (at[:, 3] - at[:, 0] - 3.0)


def features(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, subsequence, value) of all units, and the unit of each stretch; the values of a stretch have length one."""
    rows, keys, values = [], [], []
    by_size: dict[int, list[int]] = {}
    parts: list[np.ndarray] = []
    owner: list[int] = []
    for k, c in enumerate(codes_of(units)):
        # a long unit is read in overlapping stretches
        for a in range(0, max(1, len(c) - LONGEST // 2), LONGEST // 2) if len(c) > LONGEST + 2 else (0,):
            p = c[a : a + LONGEST] if len(c) > LONGEST + 2 else c
            if len(p) >= 4:
                by_size.setdefault(len(p), []).append(len(parts))
                parts.append(p)
                owner.append(k)
    for n, members in by_size.items():
        at, weight = places(n)
        for s in range(0, len(members), AT_ONCE):
            some = members[s : s + AT_ONCE]
            m = np.stack([parts[i] for i in some])
            code = m[:, at[:, 0]]
            for j in (1, 2, 3):
                code = code * SYMBOLS + m[:, at[:, j]]
            order = np.sort((code << 10) | np.arange(len(at)), axis=1)
            w, code = weight[order & 1023], order >> 10
            new = np.ones(code.shape, bool)
            new[:, 1:] = code[:, 1:] != code[:, :-1]
            first = np.flatnonzero(new.ravel())
            value = np.add.reduceat(w.ravel(), first)
            row = first // code.shape[1]
            norm = np.sqrt(np.bincount(row, value * value, len(some)))
            rows.append(np.array(some)[row])
            keys.append(code.ravel()[first])
            values.append(value / norm[row])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(values), np.array(owner)


def unit_scores(units: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Machine output of each unit; that of a long one is its worst stretch."""
    out = np.full(len(units), LOWEST)
    for s in range(0, len(units), AT_ONCE):
        row, key, value, owner = features(units[s : s + AT_ONCE])
        if len(owner):
            np.maximum.at(out, s + owner, np.bincount(row, weights[key] * value, len(owner)) + bias)
    return out


class Machine:
    """Weights per subsequence, and the logistic curve that turns the worst unit into a probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, middle: float):
        self.weights, self.bias, self.slope, self.middle = weights, bias, slope, middle
        self.known: dict[str, float] = {}

    def worst_of(self, texts: list[str]) -> list[float]:
        """The worst unit of each text; units that were not met before are scored together."""
        words = [words_of(t) for t in texts]
        every = set().union(*words)
        fresh = [w for w in every if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(every)
        units = [unit(w) for w in fresh]
        some = [u for u in dict.fromkeys(units) if u]
        score = dict(zip(some, unit_scores(some, self.weights, self.bias).tolist()))
        self.known.update((w, score.get(u, LOWEST)) for w, u in zip(fresh, units))
        return [max(map(self.known.__getitem__, ws), default=LOWEST) for ws in words]

    def worst(self, text: str) -> float:
        return self.worst_of([text])[0]

    def probability(self, worst: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (worst - self.middle), -30, 30))))


def _kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of units with landmarks (units that fit one stretch)."""
    row, key, value, owner = features(landmarks)
    keys, column = np.unique(key, return_inverse=True)
    table = np.zeros((len(keys), len(landmarks)), np.float32)
    table[column, owner[row]] = value
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for s in range(0, len(units), AT_ONCE):
        row, key, value, owner = features(units[s : s + AT_ONCE])
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        row, at, value = owner[row[hit]], at[hit], value[hit]
        order = np.argsort(row, kind="stable")
        row, at, value = row[order], at[order], value[order]
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            for f in range(0, len(first), 256):
                a, b = first[f], first[f + 256] if f + 256 < len(first) else len(row)
                out[s + row[first[f : f + 256]]] = np.add.reduceat(table[at[a:b]] * value[a:b, None].astype(np.float32), first[f : f + 256] - a, axis=0)
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, rounds: int = 15) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last column of x is one."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    last = None
    for _ in range(rounds):
        active = y * (x @ w) < 1
        if last is not None and np.array_equal(active, last):
            break
        a, c = x[active], cost * weight[active]
        w = np.linalg.solve(ridge + (a * c[:, None]).T @ a, a.T @ (c * y[active]))
        last = active
    return w


def _altered(u: str, rng: np.random.Generator) -> list[str]:
    """Spellings with a letter put in or doubled, at each place inside, and one with a letter left out, as further examples."""
    if not 3 < len(u) < LONGEST:
        return []
    inside = range(1, len(u))
    out = [u[:k] + chr(97 + x) + u[k:] for k in inside for x in rng.integers(26, size=INSERTED).tolist()]
    out += [u[:k] + u[k - 1] + u[k:] for k in inside]
    if len(u) > 4:
        at = int(rng.integers(1, len(u) - 1))
        out.append(u[:at] + u[at + 1 :])
    return list(dict.fromkeys(out))


def _tolerant(units: list[str], clean: list[str], rng: np.random.Generator) -> list[str]:
    """Those of ``units`` that no clean unit is as like as their own altered spellings are.

    To tolerate altered spellings of the others would mark the clean unit as well.
    """
    near = _kernel(clean, units).max(axis=0)
    return [u for u, k in zip(units, near) if (own := _altered(u, rng)) and k < np.median(_kernel(own, [u]))]


def _best(ids: np.ndarray, score: np.ndarray) -> int:
    """The unit with the highest score, the last one of equals."""
    s = score[ids]
    return int(ids[np.flatnonzero(s == s.max())[-1]])


def fit(bags: list[tuple[bool, str]], seed: int = 7) -> Machine | None:
    """Machine of (toxic, text) examples; none if a class is missing.  Units are kept once, documents hold their numbers."""
    number: dict[str, int] = {}
    docs, toxic = [], []
    for label, text in bags:
        ids = {number.setdefault(u, len(number)) for u in map(unit, words_of(text)) if u and len(u) <= LONGEST}
        if ids:
            docs.append(np.fromiter(ids, np.int32, len(ids)))
            toxic.append(label)
    if len(set(toxic)) < 2:
        return None
    names = sorted(number)
    place = np.empty(len(names), np.int32)
    place[[number[u] for u in names]] = np.arange(len(names))
    number.clear()
    docs = [np.sort(place[d]) for d in docs]
    toxic = np.array(toxic)
    count = lambda of: np.bincount(np.concatenate([d for d, t in zip(docs, toxic) if t == of]), minlength=len(names))
    good, bad = count(False), count(True)
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())
    odds = np.where(bad > 0, np.log((bad / n_bad + 1 / n_bad) / (good / n_good + 1 / n_good)), -np.inf)
    rng = np.random.default_rng(seed)
    clean = np.flatnonzero(good)
    common = np.argsort(-good, kind="stable")[: LANDMARKS // 4]
    spread = rng.choice(clean, min(len(clean), LANDMARKS // 4), replace=False)
    telling_first = np.argsort(-odds, kind="stable")[: LANDMARKS // 2]
    is_clean = set(names[i] for i in clean)
    tolerant = _tolerant([names[i] for i in telling_first], [names[i] for i in clean], rng)
    # altered spellings of the units that tell most are landmarks too, for the machine can weigh only what landmarks hold
    variants = [v for u in tolerant[: LANDMARKS // 16] for v in rng.permutation(_altered(u, rng))[: LANDMARKS // 16].tolist()]
    tolerant = set(tolerant)
    landmarks = list(dict.fromkeys([*(names[i] for i in (*telling_first, *common, *spread)), *variants]))
    row, key, value, owner = features(landmarks)
    k = _kernel(landmarks, landmarks).astype(float)
    lam, vec = np.linalg.eigh(k)
    keep = lam > 1e-3 * lam[-1]
    root = vec[:, keep] / np.sqrt(lam[keep])  # Nyström map: kernel values times this

    # a unit that other documents have nearly as often cannot stand for the class: a wrongly labelled document has nothing but such
    marks = (good == 0) | (odds > MARKED)
    toxic_docs = [m for d, t in zip(docs, toxic) if t and len(m := d[marks[d]])]
    if not toxic_docs:
        return None
    stands = [_best(d, odds) for d in toxic_docs]
    # units of many toxic documents and of no other stand for the class, whichever unit is the worst of a document
    telling = Counter({int(i): int(bad[i]) for i in np.flatnonzero((bad >= max(3, n_bad // 200)) & (good == 0))})
    hard = rng.choice(clean, min(len(clean), 6000), replace=False)
    weights, bias, score = np.zeros(SYMBOLS**4, np.float32), 0.0, np.zeros(len(names))
    for _ in range(4):
        yes = {names[i]: float(n) for i, n in (Counter(stands) | telling).items()}
        for u in sorted(tolerant & yes.keys()):
            more = [v for v in _altered(u, rng) if v not in is_clean]
            for v in more:
                yes[v] = max(yes.get(v, 0.0), yes[u] * ALTERED / len(more))
        no = [i for i in np.unique(np.concatenate([hard, common])).tolist() if names[i] not in yes]
        units = list(yes) + [names[i] for i in no]
        z = _kernel(units, landmarks) @ root
        x = np.hstack([z, np.ones((len(z), 1))])
        y = np.concatenate([np.ones(len(yes)), -np.ones(len(units) - len(yes))])
        # both classes weigh the same; a unit of many documents, wrong in all of them, weighs more than one of few
        of_docs = np.sqrt(np.maximum(good[no], 1))
        weight = np.concatenate([np.array(list(yes.values())) / sum(yes.values()), of_docs / of_docs.sum()])
        w = _svm(x, y, weight, cost=2000.0)
        alpha, bias = root @ w[:-1], float(w[-1])
        weights = np.bincount(key, alpha[owner[row]] * value, SYMBOLS**4).astype(np.float32)
        score = unit_scores(names, weights, bias)
        best = [_best(d, score) for d in toxic_docs]
        # a toxic document whose best unit looks like the other class has nothing to teach
        stands = [i for i in best if score[i] > -0.5] or best
        hard = np.concatenate([hard[:6000], clean[np.argsort(-score[clean], kind="stable")[:4000]]])
    # for the curve, a toxic document counts half as it is and half with a spelling of its unit that the machine did not learn from
    fresh = {}
    for k, i in enumerate(stands):
        other = [v for v in _altered(names[i], rng) if v not in yes and v not in is_clean] if names[i] in tolerant else []
        if other:
            fresh[k] = other[int(rng.integers(len(other)))]
    weight = np.ones(len(docs) + len(fresh))
    weight[np.flatnonzero([t and len(d[marks[d]]) > 0 for d, t in zip(docs, toxic)])[list(fresh)]] = 0.5
    weight[len(docs) :] = 0.5
    worst = np.concatenate([[score[d].max() for d in docs], unit_scores(list(fresh.values()), weights, bias)])
    slope, middle = _curve(worst, np.concatenate([toxic, np.ones(len(fresh))]).astype(float), weight)
    return Machine(weights, bias, slope, middle)


def _curve(worst: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the labels, by Newton steps."""
    x = np.stack([worst, np.ones(len(worst))], 1)
    w = np.array([2.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (weight * (label - q)) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    slope = max(w[0], 1e-3)
    return float(slope), float(-w[1] / slope)


def examples(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple[bool, str]]:
    """At most ``most`` labelled texts of each class, of rows that are not held out, the first by a hash of the id.

    Of an id with several texts the least one counts.  Tasks reduce a text to its distinct units that are short enough to be
    learned from, a line each; the driver gets no text.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).select("doc_id", "toxic").distinct()
    classes = [usable.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for toxic in (1, 0)]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).dropna()
    chosen = texts.join(F.broadcast(classes[0].unionByName(classes[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def units_of(batch: pa.Array) -> list[pa.Array]:
        return [pa.array(["\n".join(sorted({w for w in words_of(x) if len(unit(w)) <= LONGEST})) for x in batch.to_pylist()], pa.string())]

    rows = map_texts(chosen, units_of, T.StructType([T.StructField("units", T.StringType())]), ["doc_id", "toxic"]).collect()
    return [(r.toxic == 1, r.units) for r in sorted(rows, key=lambda r: (r.toxic, r.doc_id))]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(fit(examples(docs, labels)))
    fields = T.StructType([T.StructField("score", T.DoubleType())])

    def run(texts: pa.Array) -> list[pa.Array]:
        machine = shared.value
        return [pa.array([machine.probability(x) for x in machine.worst_of(texts.to_pylist())] if machine else [0.0] * len(texts), pa.float64())]

    out = map_texts(docs, run, fields, ["doc_id"])
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
