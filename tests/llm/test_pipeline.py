"""The pipeline and the registered queries against plain versions."""

import random
from collections import defaultdict

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tests.llm import brute
from verdikt.llm import pii, quality, toxicity
from verdikt.llm.queries import QUERIES


def verdicts(rows):
    """Positions of the rows that the quality rules keep: sketches and fences written out."""
    m = [brute.quality(r.text) for r in rows]
    values = [{"word_length": 100 * c // max(n, 1), "symbols": 1000 * s // max(n, 1), "dup_lines": 1000 * d // max(n, 1), "repeats": 1000 * r // max(n, 1)} for n, c, s, d, r, _ in m]

    def bucket(x):
        k = max(0, len(bin(x)) - 2 - quality.LEAD_BITS)
        return x >> k << k

    pools = defaultdict(lambda: defaultdict(list))
    for r, v, x in zip(rows, values, m):
        if not x[-1]:
            for key in ((0, r.lang, r.source), (1, r.lang), (2,)):
                for name, value in v.items():
                    pools[key][name].append(bucket(value))
    out = []
    for k, (r, v, x) in enumerate(zip(rows, values, m)):
        if x[-1]:
            continue
        key = next(key for key in ((0, r.lang, r.source), (1, r.lang), (2,)) if key == (2,) or len(pools[key]["symbols"]) >= quality.LEAST_DOCS)
        inside = True
        for name, low, per_mille, times in quality.FENCES:
            s = sorted(pools[key][name])
            at = lambda q: s[-(-q * len(s) // 1000) - 1]  # noqa: B023, E731
            edge = lambda x: x + (1 << max(0, len(bin(x)) - 2 - quality.LEAD_BITS))
            if low:
                inside &= v[name] >= at(per_mille) - times * (edge(at(500)) - at(per_mille))
            else:
                inside &= v[name] <= edge(at(per_mille)) + times * (edge(at(per_mille)) - at(500))
        if inside:
            out.append(k)
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()


def test_quality_verdicts(spark, documents):
    kept = {documents[k].doc_id for k in verdicts(documents)}
    assert {r.doc_id for r in QUERIES["op9_quality_rules"](spark, SF_DIR).filter("kept").collect()} == kept


def test_pipeline_stages(spark, documents):
    rows = [documents[k] for k in verdicts(documents)]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        results.append(docs)
    assert sorted(map(tuple, results[0].collect())) == sorted(map(tuple, rows))

    fps = [brute.fingerprint(r.text) for r in rows]
    best = {}
    for r, root in zip(rows, brute.components(fps)):
        best[root] = min(best.get(root, r), r, key=lambda x: x.doc_id)
    rows = list(best.values())
    assert sorted(map(tuple, results[1].collect())) == sorted(map(tuple, rows))

    bench = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {x[0] for x in brute.contamination([(r.doc_id, r.text) for r in rows], bench) if x[-1]}
    rows = [r for r in rows if r.doc_id not in hit]
    assert hit and sorted(map(tuple, results[2].collect())) == sorted(map(tuple, rows))

    redacted = {r.doc_id: r for r in results[3].collect()}
    assert set(redacted) == {r.doc_id for r in rows}
    for r in rows:
        spans = brute.personal(r.text)
        new = redacted[r.doc_id]
        assert not brute.personal(new.text) and (new.text == r.text or pii.candidates(r.text)[1])
        assert len(new.text) == new.n_chars or new.text == r.text
        assert sum(new.text.count(f"[{k.upper()}]") for k in pii.KINDS) >= bool(spans)

    tokens = defaultdict(int)
    for r in results[4].collect():
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(brute.WORD.findall(r.text)) + 1 for i, r in redacted.items()}
    for d, r in zip(results[:4], [docs] * 4):
        assert d.schema == spark.read.parquet(f"{SF_DIR}/documents.parquet").schema


def test_registered_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_contamination_query(spark, documents):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op4_benchmark_decontamination"](spark, SF_DIR).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got)) == sorted(brute.contamination([(r.doc_id, r.text) for r in documents], bench))


def test_substring_query(spark, documents):
    assert sorted(map(tuple, QUERIES["op2_substring_dedup"](spark, SF_DIR).collect())) == sorted(brute.without_repeats([(r.doc_id, r.text) for r in documents]))


def test_toxicity_query(spark):
    """Held out: the labels are wrong for some documents without any insult, so found are those that hold one."""
    insults = {"trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "scum", "loser", "moron"}
    tables = SF_DIR.replace("sf0.001", "sf0.01")
    labels, docs = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("labels", "documents"))
    rows = QUERIES["op8_toxicity"](spark, tables).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").filter("held_out").collect()
    holds = [bool(insults & {toxicity.unit(w) for w in toxicity.words_of(r.text or "")}) for r in rows]
    assert sum(holds) >= 4 and all(r.predicted for r, h in zip(rows, holds) if h)
    assert sum(r.predicted for r, h in zip(rows, holds) if not h) <= len(rows) // 50


def test_toxicity_learns_despite_wrong_labels():
    """One clean document in twenty is labelled toxic; recall, precision, and spellings never seen."""
    rng = random.Random(4)
    common = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    insults = ["dumbhead", "fatface", "jerkwad", "pigbrain"]
    bags, truth = [], []
    for i in range(700):
        bad = i % 6 == 0
        words = rng.choices(common, k=60) + ([rng.choice(insults)] if bad else [])
        bags.append((bad or rng.random() < 0.05, " ".join(words)))
        truth.append(bad)
    machine = toxicity.fit(bags[:500])
    said = [machine.probability(machine.worst(t)) >= 0.5 for _, t in bags[500:]]
    right = sum(a and b for a, b in zip(said, truth[500:]))
    assert right >= 0.9 * sum(truth[500:]) and right >= 0.9 * sum(said)
    for word in insults:
        k = len(word) // 2
        for spelling in (word.upper(), word + "!!", word[:k] + "-" + word[k:], " ".join(word), word[:k] + word[k - 1 :]):
            assert machine.probability(machine.worst(f"{common[0]} {spelling} {common[1]}")) >= 0.5, spelling


def test_toxicity_tolerates_letters_put_in():
    """At every place, with letters the machine need not have met; clean words altered alike stay clean, and so does a clean neighbour."""
    rng = random.Random(8)
    common = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    insults, near = ["dumbhead", "fatface", "jerkwad", "pigbrain", "grumblers"], "grumbler"
    bags = []
    for i in range(600):
        words = rng.choices(common, k=60) + ([rng.choice(insults)] if i % 6 == 0 else [near] * (i % 3 == 0))
        bags.append((i % 6 == 0, " ".join(words)))
    machine = toxicity.fit(bags)
    says = lambda w: machine.probability(machine.worst(w)) >= 0.5
    put_in = lambda w: [w[:k] + c + w[k:] for k in range(1, len(w)) for c in rng.sample("abcdefghijklmnopqrstuvwxyz", 5) + [w[k - 1]]]
    altered = [says(v) for w in insults[:4] for v in put_in(w)]
    assert sum(altered) >= 0.9 * len(altered)
    assert not says(near) and all(map(says, insults))
    clean = [says(v) for w in common[:60] if len(w) > 3 for v in put_in(w)]
    assert sum(clean) <= 0.02 * len(clean)


def test_toxicity_examples_are_one_a_document(spark):
    docs = spark.createDataFrame([(i, t) for i in range(1, 9) for t in ("b same same " + "x" * 40, "a other i d i o t", None)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.examples(docs, labels)
    assert got == toxicity.examples(docs.repartition(2), labels) and {u for _, u in got} == {"\n".join(sorted(["a", "other", "i", "d", "o", "t", "idiot"]))}
