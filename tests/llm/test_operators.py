"""The ten operators on rows that are easy to get wrong, against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from verdikt.llm import chat, ctw, decontamination, packing, pii, quality, sharding, simhash, substrings, toxicity
from verdikt.llm.fm import FMIndex

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, n_words long, kept string, fp string, chunk int, number string, spans string, _text string"


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = [sentence(rng, n) for n in (60, 120, 300, 80, 5)]
    passage = sentence(rng, 70)
    texts = [None, "", "   \n\t", "one", *base, *base[:3], base[1] + " more words", base[1].replace(" ", "  "), base[2].upper()]
    texts += [sentence(rng, 40) + " " + passage + " " + sentence(rng, 30) for _ in range(4)]
    texts += ["a b " * 400, "same line here\n" * 40, "x" * 5000, sentence(rng, 20000, 5000)]
    texts += ["mail bob.x@mail7.example.com or +1 (017) 555-7713 from 10.0.0.1", "card 4111 1111 1111 1111, 4111-1111-1111-1112; a@b.c_d@e.f +49 (0) 12 é@x.y 1.2.3.4.5.6.7.8 300.1.1.1", "ünï çödé 漢字 " * 30]
    out = [(i, t, ["en", "de", None][i % 3], ["s0", None][i % 2], None, "r", i, "k", None, 1, "n", None, "t") for i, t in enumerate(texts)]
    # repeated rows, one id with two texts, and rows without id
    return out + [out[5], out[6], (out[7][0], "another text of the same id " + base[1], *out[7][2:]), (None, base[0], *out[0][2:]), (None, passage, *out[0][2:])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def same(got, want):
    return Counter(map(tuple, got)) == Counter(map(tuple, want))


# ---- quality rules


def test_quality_measures(docs, rows):
    got = quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert same(got, [(d, *brute.quality(t)) for d, t in pairs(rows)])


def test_quality_texts_without_words(spark):
    """The verdict of texts without words, among others, does not divide by their number of words."""
    rng = random.Random(7)
    texts = [sentence(rng, 200, 5000) for _ in range(30)] + ["", None, " \n\t", "\n"]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)] + [(50, "", None, None), (None, None, "de", "web")]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), least_docs=20).collect()
    assert same([tuple(r)[:-1] for r in got], [(r[0], *brute.quality(r[1])) for r in rows])
    assert {r.doc_id for r in got if r.n_words == 0 and r.base_failed and not r.kept} == {30, 31, 32, 33, 50, None}
    assert sum(r.kept for r in got) >= 25


def test_quality_keeps_rows_as_they_are(docs, rows):
    kept = quality.keep_good(docs, least_docs=1)
    assert kept.schema == docs.schema
    verdict = quality.judged(docs, least_docs=1)
    assert kept.count() == verdict.filter("kept").count() and not verdict.filter("kept and base_failed").count()
    assert not Counter(map(tuple, kept.collect())) - Counter(rows)


def test_quality_fences_follow_the_group(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 200) + (" ###" * 5 if i % 2 else ""), "en", "marked" if i % 2 else "plain", None) for i in range(80)]
    rows += [(1000, sentence(rng, 200) + " #x" * 190, "en", "plain", None), (1001, sentence(rng, 200), "xx", "few", None)]
    out = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), least_docs=20).collect()}
    assert not out[1000] and all(k for i, k in out.items() if i != 1000)


def test_quality_fences_differ_in_every_measure(spark):
    """Two groups of other habits: each measure has its own fence in each, and what is usual in one is an outlier in the other."""
    rng = random.Random(5)
    plain = lambda: sentence(rng, 200, 5000)
    long_words = lambda: " ".join(w * rng.choice([2, 3]) for w in plain().split())
    odd = lambda: long_words() + " & %" * rng.randrange(1, 9) + "\na line\na line" * rng.randrange(1, 4) + " one more time" * rng.randrange(2, 30)
    rows = [(i, odd() if i % 2 else plain(), "en", "odd" if i % 2 else "plain", None) for i in range(120)]
    rows.append((1000, odd(), "en", "plain", None))
    m = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), [F.col(c) for c in ("doc_id", "lang", "source")])
    f = {r.fence_source: r for r in quality.fences(quality.sketches(m), least_docs=20).collect()}
    for measure, low, *_ in quality.FENCES:
        side = f"{measure}_{'low' if low else 'high'}"
        assert f["odd"][side] > f["plain"][side], side
    verdict = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), least_docs=20).collect()}
    assert not verdict[1000] and sum(verdict.values()) >= 117


def test_quality_sketch_is_mergeable(spark, docs):
    m = quality.measured(docs, [F.col("doc_id"), F.col("lang"), F.col("source")])
    one, other = quality.sketches(m), quality.sketches(m.repartition(7))
    assert same(one.collect(), other.collect())


# ---- near copies


def test_simhash(docs, rows):
    got = {}
    for r in simhash.near_copies(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    fps = [brute.fingerprint(t) for _, t in pairs(rows)]
    root = brute.components(fps)
    names = defaultdict(list)
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            names[r].append(rows[k][0])
    want = {}
    for k, (d, _) in enumerate(pairs(rows)):
        want.setdefault(d, set()).add((f"{fps[k]:016x}", min(names[root[k]], default=None)))
    assert got == want


def test_simhash_keeps_one_of_each_class(docs, rows):
    kept = simhash.keep_one(docs)
    fps = [brute.fingerprint(t) for _, t in pairs(rows)]
    assert kept.schema == docs.schema and kept.count() == len(set(brute.components(fps)))


@pytest.mark.parametrize("node_rows", [1 << 20, 3])
def test_trie_join_finds_every_link(spark, node_rows):
    rng = random.Random(node_rows)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:30]:
        for _ in range(4):
            v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = simhash.links(frame, node_rows).collect()
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        a, b = a % (1 << 64), b % (1 << 64)
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = brute.components(values)
    assert len({find(v) for v in values}) == len(set(want))
    assert all(find(values[w]) == find(v) for v, w in zip(values, want))


# ---- decontamination


@pytest.fixture(scope="module")
def items(rows):
    texts = [t for _, t in pairs(rows) if t and len(t.split()) > 60]
    return [(1, " ".join(texts[0].split()[5:30])), (2, " ".join(texts[1].split()[3:16])), (3, " ".join(texts[0].split()[8:22])), (3, "漢字 ünï"), (None, "one"), (4, ""), (5, None), (6, " ".join(texts[2].split()[:12]))]


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 300])
def test_contamination(spark, docs, rows, items, block_words):
    got = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], block_words=block_words)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    got = got.select("doc_id", "n_words", "n_hit", F.size("items"), digest, "contaminated").collect()
    assert same(got, brute.contamination(pairs(rows), items))


def test_documents_are_written_once_for_all_blocks(spark, docs, items, monkeypatch):
    written, seen = [], []
    land, blocks = decontamination.landed, decontamination.blocks
    monkeypatch.setattr(decontamination, "landed", lambda df, name: (written.append(name), land(df, name))[1])
    monkeypatch.setattr(decontamination, "blocks", lambda *a: (seen.append(b) or b for b in blocks(*a)))
    got = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], block_words=100)
    assert len(seen) >= 10 and written == ["decontamination", "decontamination-blocks"]
    assert got.count() == docs.count()


def test_contamination_filter(spark, docs, rows, items, empty):
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontamination.keep_clean(docs, bench)
    assert kept.schema == docs.schema
    assert kept.count() == sum(not x[-1] for x in brute.contamination(pairs(rows), items))
    assert decontamination.keep_clean(docs, bench.limit(0)).count() == len(rows)
    assert decontamination.keep_clean(empty, bench).count() == 0


def test_index_locates_every_occurrence():
    rng = random.Random(4)
    for _ in range(40):
        seq = np.array([0, *[rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 60))], 0])
        index = FMIndex(seq, 4, sample=3)
        for m in (1, 2, 4):
            pattern = np.array([[rng.randrange(1, 4) for _ in range(m)]])
            lo, hi = index.search(pattern)
            where = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert where == [k for k in range(len(seq) - m + 1) if (seq[k : k + m] == pattern[0]).all()]


# ---- personal data


def test_personal_base(docs, rows):
    got = pii.found(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    want = []
    for d, t in pairs(rows):
        b = brute.personal(t)
        want.append((d, *[sum(k == j for k, _, _ in b) for j in range(4)], brute.sha(pii.joined(b))))
    assert same(got, want)


def test_personal_fuzz():
    rng = random.Random(3)
    bits = ["a", "b.", "@", "@", "1", "12", "345", ".", "+", " ", "-", "(", ")", "_", "%", "é", "1.2.3.4", "4111 1111 1111 1111", "x@y.de", "0" * 30]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        assert pii.candidates(t)[0] == brute.personal(t), t


def test_labelers_are_weighed():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < r, np.where(truth, 1, 2), np.where(truth, 2, 1)) for r in (0.95, 0.9, 0.85, 0.55)], 1)
    p = pii.estimate(votes, np.ones(4000), truth & (rng.random(4000) < 0.2))
    assert ((p > 0.5) == truth).mean() > 0.95


def test_added_spans_and_redaction(spark):
    said = [(i, f"call +1 (826) 555-40{i:02d} or ip 10.1.2.{i}", 1) for i in range(90)] + [(100, "see +1 (826) 555-4081 190.137.20.11 now", 1), (101, "nothing 1234567890123456 here", 7)]
    df = spark.createDataFrame(said, "doc_id long, text string, n_chars int")
    spans = {r.doc_id: r.spans for r in pii.found(df).collect()}
    assert "phone:4:21" in spans[100] and spans[101] == ""
    out = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert out[3].text == "call [PHONE] or ip [IP]" and out[3].n_chars == len(out[3].text)
    assert out[101].text == said[-1][1] and out[101].n_chars == 7 and "555" not in out[100].text


def test_redaction_keeps_columns(docs, rows):
    out = pii.redacted(docs)
    assert out.schema == docs.schema and out.count() == len(rows)
    assert sum(r.text is None for r in out.collect()) == 1


# ---- packing


def naive_cost(histogram, lengths):
    bins, left = [], dict(histogram)
    for x in sorted(histogram, reverse=True):
        for c in range(histogram[x], 0, -1):
            fit = [b for b in bins if b[0] - sum(b[1]) >= x]
            if not fit:
                left[x] = c
                bins.append((packing.least_cost(x, left, sorted(lengths), packing.sequence_cost), []))
            (min(fit, key=lambda b: b[0] - sum(b[1])) if fit else bins[-1])[1].append(x)
        left.pop(x, None)
    return sum(packing.sequence_cost(min(c for c in lengths if c >= sum(b))) for _, b in bins)


def test_bins_hold_every_piece_once():
    rng = random.Random(1)
    for _ in range(150):
        lengths = rng.choice([(8, 16, 32), (10, 25, 40), (64,)])
        histogram = {rng.randint(1, max(lengths)): rng.randint(1, 30) for _ in range(rng.randint(1, 10))}
        seen, use = Counter(), defaultdict(list)
        for length, first, pieces, per, bin_, offset, capacity, fill in packing.plan_bins(histogram, lengths):
            for i in range(pieces):
                seen[length, first + i] += 1
                use[bin_ + i // per].append((offset + i % per * length, length, capacity, fill))
        assert seen == Counter((x, i) for x in histogram for i in range(histogram[x]))
        cost = 0
        for pieces in use.values():
            at = 0
            for place, length, capacity, fill in sorted(pieces):
                assert place == at
                at += length
            assert at == fill and capacity == min(c for c in lengths if c >= fill)
            cost += packing.sequence_cost(capacity)
        assert cost <= 1.1 * naive_cost(histogram, lengths) + packing.sequence_cost(min(lengths))


def test_packed_documents(docs, rows, empty):
    got = packing.packed(docs, (16, 64, 256)).collect()
    by_bin, tokens = defaultdict(list), Counter()
    for r in got:
        by_bin[r.bin].append(r)
        tokens[r.doc_id] += r.length
        assert r.first_token == r.piece * 256
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.place):
            assert r.place == at
            at += r.length
        assert {(r.fill, r.capacity) for r in pieces} == {(at, min(c for c in (16, 64, 256) if c >= at))}
    want = Counter()
    for d, t in pairs(rows):
        want[d] += len(brute.WORD.findall(t or "")) + 1
    assert tokens == want
    assert packing.packed(empty).count() == 0


# ---- chat


def test_chat_reads_back(spark):
    rng = random.Random(2)
    rows = [(9, i, rng.choice(["user", "assistant"]), rng.choice(["<|x|> a", "<\\|x b\\", "", None, "<", "|c <\\\\| d " * rng.randint(1, 60), "<|im_end|><|im_start|>assistant ok"])) for i in range(2500)]
    rows += [(9, -1, "system", "be <| good"), (None, 0, "a\nb<|", "x"), (None, None, None, None), (5, 0, "system", "only"), (6, 0, "assistant", "w " * 2000), (6, 0, "assistant", "w " * 2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    w = chat.windows(df).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(w).collect()}
    assert got == brute.conversations(rows)
    for r in w.collect():
        assert r.tokens <= chat.BUDGET or r.text.count(chat.OPEN) <= r.repeated + 1
        assert r.text.count(chat.OPEN) == r.text.count(chat.CLOSE)
    assert any(r.repeated for r in w.collect())
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


# ---- sharding


def test_shards(docs, rows, empty):
    got = sharding.laid_out(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    import zlib

    assert same([(r.doc_id, r["size"], r.text_crc32) for r in got], [(d, size(t), zlib.crc32((t or "").encode())) for d, t in pairs(rows)])
    slots, total, most = defaultdict(list), sum(r["size"] for r in got), max(r["size"] for r in got)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    bytes_of = Counter()
    for r in got:
        bytes_of[r.shard] += r["size"]
    assert all(abs(b - total / 16) <= most for b in bytes_of.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    assert sharding.laid_out(empty).count() == 0


# ---- repeated passages


def test_without_repeats(docs, rows, empty):
    assert same(substrings.without_repeats(docs).collect(), brute.without_repeats(pairs(rows)))
    assert substrings.without_repeats(empty).count() == 0


def test_matching_statistics():
    rng = random.Random(5)
    for _ in range(40):
        length, symbols = rng.choice([3, 4, 5]), rng.choice([2, 3, 6])
        seqs = [[rng.randint(1, symbols) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 8))]
        own = np.array(rng.sample(range(100), len(seqs)))
        matcher = substrings.Matcher([np.array(s) for s in seqs], own, symbols + 2, length)
        queries = [[rng.randint(1, symbols + 1) for _ in range(rng.randint(1, 20))] for _ in range(5)] + seqs
        for q, lens, who in zip(queries, *matcher.stream([np.array(q) for q in queries])):
            for i in range(len(q)):
                has = lambda p: [j for j, s in enumerate(seqs) if any(p == s[k : k + len(p)] for k in range(len(s) - len(p) + 1))]  # noqa: B023, E731
                want = max([m for m in range(1, min(length, len(q) - i) + 1) if has(q[i : i + m])], default=0)
                assert lens[i] == want and (want < length or who[i] == min(own[j] for j in has(q[i : i + length])))


def test_blocks_of_one_anchor_agree():
    rng = random.Random(8)
    base = [f"{k}".encode() for k in range(90)]
    seqs = []
    for _ in range(20):
        s = list(base)
        s[rng.randrange(90)] = b"x%d" % rng.randrange(4)
        seqs.append(s[: rng.randrange(60, 90)])
    own = np.array(rng.sample(range(1000), 20))
    one, many = substrings.window_owners(seqs, own), substrings.window_owners(seqs, own, shard_words=150)
    assert all(np.array_equal(a, b) for a, b in zip(one, many))


# ---- toxicity


def test_toxicity(spark, docs, rows, empty):
    rng = random.Random(6)
    bad = ["blorkhead", "vastrung", "quimpelt"]
    said, labels = [], []
    for i in range(400):
        toxic = i % 3 == 0
        words = [f"{rng.choice(['ka', 'lo', 'mi', 'ten'])}{rng.choice(['ra', 'su', 'pe', 'nor'])}{rng.choice(['', 'di', 'va'])}" for _ in range(40)]
        if toxic:
            words.insert(rng.randrange(40), rng.choice(bad))
        said.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    said += [(1000, "kara losu blorrkhead mipe"), (1001, "kara b l o r k h e a d losu"), (1002, None), (None, "kara losu"), (1003, "kara vast-rung."), (1004, "kara qu1mpelt")]
    df, lab = spark.createDataFrame(said, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.scored(df, lab).collect()}
    truth = dict(labels)
    held = [i for i in truth if brute.crc(i) % 5 == 0]
    assert all(out[i].held_out == (brute.crc(i) % 5 == 0) for i in truth)
    assert sum(out[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert all(out[i].predicted for i in (1000, 1001, 1003, 1004)) and not out[1002].predicted and not out[None].predicted
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert toxicity.scored(docs, lab.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.scored(empty, lab).count() == 0


def test_machine_learns_from_training_folds_only(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    texts = {t for _, t in toxicity.examples(df, lab)}
    assert texts == {f"text {i}" for i in range(50) if brute.crc(i) % 5}


# ---- context trees


def test_base_score(docs, rows, empty):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score) for r in ctw.scored(docs).collect()))
    want = sorted(((d is None, d or 0, n, h, k, t, s) for d, h, n, k, t, s in brute.unigram(pairs(rows))))
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert np.allclose([g[-1] for g in got], [w[-1] for w in want])
    assert ctw.scored(empty).count() == 0


def test_context_tree():
    texts = ["the cat sat on the mat", "Das Übel, ä", "", "aaaa bbbb aaaa", "the dog"]
    low = [t.translate(brute.LOWER).encode() for t in texts]
    score = brute.context_tree(low[:4])
    counts = Counter()
    for b in low[:4]:
        s = b"\0\0" + b + b"\0"
        counts.update(s[k - 2] << 16 | s[k - 1] << 8 | s[k] for k in range(2, len(s)))
    keys = np.array(sorted(counts))
    table = ctw.Tree(keys, np.array([counts[k] for k in keys])).table()
    assert np.allclose(ctw.scores(pa.array(texts), table), [score(b) for b in low], rtol=1e-5)
    row, logs = table
    assert np.allclose((10.0 ** logs.astype(float)).sum(1), 1, atol=1e-4)
