"""Held-out accuracy, tolerance of changed spellings, the kernel by definition, and defined results at the edges."""

import itertools
import random
import zlib

import numpy as np
import pytest

from quire.llm import toxicity as tx

INSULTS = ["blorf", "snargle", "quimpy", "grozzit"]


def corpus(n, seed=1):
    r = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    for i in range(n):
        words = [word() for _ in range(r.randint(3, 80))]
        toxic = i % 3 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(INSULTS))
        yield i, " ".join(words), int(toxic)


@pytest.fixture(scope="module")
def machine():
    rows = [x for x in corpus(900) if zlib.crc32(str(x[0]).encode()) % 4 != tx.HELD_OUT]
    return tx.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]), 1 / 3)


def test_held_out(machine):
    rows = [x for x in corpus(900) if zlib.crc32(str(x[0]).encode()) % 4 == tx.HELD_OUT]
    score = machine.scores([t.encode() for _, t, _ in rows])
    right = (score >= tx.THRESHOLD) == np.array([y == 1 for *_, y in rows])
    assert right.mean() > 0.97


def test_changed_spellings(machine):
    score = lambda t: machine.scores([("tala " + t + " mina").encode()])[0]
    for t in ("snargle", "SNARGLE!", "s n a r g l e", "snar-gle", "sn4rgle", "snarggle", "(snargle)", "s.n.a.r.g.l.e"):
        assert score(t) >= tx.THRESHOLD, t
    for t in ("talatina", "gala", "s", "", "..."):
        assert score(t) < tx.THRESHOLD, t


def by_definition(a, b):
    """Subsequences of three symbols with a span of at most five, normalized by their own weights."""

    def weights(w):
        padded = [0, *w, 0]
        out, square = {}, 0.0
        for i, j, k in itertools.combinations(range(len(padded)), 3):
            if k - i <= 4:
                weight = tx.DECAY ** (k - i - 2)
                code = (padded[i], padded[j], padded[k])
                out[code] = out.get(code, 0) + weight
                square += weight**2
        return out, square**0.5

    (x, n), (y, m) = weights(a), weights(b)
    return sum(v * y.get(c, 0) for c, v in x.items()) / (n * m)


def test_kernel_by_definition():
    words = [bytes(ord(c) - 96 for c in w) for w in ("idiot", "idiiot", "id", "stupid", "a", "banana")]
    got = tx.kernel(words, words)
    want = [[by_definition(a, b) for b in words] for a in words]
    assert np.allclose(got, want, atol=1e-5)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "fine words here", 0.5), (2, None, 0.5), (3, "", 0.5), (3, "", 0.5), (None, "x " * 100_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    for labels in (none, one):
        m = tx.fit(docs, labels)
        got = tx.score_texts(docs.select("doc_id", "text"), m).collect()
        assert len(got) == 5 and all(0 <= r.score < tx.THRESHOLD for r in got)
        assert tx.without_toxic(docs, labels).count() == 5
    assert tx.score_texts(docs.limit(0).select("doc_id", "text"), m).count() == 0


def test_sample_ignores_held_out_rows(spark):
    rows = list(corpus(120))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == tx.HELD_OUT else y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = tx.fit(docs, labels), tx.fit(docs, flipped)
    assert np.array_equal(a.table, b.table) and (a.slope, a.offset) == (b.slope, b.offset)


def test_query_by_brute_force(spark, sf):
    """op5_toxicity against a machine that is trained here from the rows that may teach it, text by text; and what it misses."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == tx.HELD_OUT
    known = sorted(i for i in labels if not held(i))
    taught = [i for i in known if i in docs and len((docs[i] or "").encode()) <= tx.TRAIN_BYTES]
    machine = tx.train([(docs[i] or "").encode() for i in taught], np.array([labels[i] for i in taught]), sum(labels[i] for i in known) / len(known))
    found = {r.doc_id: r for r in tx.op5_toxicity(spark, sf).collect()}
    assert set(found) == set(docs)
    for i, text in docs.items():
        score = machine.scores([(text or "").encode()])[0]
        assert abs(found[i].score - score) < 1e-9
        assert found[i].held_out == held(i) and found[i].predicted == (found[i].score >= tx.THRESHOLD)


def test_held_out_accuracy_of_the_test_data(spark):
    """On the largest test table: the smaller ones have no more than 14 toxic texts that training never saw."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in tx.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y in rows if y], [s for s, y in rows if not y]
    area = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    caught, wrong = sum(s >= tx.THRESHOLD for s in bad), sum(s >= tx.THRESHOLD for s in good)
    print(f"held out: {len(rows)} texts, {len(bad)} toxic, area {area:.3f}, precision {caught / (caught + wrong):.3f}, recall {caught / len(bad):.3f}")
    assert area > 0.9


def test_long_texts_and_clashing_names(spark, machine):
    text = "tala mina " * 60_000 + "snargle" + " tala mina" * 40_000
    assert machine.scores([text.encode()])[0] >= tx.THRESHOLD > machine.scores([("tala mina " * 100_000).encode()])[0]
    rows = list(corpus(60))
    docs = spark.createDataFrame([(i, t, "z", t, "w") for i, t, _ in rows], "doc_id long, text string, _toxicity string, _text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    kept = tx.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert all(r._toxicity == "z" and r._text == r.text and r.score == "w" for r in kept.collect())
