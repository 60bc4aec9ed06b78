"""Components against brute force over full shingle sets."""

import random

import pytest

from quire.llm import near_dup as nd


def brute(rows, percent=85):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def family(r, n, words, edits):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = word()
        yield " ".join(w)


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, key int")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(frame, nd.OP_PERCENT).collect()}


@pytest.mark.parametrize("block", [nd.BLOCK, 16])
def test_families(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    r = random.Random(5)
    texts = [*family(r, 70, 120, 6), *family(r, 40, 60, 3), *family(r, 30, 300, 12), "A b C", "a  B\tc", "a b", "", None, " \n", "Ünï ÜNÏ x y z", "ünï ÜNÏ x y z"]
    r.shuffle(texts)
    texts += texts[:5]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == {}
    found = run(spark, [(None, "one two three four five six"), (7, "one two three four five six"), (3, "one two three four five six")])
    assert found == {None: (2, None, True), 7: (2, 3, False), 3: (2, 3, True)}
    long = "w " * 200_000
    assert run(spark, [(1, long), (2, long)]) == {1: (1, 1, True), 2: (1, 1, False)}


def test_kept_documents(spark):
    rows = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (9, None, "z"), (None, "q", "n")], "doc_id long, text string, kept string")
    assert sorted((r.doc_id or 0, r.kept) for r in nd.without_near_duplicates(rows).collect()) == [(0, "n"), (1, "y"), (9, "z")]
