"""Removed bytes against brute force, and longest previous factors against their definition."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quire.llm import suffix_dedup as sd


def brute(texts, first=False):
    where = defaultdict(list)
    raw = {i: (t or "").encode() for i, t in texts}
    for i in sorted(raw):
        for p in range(len(raw[i]) - sd.LEAST + 1):
            where[raw[i][p : p + sd.LEAST]].append((i, p))
    out = {}
    gone = {i: np.zeros(len(r), bool) for i, r in raw.items()}
    for places in where.values():
        if len(places) > 1:
            for i, p in places[1:] if first else places:
                gone[i][p : p + sd.LEAST] = True
    for i, r in raw.items():
        g = gone[i]
        out[i] = (len(r), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), np.frombuffer(r, np.uint8)[~g].tobytes())
    return out


def fixture():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    p, q = prose(80), prose(45)
    texts = [prose(60) + p + prose(20), p, p[5:] + prose(10), prose(30) + q + prose(5) + q, q + p, "x" + q[3:240] + "y", "aaaa" * 200, "ab" * 300, None, "", "short", p[:150], prose(200)]
    base = prose(300).split(" ")
    for _ in range(12):
        words = list(base)
        for _ in range(4):
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [texts[1], texts[13], "\n".join([prose(20), p, prose(20), p])]
    return list(enumerate(texts))


@pytest.mark.parametrize(("keep", "hot"), [("none", sd.HOT), ("none", 1), ("none", 4), ("first", sd.HOT), ("first", 1), ("first", 4)])
def test_against_brute_force(spark, keep, hot):
    texts = fixture()
    rows = spark.createDataFrame([(i, t, i) for i, t in texts], "doc_id long, text string, place long")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(rows, keep, hot).collect()}
    assert found == brute(texts, keep == "first")


def test_test_data(spark, documents):
    texts = [(i, t) for i, t in enumerate(documents) if len(t) < 4000][:90]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(rows).collect()}
    assert found == brute(texts)
    assert sd.remove_repeats(rows.limit(0)).count() == 0


def test_longest_previous_factors():
    r = random.Random(1)
    for n in (1, 2, 30):
        s = "".join(r.choice("ab") for _ in range(n))
        sa = sorted(range(n), key=lambda i: s[i:])
        common = lambda i, j: next((k for k in range(n) if i + k >= n or j + k >= n or s[i + k] != s[j + k]), n)
        lcp = [0] + [common(sa[i - 1], sa[i]) for i in range(1, n)]
        want = [max([0, *(common(i, j) for j in range(i))]) for i in range(n)]
        assert sd.lpf(sa, lcp) == want


def test_every_window_has_its_anchor():
    data = np.frombuffer("".join(random.Random(2).choice("abc ") for _ in range(3000)).encode(), np.uint8)
    at = set(sd.anchors(data)[0].tolist())
    assert all(any(p in at for p in range(s, s + sd.LEFT + 1)) for s in range(len(data) - sd.LEAST + 1))


def by_rows(rows, first=False):
    """Results of rows (doc_id, text), each a document of its own whatever its id, as a sorted list."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) if first else range(len(rows))
    found = brute([(place, rows[i][1]) for place, i in enumerate(order)], first)
    return sorted(((rows[i][0], *found[place]) for place, i in enumerate(order)), key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_null_and_repeated_ids(spark, keep):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcde") for _ in range(5)) for _ in range(n))
    p, a, b, c = prose(60), prose(90), prose(120), prose(70)
    rows = [(7, p + a), (7, b), (None, c + p), (None, b[:50] + c), (9, a), (None, None), (None, "short"), (3, p + prose(20)), (5, prose(50)), (5, prose(50))]
    rows += [(11, "z" * 400), (12, c), (12, c), (12, c), (None, prose(40))]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, k1 int")
    found = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in sd.remove_repeats(frame, keep).collect()), key=repr)
    assert found == by_rows(rows, keep == "first")


def test_thresholded_factors():
    r = random.Random(4)
    for _ in range(30):
        s = "".join(r.choice("ab") for _ in range(40))
        sa = sorted(range(40), key=lambda i: s[i:])
        common = lambda i, j: next((k for k in range(40) if i + k >= 40 or j + k >= 40 or s[i + k] != s[j + k]), 40)
        lcp = [0] + [common(sa[i - 1], sa[i]) for i in range(1, 40)]
        factors = sd.lpf(sa, lcp)
        for least in (1, 3, 6):
            assert sd.has_earlier(np.array(sa), np.array(lcp), least).tolist() == [factors[i] >= least for i in sa]


def test_long_texts_in_stretches(monkeypatch):
    data = np.frombuffer("".join(random.Random(6).choice("abc ") for _ in range(30_000)).encode(), np.uint8)
    whole = sd._anchors_of(data)
    monkeypatch.setattr(sd, "STRETCH", 3000)
    assert all(np.array_equal(x, y) for x, y in zip(sd.anchors(data), whole, strict=True))
