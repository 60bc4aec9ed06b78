"""The limit of similarity as a parameter: brute force at several limits."""

import random

import pytest

from quire.llm import near_dup as nd
from tests.llm.test_near_dup import family


def groups(rows, percent):
    """Each document's smallest linked one, by comparing full shingle sets until nothing changes."""
    sets = {i: {tuple(t.split()[k : k + nd.WORDS]) for k in range(len(t.split()) - nd.WORDS + 1)} for i, t in rows}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    before = None
    while before != least:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_limits(spark, percent):
    r = random.Random(11)
    rows = list(enumerate(t for _ in range(12) for t in family(r, 5, 100, 3)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x.component_id for x in nd.near_duplicates(frame, percent).collect()}
    assert found == groups(rows, percent)
    assert len({tuple(sorted(groups(rows, p).items())) for p in (80, 85, 90)}) == 3
    kept = {x.doc_id for x in nd.without_near_duplicates(frame, percent).collect()}
    assert kept == {i for i, c in found.items() if i == c}


def test_banding():
    assert nd.banding(85) == (5, 25) and nd.banding(80) == (4, 32)


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", "p", 7, "k"), (2, "a b c d e f", "q", 8, "l"), (None, "a b c d e f", "r", 9, "m")], "doc_id long, text string, _d string, kept_id long, kept string")
    found = nd.without_near_duplicates(rows)
    assert found.columns == rows.columns
    assert sorted((r.doc_id or 0, r._d, r.kept_id, r.kept) for r in found.collect()) == [(0, "r", 9, "m"), (1, "p", 7, "k")]


def test_texts_in_stretches(monkeypatch):
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 30))) for _ in range(3000)).encode() + b"\t" + b"x" * 5000 + b" end of it"
    whole = nd.shingle_sets([text, b"a b", text])
    monkeypatch.setattr(nd, "CHUNK", 1000)
    assert [s.tolist() for s in nd.shingle_sets([text, b"a b", text])] == [s.tolist() for s in whole]
