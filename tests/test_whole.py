"""Queries over whole tables: no row of the input stays outside. Their values are compared with SQL in test_queries."""

import difflib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quire.functions.text import SEARCH_STOP_WORDS
from quire.operators import hybrid, match, texts
from quire.plans import registry


def rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_queues_hold_all_orders(spark, sf):
    keys = {r.o_orderkey for r in rows(spark, sf, "orders").select("o_orderkey").collect()}
    run = lambda n: registry.QUERIES[n](spark, sf)
    assert sum(r.n for r in run("queue_status").collect()) == len(keys)
    assert {r.bookid for r in run("queue_transition").collect()} == keys
    assert {r.bookid for r in run("queue_seed").collect()} == keys


def test_children_of_all_orders(spark, sf):
    orders, line = rows(spark, sf, "orders"), rows(spark, sf, "lineitem")
    want = {r[0] for r in line.select("l_orderkey").collect()} | {r[0] for r in orders.where("o_orderstatus = 'F'").select("o_orderkey").collect()}
    assert {r.l_orderkey for r in registry.QUERIES["replace_children"](spark, sf).collect()} == want


def test_markers_of_all_documents(spark, sf):
    assert registry.QUERIES["marker_mismatch"](spark, sf).where("id >= 0").count() == rows(spark, sf, "documents").count()


def brute_cascade(queries, books):
    """The stages of title_cascade, query by query and book by book; titles are lower-case words."""
    stop = {"the", "and"}
    key = lambda t: " ".join(t.split())
    words = lambda t: {w for w in key(t).split() if len(w) > 2 and w not in stop}
    fits = lambda a, names: any(a == n or len(set(a.split()) & set(n.split())) >= 2 for n in names)
    out = {}
    for i, title, author, year in queries:
        same = [b for b in books if key(title) and key(b[1]) == key(title)]
        by = [b for b in same if author and fits(author, b[2])]
        both = [b for b in by if year is not None and b[3] == year]
        stages = [(n, x) for n, x in (("title_author", by), ("title_author_year", both), ("unique_title", same)) if len(x) == 1]
        if stages:
            out[i] = (stages[0][1][0][0], stages[0][0], None)
            continue
        found = []
        for k, name, names, issued in books:
            if words(title) and words(title) <= words(name) and (not author or fits(author, names)):
                near = 100 if key(title) == key(name) else 75 if key(title) in key(name) else 50 if key(name) in key(title) else 0
                score = len(words(title)) + near + 20 * (year is not None and year == issued)
                if score >= 12:
                    found.append((-score, len(words(name)), len(key(name)), k))
        if found:
            out[i] = (min(found)[3], "loose", -min(found)[0])
    return out


def test_title_cascade_by_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice(["ring", "bolt", "gear", "old", "hot", "the"])
    title = lambda n: " ".join(word() for _ in range(n))
    author = lambda: r.choice(["ann lee", "bob ray", "cyd fox"])
    year = lambda: r.choice([1801, 1802, None])
    books = [(i, title(r.randint(1, 4)), [author() for _ in range(r.randint(1, 2))], year()) for i in range(150)]
    books += [(150 + i, *books[i][1:]) for i in range(30)]
    books += [(200, "lone gear of tin", ["ann lee"], None), (201, "lone bolt of tin", ["bob ray"], 1801), (202, "lone bolt of tin", ["bob ray"], 1802)]
    queries = [(i, title(r.randint(1, 3)), r.choice([author(), "", None]), year()) for i in range(150)]
    queries += [(150 + i, *queries[i][1:]) for i in range(30)] + [(200, "lone gear of tin", "x y", 1801), (201, "lone bolt of tin", "bob ray", 1802), (202, "lone gear of tin", "ann lee", None)]
    asked = spark.createDataFrame(queries, "query_id bigint, title string, author string, year int")
    known = spark.createDataFrame(books, "bookid bigint, title string, authors array<string>, year int")
    found = [tuple(x) for x in match.title_cascade(asked, known).select("query_id", "bookid", "stage", "score").collect()]
    want = brute_cascade(queries, books)
    assert {x[0]: x[1:] for x in found} == want and len(found) == len(want)
    assert set(Counter(x[1] for x in want.values())) == {"title_author", "title_author_year", "unique_title", "loose"}


def test_title_cascade_asks_for_all_parts(spark, sf):
    keys = {x.p_partkey for x in rows(spark, sf, "part").select("p_partkey").collect()}
    assert {x.query_id for x in registry.QUERIES["title_cascade"](spark, sf).collect()} == keys


def test_text_match_holds_all_parts(spark, sf):
    found = {(x.x, x.parts) for x in registry.QUERIES["text_match"](spark, sf).select("x", "parts").distinct().collect()}
    assert sum(n for _, n in found) == rows(spark, sf, "part").count()


def test_lexical_ratio_of_whole_texts(spark, sf):
    docs = rows(spark, sf, "documents")
    norm = lambda t: " ".join(re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).split())
    cleaned = docs.select("doc_id", "text", texts.clean(F.col("text")).alias("c")).collect()
    want = {x.doc_id: difflib.SequenceMatcher(None, norm(x.text), norm(x.c)).ratio() for x in cleaned}
    assert {x.doc_id: x.ratio for x in registry.QUERIES["lexical_ratio"](spark, sf).collect()} == want
    assert len(want) == docs.count()


def test_cosine_searches_for_every_twentieth(spark, sf, monkeypatch):
    keys = {x.vec_id for x in rows(spark, sf, "embeddings").select("vec_id").collect()}
    run = lambda: {(x.q, x.rank): (x.vec_id, x.score) for x in registry.QUERIES["cosine_topk"](spark, sf).collect()}
    whole = run()
    assert {q for q, _ in whole} == {k for k in keys if k % 20 == 0} and len(whole) == 10 * len({q for q, _ in whole})
    monkeypatch.setattr(hybrid, "QUERY_BLOCK", 7)
    monkeypatch.setattr(hybrid, "VECTOR_BLOCK", 60)
    assert run() == whole


def test_banded_search_by_brute_force(spark, sf):
    def grams(t):
        padded = f"  {t} "
        return {padded[i : i + 3] for i in range(len(padded) - 2)}

    parts = [(x.p_partkey, x.p_name, x.p_size) for x in rows(spark, sf, "part").collect()]
    queries = [(1, "small ring"), (2, "ring small"), (3, "blue"), (4, "red widgets")] + [(k + 100, n) for k, n, _ in parts if k % 20 == 0]
    want = {}
    for q, text in queries:
        for k, name, size in parts:
            a, b = set(text.split()), set(name.split())
            alike = len(grams(text) & grams(name)) / len(grams(text) | grams(name))
            bands = [1050.0] * (text == name) + [950.0] * (sorted(text.split()) == sorted(name.split()))
            if a & b:
                bands += [800 + 50 * alike] * (text in name) + [600 + 50 * alike] * (alike >= 0.55)
            if bands:
                want[q, k] = round(max(bands) + 10 * math.log(max(size, 1)), 6)
    found = registry.QUERIES["banded_search"](spark, sf).collect()
    assert {(x.query_id, x.bookid): x.score for x in found} == want and len(found) == len(want)


def test_passages_with_all_their_tokens(spark, sf):
    words = lambda t: {w for w in re.split(r"[^\w]+", t.lower()) if len(w) >= 2} - set(SEARCH_STOP_WORDS)
    docs = {x.doc_id: words(x.text) for x in rows(spark, sf, "documents").collect()}
    want = {(x.item_id, d) for x in rows(spark, sf, "benchmark").collect() for d, w in docs.items() if words(x.text) <= w}
    assert {tuple(x) for x in registry.QUERIES["passage_contains"](spark, sf).collect()} == want
