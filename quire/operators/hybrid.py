"""Hybrid search: banded title and author scores, trigrams, and fusion of rankings by reciprocal rank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FUSION_K = 60
TRIGRAM_LEAST = 0.55
#: Queries and vectors that are multiplied at once.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a padded text."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def rank_by(rows: DataFrame, query: str, score: str, key: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key)))


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, query: str = "query_id", key: str = "id", k: int = FUSION_K) -> DataFrame:
    """query, key and score from two rankings (query, key, rank): the sum of 1 / (k + rank), where an item may be in one only."""
    x = a.select(query, key, F.col("rank").alias("_a"))
    y = b.select(query, key, F.col("rank").alias("_b"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return x.join(y, [query, key], "full_outer").select(query, key, (part("_a") + part("_b")).alias("score"))


def author_score(surname: Column, given: Column, query_surname: Column, query_given: Column) -> Column:
    """surname similarity * (0.6 + 0.4 * given similarity); null below 0.6 of surname similarity."""
    edit = 1 - F.levenshtein(surname, query_surname) / F.greatest(F.length(surname), F.length(query_surname), F.lit(1))
    near = F.greatest(trigram_similarity(surname, query_surname), edit)
    same = F.when((given == "") | (query_given == ""), 0.5).when(given == query_given, 1.0).when(F.substring(given, 1, 1) == F.substring(query_given, 1, 1), 0.8).otherwise(0.0)
    return F.when(near >= 0.6, near * (0.6 + 0.4 * same))


def banded(books: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, bookid and score: the best band of each pair (equal title 1000, equal words 900, title inside 800, trigrams 600), plus 50 within a band and the logarithm of downloads.

    Candidates share a title word or the key, so no cross product arises; bands are unioned and the best is kept. Only distinct titles
    and queries are compared.
    """
    books = books.select("bookid", "numdownloads", T.search_title(F.col("title")).alias("t"), T.sorted_title_key(F.col("title")).alias("k"))
    queries = queries.select("query_id", T.search_title(F.col("query")).alias("qt"), T.sorted_title_key(F.col("query")).alias("qk"))
    b, q = books.select("t", "k").distinct(), queries.select("qt", "qk").distinct()
    both = ["qt", "qk", "t", "k"]
    equal = q.join(b, F.col("qt") == F.col("t")).select(*both, F.lit(1000.0).alias("band"), F.lit(1.0).alias("within"))
    words = q.where("qk <> ''").join(b, F.col("qk") == F.col("k")).select(*both, F.lit(900.0).alias("band"), F.lit(1.0).alias("within"))
    bw = b.select("t", "k", F.explode(F.array_distinct(F.split("k", " "))).alias("w"))
    qw = q.select("qt", "qk", F.explode(F.array_distinct(F.split("qk", " "))).alias("w"))
    near = qw.where("w <> ''").join(bw, "w").select(*both).distinct().withColumn("s", trigram_similarity(F.col("qt"), F.col("t")))
    inside = near.where(F.contains(F.col("t"), F.col("qt"))).select(*both, F.lit(800.0).alias("band"), F.col("s").alias("within"))
    alike = near.where(F.col("s") >= TRIGRAM_LEAST).select(*both, F.lit(600.0).alias("band"), F.col("s").alias("within"))
    every = equal.unionByName(words).unionByName(inside).unionByName(alike)
    best = every.groupBy(*both).agg(F.max(F.col("band") + F.col("within") * 50).alias("score"))
    downloads = F.log(F.greatest(F.col("numdownloads"), F.lit(1)).cast("double")) * 10
    return best.join(queries, ["qt", "qk"]).join(books, ["t", "k"]).select("query_id", "bookid", (F.col("score") + downloads).alias("score"))


def cosine_neighbours(queries: DataFrame, vectors: DataFrame, keep: int = 10, digits: int = 5) -> DataFrame:
    """q, vec_id, score and rank: the ``keep`` nearest of ``vectors`` (vec_id, embedding) for each of ``queries`` (q, qe) but itself.

    Both are dealt into blocks; each pair of blocks is one product and gives the best of each of its queries, so only
    these reach the ranking. Scores are rounded first; equal ones are in order of vec_id.
    """
    parts = lambda d, size: max(1, -(-d.count() // size))
    nq, nv = parts(queries, QUERY_BLOCK), parts(vectors, VECTOR_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = queries.select(own("q", nq).alias("i"), every(nv).alias("j"), F.col("q").alias("id"), F.col("qe").alias("e"))
    b = vectors.select(every(nq).alias("i"), own("vec_id", nv).alias("j"), F.col("vec_id").alias("id"), F.col("embedding").alias("e"))

    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            unit = lambda e: (lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True)))(np.stack(e.to_list()).astype(np.float64))
            with np.errstate(invalid="ignore", divide="ignore"):
                x, y = unit(left["e"]), unit(right["e"])
            ids = right["id"].to_numpy()
            for q, row in zip(left["id"].to_numpy(), x, strict=True):
                score = np.round(y @ row, digits)
                order = np.lexsort((ids, np.where(np.isnan(score), np.inf, -score)))[: keep + 1]
                out += [(q, ids[k], score[k]) for k in order if ids[k] != q][:keep]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"])

    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(best, "q bigint, vec_id bigint, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= keep)


def chapters_to_books(chapter_scores: DataFrame, bonus: float = 0.01) -> DataFrame:
    """bookid and the best chapter's score with a bonus for each further one."""
    return chapter_scores.groupBy("query_id", "bookid").agg((F.max("score") + bonus * (F.count(F.lit(1)) - 1)).alias("score"))


def author_clusters(names: DataFrame) -> DataFrame:
    """cluster and the sorted names that share an unaccented surname and first given name."""
    p = T.author_parts(F.col("name"))
    key = F.concat_ws("|", p["surname"], F.split_part(p["given"], F.lit(" "), F.lit(1)))
    return names.withColumn("cluster", key).groupBy("cluster").agg(F.array_sort(F.collect_set("name")).alias("names"))
