"""Exact top-k search by inner product with MaxScore.

A dimension is a term and its column of quantized values a posting list. Rows are dealt into shards and a query meets
each shard. For a query weight w a posting contributes w * (v - offset), where the offset is the shard's smallest value
if w > 0 and its largest if w < 0, so contributions are never negative and a term's largest one bounds it. Terms in
ascending order of bounds whose bounds together stay below the distance to the current k-th best score are
non-essential: they can't lift a row into the result alone. The essential postings are traversed, and the others
are probed, one after another, only for rows that are still competitive. Shard results merge by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
TOP = 10
#: Rows of a shard and queries of a block: what one task holds at once.
SHARD_ROWS = 4096
BLOCK_QUERIES = 1024
#: Rows of a shard that are scored before the thresholds are looked at again.
STRIDE = 1024
LONG = 1 << 63


def quantized(column: str, scale: int = SCALE):
    """floor(scale * x) for each component; null if the vector is null or holds a null or non-finite component."""
    v = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), v)


def top_rows(query: np.ndarray, own: int, ids: np.ndarray, shard: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best rows of a shard (ids ascending, ``shard`` of int64 with a line for each term) but the row ``own``.

    Returns ids, scores and how many postings were read.
    """
    offset = np.where(query >= 0, low, high)
    bound = np.where(query >= 0, query * (high - low), query * (low - high))
    order = np.argsort(bound, kind="stable")
    reach = np.cumsum(bound[order])  # what the terms up to here can add together
    base = int(query @ offset)
    best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    read = 0
    for at in range(0, len(ids), STRIDE):
        rows = np.arange(at, min(at + STRIDE, len(ids)))
        rows = rows[ids[rows] != own]
        full = len(best) >= k
        least = int(best[-1]) if full else None
        # essential terms: the rest can't reach the threshold together
        split = int(np.searchsorted(reach + base, least, side="left")) if full else 0
        essential = order[split:]
        score = query[essential] @ shard[np.ix_(essential, rows)] - int(query[essential] @ offset[essential]) + base if len(essential) else np.full(len(rows), base)
        read += len(essential) * len(rows)
        for place in range(split - 1, -1, -1):
            going = score + reach[place] >= least
            rows, score = rows[going], score[going]
            if not len(rows):
                break
            term = order[place]
            score = score + query[term] * (shard[term, rows] - offset[term])
            read += len(rows)
        if len(rows):
            all_ids, every = np.concatenate((best_ids, ids[rows])), np.concatenate((best, score))
            keep = np.lexsort((all_ids, -every))[:k]
            best_ids, best = all_ids[keep], every[keep]
    return best_ids, best, read


def _fits(vectors: np.ndarray) -> bool:
    """Whether inner products of such vectors stay exact in int64."""
    most = float(np.abs(vectors.astype(np.float64)).max(initial=0))
    return most * most * max(1, vectors.shape[-1]) < float(1 << 62)


def _search(table: pa.Table) -> pa.Table:
    """The best rows of one shard for one block of queries."""
    is_query = np.asarray(table["is_query"])
    ids = np.asarray(table["vec_id"])
    lengths = np.asarray(pa.compute.list_value_length(table["v"]))
    out: list[tuple[int, int, int]] = []
    for width in np.unique(lengths):  # vectors of another width are not comparable
        alike = np.flatnonzero(lengths == width)
        flat = np.asarray(table["v"].take(pa.array(alike)).combine_chunks().flatten())
        v = flat.reshape(len(alike), int(width))
        q, r = np.flatnonzero(is_query[alike]), np.flatnonzero(~is_query[alike])
        if not len(q) or not len(r):
            continue
        r = r[np.argsort(ids[alike][r], kind="stable")]
        row_ids, shard = ids[alike][r], np.ascontiguousarray(v[r].T)
        low, high = (shard.min(axis=1), shard.max(axis=1)) if width else (np.zeros(0, np.int64),) * 2
        exact = _fits(v)
        for i in q:
            own = int(ids[alike][i])
            if exact:
                found, score, _ = top_rows(v[i], own, row_ids, shard, low, high, TOP)
                out += zip([own] * len(found), found.tolist(), score.tolist(), strict=True)
            else:  # beyond int64: exact integers of Python, held to the range of a long at the end
                query = [int(x) for x in v[i]]
                all_scores = sorted((-max(-LONG, min(LONG - 1, sum(a * int(b) for a, b in zip(query, shard[:, c], strict=True)))), int(row_ids[c])) for c in range(len(row_ids)) if row_ids[c] != own)
                out += [(own, rid, -s) for s, rid in all_scores[:TOP]]
    columns = list(zip(*out, strict=True)) if out else [(), (), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of ``queries`` its TOP best rows of ``vectors`` (vec_id, v).

    The score is the inner product of integers, ties go to the smaller vec_id, and a row with the query's own vec_id is
    no candidate. Null vectors take no part, nor rows with null ids; vectors of different widths aren't compared; rows
    that repeat an id are candidates each. With fewer candidates all are returned; empty tables give no rows.

    Shards and query blocks have fixed sizes and both are dealt by hash, so one task holds one of each; every pair of
    them is one group, and a shard gives TOP rows per query whatever it holds.
    """
    vectors = vectors.where("v is not null and vec_id is not null")
    queries = queries.where("v is not null and vec_id is not null")
    shards = -(-vectors.count() // SHARD_ROWS) or 1
    blocks = -(-queries.count() // BLOCK_QUERIES) or 1
    # rows in repeated ids must not meet in one shard: they are dealt by id and value
    rows = vectors.select("vec_id", "v", F.lit(False).alias("is_query"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.distinct().select("vec_id", "v", F.lit(True).alias("is_query"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    found = rows.unionByName(asked).groupBy("shard", "block").applyInArrow(_search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score")


def op4_maxscore_topk(spark, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100, candidates all rows."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantized("embedding").alias("v"))
    return top_k(v, v.where(F.col("vec_id") % 100 == 0))


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, sum(q.x * r.x)::BIGINT AS score
  FROM flat q JOIN flat r ON q.i = r.i AND q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op4_maxscore_topk": op4_maxscore_topk}
ORACLE = {"op4_maxscore_topk": SQL}
