"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the keys are range-sorted into fixed ranges (the first
hexadecimal digits of the key), token counts get distributed prefix sums (totals of the ranges, then sums inside each
range), and the source is cut where the sum reaches its exact budget. A budget above the source's size takes whole
epochs first. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Ranges of a source are this many hexadecimal digits of the key: 4096 of them, so no source ends in one task.
RANGE_DIGITS = 3
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``totals`` (source, source_size) with the word budget of each source.

    Sources by code point, null last, get ``weights`` in turn and share the sum of all sizes; no target is above
    ``most_epochs`` times its source, and what is cut off goes to the others by weight until none is above. That end
    state is water-filling: with sources in order of capacity per weight, the first few are full and the rest get
    shares of one common level. One row per source is handled here, never rows of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * most_epochs).cast("double")
    ranked = (
        totals.withColumn("_weight", weight)
        .withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_left", F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        .withColumn("_weights", F.sum("_weight").over(onward))
        .withColumn("_place", F.row_number().over(fill))
    )
    fits = F.col("_left") <= F.col("_ratio") * F.col("_weights")
    level = F.min(F.when(fits, F.struct("_place", "_left", "_weights"))).over(every)
    target = F.when(F.col("_place") < level["_place"], F.col("_cap")).otherwise(level["_left"] * F.col("_weight") / level["_weights"])
    return ranked.select("source", "source_size", F.least(target, F.col("_cap")).alias("target"))


def mix_sources(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Each row of ``docs`` with the words that the mix takes of it.

    Input: doc_id, text and source. Output: the columns ``carry`` of the input, then source, size, source_size, target
    and taken (these names win over columns of the input). ``taken`` is whole epochs times size, plus what the budget's
    rest still covers in key order; the last document is cut at the exact word.

    Null text has size 0; null source is a source; rows with one doc_id share a key and are ordered by size, then by a
    hash of the text, so reruns cut the same rows; other columns pass through; an empty table gives no rows.
    """
    own = ("source", "size", "source_size", "target", "taken")
    keep = [c for c in carry if c not in own]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col("source").alias("source"), size_of(F.col("text")).alias("size"), key.alias("_key"), F.xxhash64("text").alias("_tie")
    ).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    if keep == ["doc_id"]:
        sized = written(sized, "mix-sized")
    ranges = written(sized.groupBy("source", "_range").agg(F.sum("size").alias("_words")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most_epochs)
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    starts = starts.join(t, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_start", "source_size", "target")
    inside = Window.partitionBy("source", "_range").orderBy("_key", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    starts = starts.withColumn("_budget", F.round("target").cast("long"))
    joined = summed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    epochs = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0))
    rest = F.col("_budget") - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("_start") - F.col("_inside"), F.lit(0)), F.col("size"))
    return joined.select("_row.*", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: each is there once for each epoch that takes it.

    Documents stay whole: the one that a budget cuts is taken if at least half of it fits. One without words costs
    nothing and is kept once. Copies keep their doc_id.
    """
    names = docs.columns
    own = docs.select(F.struct(*[F.col(c) for c in names]).alias("doc"), "doc_id", "text", "source")
    taken = mix_sources(own, ("doc",), seed, weights, most_epochs)
    rest = F.col("taken") % F.col("size")
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("taken div size") + F.when(rest * 2 >= F.col("size"), F.lit(1)).otherwise(F.lit(0)))
    rows = taken.select("doc", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("_copy"))
    return rows.select(*[F.col("doc")[c].alias(c) for c in names])


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same budgets and cuts over whole tables; MD5 keys order both.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w,
         (source_size * 3)::DOUBLE AS cap FROM totals),
ranked AS (
  SELECT *, row_number() OVER f AS place,
         sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM weighed WINDOW f AS (ORDER BY cap / w, source ASC NULLS LAST)),
level AS (SELECT place, remaining, ws FROM ranked WHERE remaining <= cap / w * ws ORDER BY place LIMIT 1),
targets AS (
  SELECT r.source, r.source_size, least(CASE WHEN r.place < l.place THEN r.cap ELSE l.remaining * r.w / l.ws END, r.cap) AS target
  FROM ranked r, level l),
summed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(greatest(budget % source_size - earlier, 0), size) END::BIGINT AS taken
FROM summed
"""

QUERIES = {"op7_source_mixing": op7_source_mixing}
ORACLE = {"op7_source_mixing": SQL}
