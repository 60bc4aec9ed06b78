"""Tables as snapshots: upserts, child replacement, cascades, work queues and reading history.

Files of a table are never changed; each operator returns the next snapshot as one declarative plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx

KEEP_RECENT = 10
ERROR_CHARS = 500


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    test = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        test = test & a[k].eqNullSafe(b[k])
    return test


def upsert_replace(base: DataFrame, updates: DataFrame, keys: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Rows of ``updates`` take the place of rows with their keys as a whole: columns they lack fall back to defaults or null."""
    full = updates
    for name, kind in base.dtypes:
        if name not in full.columns:
            full = full.withColumn(name, F.lit((defaults or {}).get(name)).cast(kind))
    return base.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(full.select(*base.columns))


def upsert_update(base: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only ``columns`` change in rows that are there; other rows are added, with null in columns that updates lack."""
    marked = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    merged = base.join(marked, keys, "left").select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])
    return merged.unionByName(insert_ignored(base, updates.select(*keys, *columns), keys), allowMissingColumns=True)


def insert_ignored(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys ``base`` lacks."""
    return rows.join(base.select(*keys).distinct(), keys, "left_anti")


def insert_or_ignore(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(insert_ignored(base, rows, keys), allowMissingColumns=True)


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``new`` give way to those in ``new``."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], victims: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table (frame, key column) without rows of the victims."""
    gone = victims.select(F.col(key).alias("_victim")).distinct()
    return {name: frame.join(gone, frame[column] == gone["_victim"], "left_anti") for name, (frame, column) in tables.items()}


def delete_where_other_key(table: DataFrame, wrong: DataFrame, key: str) -> DataFrame:
    """Rows that were stored under a foreign key go."""
    return table.join(wrong.select(key).distinct(), key, "left_anti")


def guarded_save(contents: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saves texts whose header does not name another book; returns the snapshot and the rejected rows. Columns bookid, gutenbergbookid, raw_content, clean_content."""
    from ..functions.text import marker_mismatch

    bad = marker_mismatch(F.col("raw_content"), F.col("gutenbergbookid"))
    good = texts.where(~bad).drop("gutenbergbookid")
    return upsert_replace(contents, good, ["bookid"], {"content_type": "text", "has_images": False}), texts.where(bad)


def save_description(desc: DataFrame, new: DataFrame) -> DataFrame:
    """A description keeps what the new one lacks (summary, title, author, genres); rows without any summary aren't written."""
    keep = ["source_title", "source_author", "genres_text", "freebase_id", "summary"]
    old = desc.select("bookid", *[F.col(c).alias(f"_old_{c}") for c in keep])
    own = [c for c in keep if c in new.columns]
    merged = new.join(old, "bookid", "left").select("bookid", *[F.coalesce(F.nullif(F.col(c), F.lit("")) if c in own else F.lit(None).cast("string"), F.col(f"_old_{c}")).alias(c) for c in keep])
    return upsert_replace(desc, merged.where("coalesce(summary, '') <> ''"), ["bookid"])


# Work queues: (queue_key, bookid, status, attempts, last_error, ...)


def queue_seed(queue: DataFrame, targets: DataFrame, namespace: str, rearm: bool = True) -> DataFrame:
    """Targets become pending; done and skipped rows stay, others are set back (or, without ``rearm``, left as they are)."""
    fresh = targets.select(F.lit(namespace).alias("queue_key"), "bookid").distinct()
    stay = F.col("status").isin("done", "skipped") if rearm else F.lit(True)
    hit = fresh.withColumn("_hit", F.lit(True))
    kept = queue.join(hit, ["queue_key", "bookid"], "left")
    reset = F.col("_hit").isNotNull() & ~stay
    columns = {"status": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string")}
    kept = kept.select(*[F.when(reset, columns[c]).otherwise(F.col(c)).cast(t).alias(c) if c in columns else F.col(c) for c, t in queue.dtypes])
    new = insert_ignored(queue, fresh, ["queue_key", "bookid"]).withColumns({"status": F.lit("pending"), "attempts": F.lit(0).cast(dict(queue.dtypes)["attempts"]), "last_error": F.lit(None).cast("string")})
    return kept.unionByName(new, allowMissingColumns=True)


def queue_pending(queue: DataFrame, namespace: str, most_attempts: int, order: list[Column] | None = None) -> DataFrame:
    """What may be worked on: pending or failed with attempts left."""
    return queue.where((F.col("queue_key") == namespace) & F.col("status").isin("pending", "failed") & (F.col("attempts") < most_attempts)).orderBy(*(order or [F.col("bookid")]))


def queue_transition(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Applies (queue_key, bookid, status, delta, error): attempts grow by delta, errors are cut."""
    o = outcomes.select("queue_key", "bookid", F.col("status").alias("_status"), F.col("delta").alias("_delta"), F.substring("error", 1, ERROR_CHARS).alias("_error"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    changed = {"status": F.when(hit, F.col("_status")).otherwise(F.col("status")), "attempts": F.col("attempts") + F.coalesce("_delta", F.lit(0)), "last_error": F.when(hit, F.col("_error")).otherwise(F.col("last_error"))}
    return queue.join(o, ["queue_key", "bookid"], "left").select(*[changed[c].cast(t).alias(c) if c in changed else F.col(c) for c, t in queue.dtypes])


def queue_status(queue: DataFrame) -> DataFrame:
    return queue.groupBy("queue_key", "status").agg(F.count(F.lit(1)).alias("n"))


def queue_reset(queue: DataFrame, namespace: str) -> DataFrame:
    return queue.where(F.col("queue_key") != namespace)


# Reading history: (user_id, book_id, media_type, position, updated_at, id)


def latest(events: DataFrame) -> DataFrame:
    """The last state of each (user, book); equal times are decided by id."""
    w = Window.partitionBy("user_id", "book_id").orderBy(F.desc("updated_at"), F.desc("id"))
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def recent(events: DataFrame, keep: int = KEEP_RECENT) -> DataFrame:
    """The newest ``keep`` books of each user, with their place."""
    w = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("id"))
    return latest(events).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def normalized_history(events: DataFrame) -> DataFrame:
    """Media types outside (audio, text) become audio, positions get their canonical form."""
    kind = F.lower(F.trim(F.coalesce("media_type", F.lit(""))))
    return events.withColumn("media_type", F.when(kind.isin("audio", "text"), kind).otherwise("audio")).withColumn("position", jsonx.canonical_position(F.col("position")))


def decorated(history: DataFrame, desc: DataFrame, cover_art: DataFrame) -> DataFrame:
    """History with the description's title and the preferred cover: two joins, not a look-up per item."""
    from .catalog import best_cover

    d = desc.select(F.col("bookid").alias("_b"), F.col("source_title").alias("desc_title"))
    c = best_cover(cover_art).select(F.col("bookid").alias("_c"), F.col("image_url").alias("cover_url"))
    return history.join(d, F.col("book_id") == F.col("_b"), "left").join(c, F.col("book_id") == F.col("_c"), "left").drop("_b", "_c")


def cached_lookup(keys: DataFrame, cache: DataFrame, compute, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Cache-aside: (all rows, rows to append). ``compute`` gets the keys that the cache lacks and returns (key, payload)."""
    missing = compute(keys.join(cache.select(key), key, "left_anti"))
    return keys.join(cache.select(key, "payload").unionByName(missing.select(key, "payload")), key), missing
