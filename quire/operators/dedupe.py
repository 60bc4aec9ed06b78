"""Duplicate books: groups by normalised title and author, the canonical record, and merging into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

DESC_WORTH, AUDIO_WORTH = 1_000_000, 500_000


def duplicate_groups(books: DataFrame, least: int = 2) -> DataFrame:
    """title_key, author_key and the sorted bookids of groups of two or more. Books (bookid, title, authors) without a title key are left out."""
    keyed = books.select("bookid", T.title_key(F.col("title")).alias("title_key"), T.author_key(F.col("authors")).alias("author_key")).where("title_key <> ''")
    return keyed.groupBy("title_key", "author_key").agg(F.array_sort(F.collect_list("bookid")).alias("bookids")).where(F.size("bookids") >= least)


def scores(books: DataFrame, contents: DataFrame, desc: DataFrame, audio: DataFrame) -> DataFrame:
    """bookid and score: characters of text, a real description, audio, downloads."""
    c = contents.groupBy("bookid").agg(F.max(F.length("raw_content")).alias("_chars"))
    d = desc.groupBy("bookid").agg(F.max(F.when(F.col("source") != "catalog", 1).otherwise(0)).alias("_desc"))
    a = audio.select(F.col("book_id").alias("bookid")).distinct().withColumn("_audio", F.lit(1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = books.select("bookid", "numdownloads").join(c, "bookid", "left").join(d, "bookid", "left").join(a, "bookid", "left")
    return joined.select("bookid", (zero("_chars") + zero("_desc") * DESC_WORTH + zero("_audio") * AUDIO_WORTH + zero("numdownloads")).cast("bigint").alias("score"))


def canonical(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """bookid, target and place: each member's canonical record, the one with the highest score (ties: smallest id), and its rank."""
    members = groups.select("title_key", "author_key", F.explode("bookids").alias("bookid")).join(scored, "bookid")
    w = Window.partitionBy("title_key", "author_key")
    best = w.orderBy(F.desc("score"), "bookid")
    return members.select("bookid", F.first("bookid").over(best).alias("target"), F.row_number().over(best).alias("place"), "score")


def merged_contents(contents: DataFrame, links: DataFrame) -> DataFrame:
    """Per target the longest text of its group; between equal ones the better-ranked record's, so the target's own stays."""
    of = contents.join(links, "bookid", "left").withColumn("_target", F.coalesce("target", "bookid"))
    w = Window.partitionBy("_target").orderBy(F.desc(F.length("raw_content")), F.coalesce("place", F.lit(1)), "bookid")
    return of.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("bookid", "target", "place", "score", "_r").withColumnRenamed("_target", "bookid")


def merged_first(rows: DataFrame, links: DataFrame, key: str, eligible: Column) -> DataFrame:
    """Per target the target's own row if eligible, else that of the best-ranked source that has an eligible one."""
    of = rows.join(links.select(F.col("bookid").alias(key), "target", "place"), key, "left").withColumn("_target", F.coalesce("target", key))
    w = Window.partitionBy("_target").orderBy(F.when(eligible, 0).otherwise(1), F.coalesce("place", F.lit(1)), key)
    return of.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop(key, "target", "place", "_r").withColumnRenamed("_target", key)


def merge(tables: dict[str, DataFrame], links: DataFrame, dry_run: bool = False) -> dict[str, DataFrame]:
    """Next snapshots of books, book_contents, book_desc, book_audio and book_cover_art after sources went into their targets.

    With ``dry_run`` only the change set (source and target ids) is returned.
    """
    gone = links.where("place > 1").select("bookid", "target")
    if dry_run:
        return {"changes": gone}
    out = {"books": tables["books"].join(gone.select(F.col("bookid").alias("_v")), F.col("id") == F.col("_v"), "left_anti")}
    out["book_contents"] = merged_contents(tables["book_contents"], links)
    out["book_desc"] = merged_first(tables["book_desc"], links, "bookid", F.col("source") != "catalog")
    out["book_audio"] = merged_first(tables["book_audio"], links, "book_id", ~F.coalesce("is_synthesized", F.lit(False)))
    if "book_cover_art" in tables:
        from .state import insert_or_ignore

        art = tables["book_cover_art"]
        moved = art.join(gone.select(F.col("bookid"), F.col("target")), "bookid").withColumn("bookid", F.col("target")).drop("target").dropDuplicates(["bookid", "size_label", "image_url"])
        kept = art.join(gone.select("bookid"), "bookid", "left_anti")
        out["book_cover_art"] = insert_or_ignore(kept, moved, ["bookid", "size_label", "image_url"])
    return out
