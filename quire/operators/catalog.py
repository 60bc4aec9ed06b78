"""The catalogue: a denormalised view, and browsing, keyword search, counts, paging and look-ups over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .classify import category_of

PAGE = 20


def first_title(titles: DataFrame) -> DataFrame:
    """bookid and title: the first by ``ord``, then by name."""
    return titles.groupBy("bookid").agg(F.min(F.struct("ord", "name"))["name"].alias("title"), F.array_sort(F.collect_set("name")).alias("titles"))


def names_of(names: DataFrame, bridge: DataFrame, key: str, alias: str) -> DataFrame:
    """bookid and the sorted distinct names that a bridge table gives it."""
    return bridge.join(names, bridge[key] == names["id"]).groupBy("bookid").agg(F.array_sort(F.collect_set("name")).alias(alias))


def catalog_view(books: DataFrame, titles: DataFrame, authors: DataFrame, book_authors: DataFrame, subjects: DataFrame, book_subjects: DataFrame, languages: DataFrame | None = None, desc: DataFrame | None = None) -> DataFrame:
    """One row per book: id, title, titles, authors, year, language, downloads, subjects, category. Every child is aggregated once and joined by key."""
    view = books.join(first_title(titles), books["id"] == F.col("bookid"), "left").drop("bookid")
    for child in (names_of(authors, book_authors, "authorid", "authors"), names_of(subjects, book_subjects, "subjectid", "all_subjects")):
        view = view.join(child, view["id"] == child["bookid"], "left").drop("bookid")
    language = F.lit(None).cast("string")
    if languages is not None:
        view = view.join(languages.select(F.col("id").alias("_lid"), F.col("name").alias("_lang")), F.col("languageid") == F.col("_lid"), "left")
        language = F.col("_lang")
    stored = F.lit(None).cast("string")
    if desc is not None:
        view = view.join(desc.select(F.col("bookid").alias("_did"), F.col("category").alias("_category")), F.col("id") == F.col("_did"), "left")
        stored = F.col("_category")
    none = F.array().cast("array<string>")
    valid = F.filter(F.coalesce("all_subjects", none), T.valid_subject)
    return view.select(
        "id",
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("titles", none).alias("titles"),
        F.coalesce("authors", none).alias("author_names"),
        F.coalesce(F.nullif(F.array_join("authors", "|"), F.lit("")), F.lit("Unknown")).alias("authors"),
        T.year_of_issue(F.col("dateissued")).alias("year"),
        F.coalesce(language, F.lit("Unknown")).alias("language"),
        F.coalesce("numdownloads", F.lit(0)).alias("downloads"),
        F.coalesce("all_subjects", none).alias("all_subjects"),
        valid.alias("subjects"),
        F.coalesce(stored, category_of(valid)).alias("category"),
    )


def _has(names: Column, token: str) -> Column:
    """An underscore of a token stands for any character, as in SQL's LIKE."""
    return F.exists(names, lambda n: F.lower(n).like(f"%{token}%"))


def words_of_query(spark, query: str | None) -> list[str]:
    """The tokens of a query, by the same expression that columns use; one row of constants."""
    return spark.range(1).select(T.search_tokens(F.lit(query or "")).alias("t")).first()["t"]


def matching(view: DataFrame, subject: str | None = None, words: list[str] = ()) -> DataFrame:
    """Books with a subject of exactly that name, and with every word in a title or an author. Without words all match."""
    tests = [_has(F.col("titles"), w) | _has(F.col("author_names"), w) for w in words]
    if subject:
        tests.append(F.array_contains("all_subjects", subject))
    return view.where(reduce(Column.__and__, tests)) if tests else view


def ranked(view: DataFrame, words: list[str] = ()) -> DataFrame:
    """With the number of words that a title holds, best first, then by downloads and id."""
    score = reduce(Column.__add__, [F.when(_has(F.col("titles"), w), 1).otherwise(0) for w in words], F.lit(0))
    return view.withColumn("score", score).orderBy(F.desc("score"), F.desc("downloads"), F.asc("id"))


def page(view: DataFrame, subject: str | None = None, search: str | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of books. The sort with a limit keeps limit + offset rows per task."""
    words = words_of_query(view.sparkSession, search) if search else []
    return ranked(matching(view, subject, words), words).offset(offset).limit(limit)


def page_with_fallback(view: DataFrame, subject: str | None = None, search: str | None = None, limit: int = PAGE, offset: int = 0) -> tuple[DataFrame, bool]:
    """A page, or the unfiltered one where nothing matches, and whether that was so."""
    words = words_of_query(view.sparkSession, search) if search else []
    found = matching(view, subject, words)
    if (subject or words) and found.isEmpty():
        return page(view, None, None, limit, offset), True
    return ranked(found, words).offset(offset).limit(limit), False


def count(view: DataFrame, subject: str | None = None, search: str | None = None, limit: int = PAGE) -> DataFrame:
    """total, and the number of pages, one at least."""
    words = words_of_query(view.sparkSession, search) if search else []
    total = matching(view, subject, words).agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("pages", F.greatest(F.ceil(F.col("total") / limit), F.lit(1)).cast("bigint"))


def subject_counts(subjects: DataFrame, book_subjects: DataFrame, limit: int | None = 50) -> DataFrame:
    """Valid subjects with their numbers of books, most first; the limit comes after the filter. Equal names of two ids stay apart."""
    counted = book_subjects.join(subjects, book_subjects["subjectid"] == subjects["id"]).groupBy("id", "name").agg(F.countDistinct("bookid").alias("books"))
    out = counted.where(T.valid_subject(F.col("name"))).orderBy(F.desc("books"), F.asc("name"), F.asc("id"))
    return out if limit is None else out.limit(limit)


def description(view: DataFrame, desc: DataFrame, book_id: int) -> DataFrame:
    """A stored description whose title and author fit the catalogue, else a placeholder from the catalogue."""
    from .match import text_matches

    book = view.where(F.col("id") == book_id)
    d = desc.select(F.col("bookid").alias("_b"), F.col("source_title"), F.col("source_author"), F.col("summary"))
    fits = text_matches(F.col("title"), F.col("source_title"), 0.8) & (F.coalesce("source_author", F.lit("")).eqNullSafe(F.lit("")) | text_matches(F.col("authors"), F.col("source_author"), 0.5))
    ok = F.coalesce(fits, F.lit(False))
    return book.join(d, F.col("id") == F.col("_b"), "left").select(F.col("id").alias("bookid"), F.when(ok, F.col("source_title")).otherwise(F.col("title")).alias("title"), F.when(ok, F.col("source_author")).otherwise(F.col("authors")).alias("author"), F.when(ok, F.col("summary")).otherwise(F.lit("")).alias("summary"), ok.alias("from_source"))


def content(contents: DataFrame, book_id: int) -> DataFrame:
    """Text and markup of one book; the filter reaches the scan."""
    return contents.where(F.col("bookid") == book_id).select("bookid", "clean_content", "html_content", "content_type", "has_images")


def audio(book_audio: DataFrame, chapters: DataFrame, book_id: int) -> DataFrame:
    """One book's audio with its chapters in order."""
    own = chapters.where(F.col("book_id") == book_id).groupBy(F.col("book_id").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("track_order", "id", "chapter_title", "track_url", "duration"))).alias("chapters"))
    return book_audio.where(F.col("book_id") == book_id).join(own, F.col("book_id") == F.col("_b"), "left").drop("_b")


def covers(cover_art: DataFrame, external_id: int) -> DataFrame:
    """Covers of an external id: by order, larger ones first, then by label and URL."""
    return cover_art.where(F.col("bookid") == external_id).orderBy(F.coalesce("sort_order", F.lit(0)), F.coalesce("byte_size", F.lit(0)).desc(), F.coalesce("size_label", F.lit("")), "image_url")


def best_cover(cover_art: DataFrame) -> DataFrame:
    """One cover per book: medium before large before others, then by order."""
    rank = F.when(F.col("size_label") == "medium", 0).when(F.col("size_label") == "large", 1).otherwise(2)
    w = Window.partitionBy("bookid").orderBy(rank, "sort_order", "image_url")
    return cover_art.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
