"""Table schemas and additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Names and types of the stored tables.
TABLES = {
    "books": "id bigint, gutenbergbookid bigint, dateissued string, languageid bigint, numdownloads bigint",
    "titles": "bookid bigint, name string, ord int",
    "authors": "id bigint, name string",
    "book_authors": "bookid bigint, authorid bigint",
    "subjects": "id bigint, name string",
    "book_subjects": "bookid bigint, subjectid bigint",
    "languages": "id bigint, name string",
    "downloadlinkstype": "id bigint, name string",
    "downloadlinks": "bookid bigint, name string, downloadtypeid bigint",
    "book_contents": "bookid bigint, raw_content string, clean_content string, content_type string, html_content string, has_images boolean, download_date timestamp",
    "book_desc": "bookid bigint, wikipedia_id bigint, freebase_id string, source_title string, source_author string, publication_date string, genres_text string, genres_json string, summary string, category string, source string, download_date timestamp",
    "book_audio": "book_id bigint, package_url string, audio_format string, track_count int, is_chaptered boolean, narrator string, narrator_source string, is_synthesized boolean, download_date timestamp",
    "book_audio_chapters": "id bigint, book_id bigint, track_order int, chapter_title string, track_url string, audio_format string, duration string, download_date timestamp",
    "book_cover_art": "id bigint, bookid bigint, size_label string, sort_order int, image_url string, mime_type string, byte_size bigint, rdf_url string, source string, download_date timestamp",
    "work_queue": "queue_key string, bookid bigint, title string, priority int, status string, attempts int, last_error string, source_url string, source_type string, updated_at timestamp",
    "recently_played": "id bigint, user_id bigint, book_id bigint, media_type string, position string, updated_at timestamp",
}
DEFAULTS = {"book_contents": {"content_type": "text", "has_images": False}, "book_desc": {"source": "cmu-book-summaries"}, "recently_played": {"position": "{}"}}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def evolved(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the shape of a table: columns it lacks are added with their defaults, types are cast, others pass through at the end."""
    wanted = StructType.fromDDL(TABLES[name])
    defaults = DEFAULTS.get(name, {})
    own = [(F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in wanted]
    return df.select(*own, *[c for c in df.columns if c not in wanted.names])
