"""Download links: candidates by priority, the best illustrated source, audio items, and what to do for a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

# Media types that texts are taken from, best first.
TEXT_PRIORITY = (
    "text/plain", "text/plain; charset=utf-8", "text/plain; charset=us-ascii", "text/plain; charset=iso-8859-1", "text/plain; charset=windows-1252", "text/html",
    "text/html; charset=utf-8", "text/html; charset=us-ascii", "text/html; charset=iso-8859-1", "text/html; charset=windows-1252", "application/prs.tei",
    "application/epub+zip", "application/pdf", "application/octet-stream",
)
HOST_PREFIXES = ("/cache/epub/", "/files/", "/ebooks/")
KIND_ORDER = tuple(k for k, _ in U.ILLUSTRATED_KINDS)


def ranked_candidates(links: DataFrame) -> DataFrame:
    """bookid and its distinct links (priority, url) in order; links of other media types are left out. Links: bookid, url, kind."""
    prio = U.rank_in(F.col("kind"), TEXT_PRIORITY)
    return links.withColumn("_p", prio).where("_p < 99").groupBy("bookid").agg(F.array_sort(F.collect_set(F.struct(F.col("_p").alias("priority"), "url"))).alias("candidates"))


def best_illustrated(links: DataFrame) -> DataFrame:
    """bookid, url and source_type of the best illustrated source: by kind, place on the host, length, then URL."""
    kind = U.illustrated_kind(F.col("url"))
    place = F.when(F.col("url").contains(HOST_PREFIXES[0]), 0).when(F.col("url").contains(HOST_PREFIXES[1]), 1).when(F.col("url").contains(HOST_PREFIXES[2]), 2).otherwise(3)
    w = Window.partitionBy("bookid").orderBy(U.rank_in(F.col("source_type"), KIND_ORDER, 9), place, F.length("url"), "url")
    return links.withColumn("source_type", kind).where("source_type is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("bookid", "url", "source_type")


def identifying_link(links: DataFrame) -> DataFrame:
    """bookid and the link that names it: the least /ebooks/ one that is no metadata file, else the least /files/ one, else the least. One aggregation."""
    u = F.col("url")
    ebooks, files = u.contains("/ebooks/") & ~F.lower(u).contains(".rdf"), u.contains("/files/")
    return links.groupBy("bookid").agg(F.coalesce(F.min(F.when(ebooks, u)), F.min(F.when(files, u)), F.min(u)).alias("url"))


def metadata_changes(catalog: DataFrame, rdf: DataFrame) -> DataFrame:
    """Books whose record (title, authors, issued, gutenbergbookid) differs from the metadata file's; nulls compare as values."""
    fields = ("title", "authors", "issued", "gutenbergbookid")
    other = rdf.select(F.col("bookid").alias("_b"), *[F.col(c).alias(f"new_{c}") for c in fields])
    differs = ~F.col("title").eqNullSafe(F.col("new_title"))
    for c in fields[1:]:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return catalog.join(other, F.col("bookid") == F.col("_b")).where(differs).drop("_b")


def audio_items(links: DataFrame) -> DataFrame:
    """One audio item per book of links (book_id, url, kind): the first media type by priority, its tracks in order, a package, and whether all is machine-read."""
    package = F.col("url").rlike(U.AUDIO_PACKAGE)
    prio = U.rank_in(F.col("kind"), U.AUDIO_PRIORITY)
    grouped = links.groupBy("book_id").agg(
        F.min(F.when(~package & (prio < 99), prio)).alias("_best"),
        F.min(F.when(package, F.col("url"))).alias("_package"),
        F.collect_set(F.when(~package, F.struct(prio.alias("p"), U.track_number(F.col("url"), F.lit(0)).alias("track_order"), "url", "kind"))).alias("_all"),
    )
    tracks = F.array_sort(F.transform(F.filter("_all", lambda t: t["p"] == F.col("_best")), lambda t: F.struct(t["track_order"].alias("track_order"), t["url"].alias("url"), t["kind"].alias("kind"))))
    out = grouped.where("_best is not null").withColumn("tracks", tracks)
    return out.select(
        "book_id",
        F.coalesce("_package", F.element_at("tracks", 1)["url"]).alias("package_url"),
        F.element_at("tracks", 1)["kind"].alias("audio_format"),
        F.size("tracks").alias("track_count"),
        (F.size("tracks") > 1).alias("is_chaptered"),
        F.forall("tracks", lambda t: U.is_synthesized(t["url"])).alias("is_synthesized"),
        "tracks",
    )


def titled_tracks(tracks: DataFrame, readme: DataFrame) -> DataFrame:
    """Tracks (book_id, track_order, url, title) with the titles and lengths of a readme's chapters (book_id, ord, title, duration), by position."""
    w = Window.partitionBy("book_id").orderBy("track_order", "url")
    chapters = readme.select("book_id", F.row_number().over(Window.partitionBy("book_id").orderBy("ord")).alias("_n"), F.col("title").alias("_title"), "duration")
    return tracks.withColumn("_n", F.row_number().over(w)).join(chapters, ["book_id", "_n"], "left").withColumn("title", F.coalesce("title", "_title")).drop("_n", "_title")


def readme_parts(text: Column) -> Column:
    """(narrator, chapters) of a readme: a "read by" line unless it names no person, and "1 title - 0:12:34" lines."""
    who = F.trim(F.regexp_extract(text, r"(?im)^\s*(?:read|narrated) by:?\s+(.+?)\s*$", 1))
    narrator = F.when((who != "") & ~who.rlike(r"(?i)^(various|volunteers?|unknown|a group|computer)"), who)
    line = r"(?m)^\s*\d+\W+(.+?)\s+-\s+(\d+:\d\d:\d\d)\s*$"
    chapters = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), F.lit(1)).alias("title"), F.regexp_extract_all(text, F.lit(line), F.lit(2)).alias("duration"))
    return F.struct(narrator.alias("narrator"), chapters.alias("chapters"))


def file_plan(local: DataFrame, live: DataFrame) -> DataFrame:
    """book_id and action from the names of local and live files: download, repair, refresh, local or skip."""
    a = local.groupBy("book_id").agg(F.array_sort(F.collect_set("name")).alias("_local"))
    b = live.groupBy("book_id").agg(F.array_sort(F.collect_set("name")).alias("_live"))
    none = F.array().cast("array<string>")
    both = a.join(b, "book_id", "full_outer").select("book_id", F.coalesce("_local", none).alias("l"), F.coalesce("_live", none).alias("v"))
    action = F.when((F.size("l") == 0) & (F.size("v") == 0), "skip").when(F.size("l") == 0, "download").when(F.size("v") == 0, "local").when(F.col("l") == F.col("v"), "skip").when(F.size(F.array_except("v", "l")) > 0, "repair").otherwise("refresh")
    return both.select("book_id", action.alias("action"), F.size("l").alias("n_local"), F.size("v").alias("n_live"))


def content_plan(books: DataFrame, links: DataFrame) -> DataFrame:
    """bookid and action: skip without links, audio-only if every link is audio or video, repair if none belongs to the book, refresh if there is content, else download."""
    own = U.belongs_to(F.col("url"), F.col("gutenbergbookid"))
    facts = books.join(links, "bookid", "left").groupBy("bookid", "has_content").agg(
        F.count("url").alias("n"), F.coalesce(F.bool_and(U.is_media_type(F.col("kind"))), F.lit(False)).alias("media"), F.coalesce(F.bool_or(own), F.lit(False)).alias("own")
    )
    return facts.select("bookid", F.when(F.col("n") == 0, "skip").when(F.col("media"), "audio-only").when(~F.col("own"), "repair").when(F.col("has_content"), "refresh").otherwise("download").alias("action"))


def audio_resolution(candidates: DataFrame, existing: DataFrame, librivox: DataFrame, repair: bool = False) -> DataFrame:
    """book_id, action and source: an item of its own, else one of the other catalogue for gaps and machine-read rows, else in repair mode a deletion."""
    c, e, l = (d.select("book_id", F.lit(True).alias(n), *extra) for d, n, extra in ((candidates, "_c", [F.col("is_synthesized").alias("_synth")]), (existing, "_e", []), (librivox, "_l", [])))
    both = c.join(e, "book_id", "full_outer").join(l, "book_id", "full_outer")
    action = F.when(F.col("_c") & ~F.coalesce("_synth", F.lit(False)), "own").when(F.col("_l"), "librivox").when(F.col("_c"), "own").when(F.lit(repair) & F.col("_e"), "delete").otherwise("keep")
    return both.select("book_id", action.alias("action"))


def missing_from(books: DataFrame, contents: DataFrame) -> DataFrame:
    """Books without content."""
    return books.join(contents.select("bookid"), "bookid", "left_anti")


def with_other_marker(contents: DataFrame, books: DataFrame) -> DataFrame:
    """Books whose text names another one in its header."""
    from ..functions.text import marker_mismatch

    own = contents.join(books.select(F.col("id").alias("bookid"), "gutenbergbookid"), "bookid")
    return own.where(marker_mismatch(F.col("raw_content"), F.col("gutenbergbookid"))).select("bookid", "gutenbergbookid")


def incomplete_descriptions(books: DataFrame, desc: DataFrame) -> DataFrame:
    """Books without a description, or with one that has no summary."""
    full = desc.where("trim(coalesce(summary, '')) <> ''").select("bookid")
    return books.join(full, books["id"] == full["bookid"], "left_anti")


def audio_gaps(books: DataFrame, audio: DataFrame, limit: int | None = 5000) -> DataFrame:
    """Books without audio, most downloaded first."""
    found = books.join(audio, books["id"] == audio["book_id"], "left_anti").orderBy(F.desc("numdownloads"), "id")
    return found if limit is None else found.limit(limit)


def with_flag(books: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """An EXISTS test as a column."""
    return books.join(other.select(key).distinct().withColumn("_f", F.lit(True)), key, "left").withColumn(flag, F.col("_f").isNotNull()).drop("_f")


def shard_of(key: Column, shards: int) -> Column:
    """A shard by hash of the id: it does not move when other rows go."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def round_robin(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """The shard of each row by its position in order."""
    from .ordinals import with_position

    return with_position(rows, order, "shard").withColumn("shard", F.col("shard") % shards)


def first_done(results: DataFrame) -> DataFrame:
    """bookid, status and message from (bookid, rank, status, message) of all sources tried: the first done one wins, else error if any failed, else skipped."""
    return results.groupBy("bookid").agg(
        F.min(F.when(F.col("status") == "done", F.struct("rank", "message"))).alias("_done"), F.bool_or(F.col("status") == "error").alias("_error"), F.array_sort(F.collect_list(F.struct("rank", "message"))).alias("_all")
    ).select("bookid", F.when(F.col("_done").isNotNull(), "done").when(F.col("_error"), "error").otherwise("skipped").alias("status"), F.substring(F.when(F.col("_done").isNotNull(), F.col("_done.message")).otherwise(F.array_join(F.transform("_all", lambda m: m["message"]), "; ")), 1, 500).alias("message"))
