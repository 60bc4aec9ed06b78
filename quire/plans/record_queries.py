"""Queries over sources, sinks, records and their upkeep: inputs in the sources' own formats are made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import text as T
from ..functions import urls as U
from ..operators import catalog, classify, dedupe, hybrid, links, match, state
from ..session import table
from ..sources import readers, sinks
from . import catalog_queries as books


def _joined(c):
    return F.array_join(c, "|")


def _records(spark, sf) -> DataFrame:
    """Metadata files, one for each part, as they are read."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    xml = F.concat(
        F.lit("<r xmlns:d='u:d'><d:title> "), "p_name", F.lit(" </d:title><d:alternative>Of "), "p_name", F.lit("</d:alternative><d:creator><a><d:name>"), "p_brand", F.lit("</d:name><d:alias>other</d:alias></a></d:creator><d:issued>"),
        (F.lit(1800) + F.col("p_size")).cast("string"), F.lit("-01-01</d:issued><d:subject><b><d:value>"), "p_type", F.lit("</d:value></b></d:subject><d:file d:about='https://x.org/"), k, F.lit("/pg"), k, F.lit(".cover.medium.jpg'/><d:file d:about='https://x.org/"),
        k, F.lit("/"), k, F.lit(".txt'/><d:file d:about='https://x.org/"), k, F.lit("/pg"), k, F.lit(".cover.png'/></r>"),
    )
    return readers.rdf_records(p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("gutenbergbookid"), xml.cast("binary").alias("content")))


def rdf_records(spark, sf):
    r = _records(spark, sf)
    return r.select("id", _joined("titles").alias("titles"), _joined("authors").alias("authors"), "issued", "summary", _joined("subjects").alias("subjects"), F.size("files").cast("bigint").alias("files"))


def rdf_covers(spark, sf):
    return readers.cover_entries(_records(spark, sf)).select("bookid", "size_label", F.col("sort_order").cast("bigint").alias("sort_order"), "image_url")


def rdf_star(spark, sf):
    t = readers.star_schema(_records(spark, sf))
    name = lambda kind, dim, pairs, key: t[pairs].join(t[dim], t[pairs][key] == t[dim]["id"]).select(F.lit(kind).alias("kind"), "bookid", F.lit(0).cast("bigint").alias("ord"), "name")
    titles = t["titles"].select(F.lit("title").alias("kind"), "bookid", F.col("ord").cast("bigint").alias("ord"), "name")
    dates = t["books"].select(F.lit("issued").alias("kind"), F.col("id").alias("bookid"), F.lit(0).cast("bigint").alias("ord"), F.col("dateissued").alias("name"))
    return titles.unionByName(dates).unionByName(name("author", "authors", "book_authors", "authorid")).unionByName(name("subject", "subjects", "book_subjects", "subjectid"))


def dataset_texts(spark, sf):
    d = table(spark, sf, "documents").select(F.concat((F.col("doc_id") % 50).cast("string"), F.lit("-0")).alias("id"), "text")
    return readers.dataset_texts(d).select("bookid", F.length("text").cast("bigint").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def listing_links(spark, sf):
    p = table(spark, sf, "pages").select(F.concat(F.lit("https://"), U.host(F.col("url")), F.lit("/files/"), F.col("page_id").cast("string"), F.lit("/")).alias("base"))
    names = ("../", "?C=N", "1.txt", "1.txt", "readme_warning.txt", "1.rdf", "a.nfo", "/dir/2-h.zip", "sub/", "https://y.org/3.MP3", "x.unknown")
    return readers.listing_links(p.withColumn("html", F.lit("".join(f'<a href="{n}">n</a>' for n in names))))


def listed_ids(spark, sf):
    d = table(spark, sf, "documents")
    return readers.listed_ids(d.select(F.concat(F.when(F.col("doc_id") % 5 == 0, "covers/").otherwise("books/"), (F.col("doc_id") % 70).cast("string"), F.when(F.col("doc_id") % 3 == 0, "/images/a.png").otherwise("/text/a.txt")).alias("path")))


def page_summary(spark, sf):
    p = table(spark, sf, "pages")
    html = F.concat(F.lit('<p>x</p><div id=1 class="a summary-text-container b">One <div>two</div>\n '), "url", F.lit("</div><div>no</div>"))
    return p.select("page_id", readers.page_summary(html).alias("summary"))


def librivox_items(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("string").alias("section_number"), F.concat(F.lit("Part "), F.col("l_linenumber").cast("string")).alias("title"), F.lit("u").alias("listen_url"), F.lit("1:00").alias("playtime"), F.array(F.struct(F.col("l_returnflag").alias("display_name"))).alias("readers")).alias("s"))
    answers = line.groupBy(F.col("l_orderkey").alias("book_id")).agg(F.collect_list("s").alias("sections"))
    payload = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("z"), F.col("book_id").cast("string")).alias("url_zip_file"), "sections")).alias("books")))
    out = readers.librivox_items(answers.select("book_id", payload.alias("payload")))
    return out.select("book_id", "package_url", _joined(F.transform("tracks", lambda t: t["title"])).alias("titles"), "narrator")


def live_or_local(spark, sf):
    c = table(spark, sf, "customer")
    a, b = c.where("c_nationkey < 15").select("c_custkey", F.col("c_name").alias("v")), c.where("c_nationkey > 9").select("c_custkey", F.col("c_mktsegment").alias("v"))
    return readers.live_or_local(a, b, "c_custkey", "v")


def book_records(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    ids = o.select((F.col("o_custkey") * 2).alias("gutenbergbookid")).distinct()
    id_map = c.select((F.col("c_custkey") - F.col("c_custkey") % 4).alias("gutenbergbookid"), F.col("c_custkey").alias("bookid"))
    own = c.select(F.col("c_custkey").alias("bookid"), "c_name", "c_mktsegment")
    desc = own.where("bookid % 3 = 0").select("bookid", F.col("c_name").alias("source_title"), F.col("c_mktsegment").alias("summary"), F.lit("dramatic").alias("category"))
    return readers.book_records(ids, id_map, desc, own.where("bookid % 5 = 0").select("bookid", F.col("c_name").alias("text")), own.where("bookid % 8 = 0").select("bookid", F.col("c_mktsegment").alias("html")))


def description_json(spark, sf):
    p = table(spark, sf, "part")
    desc = p.select(F.col("p_partkey").alias("bookid"), F.col("p_name").alias("source_title"), F.col("p_brand").alias("source_author"), F.col("p_type").alias("summary"), F.lit("practical").alias("category"))
    subjects = p.where("p_size > 10").select(F.col("p_partkey").alias("bookid"), F.explode(F.array("p_type", "p_brand")).alias("name"))
    return sinks.description_json(desc, subjects)


def id_map_json(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("gutenbergbookid"), F.col("c_custkey").alias("id"))
    return sinks.id_map_json(c).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("gutenbergbookid", "id"))


def content_objects(spark, sf):
    c = table(spark, sf, "customer")
    own = c.select(F.col("c_custkey").alias("bookid"), F.when(F.col("c_nationkey") < 12, "html").otherwise("text").alias("content_type"), F.concat(F.lit(" "), "c_name", F.lit("\n")).alias("raw_content"), F.col("c_mktsegment").alias("clean_content"), F.when(F.col("c_nationkey") < 6, F.concat(F.lit("<p>"), "c_name")).alias("html_content"))
    return sinks.content_objects(own)


def _covers(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("bookid"), F.when(n % 3 == 0, "medium").when(n % 3 == 1, "small").otherwise("large").alias("size_label"), n.alias("sort_order"), (n % 4).cast("bigint").alias("byte_size"), F.concat(F.lit("u"), n.cast("string")).alias("image_url"))


def best_cover(spark, sf):
    return catalog.best_cover(_covers(spark, sf)).select("bookid", "size_label", "image_url")


def covers_of_book(spark, sf):
    """A look-up by key: all covers of one book, in order."""
    return catalog.covers(_covers(spark, sf), 7).select("bookid", "size_label", "image_url")


def description_of_book(spark, sf):
    """Look-ups by key: a description that fits its book, and one that doesn't."""
    p = table(spark, sf, "part")
    desc = p.select(F.col("p_partkey").alias("bookid"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("another thing").alias("source_title"), F.lit(None).cast("string").alias("source_author"), F.col("p_type").alias("summary"))
    v = books.view(spark, sf)
    return catalog.description(v, desc, 8).unionByName(catalog.description(v, desc, 9)).select("bookid", "title", "summary", "from_source")


def page_with_fallback(spark, sf):
    """A search without hits gives the unfiltered page."""
    return books.flat(catalog.page_with_fallback(books.view(spark, sf), None, "zzzz qqqq", 10, 5)[0])


def audio_of_book(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("track_order"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("chapter_title"), F.col("l_linestatus").alias("track_url"), F.lit("1:00").alias("duration"))
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("book_id"), F.col("o_orderstatus").alias("narrator"))
    out = catalog.audio(own, line, 3)
    return out.select("book_id", "narrator", _joined(F.transform("chapters", lambda c: F.concat(c["track_order"].cast("string"), c["chapter_title"]))).alias("chapters"))


def decorated_history(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 37).alias("book_id"), F.col("ts").alias("updated_at"))
    desc = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("bookid"), F.col("n_name").alias("source_title"))
    return state.decorated(state.latest(e), desc, _covers(spark, sf)).select("user_id", "book_id", "id", "desc_title", "cover_url")


def cached_lookup(spark, sf):
    keys = table(spark, sf, "documents").select(F.concat(F.lit("k"), (F.col("doc_id") % 90).cast("string")).alias("cache_key")).distinct()
    cache = table(spark, sf, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("cache_key"), F.col("n_name").alias("payload"))
    return state.cached_lookup(keys, cache, lambda k: k.select("cache_key", F.upper("cache_key").alias("payload")))[0]


def guarded_save(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("bookid"), F.lit("old").alias("raw_content"), F.lit("old").alias("clean_content"), F.lit("html").alias("content_type"), F.lit(True).alias("has_images"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("bookid"), F.col("c_custkey").alias("gutenbergbookid"), F.concat(F.lit("[eBook #"), (F.col("c_custkey") - F.col("c_custkey") % 2).cast("string"), F.lit("]")).alias("raw_content"), F.col("c_name").alias("clean_content"))
    kept, rejected = state.guarded_save(old, new)
    marked = lambda d, kind: d.select(F.lit(kind).alias("kind"), "bookid", "clean_content")
    return marked(kept, "kept").unionByName(marked(rejected, "rejected"))


def save_description(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    none = F.lit(None).cast("string")
    old = c.select(F.col("c_custkey").alias("bookid"), F.col("c_name").alias("source_title"), F.lit("a").alias("source_author"), none.alias("genres_text"), none.alias("freebase_id"), F.when(F.col("c_custkey") % 40 != 0, F.col("c_mktsegment")).alias("summary"))
    new = s.select((F.col("s_suppkey") * 20).alias("bookid"), F.col("s_name").alias("source_title"), F.lit("").alias("source_author"), F.lit("g").alias("genres_text"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("new")).alias("summary"))
    return state.save_description(old, new).select("bookid", "source_title", "source_author", "genres_text", "summary")


def queue_reset(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "html").otherwise("text").alias("queue_key"), F.col("o_orderkey").alias("bookid"))
    return state.queue_reset(o, "html")


def delete_other_key(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return state.delete_where_other_key(line, table(spark, sf, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


def cascade_rows(spark, sf):
    """Every row that is left after orders and all that hangs on them went."""
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    gone = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    out = state.cascade_delete({"orders": (o, "o_orderkey"), "lineitem": (line, "l_orderkey")}, gone, "k")
    zero = F.lit(0).cast("bigint")
    return out["orders"].select(F.lit("orders").alias("name"), F.col("o_orderkey").alias("k"), zero.alias("n")).unionByName(out["lineitem"].select(F.lit("lineitem").alias("name"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("n")))


def merge_changes(spark, sf):
    b, c, d, a = books._groups(spark, sf)
    found = dedupe.canonical(dedupe.duplicate_groups(b), dedupe.scores(b, c, d, a))
    return dedupe.merge({}, found, dry_run=True)["changes"]


def metadata_changes(spark, sf):
    p = table(spark, sf, "part")
    own = p.select(F.col("p_partkey").alias("bookid"), F.col("p_name").alias("title"), F.col("p_brand").alias("authors"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("issued"), F.col("p_partkey").alias("gutenbergbookid"))
    rdf = p.select(F.col("p_partkey").alias("bookid"), F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("authors"), F.when(F.col("p_size") > 7, F.col("p_type")).alias("issued"), F.col("p_partkey").alias("gutenbergbookid"))
    return links.metadata_changes(own, rdf).select("bookid", "title", "new_title", "issued", "new_issued")


def first_done(spark, sf):
    line = table(spark, sf, "lineitem")
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 2), "done").when(F.col("l_returnflag") == "A", "error").otherwise("skipped")
    return links.first_done(line.select(F.col("l_orderkey").alias("bookid"), F.col("l_linenumber").alias("rank"), status.alias("status"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("message")))


def audio_resolution(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("book_id"), (F.col("c_nationkey") % 2 == 0).alias("is_synthesized"), "c_nationkey")
    pick = lambda k: c.where(F.col("book_id") % k == 0)
    return links.audio_resolution(pick(2).select("book_id", "is_synthesized"), pick(3).select("book_id"), pick(5).select("book_id"), repair=True)


def audio_gaps(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("numdownloads"))
    return links.audio_gaps(p, p.where("numdownloads > 25").select(F.col("id").alias("book_id")), None).select("id", "numdownloads")


def incomplete_descriptions(spark, sf):
    p = table(spark, sf, "part")
    desc = p.where("p_size > 20").select(F.col("p_partkey").alias("bookid"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("  ").alias("summary"))
    return links.incomplete_descriptions(p.select(F.col("p_partkey").alias("id")), desc).select("id")


def titled_tracks(spark, sf):
    line = table(spark, sf, "lineitem")
    tracks = line.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("track_order"), F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("url"), F.when(F.col("l_linenumber") == 2, "own").alias("title"))
    readme = line.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("Chapter "), F.col("l_linenumber").cast("string")).alias("title"), F.lit("0:01:00").alias("duration"))
    return links.titled_tracks(tracks, readme).select("book_id", "url", "title", "duration")


def readme_parts(spark, sf):
    c = table(spark, sf, "customer")
    text = F.concat(F.lit("Notes\nRead by: "), F.when(F.col("c_nationkey") < 8, "Various").otherwise(F.col("c_name")), F.lit("\n01 - First "), "c_mktsegment", F.lit(" - 0:12:34\nnothing\n02. Second - 1:00:00\n"))
    r = links.readme_parts(text)
    return c.select("c_custkey", r["narrator"].alias("narrator"), _joined(F.transform(r["chapters"], lambda x: F.concat(x["title"], F.lit("@"), x["duration"]))).alias("chapters"))


def sibling_summary(spark, sf):
    p = table(spark, sf, "part")
    b = p.select(F.col("p_partkey").alias("bookid"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    desc = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("bookid"), F.upper("p_name").alias("source_title"), F.col("p_brand").alias("source_author"), F.repeat(F.lit("s"), F.col("p_size")).alias("summary"))
    return match.sibling_summary(b, desc).select("bookid", F.length("summary").cast("bigint").alias("chars"))


def summary_cascade(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    s = match.summary_cascade(F.when(k % 7 == 0, F.lit(" x ")), F.when(k % 5 == 0, F.lit("y")), F.when(k % 3 == 0, F.lit("  ")), F.when(k % 2 == 0, F.col("p_type")), F.lit(None).cast("string"))
    return p.select("p_partkey", s["summary"].alias("summary"), s["source"].alias("source"))


def first_writer(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("bookid"))
    have = table(spark, sf, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("bookid"))
    return match.first_writer(o, have)


def get_or_create_ids(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    known = table(spark, sf, "customer").where("c_nationkey = 3").select((F.col("c_custkey") * 10).alias("id"), F.col("c_name").alias("name"))
    return match.get_or_create_ids(names, known)


def chapters_to_books(spark, sf):
    line = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 11).alias("query_id"), F.col("l_orderkey").alias("bookid"), F.col("l_quantity").alias("score"))
    return hybrid.chapters_to_books(line, 0.5).select("query_id", "bookid", F.round("score", 6).alias("score"))


def author_clusters(spark, sf):
    c = table(spark, sf, "customer")
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Brontë", "Dumas", "Bronte", "Verne"))), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit(", "), F.element_at(F.array(*map(F.lit, ("J. R.", "J.", "Émile", "Emile"))), (F.col("c_nationkey") % 4 + 1).cast("int")))
    return hybrid.author_clusters(c.select(name.alias("name"))).select("cluster", _joined("names").alias("names"))


def text_forms(spark, sf):
    """Single values: credits, lists, excerpts, entities, row ids, keys of runs."""
    p = table(spark, sf, "part")
    credit = F.concat("p_brand", F.lit(" & Co and "), "p_type", F.lit("; Last, First"))
    return p.select(
        "p_partkey", _joined(T.author_names(credit)).alias("authors"), _joined(T.subject_list(F.concat("p_type", F.lit("| ;"), "p_brand", F.lit("\n")))).alias("subjects"), T.excerpt(F.col("p_name"), 6).alias("excerpt"),
        T.unescaped_basic(F.concat(F.lit("&lt;&amp;quot; "), "p_name", F.lit("&#39;"))).alias("plain"), T.row_id(F.concat(F.col("p_partkey").cast("string"), F.lit("-0")), F.lit("x")).alias("row"),
        jsonx.run_key(F.array(F.lit("b"), F.col("p_partkey").cast("string"))).alias("run"), T.clean_catalog_title(F.concat(F.col("p_name"), F.lit(" $b  sub  title"))).alias("title"),
    )


def roman_values(spark, sf):
    cases = [(1, "IV"), (2, "xiv"), (3, "MCMXCIV"), (4, "abc"), (5, None), (6, "XL"), (7, "D")]
    return spark.createDataFrame(cases, "id bigint, n string").select("id", T.roman_value(F.col("n")).cast("bigint").alias("value"))


def category_cascade(spark, sf):
    p = table(spark, sf, "part")
    stored, subjects = F.when(F.col("p_size") > 40, "practical"), F.when(F.col("p_size") > 20, F.array(F.lit("Biography")))
    summary = F.when(F.col("p_size") > 10, F.concat(F.lit("A history of "), "p_name"))
    answer = F.when(F.col("p_size") % 2 == 0, "I think: ANALYTICAL, not practical").otherwise("none")
    return p.select("p_partkey", classify.category_cascade(stored, subjects, summary).alias("category"), classify.category_word(answer).alias("word"))


_CASE = " ".join(f"WHEN regexp_matches(j, '(?i)\\b(?:{w.replace(chr(39), chr(39) * 2)})\\b') THEN '{n}'" for n, w in classify.CATEGORIES)
_C = "(SELECT l_orderkey AS bookid, CASE l_linenumber % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'small' ELSE 'large' END AS size_label, l_linenumber AS sort_order, l_linenumber % 4 AS byte_size, 'u' || l_linenumber AS image_url FROM lineitem)"

QUERIES = {
    f.__name__: f
    for f in (
        rdf_records, rdf_covers, rdf_star, dataset_texts, listing_links, listed_ids, page_summary, librivox_items, live_or_local, book_records, description_json, id_map_json, content_objects, best_cover, covers_of_book, description_of_book,
        page_with_fallback, audio_of_book, decorated_history, cached_lookup, guarded_save, save_description, queue_reset, delete_other_key, cascade_rows, merge_changes, metadata_changes, first_done, audio_resolution, audio_gaps,
        incomplete_descriptions, titled_tracks, readme_parts, sibling_summary, summary_cascade, first_writer, get_or_create_ids, chapters_to_books, author_clusters, text_forms, roman_values, category_cascade,
    )
}

ORACLE = {
    "rdf_records": "SELECT p_partkey AS id, p_name || '|Of ' || p_name AS titles, p_brand AS authors, (1800 + p_size) || '-01-01' AS issued, NULL::VARCHAR AS summary, p_type AS subjects, 3::BIGINT AS files FROM part",
    "rdf_covers": "SELECT p_partkey AS bookid, 'medium' AS size_label, 0::BIGINT AS sort_order, 'https://x.org/' || p_partkey || '/pg' || p_partkey || '.cover.medium.jpg' AS image_url FROM part UNION ALL SELECT p_partkey, 'default', 2, 'https://x.org/' || p_partkey || '/pg' || p_partkey || '.cover.png' FROM part",
    "rdf_star": "SELECT 'title' AS kind, p_partkey AS bookid, o AS ord, CASE o WHEN 0 THEN p_name ELSE 'Of ' || p_name END AS name FROM part, (VALUES (0::BIGINT), (1)) v(o) UNION ALL SELECT 'issued', p_partkey, 0, (1800 + p_size) || '-01-01' FROM part UNION ALL SELECT 'author', p_partkey, 0, p_brand FROM part UNION ALL SELECT 'subject', p_partkey, 0, p_type FROM part",
    "dataset_texts": "SELECT doc_id % 50 AS bookid, length(text)::BIGINT AS chars, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 50 ORDER BY length(text) DESC, text DESC) = 1",
    "listing_links": """WITH p AS (SELECT DISTINCT page_id, 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages)
SELECT h || '/files/' || page_id || '/' AS base, CASE i WHEN 1 THEN h || '/files/' || page_id || '/1.txt' WHEN 2 THEN h || '/dir/2-h.zip' ELSE 'https://y.org/3.MP3' END AS url, ['text/plain', 'application/octet-stream', 'audio/mpeg'][i] AS kind FROM p, (VALUES (1), (2), (3)) v(i)""",
    "listed_ids": "SELECT DISTINCT doc_id % 70 AS gutenbergbookid FROM documents WHERE doc_id % 3 = 0",
    "page_summary": "SELECT page_id, 'One two ' || url AS summary FROM pages",
    "librivox_items": "SELECT l_orderkey AS book_id, 'z' || l_orderkey AS package_url, string_agg('Part ' || l_linenumber, '|' ORDER BY l_linenumber) AS titles, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'Various' END AS narrator FROM lineitem GROUP BY 1",
    "live_or_local": "SELECT c_custkey, CASE WHEN c_nationkey > 9 THEN c_mktsegment ELSE c_name END AS v FROM customer",
    "book_records": """WITH i AS (SELECT DISTINCT o_custkey * 2 AS g FROM orders), m AS (SELECT c_custkey - c_custkey % 4 AS g, min(c_custkey) AS b, count(*) AS n FROM customer GROUP BY 1)
SELECT i.g AS gutenbergbookid, b AS bookid, CASE WHEN b % 3 = 0 THEN c_name ELSE 'Untitled' END AS title, CASE WHEN b % 3 = 0 THEN c_mktsegment ELSE '' END AS summary, CASE WHEN b % 3 = 0 THEN 'dramatic' END AS category,
       CASE WHEN b % 5 = 0 THEN c_name WHEN b % 8 = 0 THEN c_mktsegment END AS text, CASE WHEN b IS NULL THEN 'unknown id' WHEN n > 1 THEN 'conflicting ids' WHEN b % 5 <> 0 AND b % 8 <> 0 THEN 'no content' END AS problem
FROM i LEFT JOIN m USING (g) LEFT JOIN customer ON c_custkey = b""",
    "description_json": """SELECT p_partkey AS bookid, to_json({'bookid': p_partkey, 'source_title': p_name, 'source_author': p_brand, 'summary': p_type, 'subjects': CASE WHEN p_size > 10 THEN list_sort(list_distinct([p_type, p_brand])) ELSE []::VARCHAR[] END, 'category': 'practical'})::VARCHAR AS value FROM part""",
    "id_map_json": "SELECT (c_custkey * 3)::VARCHAR AS gutenbergbookid, c_custkey AS id FROM customer",
    "content_objects": "SELECT c_custkey AS bookid, CASE WHEN c_nationkey < 12 THEN 'html' ELSE 'txt' END AS extension, CASE WHEN c_nationkey < 6 THEN '<p>' || c_name WHEN c_nationkey < 12 THEN c_mktsegment ELSE c_name END AS body FROM customer",
    "best_cover": f"SELECT bookid, size_label, image_url FROM {_C} QUALIFY row_number() OVER (PARTITION BY bookid ORDER BY CASE size_label WHEN 'medium' THEN 0 WHEN 'large' THEN 1 ELSE 2 END, sort_order, image_url) = 1",
    "covers_of_book": f"SELECT bookid, size_label, image_url FROM {_C} WHERE bookid = 7",
    "description_of_book": "SELECT p_partkey AS bookid, p_name AS title, CASE p_partkey WHEN 8 THEN p_type ELSE '' END AS summary, p_partkey = 8 AS from_source FROM part WHERE p_partkey IN (8, 9)",
    "page_with_fallback": f"{books._VIEW} SELECT {books._COLUMNS} FROM v ORDER BY downloads DESC, id LIMIT 10 OFFSET 5",
    "audio_of_book": "SELECT o_orderkey AS book_id, o_orderstatus AS narrator, string_agg(l_linenumber || l_returnflag, '|' ORDER BY l_linenumber, l_partkey, l_returnflag) AS chapters FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 3 GROUP BY 1, 2",
    "decorated_history": f"""WITH h AS (SELECT event_id AS id, user_id, event_id % 37 AS book_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 37 ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT bookid, image_url FROM {_C} QUALIFY row_number() OVER (PARTITION BY bookid ORDER BY CASE size_label WHEN 'medium' THEN 0 WHEN 'large' THEN 1 ELSE 2 END, sort_order, image_url) = 1)
SELECT user_id, book_id, id, n_name AS desc_title, image_url AS cover_url FROM h LEFT JOIN nation ON n_nationkey = book_id LEFT JOIN c ON bookid = book_id""",
    "cached_lookup": "SELECT DISTINCT 'k' || (doc_id % 90) AS cache_key, coalesce(n_name, 'K' || (doc_id % 90)) AS payload FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 90",
    "guarded_save": "SELECT 'kept' AS kind, c_custkey AS bookid, CASE WHEN c_custkey % 6 = 0 THEN c_name ELSE 'old' END AS clean_content FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'rejected', c_custkey, c_name FROM customer WHERE c_custkey % 6 = 3",
    "save_description": """WITH o AS (SELECT c_custkey AS b, c_name, CASE WHEN c_custkey % 40 <> 0 THEN c_mktsegment END AS s FROM customer), n AS (SELECT s_suppkey * 20 AS b, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'new' END AS s FROM supplier),
m AS (SELECT n.b, n.s_name, CASE WHEN o.b IS NOT NULL THEN 'a' END AS a, coalesce(n.s, o.s) AS s FROM n LEFT JOIN o ON o.b = n.b)
SELECT b AS bookid, c_name AS source_title, 'a' AS source_author, NULL::VARCHAR AS genres_text, s AS summary FROM o WHERE b NOT IN (SELECT b FROM m WHERE s IS NOT NULL) UNION ALL SELECT b, s_name, a, 'g', s FROM m WHERE s IS NOT NULL""",
    "queue_reset": "SELECT 'text' AS queue_key, o_orderkey AS bookid FROM orders WHERE o_orderkey % 2 <> 0",
    "delete_other_key": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')",
    "cascade_rows": "WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT 'orders' AS name, o_orderkey AS k, 0::BIGINT AS n FROM orders WHERE o_orderkey NOT IN (FROM g) UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber::BIGINT FROM lineitem WHERE l_orderkey NOT IN (FROM g)",
    "merge_changes": f"{books._GROUPS} SELECT bookid, target FROM ranked WHERE place > 1",
    "metadata_changes": "SELECT p_partkey AS bookid, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS new_title, CASE WHEN p_size > 5 THEN p_type END AS issued, CASE WHEN p_size > 7 THEN p_type END AS new_issued FROM part WHERE (p_partkey % 4 = 0 AND upper(p_name) <> p_name) OR p_size IN (6, 7)",
    "first_done": """WITH l AS (SELECT l_orderkey AS b, l_linenumber AS r, CASE WHEN l_returnflag = 'R' AND l_linenumber > 2 THEN 'done' WHEN l_returnflag = 'A' THEN 'error' ELSE 'skipped' END AS s, l_returnflag || l_linenumber AS m FROM lineitem)
SELECT b AS bookid, CASE WHEN bool_or(s = 'done') THEN 'done' WHEN bool_or(s = 'error') THEN 'error' ELSE 'skipped' END AS status, coalesce(arg_min(m, {'r': r, 'm': m}) FILTER (WHERE s = 'done'), string_agg(m, '; ' ORDER BY r, m)) AS message FROM l GROUP BY 1""",
    "audio_resolution": """SELECT c_custkey AS book_id, CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 2 <> 0 THEN 'own' WHEN c_custkey % 5 = 0 THEN 'librivox' WHEN c_custkey % 2 = 0 THEN 'own' WHEN c_custkey % 3 = 0 THEN 'delete' ELSE 'keep' END AS action FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0""",
    "audio_gaps": "SELECT p_partkey AS id, p_size::BIGINT AS numdownloads FROM part WHERE p_size <= 25",
    "incomplete_descriptions": "SELECT p_partkey AS id FROM part WHERE NOT (p_size > 20 AND p_size % 2 = 0)",
    "titled_tracks": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem WHERE l_linenumber <= 3)
SELECT t.l_orderkey AS book_id, 'u' || t.l_linenumber AS url, CASE WHEN t.l_linenumber = 2 THEN 'own' WHEN r.i IS NOT NULL THEN 'Chapter ' || r.l_linenumber END AS title, CASE WHEN r.i IS NOT NULL THEN '0:01:00' END AS duration FROM t LEFT JOIN r ON r.l_orderkey = t.l_orderkey AND r.i = t.i""",
    "readme_parts": "SELECT c_custkey, CASE WHEN c_nationkey >= 8 THEN c_name END AS narrator, 'First ' || c_mktsegment || '@0:12:34|Second@1:00:00' AS chapters FROM customer",
    "sibling_summary": "SELECT p.p_partkey AS bookid, max(d.p_size)::BIGINT AS chars FROM part p JOIN part d ON d.p_name = p.p_name AND d.p_brand = p.p_brand AND d.p_partkey <> p.p_partkey AND d.p_size % 3 = 0 AND d.p_size > 0 GROUP BY 1",
    "summary_cascade": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'x' WHEN p_partkey % 5 = 0 THEN 'y' WHEN p_partkey % 2 = 0 THEN p_type END AS summary, CASE WHEN p_partkey % 7 = 0 THEN 'existing' WHEN p_partkey % 5 = 0 THEN 'sibling' WHEN p_partkey % 2 = 0 THEN 'rdf_same_work' END AS source FROM part",
    "first_writer": "SELECT min(o_orderkey) AS query_id, o_custkey AS bookid FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY 2",
    "get_or_create_ids": "WITH k AS (SELECT c_custkey * 10 AS id, c_name AS name FROM customer WHERE c_nationkey = 3) SELECT * FROM k UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM k) + row_number() OVER (ORDER BY name), name FROM (SELECT DISTINCT c_name AS name FROM customer WHERE c_name NOT IN (SELECT name FROM k))",
    "chapters_to_books": "SELECT l_orderkey % 11 AS query_id, l_orderkey AS bookid, round(max(l_quantity) + 0.5 * (count(*) - 1), 6) AS score FROM lineitem GROUP BY 1, 2",
    "author_clusters": """WITH n AS (SELECT DISTINCT ['Brontë', 'Dumas', 'Bronte', 'Verne'][c_custkey % 4 + 1] AS s, ['J. R.', 'J.', 'Émile', 'Emile'][c_nationkey % 4 + 1] AS g FROM customer)
SELECT CASE s WHEN 'Brontë' THEN 'bronte' ELSE lower(s) END || '|' || CASE WHEN g IN ('J. R.', 'J.') THEN 'j' ELSE 'emile' END AS cluster, string_agg(s || ', ' || g, '|' ORDER BY s || ', ' || g) AS names FROM n GROUP BY 1""",
    "text_forms": r"""SELECT p_partkey, p_brand || '|Co|' || p_type || '|Last, First' AS authors, p_type || '|' || p_brand AS subjects, CASE WHEN length(p_name) <= 6 THEN p_name ELSE rtrim(substr(p_name, 1, 5)) || '…' END AS excerpt,
       '<&quot; ' || p_name || '''' AS plain, p_partkey AS row, substr(sha1(least('b', p_partkey::VARCHAR) || ',' || greatest('b', p_partkey::VARCHAR)), 1, 12) AS run, p_name || ' sub title' AS title FROM part""",
    "roman_values": "SELECT * FROM (VALUES (1::BIGINT, 4::BIGINT), (2, 14), (3, 1994), (4, NULL), (5, NULL), (6, 40), (7, 500)) v(id, value)",
    "category_cascade": f"""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'practical' ELSE coalesce(CASE WHEN p_size > 20 THEN (SELECT CASE {_CASE} END FROM (SELECT 'Biography' AS j)) END, CASE WHEN p_size > 10 THEN (SELECT CASE {_CASE} END FROM (SELECT 'A history of ' || p_name AS j)) END, 'dramatic') END AS category,
       CASE WHEN p_size % 2 = 0 THEN 'analytical' END AS word FROM part""",
}
