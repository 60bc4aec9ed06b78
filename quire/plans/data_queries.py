"""Queries over links, state, texts and scores on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import text as T
from ..functions import urls as U
from ..operators import hybrid, links, state, summarize, texts
from ..session import table

_FILES = ("-h.zip", ".html.images", ".epub3.images", ".epub.images", ".txt", ".mp3", "-mp3.zip", ".ogg")


def _links(spark, sf) -> DataFrame:
    """Links made of pages: the site is a book, the page's number a file."""
    p = table(spark, sf, "pages")
    suffix = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("page_id") % len(_FILES) + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ("/cache/epub/", "/files/", "/ebooks/", "/other/"))), (F.col("page_id") % 7 % 4 + 1).cast("int"))
    book = F.col("page_id") % 23
    url = F.concat(F.lit("https://"), U.host(F.col("url")), folder, book.cast("string"), F.lit("/"), book.cast("string"), F.lit("-"), F.col("page_id").cast("string"), suffix)
    return p.select(book.alias("bookid"), url.alias("url")).withColumn("kind", U.media_type(F.col("url")))


_LINKS = """
WITH l AS (
  SELECT page_id % 23 AS bookid, 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || ['/cache/epub/', '/files/', '/ebooks/', '/other/'][(page_id % 7 % 4 + 1)::INT] ||
         (page_id % 23) || '/' || (page_id % 23) || '-' || page_id || ['-h.zip', '.html.images', '.epub3.images', '.epub.images', '.txt', '.mp3', '-mp3.zip', '.ogg'][(page_id % 8 + 1)::INT] AS url
  FROM pages),
t AS (SELECT *, CASE WHEN url LIKE '%.txt' THEN 'text/plain' WHEN url LIKE '%.epub.images' THEN 'application/epub+zip' WHEN url LIKE '%.zip' THEN 'application/octet-stream' WHEN url LIKE '%.mp3' THEN 'audio/mpeg' WHEN url LIKE '%.ogg' THEN 'audio/ogg' END AS kind,
        CASE WHEN url LIKE '%-h.zip' THEN 0 WHEN url LIKE '%.html.images' THEN 1 WHEN url LIKE '%.epub3.images' THEN 2 WHEN url LIKE '%.epub.images' THEN 3 END AS r FROM l)
"""


def best_source(spark, sf):
    return links.best_illustrated(_links(spark, sf))


def ranked_candidates(spark, sf):
    out = links.ranked_candidates(_links(spark, sf))
    return out.select("bookid", F.array_join(F.transform("candidates", lambda c: c["url"]), "|").alias("urls"))


def link_repair_choice(spark, sf):
    return links.identifying_link(_links(spark, sf))


def audio_item(spark, sf):
    out = links.audio_items(_links(spark, sf).withColumnRenamed("bookid", "book_id"))
    return out.select("book_id", "package_url", "audio_format", F.col("track_count").cast("bigint").alias("track_count"), "is_synthesized", F.array_join(F.transform("tracks", lambda t: t["url"]), "|").alias("tracks"))


def action_plan(spark, sf):
    books = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("bookid"), (F.col("n_nationkey") - F.col("n_nationkey") % 2).cast("bigint").alias("gutenbergbookid"), (F.col("n_regionkey") == 1).alias("has_content"))
    return links.content_plan(books, _links(spark, sf))


def file_plan(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.concat("l_returnflag", F.lit("-"), F.col("l_linenumber").cast("string")).alias("name"), "l_linenumber", "l_linestatus")
    local = line.where("l_linenumber <= 3 and book_id % 5 <> 0")
    live = line.where("l_linestatus = 'O' and book_id % 7 <> 0")
    return links.file_plan(local, live).select("book_id", "action")


def url_facts(spark, sf):
    own = [(-1, "https://x.org/files/98/98-m/98-m-01.mp3", 98), (-2, "https://x.org/ebooks/98.txt.utf-8", 98), (-3, "https://x.org/cache/epub/98/pg98.cover.medium.jpg", 98), (-4, "https://x.org/files/981/981-0.txt?x=98/", 98), (-5, "https://en.wikipedia.org/wiki/98", 7)]
    rows = spark.createDataFrame(own, "page_id bigint, url string, id bigint").unionByName(table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") * 33 % 1000).alias("id")))
    u = F.col("url")
    return rows.select("page_id", U.linked_id(u).alias("linked_id"), U.base_of(u).alias("base"), U.belongs_to(u, F.col("id")).alias("belongs"), U.is_synthesized(u).alias("synthesized"), U.media_type(u).alias("kind"), U.track_number(u, F.col("page_id")).alias("track"), T.year_in_text(u).alias("year"))


def shard_assignment(spark, sf):
    return links.round_robin(table(spark, sf, "documents").select("doc_id"), "doc_id", 7).select("doc_id", F.col("shard").cast("bigint").alias("shard"))


def _history(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 37).alias("book_id"), F.when(F.col("event_type") == "view", "text").otherwise(F.col("event_type")).alias("media_type"), F.col("props").alias("position"), F.date_trunc("hour", "ts").alias("updated_at"))


def history_recent(spark, sf):
    return state.recent(state.normalized_history(_history(spark, sf))).select("user_id", "book_id", "id", "media_type", "position", F.col("place").cast("bigint").alias("place"))


def history_last(spark, sf):
    return state.recent(_history(spark, sf), 1).select("user_id", "book_id", "id")


def resume_label(spark, sf):
    h = _history(spark, sf)
    m = F.create_map(F.lit("selected_text_index"), F.get_json_object("position", "$.k"), F.lit("track_order"), F.get_json_object("position", "$.k"), F.lit("current_time"), (F.col("id") % 5000).cast("string"))
    return h.select("id", jsonx.resume_label(F.when(F.col("media_type") == "text", "text").otherwise("audio"), m).alias("label"))


def genre_json(spark, sf):
    own = [(-1, None), (-2, '{"/m/2": "Novel", "/m/1": "Epic"}'), (-3, '["a","b"]'), (-4, "plain"), (-5, "{bad")]
    rows = spark.createDataFrame(own, "event_id bigint, props string").unionByName(table(spark, sf, "events").select("event_id", "props"))
    return rows.select("event_id", F.array_join(jsonx.genres(F.col("props")), "|").alias("genres"))


def _queue(spark, sf):
    """A queue of all orders."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    return o.select(F.when(F.col("o_orderkey") % 2 == 0, "html").otherwise("text").alias("queue_key"), F.col("o_orderkey").alias("bookid"), status.alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"), F.col("o_orderpriority").alias("last_error"))


def queue_seed(spark, sf):
    targets = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("bookid"))
    return state.queue_seed(_queue(spark, sf), targets, "html").select("queue_key", "bookid", "status", F.col("attempts").cast("bigint").alias("attempts"), "last_error")


def queue_status(spark, sf):
    return state.queue_status(_queue(spark, sf))


def queue_pending(spark, sf):
    return state.queue_pending(_queue(spark, sf), "html", 3).select("bookid", F.col("attempts").cast("bigint").alias("attempts"))


def queue_transition(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.lit("html").alias("queue_key"), F.col("o_orderkey").alias("bookid"), F.lit("failed").alias("status"), F.lit(1).alias("delta"), F.repeat(F.lit("e"), F.lit(600)).alias("error"))
    return state.queue_transition(_queue(spark, sf), o).select("queue_key", "bookid", "status", F.col("attempts").cast("bigint").alias("attempts"), "last_error")


def _base(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("bookid"), F.col("c_name").alias("clean_content"), F.col("c_mktsegment").alias("content_type"), F.lit(True).alias("has_images"))


def upsert_replace(spark, sf):
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 20).alias("bookid"), F.col("s_name").alias("clean_content"))
    return state.upsert_replace(_base(spark, sf), new, ["bookid"], {"content_type": "text", "has_images": False})


def upsert_update(spark, sf):
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 20).alias("bookid"), F.col("s_name").alias("clean_content"))
    return state.upsert_update(_base(spark, sf), new, ["bookid"], ["clean_content"])


def insert_ignore(spark, sf):
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 20).alias("bookid"), F.col("s_name").alias("clean_content"))
    return state.insert_or_ignore(_base(spark, sf), new, ["bookid"])


def replace_children(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("n"))
    new = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(-1).cast("bigint").alias("n"))
    return state.replace_children(line, new, "l_orderkey")


def cascade_delete(spark, sf):
    o, line, c = (table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    gone = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    out = state.cascade_delete({"orders": (o, "o_orderkey"), "lineitem": (line, "l_orderkey"), "customer": (c, "c_custkey")}, gone, "k")
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, d in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def strip_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(texts.strip_markup(F.col("html")), r"\s+", " ").alias("text"))


def page_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(texts.page_links(F.col("html")), "|").alias("links"))


def image_refs(spark, sf):
    html = F.concat(F.lit('<img src="a/'), F.col("page_id").cast("string"), F.lit('.png?x"><IMG alt=1 src=\'b.jpg\'>'), "html", F.lit('<img src="c/b.jpg">'))
    return table(spark, sf, "pages").select("page_id", F.array_join(texts.image_names(html), "|").alias("images"))


def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", texts.html_text(F.col("html")).alias("text"))


def reading_model(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(texts.headings_of(F.col("html"))).alias("h")).select("page_id", "h.title", "h.anchor", "h.level")


def char_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(texts.char_chunks(F.col("text"), 250)).alias("i", "piece"))
    return d.select("doc_id", F.col("i").cast("bigint").alias("i"), "piece")


def token_windows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(texts.token_windows(T.tokens(F.col("text")), 100, 20)).alias("i", "w"))
    return d.select("doc_id", F.col("i").cast("bigint").alias("i"), F.size("w").cast("bigint").alias("n"), F.array_join("w", " ").alias("words"))


def turn_blocks(spark, sf):
    c = table(spark, sf, "conversations")
    return texts.turn_blocks(c, "conv_id", "turn", F.col("role") == "user").select("conv_id", "block", "text", F.col("n_rows").cast("bigint").alias("n_rows"))


_BOOK = "\n".join(["The Title", "", "CONTENTS.", *[f"Chapter {i}    {i * 10}" for i in range(1, 10)], "", "Preface line", "CHAPTER I", "First text.", "More.", "CHAPTER II: Of Things", "Second text.", *["Line."] * 8])


def _books(spark, sf):
    own = spark.createDataFrame([(-1, _BOOK), (-2, "CHAPTER I\nOnly.\n\nCHAPTER II\nAlso."), (-3, None), (-4, "no headings at all")], "bookid bigint, text string")
    return own.unionByName(table(spark, sf, "documents").select(F.col("doc_id").alias("bookid"), "text"))


def chapter_split(spark, sf):
    return texts.chapters(_books(spark, sf)).select("bookid", "chapter_index", "title", F.length("text").alias("chars"))


def distinct_chapters(spark, sf):
    return texts.distinct_chapters(texts.chapters(_books(spark, sf))).select("bookid", "chapter_index", "title")


def short_chapters(spark, sf):
    return texts.short_chapters(_books(spark, sf), 5).select("bookid", "n_chapters", "is_short")


def clean_text(spark, sf):
    return _books(spark, sf).select("bookid", texts.clean(F.col("text")).alias("text"))


def reclean_changed(spark, sf):
    b = _books(spark, sf).select("bookid", F.col("text").alias("raw_content"), F.concat(F.lit("*** START OF THE PROJECT GUTENBERG EBOOK ***\n"), F.coalesce("text", F.lit(""))).alias("clean_content"))
    return texts.recleaned(b).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def stub_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.looks_like_book(F.col("text")).alias("is_book"))


def markup_flag(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("d").alias("kind"))
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.lit("p").alias("kind"))
    return d.unionByName(p).select("kind", "id", T.looks_like_markup(F.col("text")).alias("is_markup"))


def marker_mismatch(spark, sf):
    """Documents under a header that names a book, which is the expected one for some of them, and rows for the rarer forms."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("[eBook #"), (F.col("doc_id") % 50).cast("string"), F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("text"), (F.col("doc_id") % 75).alias("expected"))
    cases = [(-1, "x [eBook #98] y", 98), (-2, "eText #98 then [eBook #99]", 98), (-3, None, 5), (-4, "none", 5), (-5, "ebook # 7", 7), (-6, "z" * 30_000 + "[ebook #1]", 2), (-7, "EText #12", 13)]
    rows = spark.createDataFrame(cases, "id bigint, text string, expected bigint").unionByName(d)
    return rows.select("id", T.marker_id(F.col("text")).alias("found"), T.marker_mismatch(F.col("text"), F.col("expected")).alias("mismatch"))


def search_tokens(spark, sf):
    cases = [(-1, "The Tale of 2 Cities"), (-2, "a"), (-3, "!"), (-4, "of the"), (-5, "foo_bar foo_bar x"), (-6, "Été à Paris")]
    rows = spark.createDataFrame(cases, "id bigint, q string").unionByName(table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("q")))
    return rows.select("id", F.array_join(T.search_tokens(F.col("q")), " ").alias("tokens"))


def desc_accept(spark, sf):
    from ..operators.match import text_matches

    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type")
    fits = text_matches(F.col("p_name"), F.concat(F.lit("a "), "p_name"), 0.8) & text_matches(F.col("p_type"), F.when(F.col("id") % 3 == 0, F.lit("economy class")).otherwise(F.col("p_brand")), 0.5)
    return p.select("id", fits.alias("accepted"))


def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return hybrid.cosine_neighbours(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe")), e)


def lexical_ratio(spark, sf):
    """Each document's whole text against its cleaned form."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", summarize.lexical_ratio(F.col("text"), texts.clean(F.col("text"))).alias("ratio"))


def quality_gate(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    s = (F.col("doc_id") % 100) / 100
    return d.select("doc_id", summarize.passes(s, F.col("n_chars") % 100 / 100, F.col("doc_id") % 7 / 7, F.col("quality") == 0, F.col("toxic").isNotNull()).alias("passed"))


def story_so_far(spark, sf):
    """A running join of first sentences: the fold's shape with a model that keeps all."""
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    first = c.withColumn("lead", F.regexp_extract("text", r"^[^.\n]*", 0))
    return first.select("conv_id", "turn", F.array_join(F.collect_list("lead").over(w), " / ").alias("story"))


def summarize_fold(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("bookid"), F.lit("a book").alias("title"), "text")
    return summarize.summarize_books(d, chunk=400, overlap=40, window=200).select("bookid", "chapter_index", "chapter_title", "chunk_count", "summary")


_Q = "WITH q AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'html' ELSE 'text' END AS queue_key, o_orderkey AS bookid, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status, o_orderkey % 5 AS attempts, o_orderpriority AS last_error FROM orders)"
_B = "WITH b AS (SELECT c_custkey AS bookid, c_name AS clean_content, c_mktsegment AS content_type, true AS has_images FROM customer), n AS (SELECT s_suppkey * 20 AS bookid, s_name AS clean_content FROM supplier)"
_H = "WITH h AS (SELECT event_id AS id, user_id, event_id % 37 AS book_id, CASE WHEN event_type = 'view' THEN 'text' ELSE 'audio' END AS media_type, props, date_trunc('hour', ts) AS upd FROM events), l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY user_id, book_id ORDER BY upd DESC, id DESC) = 1)"
_STOP = "['a','an','the','of','in','on','at','to','for','and','or','by','from','with','as','is','it','its','be','are','was']"

_STRIP = "E' \\t\\n\\x0B\\f\\r'"


def _chapters_sql(heading: str, front: str) -> str:
    """CTE c: bookid, k (0: what stands before the first heading), title and text of the chapters that the lines make."""
    own = ", ".join(f"({k}::BIGINT, {t})" for k, t in ((-1, f"'{_BOOK}'"), (-2, "E'CHAPTER I\\nOnly.\\n\\nCHAPTER II\\nAlso.'"), (-3, "NULL"), (-4, "'no headings at all'")))
    return f"""WITH b(bookid, text) AS (VALUES {own} UNION ALL SELECT doc_id, text FROM documents),
s AS (SELECT bookid, string_split(replace(text, E'\\r\\n', E'\\n'), E'\\n') AS x FROM b WHERE text IS NOT NULL),
l AS (SELECT bookid, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM s),
h AS (SELECT *, length(trim(line, {_STRIP})) <= {texts.HEADING_CHARS} AND regexp_matches(line, '(?i){heading}') AS head FROM l),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY bookid ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM h),
t AS (SELECT bookid, k, max(trim(line, {_STRIP})) FILTER (WHERE head) AS title, trim(string_agg(line, E'\\n' ORDER BY i), {_STRIP}) AS text, count(*) OVER (PARTITION BY bookid) AS parts FROM g GROUP BY bookid, k),
c AS (SELECT bookid, k, CASE WHEN k > 0 THEN title WHEN parts = 1 THEN 'Full Text' ELSE '{front}' END AS title, text FROM t WHERE text <> '')
"""


QUERIES = {f.__name__: f for f in (best_source, ranked_candidates, link_repair_choice, audio_item, action_plan, file_plan, url_facts, shard_assignment, history_recent, history_last, resume_label, genre_json, queue_seed, queue_status, queue_pending, queue_transition, upsert_replace, upsert_update, insert_ignore, replace_children, cascade_delete, strip_markup, page_links, image_refs, html_text, reading_model, char_chunks, token_windows, turn_blocks, chapter_split, distinct_chapters, short_chapters, clean_text, reclean_changed, stub_filter, markup_flag, marker_mismatch, search_tokens, desc_accept, cosine_topk, lexical_ratio, quality_gate, story_so_far, summarize_fold)}

ORACLE = {
    "best_source": _LINKS + "SELECT bookid, url, ['h-zip', 'html.images', 'epub3.images', 'epub.images'][r + 1] AS source_type FROM t WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bookid ORDER BY r, CASE WHEN contains(url, '/cache/epub/') THEN 0 WHEN contains(url, '/files/') THEN 1 WHEN contains(url, '/ebooks/') THEN 2 ELSE 3 END, length(url), url) = 1",
    "ranked_candidates": _LINKS + "SELECT bookid, string_agg(url, '|' ORDER BY p, url) AS urls FROM (SELECT DISTINCT bookid, url, CASE kind WHEN 'text/plain' THEN 0 WHEN 'application/epub+zip' THEN 11 WHEN 'application/octet-stream' THEN 13 END AS p FROM t) WHERE p IS NOT NULL GROUP BY bookid",
    "link_repair_choice": _LINKS + "SELECT bookid, coalesce(min(url) FILTER (WHERE contains(url, '/ebooks/') AND NOT contains(lower(url), '.rdf')), min(url) FILTER (WHERE contains(url, '/files/')), min(url)) AS url FROM t GROUP BY bookid",
    "audio_item": _LINKS + """, x AS (SELECT bookid, url, kind, regexp_matches(url, '-mp3\\.zip$') AS pk, CASE kind WHEN 'audio/mpeg' THEN 0 WHEN 'audio/ogg' THEN 2 END AS p, regexp_extract(url, '(\\d+)\\.[^./]+$', 1)::BIGINT AS n FROM (SELECT DISTINCT * FROM t) WHERE regexp_matches(url, '(\\d+)\\.[^./]+$') OR url LIKE '%zip'),
b AS (SELECT bookid, min(p) AS best, min(url) FILTER (WHERE pk) AS package FROM x GROUP BY bookid)
SELECT b.bookid AS book_id, coalesce(any_value(package), arg_min(url, (n, url))) AS package_url, any_value(kind) AS audio_format, count(*) AS track_count, bool_and(regexp_matches(url, '/\\d+-m/')) AS is_synthesized, string_agg(url, '|' ORDER BY n, url) AS tracks
FROM b JOIN x ON x.bookid = b.bookid AND x.p = b.best AND NOT x.pk GROUP BY b.bookid""".replace("SELECT bookid, url, kind, regexp", "SELECT bookid, url, kind, regexp").replace("regexp_extract(url, '(\\d+)\\.[^./]+$', 1)::BIGINT", "TRY_CAST(regexp_extract(url, '(\\d+)\\.[^./]+$', 1) AS BIGINT)"),
    "action_plan": _LINKS + """, f AS (
  SELECT n_nationkey::BIGINT AS bookid, n_regionkey = 1 AS has_content, count(url) AS n, coalesce(bool_and(coalesce(kind LIKE 'audio/%' OR kind LIKE 'video/%', false)), false) AS media,
         coalesce(bool_or(regexp_matches(url, '/(' || g || '$|(pg)?' || g || '[.-]|' || g || '_|' || g || '/)')), false) AS own
  FROM (SELECT *, n_nationkey - n_nationkey % 2 AS g FROM nation) LEFT JOIN t ON t.bookid = n_nationkey GROUP BY 1, 2)
SELECT bookid, CASE WHEN n = 0 THEN 'skip' WHEN media THEN 'audio-only' WHEN NOT own THEN 'repair' WHEN has_content THEN 'refresh' ELSE 'download' END AS action FROM f""",
    "file_plan": """
WITH l AS (SELECT l_orderkey AS b, l_returnflag || '-' || l_linenumber AS name, l_linenumber AS n, l_linestatus AS s FROM lineitem),
a AS (SELECT b, list(DISTINCT name ORDER BY name) AS x FROM l WHERE n <= 3 AND b % 5 <> 0 GROUP BY b), v AS (SELECT b, list(DISTINCT name ORDER BY name) AS y FROM l WHERE s = 'O' AND b % 7 <> 0 GROUP BY b),
j AS (SELECT coalesce(a.b, v.b) AS book_id, x, y FROM a FULL JOIN v ON a.b = v.b)
SELECT book_id, CASE WHEN x IS NULL THEN 'download' WHEN y IS NULL THEN 'local' WHEN x = y THEN 'skip' WHEN len(list_filter(y, lambda e: NOT list_contains(x, e))) > 0 THEN 'repair' ELSE 'refresh' END AS action FROM j""",
    "shard_assignment": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 7 AS shard FROM documents",
    "history_recent": _H + "SELECT user_id, book_id, id, media_type, replace(props, ': ', ':') AS position, row_number() OVER (PARTITION BY user_id ORDER BY upd DESC, id DESC) AS place FROM l QUALIFY place <= 10".replace("replace(props, ': ', ':')", "'{\"k\":\"' || (props->>'$.k') || '\"}'"),
    "history_last": _H + "SELECT user_id, book_id, id FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY upd DESC, id DESC) = 1",
    "resume_label": "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'Chapter ' || ((props->>'$.k')::INT + 1) ELSE 'Track ' || ((props->>'$.k')::INT + 1) || ' · ' || (event_id % 5000 // 60) || ':' || lpad((event_id % 5000 % 60)::VARCHAR, 2, '0') END AS label FROM events",
    "genre_json": """SELECT * FROM (VALUES (-1::BIGINT, ''), (-2, 'Epic|Novel'), (-3, 'a|b'), (-4, 'plain'), (-5, '{bad')) v(event_id, genres) UNION ALL SELECT event_id, props->>'$.k' FROM events""",
    "queue_seed": _Q + ", t AS (SELECT o_orderkey AS bookid FROM orders WHERE o_orderstatus <> 'F') SELECT queue_key, q.bookid, CASE WHEN r THEN 'pending' ELSE status END AS status, CASE WHEN r THEN 0 ELSE attempts END AS attempts, CASE WHEN r THEN NULL ELSE last_error END AS last_error FROM (SELECT q.*, queue_key = 'html' AND bookid IN (SELECT bookid FROM t) AND status NOT IN ('done', 'skipped') AS r FROM q) q UNION ALL SELECT 'html', bookid, 'pending', 0, NULL FROM t WHERE bookid NOT IN (SELECT bookid FROM q WHERE queue_key = 'html')",
    "queue_status": _Q + "SELECT queue_key, status, count(*) AS n FROM q GROUP BY 1, 2",
    "queue_pending": _Q + "SELECT bookid, attempts FROM q WHERE queue_key = 'html' AND status IN ('pending', 'failed') AND attempts < 3",
    "queue_transition": _Q + "SELECT queue_key, bookid, CASE WHEN h THEN 'failed' ELSE status END AS status, attempts + h::BIGINT AS attempts, CASE WHEN h THEN repeat('e', 500) ELSE last_error END AS last_error FROM (SELECT *, queue_key = 'html' AND status = 'done' AS h FROM q)",
    "upsert_replace": _B + "SELECT * FROM b WHERE bookid NOT IN (SELECT bookid FROM n) UNION ALL SELECT bookid, clean_content, 'text', false FROM n",
    "upsert_update": _B + "SELECT b.bookid, coalesce(n.clean_content, b.clean_content) AS clean_content, content_type, has_images FROM b LEFT JOIN n USING (bookid) UNION ALL SELECT bookid, clean_content, NULL, NULL FROM n WHERE bookid NOT IN (SELECT bookid FROM b)",
    "insert_ignore": _B + "SELECT * FROM b UNION ALL SELECT bookid, clean_content, NULL, NULL FROM n WHERE bookid NOT IN (SELECT bookid FROM b)",
    "replace_children": "WITH n AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT l_orderkey, l_linenumber::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM n) UNION ALL SELECT k, -1 FROM n",
    "cascade_delete": "WITH g AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT k FROM g) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM g) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM g)",
    "strip_markup": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?[a-z][^>]{0,200}>', ' ', 'g'), '<\?xml[^>]*\?>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages",
    "page_links": "SELECT page_id, array_to_string(list_distinct_ordered, '|') AS links FROM (SELECT page_id, list(u ORDER BY i) AS list_distinct_ordered FROM (SELECT page_id, u, min(i) AS i FROM (SELECT page_id, unnest(x) AS u, unnest(range(len(x))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"''#]+)[\"'']', 1) AS x FROM pages)) GROUP BY 1, 2) GROUP BY page_id)",
    "image_refs": "SELECT page_id, page_id || '.png|b.jpg' AS images FROM pages",
    "char_chunks": "SELECT doc_id, i, substr(text, (i * 250 + 1)::BIGINT, 250) AS piece FROM (SELECT doc_id, text, unnest(range((length(text) + 249) // 250)) AS i FROM documents)",
    "token_windows": r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(trim(text)), '[^\p{L}\p{N}_]+'), lambda x: len(x) > 0) AS w FROM documents),
n AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 100 THEN [0] ELSE range((len(w) + 79) // 80) END) AS i FROM t)
SELECT doc_id, i, len(w[i * 80 + 1:i * 80 + 100]) AS n, array_to_string(w[i * 80 + 1:i * 80 + 100], ' ') AS words FROM n""",
    "turn_blocks": "SELECT conv_id, block, string_agg(text, E'\\n' ORDER BY turn) AS text, count(*) AS n_rows FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS block FROM conversations) GROUP BY 1, 2",
    "chapter_split": _chapters_sql(texts.HEADING, "Introduction") + "SELECT bookid, (row_number() OVER (PARTITION BY bookid ORDER BY k))::INTEGER AS chapter_index, title, length(text)::INTEGER AS chars FROM c",
    "short_chapters": _chapters_sql(texts.REPAIR_HEADING, "Front Matter") + """, n AS (SELECT bookid, len(list_filter(string_split(text, E'\\n'), lambda x: trim(x) <> '')) AS n FROM c WHERE title NOT IN ('Front Matter', 'Full Text'))
SELECT b.bookid, count(n)::INTEGER AS n_chapters, count(n) >= 2 AND coalesce(bool_and(n < 5), true) AS is_short FROM b LEFT JOIN n USING (bookid) GROUP BY 1""",
    "stub_filter": "SELECT doc_id, length(t) >= 400 AND NOT regexp_matches(lower(t), 'do not download|obsolete format|alternative ids|redirect disabled') AND len(regexp_extract_all(t, '[A-Za-z0-9]{3,}')) >= 40 AS is_book FROM (SELECT doc_id, trim(coalesce(text, ''), E' \\t\\n\\x0B\\f\\r') AS t FROM documents)",
    "markup_flag": r"SELECT kind, id, regexp_matches(t, '(?i)<(html|head|body|div|p|span|table|style|script)\b') OR regexp_matches(t, '(?i)<\?xml|<!\[CDATA\[') OR len(regexp_extract_all(t, '(?i)</?[a-z][^>]{0,200}>')) >= 10 AS is_markup FROM (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'p', page_id, coalesce(html, '') FROM pages)",
    "marker_mismatch": "SELECT * FROM (VALUES (-1::BIGINT, 98::BIGINT, false), (-2, 99, true), (-3, NULL, false), (-4, NULL, false), (-5, 7, false), (-6, NULL, false), (-7, 12, true)) v(id, found, mismatch) UNION ALL SELECT doc_id AS id, doc_id % 50 AS found, doc_id % 50 <> doc_id % 75 AS mismatch FROM documents",
    "search_tokens": rf"""
WITH c(id, q) AS (VALUES (-1, 'The Tale of 2 Cities'), (-2, 'a'), (-3, '!'), (-4, 'of the'), (-5, 'foo_bar foo_bar x'), (-6, 'Été à Paris') UNION ALL SELECT conv_id * 100 + turn, text FROM conversations),
w AS (SELECT id, list_filter(string_split_regex(lower(trim(q)), '[^\p{{L}}\p{{N}}_]+'), lambda t: len(t) >= 2) AS w FROM c),
k AS (SELECT id, list(t ORDER BY i) AS w FROM (SELECT id, t, min(i) AS i FROM (SELECT id, unnest(w) AS t, unnest(range(len(w))) AS i FROM w) GROUP BY 1, 2) GROUP BY id),
f AS (SELECT id, w, list_filter(w, lambda t: NOT list_contains({_STOP}, t)) AS u FROM k)
SELECT w.id::BIGINT AS id, coalesce(array_to_string(CASE WHEN len(u) > 0 THEN u ELSE f.w END, ' '), '') AS tokens FROM w LEFT JOIN f USING (id)""",
    "desc_accept": "SELECT p_partkey AS id, p_partkey % 3 = 0 AND p_type = 'ECONOMY' AS accepted FROM part",
    "cosine_topk": "SELECT q.vec_id AS q, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10",
    "quality_gate": "SELECT doc_id, CASE WHEN quality <> 0 AND toxic IS NOT NULL THEN (doc_id % 100) / 100.0::DOUBLE >= 0.6 AND ((n_chars % 100) / 100.0::DOUBLE >= 0.35 OR (doc_id % 7) / 7.0::DOUBLE < 0.5) END AS passed FROM documents JOIN labels USING (doc_id)",
    "story_so_far": r"SELECT conv_id, turn, array_to_string(list(regexp_extract(text, '^[^.\n]*')) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), ' / ') AS story FROM conversations",
}
