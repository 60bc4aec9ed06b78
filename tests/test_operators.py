"""Hand-written cases for what SQL does not cover: traps of the semantics, invariants, sources and streaming twins."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import jsonx
from quire.functions import text as T
from quire.functions import urls as U
from quire.operators import catalog, classify, dedupe, hybrid, links, match, state, summarize, texts
from quire.sources import readers, sinks
from quire.streaming import history


def values(spark, column, *rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("x"))).collect()]


def test_tokens(spark):
    found = values(spark, T.search_tokens, "The Tale of 2 Cities", "a", "!", "of the", "x foo_bar foo_bar", None)
    assert found == [["tale", "cities"], [], [], ["of", "the"], ["foo_bar"], []]


def test_years(spark):
    dates = [None, "1000-10-10", "1851-10-18", " 1999", "c1850", "3001-01-01", "200"]
    assert values(spark, T.year_of_issue, *dates) == [None, None, 1851, 1999, None, 3001, None]
    assert values(spark, T.year_in_range, *dates) == [None, None, 1851, 1999, None, None, None]
    assert values(spark, T.year_in_text, "in 1850 and 1900", "17500", None) == ["1850", None, None]


def test_normalizers(spark):
    assert values(spark, T.match_text, "Café Noir!", None) == ["caf noir", ""]
    assert values(spark, T.folded_match_text, "Café Noir!") == ["cafe noir"]
    assert values(spark, T.spaced_match_text, "Café") == ["caf"]
    assert values(spark, T.title_key, "The Book, Vol. 1", "The Book, Vol. 2", "") == ["book vol 1", "book vol 2", ""]
    assert values(spark, T.author_key, ["Twain, Mark", "de la Cruz"], None, kind="array<string>") == [["cruz", "mark", "twain"], []]
    assert values(spark, T.author_names, "A & B and C; D", "Smith, John, Jr", "One, Two") == [["A", "B", "C", "D"], ["Smith", "John", "Jr"], ["One, Two"]]
    assert values(spark, T.clean_catalog_title, "Title $b sub x") == ["Title sub x"]
    assert values(spark, T.roman_value, "XIV", "mcmxc", "IX", "abc") == [14, 1990, 9, None]
    assert values(spark, T.author_parts, "Doe, J.R. (John)", "Jane Roe") == [("doe", "j r"), ("roe", "jane")]
    assert values(spark, lambda c: T.excerpt(c, 5), "abcdefgh", "abc") == ["abcd…", "abc"]
    assert values(spark, T.minutes_seconds, 65.0, None, kind="double") == ["1:05", "0:00"]
    assert values(spark, T.unescaped_basic, "&lt;a&gt; &amp;amp;") == ["<a> &amp;"]
    assert values(spark, T.subject_list, "a | b;c\n") == [["a", "b", "c"]]
    assert values(spark, lambda c: T.row_id(c, F.lit("[eBook #9]")), "12-0", "x-1") == [12, 9]
    assert values(spark, T.valid_subject, "", "E011", "ab", "abc", "a-1") == [False, False, False, True, True]


def test_categories(spark):
    cases = [[], ["Biography"], ["Natural history"], ["Historical fiction"], ["Science fiction", "Physics"], ["Cooking"]]
    assert values(spark, classify.category_strict, *cases, kind="array<string>") == [None, None, "biographical", "dramatic", "dramatic", "practical"]
    assert values(spark, classify.category_word, "It is Analytical.", "none") == ["analytical", None]


def test_topics_prefilter_changes_nothing(spark):
    bodies = [(i, t) for i, t in enumerate(["they worship the demon", "calm", "tortured souls", "anti-bible tract", "a hellish day", "mahābhārata"])]
    body = spark.createDataFrame(bodies, "bookid bigint, clean_content string")
    meta = body.select("bookid", F.lit("t").alias("title"), F.array(F.lit("s")).alias("subjects"), F.when(F.col("bookid") == 1, "gore").alias("summary"))
    on, off = (sorted((r.bookid, tuple(r.reasons), r.found_in) for r in classify.scan_topics(meta, body, prefilter=p).collect()) for p in (True, False))
    assert on == off == [(0, ("occult-intent",), "text"), (1, ("gory-violence",), "metadata"), (2, ("gory-violence",), "text"), (3, ("bible-attack",), "text")]


def test_urls(spark):
    case = lambda i: F.lit("https://x.org/files/98/" + i)
    row = spark.range(1).select(U.belongs_to(case("98-0.txt"), F.lit(98)), U.belongs_to(case("981.txt"), F.lit(981)), U.belongs_to(F.lit("https://x.org/a/9_1"), F.lit(98)), U.is_synthesized(F.lit("/1234-m/a.mp3")), U.audio_type(F.lit("a-mp3.zip")), U.illustrated_kind(F.lit("a.epub.noimages")), U.best_article(F.lit("https://de.wikipedia.org/wiki/A https://en.wikipedia.org/wiki/Long https://en.wikipedia.org/wiki/B"))).first()
    assert tuple(row) == (True, True, False, True, "application/octet-stream", None, "https://en.wikipedia.org/wiki/B")


def test_json(spark):
    assert values(spark, jsonx.canonical_position, '{"b": 1, "a": "x"}', "bad", "", None) == ['{"a":"x","b":"1"}', '{"raw":"bad"}', "{}", "{}"]
    assert values(spark, jsonx.genres, '{"k2": "B", "k1": "A"}', '["z","y"]', "plain", None, "{bad") == [["A", "B"], ["z", "y"], ["plain"], [], ["{bad"]]
    key = spark.range(1).select(jsonx.run_key(F.array(F.lit(2), F.lit(1)))).first()[0]
    assert key == __import__("hashlib").sha1(b"1,2").hexdigest()[:12]


def test_pages_are_disjoint(spark, sf):
    from quire.plans.catalog_queries import view

    v = view(spark, sf).cache()
    one, two = ({r.id for r in catalog.page(v, limit=5, offset=o).collect()} for o in (0, 5))
    assert len(one) == len(two) == 5 and not one & two
    assert catalog.page_with_fallback(v, search="nosuchword")[1] and not catalog.page_with_fallback(v, search="ring")[1]
    assert catalog.count(v, search="!").first().total == v.count()
    desc = spark.createDataFrame([(0, "small ring", None, "good"), (1, "other", "nobody", "bad")], "bookid bigint, source_title string, source_author string, summary string")
    assert catalog.description(v, desc, 1).first().summary == "" and catalog.description(v, desc, 99999).isEmpty()
    v.unpersist()


def test_cover_choice(spark):
    art = spark.createDataFrame([(1, "large", 0, "b"), (1, "medium", 5, "a"), (2, "small", 1, "d"), (2, "small", 0, "c")], "bookid bigint, size_label string, sort_order int, image_url string")
    assert sorted((r.bookid, r.image_url) for r in catalog.best_cover(art).collect()) == [(1, "a"), (2, "c")]


def test_upserts_differ(spark):
    base = spark.createDataFrame([(1, "old", "html", True)], "bookid bigint, clean_content string, content_type string, has_images boolean")
    new = spark.createDataFrame([(1, "new"), (2, "two")], "bookid bigint, clean_content string")
    replaced = {r.bookid: tuple(r)[1:] for r in state.upsert_replace(base, new, ["bookid"], {"content_type": "text", "has_images": False}).collect()}
    updated = {r.bookid: tuple(r)[1:] for r in state.upsert_update(base, new, ["bookid"], ["clean_content"]).collect()}
    assert replaced == {1: ("new", "text", False), 2: ("two", "text", False)}
    assert updated == {1: ("new", "html", True), 2: ("two", None, None)}


def test_guarded_save_and_descriptions(spark):
    base = spark.createDataFrame([], "bookid bigint, raw_content string, clean_content string, content_type string, has_images boolean")
    rows = spark.createDataFrame([(1, 98, "[eBook #98]", "a"), (2, 5, "[eBook #6]", "b"), (3, 7, "no marker", "c")], "bookid bigint, gutenbergbookid bigint, raw_content string, clean_content string")
    saved, rejected = state.guarded_save(base, rows)
    assert sorted(r.bookid for r in saved.collect()) == [1, 3] and [r.bookid for r in rejected.collect()] == [2]
    desc = spark.createDataFrame([(1, "T", "A", "g", "f", "old")], "bookid bigint, source_title string, source_author string, genres_text string, freebase_id string, summary string")
    new = spark.createDataFrame([(1, None), (2, "fresh"), (3, "")], "bookid bigint, summary string")
    assert sorted((r.bookid, r.summary) for r in state.save_description(desc, new).collect()) == [(1, "old"), (2, "fresh")]


def test_queue_is_idempotent(spark):
    queue = spark.createDataFrame([("k", 1, "done", 1, None), ("k", 2, "failed", 3, "e")], "queue_key string, bookid bigint, status string, attempts int, last_error string")
    targets = spark.createDataFrame([(1,), (2,), (3,)], "bookid bigint")
    once = state.queue_seed(queue, targets, "k")
    twice = state.queue_seed(once, targets, "k")
    want = [("k", 1, "done", 1, None), ("k", 2, "pending", 0, None), ("k", 3, "pending", 0, None)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want
    assert [r.bookid for r in state.queue_pending(once, "k", 1).collect()] == [2, 3]
    assert state.queue_reset(once, "k").isEmpty()


def test_duplicates_and_merge_order(spark):
    links_ = spark.createDataFrame([(1, 1, 1, 9), (2, 1, 2, 5), (3, 1, 3, 1)], "bookid bigint, target bigint, place int, score bigint")
    desc = spark.createDataFrame([(1, "catalog"), (2, "rdf"), (3, "cmu")], "bookid bigint, source string")
    assert [tuple(r) for r in dedupe.merged_first(desc, links_, "bookid", F.col("source") != "catalog").select("bookid", "source").collect()] == [(1, "rdf")]
    text = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "ccc")], "bookid bigint, raw_content string")
    assert [tuple(r) for r in dedupe.merged_contents(text, links_).select("bookid", "raw_content").collect()] == [(1, "ccc")]


def test_matching(spark):
    frame = spark.createDataFrame([("Mark Twain", "Twain, Mark|Clemens, Samuel"), ("", "x"), ("The Ring", "Ring"), ("abc def", "xyz")], "a string, b string")
    assert [r[0] for r in frame.select(match.text_matches(F.col("a"), F.col("b"), 0.5)).collect()] == [True, False, True, False]
    known = spark.createDataFrame([(5, "a")], "id bigint, name string")
    ids = match.get_or_create_ids(spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "name string"), known)
    assert sorted(map(tuple, ids.collect())) == [(5, "a"), (6, "b"), (7, "c")]
    books = spark.createDataFrame([(1, "T", "A"), (2, "t", "a"), (3, "U", "A")], "bookid bigint, title string, author string")
    desc = spark.createDataFrame([(1, "T", "A", "long summary"), (2, "T", "A", "short")], "bookid bigint, source_title string, source_author string, summary string")
    assert sorted(map(tuple, match.sibling_summary(books, desc).collect())) == [(1, "short"), (2, "long summary")]


def test_audio(spark):
    rows = [(1, "https://x/1-m/1-02.mp3", "audio/mpeg"), (1, "https://x/1-m/1-01.mp3", "audio/mpeg"), (1, "https://x/1.ogg", "audio/ogg"), (1, "https://x/1-mp3.zip", "application/octet-stream"), (2, "https://x/2.txt", "text/plain")]
    item = links.audio_items(spark.createDataFrame(rows, "book_id bigint, url string, kind string")).collect()
    assert len(item) == 1 and item[0].package_url.endswith(".zip") and item[0].track_count == 2 and item[0].is_synthesized and item[0].tracks[0].track_order == 1
    readme = "Read by: Jane Doe\n1. One - 0:01:02\n2 Two - 1:00:00\n"
    r = spark.range(1).select(links.readme_parts(F.lit(readme)).alias("p")).first().p
    assert r.narrator == "Jane Doe" and [tuple(c) for c in r.chapters] == [("One", "0:01:02"), ("Two", "1:00:00")]
    tries = spark.createDataFrame([(1, 0, "skipped", "a"), (1, 1, "done", "b"), (2, 0, "error", "c"), (2, 1, "skipped", "d")], "bookid bigint, rank int, status string, message string")
    assert sorted(map(tuple, links.first_done(tries).collect())) == [(1, "done", "b"), (2, "error", "c; d")]


def test_chunks(spark):
    assert values(spark, lambda c: texts.char_chunks(c, 4), "abcdefghij", "") == [["abcd", "efgh", "ij"], []]
    words = lambda n: [str(i) for i in range(n)]
    for n, count in ((0, 0), (4, 1), (5, 2), (6, 2), (9, 3)):
        assert len(values(spark, lambda c: texts.token_windows(c, 4, 1), words(n), kind="array<string>")[0]) == count
    assert len(values(spark, lambda c: texts.token_windows(c, 2, 5), words(5), kind="array<string>")[0]) == 5


def test_cleaning(spark):
    start = "*** START OF THE PROJECT GUTENBERG EBOOK X ***"
    raw = f"header\n{start}\nBody text.\n<p>More</p>\nEnd of the Project Gutenberg EBook\nlicence"
    assert values(spark, texts.clean, raw, None) == ["Body text.\n More", ""]
    assert values(spark, texts.strip_trailer, "End of Project Gutenberg's") == ["End of Project Gutenberg's"]
    assert texts.strip_dangling_css("x\n<!--\na {\ncolor: red;\n}\nb {\ntop: 1;\n}\n\nText here") .endswith("Text here")
    listing = "\n".join(["CONTENTS", *[f"CHAPTER {i}" for i in range(1, 11)], *["front"] * 20, "CHAPTER 1", *["text"] * 30, "CHAPTER 2", *["text"] * 30])
    assert texts.strip_prefixed_contents(listing).startswith("CHAPTER 1\ntext")
    page = "\n".join(["Title", "Contents.", *[f"Part {i}    {i}" for i in range(9)], "A wrapped", "entry    12", "", "It begins.", *["more"] * 12])
    assert "Part 3" not in texts.strip_contents_page(page) and "It begins." in texts.strip_contents_page(page)
    assert values(spark, texts.reflow, "a\n b\n\nc") == ["a b\n\nc"]


def test_splitting(spark):
    text = "front\nCHAPTER I\none\nChapter the Second: Name\ntwo\ntwo"
    assert [t for t, _ in texts.chapters_of(text)] == ["Introduction", "CHAPTER I", "Chapter the Second: Name"]
    assert texts.chapters_of("plain") == [("Full Text", "plain")]
    rows = [(1, "CHAPTER I\na\n\nCHAPTER II\nb"), (2, "CHAPTER I\na\n\nCHAPTER II\n" + "b\n" * 9), (3, "front\nCHAPTER I\na"), (4, None)]
    frame = spark.createDataFrame(rows, "bookid bigint, text string")
    assert {r.bookid: r.is_short for r in texts.short_chapters(frame, 5).collect()} == {1: True, 2: False, 3: False, 4: False}
    twice = spark.createDataFrame([(1, 1, "CHAPTER IV", "x"), (1, 2, "Chapter 4", "longer"), (1, 3, "CHAPTER V", "y")], "bookid bigint, chapter_index int, title string, text string")
    assert sorted((r.chapter_index, r.text) for r in texts.distinct_chapters(twice).collect()) == [(1, "longer"), (3, "y")]
    names = [f"The Story {w}" for w in "abcdefgh"]
    book = "\n".join(["Contents", *[f"{n} .... {i}" for i, n in enumerate(names)], "", "", "", *[x for n in names for x in (n, "text of " + n)]])
    assert [t for t, _ in texts.chapters_by_contents(book)] == names


def test_html(spark):
    assert texts.clean_html_body("<body><p></p><p>Produced by X</p><p>Text</p><img src='a'><div>*** END</div></body>") == "<p>Text</p><img src='a'><div>*** END</div>"
    assert texts.reading_model("<h1>A &b</h1><h2 id='x'>B</h2><h2>A &b</h2>") == [("A &b", "a-b", 1), ("B", "x", 2), ("A &b", "a-b-2", 2)]
    got = spark.range(1).select(texts.rewritten_images(F.lit("<img src='p/a.png'><img src=\"b.png\">"), F.lit("https://s/"), F.array(F.lit("a.png"))), texts.sanitized(F.lit("<p onclick='x()'>a<script>b</script></p>"))).first()
    assert tuple(got) == ("<img src='https://s/a.png'><img src=\"b.png\">", "<p>a</p>")


def test_summaries(spark):
    upper = lambda prompts: [p.split("\n\n", 1)[1].upper()[:60] for p in prompts]
    text = "CHAPTER I\n" + "one two three. " * 20 + "\nCHAPTER II\n" + "four five. " * 20
    books = spark.createDataFrame([(1, "B", text), (2, "C", ""), (3, "D", None)], "bookid bigint, title string, text string")
    full = summarize.summarize_books(books, upper, chunk=30, overlap=5, window=40)
    rows = sorted(map(tuple, full.collect()))
    assert [(r[0], r[1], r[2]) for r in rows] == [(1, 1, "CHAPTER I"), (1, 2, "CHAPTER II")]
    resumed = summarize.summarize_books(books, upper, full.where("chapter_index = 1"), chunk=30, overlap=5, window=40)
    assert sorted(map(tuple, resumed.collect())) == rows
    assert [r.bookid for r in summarize.unfinished(books, full).orderBy("bookid").collect()] == [2, 3]
    answer = "### Summary:\nGood text  , here !!!!\n### Instruction\nleak"
    assert values(spark, summarize.normalized_summary, answer) == ["Good text, here!"]
    assert summarize.windows(list("abcde"), 4, 1) == [list("abcd"), list("de")]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1)], "query_id bigint, id bigint, rank int")
    b = spark.createDataFrame([(1, 10, 25), (1, 11, 1)], "query_id bigint, id bigint, rank int")
    got = {r.id: round(r.score, 5) for r in hybrid.reciprocal_rank_fusion(a, b).collect()}
    assert got == {10: 0.02816, 11: 0.01639}
    s = spark.range(1).select(hybrid.author_score(F.lit("cator"), F.lit("j"), F.lit("cantor"), F.lit("j")), hybrid.author_score(F.lit("smith"), F.lit(""), F.lit("jones"), F.lit(""))).first()
    assert 0.8 < s[0] < 0.85 and s[1] is None
    c = hybrid.author_clusters(spark.createDataFrame([("Doe, Jane",), ("Doe, Jane (J.)",), ("Roe, Jane",)], "name string"))
    assert sorted(len(r["names"]) for r in c.collect()) == [1, 2]


RDF = """<rdf xmlns:r="r" xmlns:d="d"><d:title>Main</d:title><d:alternative>Other</d:alternative><d:creator><a><d:name>Zed</d:name></a></d:creator>
<d:issued>1900-01-01</d:issued><d:marc520>A summary.</d:marc520><d:subject><x><r:value>Ships</r:value></x></d:subject>
<d:hasFormat><d:file r:about="https://x/9/pg9.cover.medium.jpg"/></d:hasFormat><d:hasFormat><d:file r:about="https://x/9.txt"/></d:hasFormat></rdf>"""


def test_metadata_source(spark):
    files = spark.createDataFrame([(9, RDF), (10, "<rdf/>")], "gutenbergbookid bigint, content string")
    rows = readers.rdf_records(files).collect()
    assert len(rows) == 1 and rows[0].titles == ["Main", "Other"] and rows[0].authors == ["Zed"] and rows[0].issued == "1900-01-01" and rows[0].summary == "A summary."
    covers = readers.cover_entries(readers.rdf_records(files)).collect()
    assert [(c.bookid, c.size_label, c.image_url) for c in covers] == [(9, "medium", "https://x/9/pg9.cover.medium.jpg")]
    star = readers.star_schema(readers.rdf_records(files).withColumnRenamed("gutenbergbookid", "id"))
    v = catalog.catalog_view(star["books"], star["titles"], star["authors"], star["book_authors"], star["subjects"], star["book_subjects"]).first()
    assert (v.title, v.authors, v.year, v.downloads, v.subjects) == ("Main", "Zed", 1900, -1, ["Ships"])


def test_lists_and_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("bookid,x\n3,a\n1,b\n3,c\nzz,d\n")
    assert [r.bookid for r in readers.id_list(spark, str(tmp_path / "a.csv"), limit=5).collect()] == [1, 3]
    (tmp_path / "b.txt").write_text("1|2|A|B\n\nbad\n3|4|C\n")
    assert sorted(map(tuple, readers.bar_list(spark, str(tmp_path / "b.txt")).collect())) == [(1, 2, "A|B"), (3, 4, "C")]
    (tmp_path / "c.tsv").write_text("1\tf\tT\tA\t1900\t{}\tS\nshort\trow\n")
    assert [r.title for r in readers.summary_rows(spark, str(tmp_path / "c.tsv")).collect()] == ["T"]
    assert readers.decode_bytes("é".encode("latin-1")) == "é" and readers.decode_bytes(b"\x81") == "\x81"
    epub = io.BytesIO()
    with zipfile.ZipFile(epub, "w") as z:
        z.writestr("o/p.opf", '<package xmlns="u"><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<html><body><p>second</p></body></html>")
        z.writestr("o/b.xhtml", "<html><body><p>first</p></body></html>")
    assert readers.bytes_to_text(epub.getvalue(), "x.epub") == "first\n\nsecond"
    frame = spark.createDataFrame([(bytearray(epub.getvalue()), "x.epub", "")], "c binary, n string, k string")
    assert frame.select(readers.file_text("c", "n", "k")).first()[0] == "first\n\nsecond"
    assert frame.select(readers.epub_html("c")).first()[0].startswith("<html><body><section><p>first")
    assert readers.bytes_to_text(b"<?xml version='1.0'?><t><p>a</p><p>b</p></t>") == "a\nb"
    assert readers.bytes_to_text(rb"\section{Name} text % note", "a.tex") == "Name text"
    assert readers.main_page(["x/a.htm", "x/9-h.htm"]) == "x/9-h.htm"
    assert readers.summary_node('<div class="x summary-text-container"><div>a</div> b</div>c') == "a b"


def test_sinks(spark, tmp_path):
    desc = spark.createDataFrame([(1, "T", "A", "S", "dramatic")], "bookid bigint, source_title string, source_author string, summary string, category string")
    names = spark.createDataFrame([(1, "b"), (1, "a")], "bookid bigint, name string")
    assert '"subjects":["a","b"]' in sinks.description_json(desc, names).first().value
    sinks.append_results(desc, str(tmp_path / "r"))
    sinks.append_results(desc, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, i % 3, i % 11, "text" if i % 2 else "AUDIO ", '{"p": %d}' % i, f"2024-01-01 00:{i % 50:02d}:00") for i in range(90)]
    frame = spark.createDataFrame(rows, "id bigint, user_id bigint, book_id bigint, media_type string, position string, t string").withColumn("updated_at", F.col("t").cast("timestamp")).drop("t")
    want = sorted(map(repr, state.recent(state.normalized_history(frame)).drop("place").collect()))
    src = str(tmp_path / "in")
    for k in range(3):
        frame.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(src)
        history.keep_history(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = history.snapshot(spark, str(tmp_path / "out"))
    assert sorted(map(repr, got.select(frame.columns).collect())) == want


def test_queue_stream(spark, tmp_path):
    queue = spark.createDataFrame([("k", 1, "pending", 0, None), ("k", 2, "pending", 0, None)], "queue_key string, bookid bigint, status string, attempts int, last_error string")
    out = spark.createDataFrame([("k", 1, "failed", 1, "x", 1), ("k", 1, "done", 0, None, 2)], "queue_key string, bookid bigint, status string, delta int, error string, at int")
    out.write.parquet(str(tmp_path / "in"))
    history.keep_queue(spark.readStream.schema(out.schema).parquet(str(tmp_path / "in")), queue, str(tmp_path / "q"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, history.snapshot(spark, str(tmp_path / "q")).collect())) == [("k", 1, "done", 1, None), ("k", 2, "pending", 0, None)]


def test_plans_push_down(spark, sf):
    plan = catalog.content(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("bookid"), F.col("text").alias("clean_content"), F.col("text").alias("html_content"), F.col("lang").alias("content_type"), F.lit(False).alias("has_images")), 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "n_chars" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("shards", [1, 7])
def test_shards_do_not_move(spark, shards):
    frame = spark.range(100).withColumn("shard", links.shard_of(F.col("id"), shards))
    part = frame.where("id % 2 = 0")
    assert {r.id: r.shard for r in part.collect()}.items() <= {r.id: r.shard for r in frame.collect()}.items()


def test_schemas_and_selectors(spark):
    from quire import schema

    for name in schema.TABLES:
        assert schema.empty(spark, name).count() == 0
    old = spark.createDataFrame([(1, "raw", "x")], "bookid int, raw_content string, extra string")
    row = schema.evolved(old, "book_contents").first()
    assert (row.bookid, row.content_type, row.has_images, row.html_content, row.extra) == (1, "text", False, None, "x")
    books = spark.createDataFrame([(1, 98, 5), (2, 7, 9)], "id bigint, gutenbergbookid bigint, numdownloads bigint")
    text = spark.createDataFrame([(1, "[eBook #98]"), (2, "[eBook #98]")], "bookid bigint, raw_content string")
    assert [r.bookid for r in links.with_other_marker(text, books).collect()] == [2]
    desc = spark.createDataFrame([(1, " "), (2, "good")], "bookid bigint, summary string")
    assert [r.id for r in links.incomplete_descriptions(books, desc).collect()] == [1]
    audio = spark.createDataFrame([], "book_id bigint")
    assert [r.id for r in links.audio_gaps(books, audio).collect()] == [2, 1]
    assert summarize.profile_prompt("T", "A", "analytical", "x").startswith("Describe the claims") and "dramatic" in summarize.category_prompt("T", "s")


def test_contents_lists_keep_what_stands_before():
    listed = [f"Chapter {i}" for i in range(1, 10)]
    body = [x for i in range(1, 10) for x in (f"Chapter {i}", *["text"] * 12)]
    text = "\n".join(["The Title", "Preface by the author.", "Contents", *listed, *body])
    assert texts.strip_prefixed_contents(text) == "\n".join(["The Title", "Preface by the author.", *body])
    late = "\n".join(["word " * 30] * 200 + ["Contents", *listed, *body])  # the mark stands beyond 4,000 characters
    assert texts.strip_prefixed_contents(late) == "\n".join(["word " * 30] * 200 + body).strip()
    page = ["Title", "Contents.", "  Page", *[f"Topic {i}    {i}" for i in range(1, 5)], "A long topic that", "", "goes on    17", *[f"Topic {i}    {i}" for i in range(20, 24)]]
    prose = ["Here the prose begins.", "It goes on.", "See table    12", *["More prose."] * 9]
    assert texts.strip_contents_page("\n".join([*page, "", *prose])) == "\n".join(["Title", *prose])


def test_nothing_is_cut_from_summaries():
    from quire.operators import summarize

    longer = lambda prompts: [p.split("\n\n", 1)[-1] + " and so on" for p in prompts]
    parts = [" ".join(f"w{i}" for i in range(k, k + 30)) for k in (0, 30, 60)]
    found = summarize.reduced("x", parts, longer, window=20)
    assert set(" ".join(parts).split()) <= set(found.split())
    never = lambda prompts: 1 / 0
    assert summarize.reduced("x", ["only one"], never) == "only one" and summarize.reduced("x", ["", " "], never) == ""
    out = summarize.fold("t", [("I", "three short words"), ("II", "")], summarize.lead())
    assert out[0][3] == "three short words" and out[1][3] == ""
    assert summarize.fold("t", [("I", "three short words")], summarize.lead(), least=summarize.LEAST_CHUNK_WORDS)[0][3] == ""


def test_tidy_formulas(spark):
    from quire.operators import summarize

    cases = {"a  b @xmath1 c!!!!": "a b c!", "x &=& y": "x = y", "so nabla f holds. Then": "so \\(\\nabla f holds\\). Then", "plain [[text]] here": "plain [ text] here", "a\nb": "a b"}
    rows = spark.createDataFrame(list(cases.items()), "x string, y string").select("y", summarize.normalized_summary(F.col("x")).alias("z")).collect()
    assert [r.z for r in rows] == [r.y for r in rows]


def test_live_content(spark):
    from quire.functions import urls

    cases = {"https://x.org/files/1/1-0.txt?a": True, "https://x.org/readme_warning.txt": False, "https://x.org/1/a.nfo": False, "https://x.org/1/1.rdf": False, "https://x.org/1/": False, "https://x.org/1/a-MP3.zip": True, "https://x.org/1/b.XYZ": False, "https://x.org/1/1-H.HTM": True}
    rows = spark.createDataFrame(list(cases.items()), "u string, ok boolean").select("ok", urls.is_live_content(F.col("u")).alias("found"), urls.is_synthesized(F.lit("/files/1/1-M/1.mp3")).alias("s")).collect()
    assert all(r.ok == r.found and r.s for r in rows)


def test_positions(spark):
    from quire.operators import ordinals

    rows = spark.createDataFrame([(i * 7 % 1000, "x") for i in range(1000)] + [(None, "n")], "id bigint, position string")
    found = sorted((r.position, r.id if r.id is not None else -1) for r in ordinals.with_position(rows.select("id"), "id", "position").collect())
    assert found == [(i, i - 1) for i in range(1001)]


def test_snapshot_of_itself(spark, tmp_path):
    from quire.sources import sinks

    path = str(tmp_path / "snapshot")
    sinks.write_snapshot(spark.range(5), path)
    sinks.write_snapshot(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
