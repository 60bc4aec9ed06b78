"""Queries over the catalogue's shapes on the test tables: parts play books, part types and brands subjects, suppliers authors, line items downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, classify, dedupe, hybrid, links, match
from ..session import table

SEARCH = "The small Supplier of 9"


def tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    part, line, supplier = (table(spark, sf, t) for t in ("part", "lineitem", "supplier"))
    sold = line.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    books = part.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("id"), F.concat((F.lit(1800) + F.col("p_size")).cast("string"), F.lit("-01-01")).alias("dateissued"), F.lit(1).cast("bigint").alias("languageid"), F.coalesce("n", F.lit(0)).alias("numdownloads"))
    subject = part.select(F.col("p_partkey").alias("bookid"), F.explode(F.array("p_type", "p_brand")).alias("name")).select("bookid", "name", F.xxhash64("name").alias("subjectid"))
    return {
        "books": books,
        "titles": part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("bookid"), F.lit(0).alias("ord")),
        "authors": supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "book_authors": line.select(F.col("l_partkey").alias("bookid"), F.col("l_suppkey").alias("authorid")).distinct(),
        "subjects": subject.select(F.col("subjectid").alias("id"), "name").distinct(),
        "book_subjects": subject.select("bookid", "subjectid"),
    }


def view(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return catalog.catalog_view(t["books"], t["titles"], t["authors"], t["book_authors"], t["subjects"], t["book_subjects"])


def flat(v: DataFrame, *extra: str) -> DataFrame:
    return v.select("id", "title", "authors", "year", "language", F.col("downloads").cast("bigint").alias("downloads"), F.array_join("subjects", "|").alias("subjects"), "category", *extra)


def search_page(spark, sf):
    return flat(catalog.page(view(spark, sf), None, SEARCH, 20, 0).withColumn("score", F.col("score").cast("bigint")), "score")


def browse_page(spark, sf):
    return flat(catalog.page(view(spark, sf), None, None, 20, 40))


def search_count(spark, sf):
    return catalog.count(view(spark, sf), None, SEARCH)


def subject_filter(spark, sf):
    return flat(catalog.page(view(spark, sf), "ECONOMY", "ring", 15, 0))


def subject_counts(spark, sf):
    t = tables(spark, sf)
    return catalog.subject_counts(t["subjects"], t["book_subjects"]).select("name", "books")


def subject_valid(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.valid_subject(F.col("p_brand")).alias("brand_ok"), T.valid_subject(F.col("p_type")).alias("type_ok"), T.valid_subject(F.col("p_name")).alias("name_ok"))


def author_list(spark, sf):
    return view(spark, sf).select("id", "authors")


def missing_content(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return links.missing_from(c.withColumnRenamed("c_custkey", "bookid"), o.select(F.col("o_custkey").alias("bookid"))).select("bookid", "c_name")


def has_orders_flag(spark, sf):
    c, o = table(spark, sf, "customer").withColumnRenamed("c_custkey", "bookid"), table(spark, sf, "orders")
    return links.with_flag(c, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("bookid")), "bookid", "has_orders").select("bookid", "has_orders")


def category(spark, sf):
    cases = [(-1, []), (-2, ["Biography"]), (-3, ["Natural history"]), (-4, ["Historical fiction"]), (-5, ["Science fiction", "Physics"]), (-6, ["Cooking"]), (-7, ["History of law"]), (-8, ["Travel writing", "Letters"])]
    own = spark.createDataFrame(cases, "id bigint, s array<string>")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_type").alias("s"))
    return own.unionByName(parts).select("id", classify.category_strict(F.col("s")).alias("strict"), classify.category_of(F.col("s")).alias("category"))


def topic_rules(spark, sf):
    cases = [(-1, "They praise the old dark devil here"), (-2, "hell itself we celebrate"), (-3, "a gruesome tale of blood-soaked hills"), (-4, "bible criticism and psychics"), (-5, "praise one two three four five satan"), (-6, "erotica")]
    own = spark.createDataFrame(cases, "doc_id bigint, text string")
    docs = own.unionByName(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join(classify.topics(F.col("text")), ",").alias("reasons")).where("reasons <> ''")


def duplicate_groups(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("bookid"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"))
    return dedupe.duplicate_groups(p).select("title_key", F.array_join("author_key", "|").alias("author_key"), F.array_join(F.transform("bookids", lambda x: x.cast("string")), ",").alias("bookids"))


def _groups(spark, sf):
    p = table(spark, sf, "part")
    books = p.select(F.col("p_partkey").alias("bookid"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_size").alias("numdownloads"))
    contents = p.select(F.col("p_partkey").alias("bookid"), F.repeat(F.lit("x"), F.col("p_size")).alias("raw_content"))
    desc = p.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("bookid"), F.when(F.col("p_size") % 2 == 0, "catalog").otherwise("rdf").alias("source"))
    audio = p.where("p_size > 40").select(F.col("p_partkey").alias("book_id"), (F.col("p_size") % 2 == 0).alias("is_synthesized"))
    return books, contents, desc, audio


def canonical_pick(spark, sf):
    books, contents, desc, audio = _groups(spark, sf)
    found = dedupe.canonical(dedupe.duplicate_groups(books), dedupe.scores(books, contents, desc, audio))
    return found.select("bookid", "target", F.col("place").cast("bigint").alias("place"), "score")


def merge_result(spark, sf):
    books, contents, desc, audio = _groups(spark, sf)
    found = dedupe.canonical(dedupe.duplicate_groups(books), dedupe.scores(books, contents, desc, audio))
    out = dedupe.merge({"books": books.withColumnRenamed("bookid", "id"), "book_contents": contents, "book_desc": desc, "book_audio": audio}, found)
    c = out["book_contents"].select(F.col("bookid").alias("id"), F.length("raw_content").cast("bigint").alias("chars"))
    d = out["book_desc"].select(F.col("bookid").alias("id"), "source")
    a = out["book_audio"].select(F.col("book_id").alias("id"), "is_synthesized")
    return out["books"].select("id").join(c, "id", "left").join(d, "id", "left").join(a, "id", "left")


def work_key_siblings(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("bookid"), F.col("p_partkey").alias("gutenbergbookid"), F.col("p_name").alias("title"), F.array("p_type").alias("authors"))
    return match.work_siblings(p).select("bookid", F.array_join(F.transform("same_work", lambda x: x.cast("string")), ",").alias("same_work"))


def text_match(spark, sf):
    """Every title against all that share a word with it, said otherwise; parts of one title are counted, not paired."""
    x = table(spark, sf, "part").groupBy(F.col("p_name").alias("x")).agg(F.count(F.lit(1)).alias("parts"))
    y = x.select(F.concat(F.lit("The "), "x", F.lit("!")).alias("y"))
    word = lambda c: F.explode(T.token_set(T.match_text(F.col(c)))).alias("word")
    pairs = x.select("x", "parts", word("x")).join(y.select("y", word("y")), "word").select("x", "parts", "y").distinct()
    return pairs.select("x", "parts", "y", match.text_matches(F.col("x"), F.col("y"), 0.5).alias("fits"), match.text_matches(F.col("x"), F.col("y"), 0.8).alias("fits_well"))


def title_cascade(spark, sf):
    p = table(spark, sf, "part")
    name = lambda k: F.concat_ws(" ", "p_name", F.concat(F.lit("volume"), (F.col("p_partkey") % k).cast("string")))
    books = p.select(F.col("p_partkey").alias("bookid"), name(37).alias("title"), F.array(F.concat(F.lit("Brand "), F.col("p_type"))).alias("authors"), (F.lit(1800) + F.col("p_size")).alias("year"))
    asked = p.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, name(37)).otherwise(F.concat(F.lit("The "), "p_name")).alias("title"), F.concat(F.lit("Brand "), F.col("p_type")).alias("author"), (F.lit(1800) + F.col("p_size")).alias("year"))
    return match.title_cascade(asked, books)


def passage_contains(spark, sf):
    """Documents that hold every token of a passage, not only its first ones."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.search_tokens(F.col("text")).alias("words"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("candidate_id"), T.search_tokens(F.col("text")).alias("words"))
    return match.contains_all(q, d)


def id_map_report(spark, sf):
    ids = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("gutenbergbookid"))
    books = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - F.col("c_custkey") % 4).alias("gutenbergbookid"))
    return match.id_map_report(ids, books).select("gutenbergbookid", F.array_join(F.transform("bookids", lambda x: x.cast("string")), ",").alias("bookids"), "kind")


def rrf_hybrid(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang", "source")
    a = hybrid.rank_by(d.select(F.col("lang").alias("query_id"), "id", "n_chars"), "query_id", "n_chars", "id").where("rank <= 50")
    b = hybrid.rank_by(d.select(F.col("lang").alias("query_id"), "id", (F.col("n_chars") % 997).alias("n_chars")), "query_id", "n_chars", "id").where("rank <= 50")
    return hybrid.reciprocal_rank_fusion(a, b).select("query_id", "id", F.round("score", 9).alias("score"))


def banded_search(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("bookid"), F.col("p_name").alias("title"), F.col("p_size").alias("numdownloads"))
    q = spark.createDataFrame([(1, "The small ring"), (2, "ring, small"), (3, "blue"), (4, "red widgets")], "query_id bigint, query string")
    q = q.unionByName(table(spark, sf, "part").where("p_partkey % 20 = 0").select((F.col("p_partkey") + 100).alias("query_id"), F.col("p_name").alias("query")))
    return hybrid.banded(p, q).select("query_id", "bookid", F.round("score", 6).alias("score"))


_VIEW = """
WITH sold AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
au AS (SELECT l_partkey, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS authors FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
v AS (
  SELECT p_partkey AS id, p_name AS title, coalesce(authors, 'Unknown') AS authors, (1800 + p_size)::INTEGER AS year, 'Unknown' AS language,
         coalesce(n, 0)::BIGINT AS downloads, p_type AS subjects, p_brand, 'dramatic' AS category
  FROM part LEFT JOIN sold ON l_partkey = p_partkey LEFT JOIN au ON au.l_partkey = p_partkey)
"""
_COLUMNS = "id, title, authors, year, language, downloads, subjects, category"
_HIT = "(lower(title) LIKE '%small%')::BIGINT + (lower(title) LIKE '%supplier%')::BIGINT"
_WHERE = "(lower(title) LIKE '%small%' OR lower(authors) LIKE '%small%') AND (lower(title) LIKE '%supplier%' OR lower(authors) LIKE '%supplier%')"
_STRICT = " ".join(f"WHEN regexp_matches(j, '(?i)\\b(?:{w.replace(chr(39), chr(39) * 2)})\\b') THEN '{n}'" for n, w in classify.CATEGORIES)
_TOPIC = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p, _ in classify.TOPIC_RULES)
_GROUPS = """
WITH keyed AS (
  SELECT p_partkey AS bookid, p_size, p_type, array_to_string(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '),
           lambda t: NOT list_contains(['a','an','the','of','in','on','at','to','for','and','or','by','from','with','as','is','it','its','be','are','was'], t) AND (len(t) > 1 OR regexp_matches(t, '^\\d+$'))), ' ') AS title_key,
         'brand' AS author_key FROM part),
groups AS (SELECT title_key, author_key FROM keyed WHERE title_key <> '' GROUP BY 1, 2 HAVING count(*) >= 2),
scored AS (
  SELECT bookid, title_key, author_key, p_size, p_type, (p_size + CASE WHEN p_type = 'PROMO' AND p_size % 2 = 1 THEN 1000000 ELSE 0 END + CASE WHEN p_size > 40 THEN 500000 ELSE 0 END + p_size)::BIGINT AS score FROM keyed),
ranked AS (
  SELECT s.*, first_value(bookid) OVER w AS target, row_number() OVER w AS place
  FROM scored s JOIN groups USING (title_key, author_key) WINDOW w AS (PARTITION BY title_key, author_key ORDER BY score DESC, bookid)),
linked AS (SELECT k.*, coalesce(r.target, k.bookid) AS t, coalesce(r.place, 1) AS place FROM keyed k LEFT JOIN ranked r USING (bookid))
"""

QUERIES = {f.__name__: f for f in (search_page, browse_page, search_count, subject_filter, subject_counts, subject_valid, author_list, missing_content, has_orders_flag, category, topic_rules, duplicate_groups, canonical_pick, merge_result, work_key_siblings, text_match, title_cascade, passage_contains, id_map_report, rrf_hybrid, banded_search)}

ORACLE = {
    "search_page": f"{_VIEW} SELECT {_COLUMNS}, {_HIT} AS score FROM v WHERE {_WHERE} ORDER BY score DESC, downloads DESC, id LIMIT 20",
    "browse_page": f"{_VIEW} SELECT {_COLUMNS} FROM v ORDER BY downloads DESC, id LIMIT 20 OFFSET 40",
    "search_count": f"{_VIEW} SELECT count(*)::BIGINT AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM v WHERE {_WHERE}",
    "subject_filter": f"{_VIEW} SELECT {_COLUMNS} FROM v WHERE subjects = 'ECONOMY' AND (lower(title) LIKE '%ring%' OR lower(authors) LIKE '%ring%') ORDER BY (lower(title) LIKE '%ring%')::INT DESC, downloads DESC, id LIMIT 15",
    "subject_counts": "SELECT p_type AS name, count(*)::BIGINT AS books FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "subject_valid": r"SELECT p_partkey, regexp_matches(p_brand, '[ ,-]') OR (len(p_brand) > 2 AND NOT regexp_matches(p_brand, '\d')) AS brand_ok, regexp_matches(p_type, '[ ,-]') OR (len(p_type) > 2 AND NOT regexp_matches(p_type, '\d')) AS type_ok, regexp_matches(p_name, '[ ,-]') OR (len(p_name) > 2 AND NOT regexp_matches(p_name, '\d')) AS name_ok FROM part",
    "author_list": f"{_VIEW} SELECT id, authors FROM v",
    "missing_content": "SELECT c_custkey AS bookid, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "has_orders_flag": "SELECT c_custkey AS bookid, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS has_orders FROM customer",
    "category": f"""
WITH s(id, j) AS (VALUES (-1, ''), (-2, 'Biography'), (-3, 'Natural history'), (-4, 'Historical fiction'), (-5, 'Science fiction | Physics'), (-6, 'Cooking'), (-7, 'History of law'), (-8, 'Travel writing | Letters')
  UNION ALL SELECT p_partkey, p_name || ' | ' || p_type FROM part)
SELECT id::BIGINT AS id, CASE {_STRICT} END AS strict, CASE {_STRICT} ELSE 'dramatic' END AS category FROM s""",
    "topic_rules": f"""
WITH d(doc_id, text) AS (VALUES (-1, 'They praise the old dark devil here'), (-2, 'hell itself we celebrate'), (-3, 'a gruesome tale of blood-soaked hills'), (-4, 'bible criticism and psychics'), (-5, 'praise one two three four five satan'), (-6, 'erotica')
  UNION ALL SELECT doc_id, text FROM documents),
r AS (SELECT doc_id, array_to_string(list_filter([{_TOPIC}], lambda x: x IS NOT NULL), ',') AS reasons FROM d)
SELECT doc_id::BIGINT AS doc_id, reasons FROM r WHERE reasons <> ''""",
    "duplicate_groups": f"{_GROUPS} SELECT title_key, author_key, string_agg(bookid, ',' ORDER BY bookid) AS bookids FROM keyed JOIN groups USING (title_key, author_key) GROUP BY 1, 2",
    "canonical_pick": f"{_GROUPS} SELECT bookid, target, place, score FROM ranked",
    "merge_result": f"""{_GROUPS},
c AS (SELECT t, max(p_size)::BIGINT AS chars FROM linked GROUP BY t),
d AS (SELECT t, CASE WHEN p_size % 2 = 0 THEN 'catalog' ELSE 'rdf' END AS source FROM linked WHERE p_type = 'PROMO' QUALIFY row_number() OVER (PARTITION BY t ORDER BY p_size % 2 DESC, place, bookid) = 1),
a AS (SELECT t, p_size % 2 = 0 AS is_synthesized FROM linked WHERE p_size > 40 QUALIFY row_number() OVER (PARTITION BY t ORDER BY p_size % 2 DESC, place, bookid) = 1)
SELECT c.t AS id, chars, source, is_synthesized FROM c LEFT JOIN d USING (t) LEFT JOIN a USING (t)""",
    "work_key_siblings": "SELECT p.p_partkey AS bookid, g.ids AS same_work FROM part p JOIN (SELECT p_name, p_type, string_agg(p_partkey, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1, 2) g ON g.p_name = p.p_name AND g.p_type = p.p_type",
    "text_match": """
WITH x AS (SELECT p_name AS x, count(*) AS parts FROM part GROUP BY 1),
t AS (SELECT a.x, parts, b.x AS o, list_distinct(list_filter(string_split(a.x, ' '), lambda w: len(w) > 2)) AS p, list_distinct(list_filter(string_split('the ' || b.x, ' '), lambda w: len(w) > 2)) AS q FROM x a CROSS JOIN (SELECT x FROM x) b)
SELECT x, parts, 'The ' || o || '!' AS y, contains('the ' || o, x) OR len(list_intersect(p, q)) / least(len(p), len(q))::DOUBLE >= 0.5 AS fits, contains('the ' || o, x) OR len(list_intersect(p, q)) / least(len(p), len(q))::DOUBLE >= 0.8 AS fits_well FROM t WHERE len(list_intersect(p, q)) > 0""",
    "passage_contains": r"""
WITH stop AS (SELECT ['a','an','the','of','in','on','at','to','for','and','or','by','from','with','as','is','it','its','be','are','was'] AS s),
w AS (SELECT 0 AS side, item_id AS id, unnest(string_split_regex(lower(trim(text)), '[^\p{L}\p{N}_]+')) AS t, unnest(range(100000)) AS i FROM benchmark UNION ALL
      SELECT 1, doc_id, unnest(string_split_regex(lower(trim(text)), '[^\p{L}\p{N}_]+')), unnest(range(100000)) FROM documents),
k AS (SELECT side, id, t, min(i) AS i FROM w, stop WHERE t IS NOT NULL AND len(t) >= 2 AND NOT list_contains(s, t) GROUP BY 1, 2, 3),
q AS (SELECT id, t, count(*) OVER (PARTITION BY id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM k WHERE side = 0))
SELECT q.id AS query_id, d.id AS candidate_id FROM q JOIN k d ON d.side = 1 AND d.t = q.t GROUP BY q.id, d.id, n HAVING count(*) = n""",
    "id_map_report": """
WITH i AS (SELECT DISTINCT o_custkey * 2 AS g FROM orders), b AS (SELECT c_custkey AS id, c_custkey - c_custkey % 4 AS g FROM customer)
SELECT i.g AS gutenbergbookid, coalesce(string_agg(DISTINCT b.id, ',' ORDER BY b.id), '') AS bookids, CASE count(DISTINCT b.id) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'single' ELSE 'multiple' END AS kind FROM i LEFT JOIN b ON b.g = i.g GROUP BY i.g""",
    "rrf_hybrid": """
WITH a AS (SELECT lang AS q, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 50),
b AS (SELECT lang AS q, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 997 DESC, doc_id) AS r FROM documents QUALIFY r <= 50)
SELECT coalesce(a.q, b.q) AS query_id, coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b ON a.q = b.q AND a.id = b.id""",
}
