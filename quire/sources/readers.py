"""Sources: metadata files in RDF, tab- and bar-separated lists, id lists, bytes of many formats, archives, listings."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U

SUMMARY_ROW = "wikipedia_id string, freebase_id string, title string, author string, publication_date string, genres string, summary string"
MAIN_SUFFIXES = ("-h.htm", "-h.html", "-images.html", "/index.html")


def _all(xml: Column, path: str) -> Column:
    """Texts of a path by local names."""
    return F.filter(F.transform(F.xpath(xml, F.lit(path)), lambda s: F.trim(s)), lambda t: F.length(t) > 0)


def rdf_records(files: DataFrame, xml: str = "content") -> DataFrame:
    """Metadata of RDF files: titles (alternatives after them), authors by name else alias, issued, summary and download links. Files without a title are left out."""
    x = F.col(xml).cast("string")
    names = _all(x, "//*[local-name()='creator']//*[local-name()='name']/text()")
    aliases = _all(x, "//*[local-name()='creator']//*[local-name()='alias']/text()")
    out = files.select(
        *[c for c in files.columns if c != xml],
        F.array_distinct(F.concat(_all(x, "//*[local-name()='title']/text()"), _all(x, "//*[local-name()='alternative']/text()"))).alias("titles"),
        F.array_distinct(F.when(F.size(names) > 0, names).otherwise(aliases)).alias("authors"),
        F.element_at(F.concat(_all(x, "//*[local-name()='issued']/text()"), F.array(F.lit(None).cast("string"))), 1).alias("issued"),
        F.element_at(F.concat(_all(x, "//*[local-name()='marc520']/text()"), F.array(F.lit(None).cast("string"))), 1).alias("summary"),
        F.array_distinct(_all(x, "//*[local-name()='subject']//*[local-name()='value']/text()")).alias("subjects"),
        F.xpath(x, F.lit("//*[local-name()='file']/@*[local-name()='about']")).alias("files"),
    )
    return out.where(F.size("titles") > 0)


def cover_entries(records: DataFrame, external_id: str = "gutenbergbookid") -> DataFrame:
    """bookid, size_label, sort_order, image_url: cover images among a record's files, one row per URL."""
    url = records.select(F.col(external_id).alias("bookid"), F.posexplode("files").alias("sort_order", "image_url"))
    found = url.where(F.col("image_url").rlike(r"(?i)pg\d+\.cover(\.[a-z]+)?\.(jpe?g|png|gif)$"))
    label = F.coalesce(F.nullif(F.lower(F.regexp_extract("image_url", r"(?i)\.cover\.([a-z]+)\.(?:jpe?g|png|gif)$", 1)), F.lit("")), F.lit("default"))
    return found.groupBy("bookid", "image_url").agg(F.min("sort_order").alias("sort_order"), F.min(label).alias("size_label"))


def star_schema(records: DataFrame) -> dict[str, DataFrame]:
    """books, titles, authors, book_authors, subjects and book_subjects from metadata records (id, ...). Unknown dates get a sentinel."""
    books = records.select("id", F.col("id").alias("gutenbergbookid"), F.coalesce("issued", F.lit("1000-10-10")).alias("dateissued"), F.lit(-1).cast("bigint").alias("languageid"), F.lit(-1).cast("bigint").alias("numdownloads"))
    titles = records.select(F.col("id").alias("bookid"), F.posexplode("titles").alias("ord", "name"))

    def dimension(column: str, key: str) -> tuple[DataFrame, DataFrame]:
        pairs = records.select(F.col("id").alias("bookid"), F.explode(column).alias("name")).distinct()
        dim = pairs.select("name").distinct().withColumn("id", F.xxhash64("name"))  # an id that needs no counter
        return dim.select("id", "name"), pairs.select("bookid", F.xxhash64("name").alias(key))

    authors, book_authors = dimension("authors", "authorid")
    subjects, book_subjects = dimension("subjects", "subjectid")
    return {"books": books, "titles": titles, "authors": authors, "book_authors": book_authors, "subjects": subjects, "book_subjects": book_subjects}


def summary_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tab-separated file of summaries; rows with fewer than seven fields are left out, empty fields are kept."""
    fields = F.split("value", "\t", -1)
    names = [c.split()[0] for c in SUMMARY_ROW.split(", ")]
    return spark.read.text(path).where(F.size(fields) >= len(names)).select(*[fields[i].alias(n) for i, n in enumerate(names)])


def tar_members(files: DataFrame) -> DataFrame:
    """path, name and content of the members of tar archives (a binaryFile frame)."""

    def read(frames):
        import tarfile

        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                with tarfile.open(fileobj=io.BytesIO(r.content)) as tar:
                    rows += [(r.path, m.name, tar.extractfile(m).read()) for m in tar if m.isfile()]
            yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return files.select("path", "content").mapInPandas(read, "path string, name string, content binary")


def id_list(spark: SparkSession, path: str, column: str = "bookid", pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct ids of a CSV file with a header, by an optional pattern; with a limit the first ones of the file."""
    rows = spark.read.csv(path, header=True)
    rows = rows.where(F.col(column).rlike(pattern)) if pattern else rows
    return _first_of_file(rows.select(F.col(column).try_cast("bigint").alias(column)), column, limit).select(column)


def _first_of_file(rows: DataFrame, key: str, limit: int | None) -> DataFrame:
    """The first row of each key that isn't null; with a limit the keys that the file names first, shown by key."""
    placed = rows.where(F.col(key).isNotNull()).withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    first = placed.groupBy(key).agg(F.min(F.struct("_file", "_at", *[c for c in rows.columns if c != key])).alias("_f"))
    first = first.orderBy("_f._file", "_f._at").limit(limit) if limit else first
    out = first.select(key, *[F.col("_f")[c].alias(c) for c in rows.columns if c != key])
    return out.orderBy(key) if limit else out


def bar_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """bookid, gutenbergbookid and title of a bar-separated file without header; titles may hold bars."""
    parts = F.split("value", r"\|", 3)
    out = spark.read.text(path).select(parts[0].try_cast("bigint").alias("bookid"), F.get(parts, 1).try_cast("bigint").alias("gutenbergbookid"), F.trim(F.get(parts, 2)).alias("title"))
    return _first_of_file(out, "bookid", limit)


def dataset_texts(rows: DataFrame) -> DataFrame:
    """bookid (from the row's id or its text's header) and text of a dataset with splits, the longest text of each."""
    from ..functions.text import row_id

    return rows.select(row_id(F.col("id"), F.col("text")).alias("bookid"), "text").where("bookid is not null").groupBy("bookid").agg(F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"))


def listing_links(pages: DataFrame) -> DataFrame:
    """url, name and kind of the files that directory listings (base, html) link to, absolute and distinct."""
    from ..operators.texts import page_links

    rel = pages.select("base", F.explode(page_links(F.col("html"))).alias("href")).where("href not like '?%' and href not like '..%' and href not like '/'")
    url = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(F.regexp_extract("base", r"^([a-z]+://[^/]+)", 1), "href")).otherwise(F.concat("base", "href"))
    return rel.select("base", url.alias("url")).distinct().where(U.is_live_content(F.col("url"))).withColumn("kind", F.coalesce(U.media_type(F.col("url")), U.audio_type(F.col("url"))))


def listed_ids(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct ids of object paths <prefix>/<id>/images/<file>."""
    return paths.select(F.regexp_extract(column, r"/(\d+)/images/[^/]+$", 1).try_cast("bigint").alias("gutenbergbookid")).where("gutenbergbookid is not null").distinct()


def decode_bytes(raw: bytes, declared: str | None = None) -> str:
    """Text of bytes: as declared, else UTF-8, else Windows-1252, else Latin-1, which takes all."""
    for name in (declared, "utf-8", "cp1252"):
        try:
            if name:
                return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    return raw.decode("latin-1")


def xml_to_text(raw: bytes) -> str:
    import xml.etree.ElementTree as tree

    try:
        parts = (t.strip() for t in tree.fromstring(raw).itertext())
    except tree.ParseError:
        return re.sub(r"<[^>]+>", " ", decode_bytes(raw)).strip()
    return "\n".join(p for p in parts if p)


def tex_to_text(raw: bytes) -> str:
    text = re.sub(r"(?<!\\)%.*", "", decode_bytes(raw))
    text = re.sub(r"\\(?:begin|end|documentclass|usepackage|label|ref|cite)(?:\[[^\]]*\])?\{[^}]*\}", "", text)
    text = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)
    return re.sub(r"\\[a-zA-Z]+\*?|[{}]", "", text).strip()


def spine_documents(archive: zipfile.ZipFile) -> list[str]:
    """Documents of an EPUB in reading order; without a package file, all pages by name."""
    import posixpath
    import xml.etree.ElementTree as tree

    names = archive.namelist()
    package = next((n for n in names if n.lower().endswith(".opf")), None)
    if package:
        root = tree.fromstring(archive.read(package))
        items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item")}
        order = [items.get(e.get("idref")) for e in root.iter() if e.tag.endswith("}itemref")]
        found = [posixpath.normpath(posixpath.join(posixpath.dirname(package), h)) for h in order if h]
        return [f for f in found if f in names]
    return sorted(n for n in names if n.lower().endswith((".html", ".htm", ".xhtml")))


def main_page(names: list[str]) -> str | None:
    """The main page of an archive: by suffix, in order of preference, else the first page."""
    pages = [n for n in names if n.lower().endswith((".htm", ".html"))]
    for suffix in MAIN_SUFFIXES:
        for n in pages:
            if n.lower().endswith(suffix):
                return n
    return pages[0] if pages else None


def bytes_to_text(raw: bytes, name: str = "", kind: str = "") -> str | None:
    """Text of a file by its media type, suffix or first bytes. PDF needs a reader that is not part of this package, so it has none: None, as is an empty text."""
    from ..operators.texts import html_to_text

    low = name.lower()
    if raw[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            inner = spine_documents(archive) or sorted(n for n in archive.namelist() if n.lower().endswith((".txt", ".xml", ".tex", ".tei")))
            return "\n\n".join(t for n in inner if (t := bytes_to_text(archive.read(n), n)))
    if raw[:5] == b"%PDF-" or "pdf" in kind:
        return None
    if "html" in kind or low.endswith((".html", ".htm", ".xhtml")) or re.match(rb"\s*(?:<!doctype html|<html)", raw[:200], re.I):
        return html_to_text(decode_bytes(raw))
    if "tei" in kind or low.endswith((".xml", ".tei")) or raw[:5] == b"<?xml":
        return xml_to_text(raw)
    if "tex" in kind.split("/")[-1].split(".") or low.endswith(".tex"):
        return tex_to_text(raw)
    return decode_bytes(raw)


def file_text(content: Column, name: Column, kind: Column) -> Column:
    """Text of file contents; null stays null."""

    def run(content: pd.Series, name: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else bytes_to_text(bytes(c), n or "", k or "") for c, n, k in zip(content, name, kind, strict=True)])

    return F.pandas_udf(run, "string")(content, name, kind)


def joined_epub(raw: bytes) -> str:
    """One page from the documents of an EPUB in reading order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        bodies = []
        for n in spine_documents(archive):
            page = decode_bytes(archive.read(n))
            body = re.search(r"(?is)<body\b[^>]*>(.*?)</body>", page)
            bodies.append(f"<section>{body[1] if body else page}</section>")
        return "<html><body>" + "".join(bodies) + "</body></html>"


def epub_html(content: Column) -> Column:
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if c is None else joined_epub(bytes(c)))

    return F.pandas_udf(run, "string")(content)


def summary_node(page: str) -> str:
    """Text of the element whose class is summary-text-container, found by counting depth."""
    m = re.search(r"(?i)<([a-z]+)\b[^>]*\bclass\s*=\s*[\"'][^\"']*\bsummary-text-container\b[^>]*>", page)
    if not m:
        return ""
    depth, at = 1, m.end()
    for t in re.finditer(rf"(?i)<(/?){m[1]}\b[^>]*>", page[at:]):
        depth += -1 if t[1] else 1
        if depth == 0:
            return " ".join(re.sub(r"<[^>]+>", " ", page[at : at + t.start()]).split())
    return " ".join(re.sub(r"<[^>]+>", " ", page[at:]).split())


def page_summary(html: Column) -> Column:
    from ..operators.texts import text_function

    return text_function()(summary_node)(html)


def librivox_items(responses: DataFrame) -> DataFrame:
    """Audio items of captured JSON answers (book_id, payload)."""
    kind = "struct<books:array<struct<url_zip_file:string,sections:array<struct<section_number:string,title:string,listen_url:string,playtime:string,readers:array<struct<display_name:string>>>>>>>"
    book = F.get(F.from_json("payload", kind)["books"], 0)
    tracks = F.array_sort(F.transform(book["sections"], lambda s: F.struct(s["section_number"].try_cast("int").alias("track_order"), s["title"].alias("title"), s["listen_url"].alias("url"), s["playtime"].alias("duration"))))
    narrators = F.array_distinct(F.flatten(F.transform(book["sections"], lambda s: F.transform(F.coalesce(s["readers"], F.array()), lambda r: r["display_name"]))))
    out = responses.select("book_id", book["url_zip_file"].alias("package_url"), tracks.alias("tracks"), narrators.alias("_n"))
    return out.where(F.size("tracks") > 0).select("book_id", "package_url", "tracks", F.when(F.size("_n") == 1, F.element_at("_n", 1)).when(F.size("_n") > 1, "Various").alias("narrator"))


def live_or_local(local: DataFrame, live: DataFrame, key: str, value: str) -> DataFrame:
    """Captured live bytes win over local ones."""
    return local.withColumnRenamed(value, "_local").join(live.withColumnRenamed(value, "_live"), key, "full_outer").select(key, F.coalesce("_live", "_local").alias(value))


def book_records(ids: DataFrame, id_map: DataFrame, desc: DataFrame, texts: DataFrame, pages: DataFrame) -> DataFrame:
    """Inputs of a summary run: external ids resolved by a map, description with defaults, text else markup; ``problem`` tells what is missing."""
    m = id_map.groupBy("gutenbergbookid").agg(F.min("bookid").alias("bookid"), F.count_distinct("bookid").alias("_n"))
    found = ids.join(m, "gutenbergbookid", "left").join(desc.select("bookid", "source_title", "summary", "category"), "bookid", "left").join(texts.select("bookid", F.col("text").alias("_text")), "bookid", "left").join(pages.select("bookid", F.col("html").alias("_html")), "bookid", "left")
    body = F.coalesce("_text", "_html")
    problem = F.when(F.col("bookid").isNull(), "unknown id").when(F.col("_n") > 1, "conflicting ids").when(body.isNull(), "no content")
    return found.select("gutenbergbookid", "bookid", F.coalesce("source_title", F.lit("Untitled")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), "category", body.alias("text"), problem.alias("problem"))
