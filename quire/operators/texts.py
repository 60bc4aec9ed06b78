"""Cleaning, splitting and chunking of book texts.

What a regular expression can do stays in the JVM; line scanners with look-ahead are one Arrow-batched function per
document, so bodies are never exploded into lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of headers, trailers and headings in the texts.
START_MARK = r"^\s*\*{3,}\s*start of (?:(?:this|the)\s+)?project gutenberg"
TRAILER_MARKS = (
    r"section\s+1\.\s+general terms of use and redistributing project gutenberg",
    r"(?:\*\*\*\s*)?end of (?:(?:this|the)\s+)?project gutenberg",
    r"updated editions will replace the previous one",
    r"\*{3,}\s*this file should be named",
    r"project gutenberg(?:-tm)?\s+is\s+a\s+registered\s+trademark",
)
SPELLED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth"
PREAMBLE_LINES, PREAMBLE_LATEST = 800, 500
HEADING = rf"^\s*(?:chapter|book|part|section|act|canto|scene|volume)\s+(?:the\s+)?(?:[ivxlcdm]+|\d+|{SPELLED.replace(' ', '|')})\.?(?:\s*[:\-–—]\s*.{{0,80}})?\s*$"
REPAIR_HEADING = rf"^\s*(?:chapter|book|part|section)\s+(?:the\s+)?(?:[ivxlcdm]+|\d+|{SPELLED.replace(' ', '|')})\b(?:\s*[:.\-–—]\s*.*)?\s*$"
HEADING_CHARS = 180
CHAPTER_LISTING = r"^\s*(chapter|book|part|section)\s+([ivxlcdm]+|\d+)\b"


def text_function(kind: str = "string") -> Callable:
    """An Arrow-batched function of one text column; null stays null. It is made on first use, when there is a session."""

    def wrap(function: Callable) -> Callable[[Column], Column]:
        def run(column: pd.Series) -> pd.Series:
            return column.map(lambda t: None if t is None else function(t))

        return lambda column: F.pandas_udf(run, kind)(column)

    return wrap


# Markup and whitespace (native)


def strip_markup(text: Column, dangling_css: bool = False) -> Column:
    """Text without declarations, character data marks, blockout lines, script and style blocks, comments and tags of up to 200 characters.

    ``dangling_css`` also takes out a style block that an unclosed comment opens, which needs a line scanner.
    """
    out = F.coalesce(text, F.lit(""))
    for pattern in (r"(?i)<\?xml[^>]*\?>", r"(?im)^\s*/\*\s*(?:<!\[CDATA\[\s*)?xml (?:blockout|start|end)[^\n]*$", r"(?i)<!\[CDATA\[|\]\]>", r"(?is)<(script|style)\b[^>]*>.*?</\1>", r"(?s)<!--.*?-->"):
        out = F.regexp_replace(out, pattern, " ")
    out = scan_css(out) if dangling_css else out
    out = F.regexp_replace(out, r"(?i)</?[a-z][^>]{0,200}>", " ")
    return tidy(F.regexp_replace(out, r"(?im)^\s*xml blockout\s*$", " "))


def tidy(text: Column) -> Column:
    """No spaces at line ends and at most one empty line in a row; spaces inside lines stay, as they set off columns."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def strip_trailer(text: Column) -> Column:
    """Text before the first trailer mark; the whole text if nothing were left."""
    pattern = "(?im)^\\s*(?:" + "|".join(TRAILER_MARKS) + ")"
    head = F.rtrim(F.split(text, pattern, 2)[0])
    return F.when(F.trim(head) != "", head).otherwise(text)


def lines_of(text: Column) -> Column:
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)


def has_preamble(text: Column) -> Column:
    return F.exists(F.slice(lines_of(text), 1, PREAMBLE_LINES), lambda x: x.rlike("(?i)" + START_MARK))


def strip_preamble(text: Column) -> Column:
    """Text after the start mark, if it is among the first 501 lines."""
    lines = lines_of(text)
    at = F.array_position(F.transform(F.slice(lines, 1, PREAMBLE_LINES), lambda x: x.rlike("(?i)" + START_MARK)), True)
    rest = F.ltrim(F.array_join(F.slice(lines, at.cast("int") + 1, F.greatest(F.size(lines) - at.cast("int"), F.lit(0))), "\n"))
    return F.when((at > 0) & (at - 1 <= PREAMBLE_LATEST), rest).otherwise(text)


def strip_boilerplate(text: Column) -> Column:
    """For summaries: text between the start and end marks."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)^.*?\*{3}\s*start of (?:this |the )?project gutenberg[^\n]*\n", "")
    out = F.regexp_replace(out, r"(?is)\*{3}\s*end of (?:this |the )?project gutenberg.*$", "")
    return F.trim(out, F.lit(" \n\r\t"))


def reflow(text: Column) -> Column:
    """Paragraphs with their lines joined."""
    paragraphs = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))
    return F.array_join(F.filter(paragraphs, lambda p: F.length(p) > 0), "\n\n")


# Line scanners (one function per document)

_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def heading_number(token: str) -> int | None:
    """The value of digits or a Roman numeral."""
    if token.isdigit():
        return int(token)
    values = [_ROMAN.get(c) for c in token.lower()]
    if not values or None in values:
        return None
    return sum(-v if any(w > v for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values))


def strip_dangling_css(text: str) -> str:
    """Drops a style block that an unclosed comment opens near the start: five style-like lines or more right after the mark."""
    at = text.find("<!--")
    if not 0 <= at <= 2500 or "-->" in text[at:]:
        return text
    lines = text[at + 4 : at + 4 + 1200].split("\n")
    style = [i for i, x in enumerate(lines) if re.search(r"[{}]|^\s*[-\w]+\s*:\s*[^;]*;?\s*$|^\s*/\*", x)]
    if len(style) < 5:
        return text
    rest = text[at + 4 :].split("\n")
    last = 0
    for i, line in enumerate(rest):
        if re.search(r"[{};]\s*$|^\s*/\*|^\s*$", line):
            last = i + 1
        elif i > last + 1:
            break
    return text[:at] + "\n".join(rest[last:])


def strip_prefixed_contents(text: str) -> str:
    """Drops a list of chapters before the text: a contents mark, eight numbered headings close together, and then numbering from the start again."""
    lines = text.split("\n")
    mark = next((i for i, x in enumerate(lines[:4000]) if re.match(r"^\s*(?:table of\s+)?contents\b", x, re.I)), None)
    if len(lines) < 80 or mark is None:
        return text
    found = [(i, n) for i, x in enumerate(lines[mark + 1 : mark + 2200], mark + 1) if (m := re.match(CHAPTER_LISTING, x, re.I)) and (n := heading_number(m[2])) is not None]
    if len(found) < 8:
        return text
    for k in range(8, len(found)):
        listed, (line, number) = found[:k], found[k]
        if number != found[0][1]:
            continue
        gaps = [b[0] - a[0] for a, b in zip(listed, listed[1:], strict=False)]
        if sum(g <= 40 for g in gaps) < 0.7 * len(gaps):
            continue
        if k + 1 < len(found) and found[k + 1][1] != number + 1:
            continue
        # what stands before the mark, a title page or a preface, is no list
        return "\n".join(lines[:mark] + lines[line:]).strip() or text
    return text


def strip_contents_page(text: str) -> str:
    """Drops a page of eight or more "title   number" rows below a contents line.

    A line that is no row belongs to the list if the next one that isn't blank, among three, is a row: a title that goes
    on in the next line. The list ends at the first other line; a list without an end is left alone.
    """
    lines = text.split("\n")
    start = next((i for i, x in enumerate(lines[:3000]) if re.match(r"^\s*contents\.?\s*$", x, re.I)), None)
    if len(lines) < 20 or start is None:
        return text
    listed = [x.strip() for x in lines[start + 1 : start + 2600]]
    is_row = [re.match(r"\S.*?\s{2,}\d{1,4}$", x) is not None for x in listed]

    def ends(i: int) -> bool:
        if not listed[i] or is_row[i] or re.match(r"page\.?$", listed[i], re.I):
            return False
        return not next((is_row[j] for j in range(i + 1, min(i + 4, len(listed))) if listed[j]), False)

    end = next((i for i in range(len(listed)) if ends(i)), None)
    if end is None or sum(is_row[:end]) < 8:
        return text
    return "\n".join(lines[:start] + lines[start + 1 + end :]).strip() or text


scan_text = text_function()(lambda t: strip_prefixed_contents(strip_contents_page(t)))
scan_css = text_function()(strip_dangling_css)


def clean(raw: Column) -> Column:
    """The whole cleaning: markup, preamble, contents pages, trailer."""
    return F.trim(strip_trailer(scan_text(strip_preamble(strip_markup(raw, dangling_css=True)))), F.lit(" \n"))


def recleaned(contents: DataFrame) -> DataFrame:
    """bookid, new_text and outcome for every row: no-raw, no-preamble, unchanged or changed."""
    new = contents.select("bookid", "raw_content", "clean_content", F.when(F.trim(F.coalesce("raw_content", F.lit(""))) != "", clean(F.col("raw_content"))).alias("new_text"))
    outcome = F.when(F.col("new_text").isNull(), "no-raw").when(~has_preamble(F.col("clean_content")), "no-preamble").when(F.col("new_text").eqNullSafe(F.col("clean_content")), "unchanged").otherwise("changed")
    return new.select("bookid", "new_text", outcome.alias("outcome"))


# Splitting


def chapters_of(text: str, heading: str = HEADING, front: str = "Introduction", whole: str = "Full Text") -> list[tuple[str, str]]:
    """(title, text) of each chapter; a heading line opens one and stays in it, text before the first is ``front``."""
    pattern = re.compile(heading, re.I)
    out: list[tuple[str, list[str]]] = [(front, [])]
    for line in text.replace("\r\n", "\n").split("\n"):
        if len(line.strip()) <= HEADING_CHARS and pattern.match(line):
            out.append((line.strip(), []))
        out[-1][1].append(line)
    blocks = [(t, "\n".join(x).strip()) for t, x in out]
    if len(blocks) == 1:
        return [(whole, blocks[0][1])] if blocks[0][1] else []
    return [b for b in blocks if b[1]]


CHAPTERS = "array<struct<title:string,text:string>>"
split_chapters = text_function(CHAPTERS)(lambda t: [{"title": a, "text": b} for a, b in chapters_of(t)])
split_for_repair = text_function(CHAPTERS)(lambda t: [{"title": a, "text": b} for a, b in chapters_of(t, REPAIR_HEADING, "Front Matter")])


def chapters(texts: DataFrame, key: str = "bookid", text: str = "text") -> DataFrame:
    """key, chapter_index (from 1), title and text."""
    rows = texts.select(key, F.posexplode(split_chapters(F.col(text))).alias("i", "c"))
    return rows.select(key, (F.col("i") + 1).alias("chapter_index"), "c.title", "c.text")


def short_chapters(texts: DataFrame, least_lines: int, key: str = "bookid", text: str = "text") -> DataFrame:
    """key, n_chapters, counts (lines with text of each) and is_short: two chapters or more besides front matter, all below ``least_lines``."""
    body = F.filter(split_for_repair(F.coalesce(F.col(text), F.lit(""))), lambda c: ~c["title"].isin("Front Matter", "Full Text"))
    count = lambda c: F.size(F.filter(F.split(c["text"], "\n"), lambda x: F.trim(x) != ""))
    out = texts.select(key, F.transform(body, count).alias("counts"))
    return out.select(key, F.size("counts").alias("n_chapters"), "counts", ((F.size("counts") >= 2) & F.forall("counts", lambda c: c < least_lines)).alias("is_short"))


def scan_outcomes(books: DataFrame, least_lines: int) -> DataFrame:
    """bookid and outcome of books (bookid, text, has_audio): audio, blank, short or fine."""
    verdict = short_chapters(books.where("not has_audio and trim(coalesce(text, '')) <> ''"), least_lines).select("bookid", F.when(F.col("is_short"), "short").otherwise("fine").alias("_v"))
    return books.join(verdict, "bookid", "left").select("bookid", F.when(F.col("has_audio"), "audio").when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank").otherwise(F.col("_v")).alias("outcome"))


def canonical_heading(title: Column) -> Column:
    """A key of equal headings: kind and number, Roman or Arabic."""
    from ..functions.text import roman_value

    kind = F.lower(F.regexp_extract(title, r"(?i)^\s*(chapter|book|part|section|act|canto|scene|volume)\b", 1))
    number = F.regexp_extract(title, r"(?i)^\s*\w+\s+([ivxlcdm]+|\d+)\b", 1)
    value = F.when(number.rlike(r"^\d+$"), number.try_cast("int")).otherwise(roman_value(number))
    return F.when((kind != "") & value.isNotNull(), F.concat_ws(" ", kind, value.cast("string"))).otherwise(F.lower(F.trim(title)))


def distinct_chapters(split: DataFrame, key: str = "bookid") -> DataFrame:
    """Of chapters with one canonical heading the longest, at the place of the first; a part or book heading is context, so "Book II / Chapter 1" is no copy of "Book I / Chapter 1"."""
    structural = F.col("title").rlike(r"(?i)^\s*(?:part|book|volume)\b")
    w = Window.partitionBy(key).orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, 0)
    parent = F.last(F.when(structural, canonical_heading(F.col("title"))), True).over(w)
    keyed = split.withColumn("_parent", F.when(structural, F.lit("")).otherwise(F.coalesce(parent, F.lit("")))).withColumn("_key", canonical_heading(F.col("title")))
    kept = keyed.groupBy(key, "_parent", "_key").agg(F.min("chapter_index").alias("chapter_index"), F.max_by(F.struct("title", "text"), F.struct(F.length("text"), -F.col("chapter_index"))).alias("_c"))
    return kept.select(key, "chapter_index", "_c.title", "_c.text").where("title not in ('Introduction', 'Front Matter') or chapter_index > 1")


def chapters_by_contents(text: str, least_entries: int = 8, least_matched: int = 6) -> list[tuple[str, str]]:
    """Splits by the titles of a contents page, where headings follow no pattern: entries that are lines of their own further down."""
    lines = text.split("\n")
    start = next((i for i, x in enumerate(lines) if re.match(r"^\s*(?:table of\s+)?contents\.?\s*$", x, re.I)), None)
    if start is None:
        return []
    entries, i, blank = [], start + 1, 0
    while i < len(lines) and blank < 3:
        line = re.sub(r"[\s.]*\d*\s*$", "", lines[i]).strip()
        blank = 0 if line else blank + 1
        if line:
            entries.append(line)
        i += 1
    if len(entries) < least_entries:
        return []
    places, at = [], i
    for e in entries:
        found = next((j for j in range(at, len(lines)) if lines[j].strip().lower() == e.lower()), None)
        if found is not None:
            places.append((found, e))
            at = found + 1
    if len(places) < least_matched:
        return []
    ends = [p for p, _ in places[1:]] + [len(lines)]
    return [(t, "\n".join(lines[p + 1 : e]).strip()) for (p, t), e in zip(places, ends, strict=True)]


split_by_contents = text_function(CHAPTERS)(lambda t: [{"title": a, "text": b} for a, b in chapters_by_contents(t)])


def turn_blocks(rows: DataFrame, key: str, order: str, is_head: Column, text: str = "text") -> DataFrame:
    """Blocks of rows that a heading row opens: a running count of headings by key, then one aggregation."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("block", F.sum(F.when(is_head, 1).otherwise(0)).over(w))
    grouped = marked.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_r"))
    return grouped.select(key, "block", F.array_join(F.transform("_r", lambda r: r["t"]), "\n").alias("text"), F.size("_r").alias("n_rows"))


# Chunking


def char_chunks(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters; the last may be shorter, an empty text has none."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def token_windows(words: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that start every max(1, size - overlap); one window if all words fit."""
    step = max(1, size - overlap)
    # the array around ``words`` has one element: it binds their value, which would be computed again for each window
    bound = lambda w: F.when(F.size(w) == 0, F.array().cast("array<array<string>>")).when(F.size(w) <= size, F.array(w)).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / step).cast("int")), lambda i: F.slice(w, i * step + 1, F.lit(size)))
    )
    return F.transform(F.array(words), bound)[0]


# HTML


def html_to_text(page: str) -> str:
    """Text of a page, block elements as lines."""
    import html

    page = re.sub(r"(?is)<(script|style|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", " ", page)
    page = re.sub(r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|nav|footer|header|blockquote|br|hr|pre)\b[^>]*>", "\n", page)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in page.split("\n"))
    return "\n".join(x for x in lines if x)


html_text = text_function()(html_to_text)
BODY_BOILERPLATE = re.compile(r"project gutenberg|\*\*\*|end of the project|produced by|transcriber", re.I)


def clean_html_body(page: str) -> str:
    """Markup without style, script and link elements, and without empty or boilerplate nodes at both ends of the body."""
    page = re.sub(r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<link\b[^>]*>", "", page)
    body = re.search(r"(?is)<body\b[^>]*>(.*?)(?:</body>|\Z)", page)
    inner = body[1] if body else page
    nodes = [n for n in re.split(r"(?i)(?<=</p>)|(?<=</div>)|(?<=</h[1-6]>)|(?<=</section>)|(?<=</article>)|(?<=</footer>)|(?<=</nav>)", inner) if n]
    text = lambda n: re.sub(r"<[^>]+>", "", n).strip()
    bad = lambda n: "<img" not in n.lower() and (not text(n) or BODY_BOILERPLATE.search(text(n)))
    while nodes and bad(nodes[0]):
        nodes.pop(0)
    while nodes and bad(nodes[-1]):
        nodes.pop()
    return "".join(nodes).strip()


clean_html = text_function()(clean_html_body)


def image_names(page: Column) -> Column:
    """Distinct file names of images that a page refers to."""
    refs = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit("(?i)<img\\b[^>]*?\\bsrc\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.array_distinct(F.transform(refs, lambda u: F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), "^.*/", "")))


def rewritten_images(page: Column, base: Column, uploaded: Column) -> Column:
    """A page with the sources of uploaded images moved below ``base``."""
    start = F.coalesce(page, F.lit(""))
    return F.aggregate(uploaded, start, lambda p, n: F.regexp_replace(p, F.concat(F.lit("(?i)(<img\\b[^>]*?\\bsrc\\s*=\\s*[\"'])[^\"']*?"), F.concat(F.lit("\\Q"), n, F.lit("\\E")), F.lit("([\"'])")), F.concat(F.lit("$1"), base, n, F.lit("$2"))))


def page_links(page: Column) -> Column:
    """Targets of links, first occurrences in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit("(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"'#]+)[\"']"), F.lit(1)))


def reading_model(page: str) -> list[tuple[str, str, int]]:
    """(title, anchor, level) of the headings of a page, without scripts."""
    out, seen = [], {}
    page = re.sub(r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", "", page)
    for m in re.finditer(r"(?is)<h([1-6])\b([^>]*)>(.*?)</h\1>", page):
        title = " ".join(re.sub(r"<[^>]+>", "", m[3]).split())
        given = re.search(r"\bid\s*=\s*[\"']([^\"']+)", m[2])
        slug = given[1] if given else re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-") or "section"
        seen[slug] = seen.get(slug, 0) + 1
        if title:
            out.append((title, slug if seen[slug] == 1 else f"{slug}-{seen[slug]}", int(m[1])))
    return out


headings_of = text_function("array<struct<title:string,anchor:string,level:int>>")(lambda t: [{"title": a, "anchor": b, "level": c} for a, b, c in reading_model(t)])


def sanitized(page: Column) -> Column:
    """A page without scripts and without event attributes."""
    out = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<script\b[^>]*>.*?(?:</script\s*>|$)", "")
    return F.regexp_replace(out, r"(?i)\son[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
