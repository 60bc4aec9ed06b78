"""Text functions as Column builders: tokenizers, normalizers, identifiers in texts, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide results.
SEARCH_STOP_WORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "by", "from", "with", "as", "is", "it", "its", "be", "are", "was")
TITLE_STOP_WORDS = ("a", "an", "and", "book", "for", "from", "in", "of", "on", "or", "the", "to", "volume", "vol")
WARNING_MARKERS = ("do not download", "obsolete format", "alternative ids", "redirect disabled")
LEAST_TEXT_CHARS, LEAST_TEXT_WORDS = 400, 40
MARKER_PATTERNS = (r"(?i)\[\s*ebook\s*#\s*(\d+)\s*\]", r"(?i)\bebook\s*#\s*(\d+)\b", r"(?i)\betext\s*#\s*(\d+)\b")
MARKER_PREFIX = 30_000
#: Latin letters with marks and their plain letters, for folding without a decomposition function.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzAAAAAACEEEEIIIINOOOOOUUUUY"


def _in(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def tokens(text: Column, pattern: str = "(?U)\\W+") -> Column:
    """Lower-cased words; the split follows Unicode word characters."""
    return F.filter(F.split(F.lower(F.trim(text)), pattern), lambda t: F.length(t) > 0)


def search_tokens(query: Column) -> Column:
    """Words of a query for keyword search: two characters or more, first occurrences, without stop words unless nothing else is there."""
    words = F.array_distinct(F.filter(tokens(F.coalesce(query, F.lit(""))), lambda t: F.length(t) >= 2))
    useful = F.filter(words, lambda t: ~t.isin(*SEARCH_STOP_WORDS))
    return F.when(F.size(useful) > 0, useful).otherwise(words)


def year_of_issue(date: Column) -> Column:
    """The first four characters as a year if they are digits and above 1000."""
    head = F.substring(F.trim(date), 1, 4)
    year = F.when(head.rlike(r"^\d{1,4}$"), head.cast("int"))
    return F.when(year > 1000, year)


def year_in_range(date: Column) -> Column:
    """A leading four-digit year between 1000 and 3000, both excluded."""
    year = F.expr("null").cast("int") if date is None else F.nullif(F.regexp_extract(F.coalesce(date, F.lit("")), r"^\s*(\d{4})", 1), F.lit("")).cast("int")
    return F.when((year > 1000) & (year < 3000), year)


def year_in_text(text: Column) -> Column:
    """The first word that is a year of the 18th century's end or later (18xx, 19xx, 20xx)."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(1[89]\d{2}|20\d{2})\b", 1), F.lit(""))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", "")


def match_text(text: Column) -> Column:
    """For comparisons: ASCII letters and digits in lower case, single spaces; other characters vanish."""
    return F.trim(F.regexp_replace(F.lower(ascii_only(text)), "[^a-z0-9]+", " "))


def folded_match_text(text: Column) -> Column:
    """As :func:`match_text`, but letters with marks lose only the marks."""
    return match_text(F.translate(F.coalesce(text, F.lit("")), ACCENTED, PLAIN))


def spaced_match_text(text: Column) -> Column:
    """As :func:`match_text`, but other characters become spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def token_set(normalized: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: F.length(t) >= least))


def title_key(title: Column) -> Column:
    """Key of equal titles: stop words and single letters go, numbers stay, so volumes differ."""
    words = F.split(match_text(title), " ")
    return F.array_join(F.filter(words, lambda t: ~t.isin(*SEARCH_STOP_WORDS) & ((F.length(t) > 1) | t.rlike(r"^\d+$"))), " ")


def author_key(names: Column) -> Column:
    """Sorted distinct words of three letters or more over all names of an array."""
    parts = F.flatten(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.split(F.lower(n), "[^a-z]+")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(*SEARCH_STOP_WORDS))))


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(folded_match_text(title), " "), lambda t: (F.length(t) > 2) & ~t.isin(*TITLE_STOP_WORDS)))


def clean_catalog_title(title: Column) -> Column:
    """Titles without subfield marks ($a, $b ...), no-break spaces and runs of white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(title, F.lit("")), F.lit(" "), F.lit(" ")), r"\s*\$[a-z]\s*", " "), r"\s+", " "))


def author_names(value: Column) -> Column:
    """Single names of a credit: split at &, "and" and ;, and at commas where there is more than one."""
    parts = F.split(F.coalesce(value, F.lit("")), r"(?i)\s*&\s*|\s+and\s+|\s*;\s*")
    commas = lambda p: F.length(p) - F.length(F.replace(p, F.lit(","), F.lit("")))
    pieces = F.flatten(F.transform(parts, lambda p: F.when(commas(p) > 1, F.split(p, ",")).otherwise(F.array(p))))
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda p: F.length(p) > 0)


def marker_id(text: Column, prefix: int = MARKER_PREFIX) -> Column:
    """The identifier in a text's header. The order of patterns counts, not the place."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, prefix)
    found = [F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in MARKER_PATTERNS]
    return F.coalesce(*found).cast("bigint")


def marker_mismatch(text: Column, expected: Column) -> Column:
    """Whether a text names another identifier; without a marker it does not."""
    return F.coalesce(marker_id(text) != expected, F.lit(False))


def row_id(identifier: Column, text: Column) -> Column:
    """The number before the dash of a row's identifier, else the one in the text's header."""
    head = F.split_part(F.coalesce(identifier, F.lit("")), F.lit("-"), F.lit(1))
    return F.when(head.rlike(r"^\d+$"), head.cast("bigint")).otherwise(marker_id(text))


def valid_subject(subject: Column) -> Column:
    """A heading that readers understand: several words, or a word of three letters or more without digits."""
    s = F.trim(F.coalesce(subject, F.lit("")))
    return s.rlike("[ ,-]") | ((F.length(s) > 2) & ~s.rlike(r"\d"))


def looks_like_warning(text: Column) -> Column:
    return F.lower(text).rlike("|".join(WARNING_MARKERS))


def looks_like_book(text: Column) -> Column:
    """Long enough, no warning page, and enough words of three letters or digits."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return (F.length(t) >= LEAST_TEXT_CHARS) & ~looks_like_warning(t) & (F.regexp_count(t, F.lit("[A-Za-z0-9]{3,}")) >= LEAST_TEXT_WORDS)


def looks_like_markup(text: Column) -> Column:
    """Structural tags, an XML declaration or character data section, or ten tags of any kind."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(r"(?i)<(html|head|body|div|p|span|table|style|script)\b") | t.rlike(r"(?i)<\?xml|<!\[CDATA\[") | (F.regexp_count(t, F.lit(r"(?i)</?[a-z][^>]{0,200}>")) >= 10)


def subject_list(value: Column) -> Column:
    """Entries of a list that is separated by bars, semicolons or line ends."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"[|;\n]"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def excerpt(text: Column, most: int) -> Column:
    """At most ``most`` characters, with an ellipsis in place of the rest."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))).cast("bigint")
    return F.format_string("%d:%02d", F.expr("0") + F.floor(whole / 60).cast("bigint"), whole % 60)


def roman_value(numeral: Column) -> Column:
    """The value of a Roman numeral: a sign before a larger one counts negative. Null if there are other characters."""
    n = F.upper(F.trim(numeral))
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    step = lambda s, v: F.struct(F.when(v < s["top"], s["sum"] - v).otherwise(s["sum"] + v).alias("sum"), F.greatest(v, s["top"]).alias("top"))
    digits = F.transform(F.filter(F.split(F.reverse(n), ""), lambda c: F.length(c) > 0), value)
    return F.when(n.rlike("^[IVXLCDM]+$"), F.aggregate(digits, start, step, lambda s: s["sum"]))


def unescaped_basic(text: Column) -> Column:
    """The five entities that every page has; the ampersand goes last."""
    out = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def search_title(title: Column) -> Column:
    """Title for hybrid search: unaccented, lower case, no leading article, no punctuation."""
    t = F.lower(F.translate(F.coalesce(title, F.lit("")), ACCENTED, PLAIN))
    t = F.regexp_replace(t, r"\s*[(\[][a-z ]+(edition|translation)[)\]]\s*$", "")
    t = F.regexp_replace(t, r"^\s*(the|a|an|le|la|les|der|die|das|el|los|las)\s+", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def sorted_title_key(title: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(search_title(title), " "), lambda t: (F.length(t) > 0) & ~t.isin(*SEARCH_STOP_WORDS))), " ")


def author_parts(name: Column) -> Column:
    """(surname, given) of "Surname, Given" or "Given Surname"; parentheses go, glued initials are parted."""
    n = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", ""))
    n = F.regexp_replace(n, r"\.(?=[A-Za-z])", ". ")
    comma = F.instr(n, ",") > 0
    surname = F.when(comma, F.split_part(n, F.lit(","), F.lit(1))).otherwise(F.regexp_extract(n, r"(\S+)$", 1))
    given = F.when(comma, F.split_part(n, F.lit(","), F.lit(2))).otherwise(F.regexp_replace(n, r"\S+$", ""))
    return F.struct(match_text(F.translate(surname, ACCENTED, PLAIN)).alias("surname"), match_text(F.translate(given, ACCENTED, PLAIN)).alias("given"))
