"""URL functions: identifiers, media types, kinds and ranks of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and the media types they stand for, in the order in which they are tried.
TEXT_TYPES = (
    ((".txt.utf-8", ".txt.us-ascii", ".txt"), "text/plain"),
    ((".html.utf-8", ".htm.utf-8"), "text/html; charset=utf-8"),
    ((".html.us-ascii", ".htm.us-ascii"), "text/html; charset=us-ascii"),
    ((".html", ".htm", ".xhtml"), "text/html"),
    ((".tei.utf-8", ".tei"), "application/prs.tei"),
    ((".tex",), "application/prs.tex"),
    ((".epub", ".epub.noimages", ".epub.images"), "application/epub+zip"),
    ((".zip",), "application/octet-stream"),
    ((".pdf",), "application/pdf"),
    ((".mp3",), "audio/mpeg"),
    ((".ogg",), "audio/ogg"),
    ((".m4a", ".mp4"), "audio/mp4"),
    ((".mid", ".midi"), "audio/midi"),
    ((".wav",), "audio/x-wav"),
    ((".wma",), "audio/x-ms-wma"),
    ((".mpeg", ".mpg"), "video/mpeg"),
    ((".avi",), "video/x-msvideo"),
    ((".mov",), "video/quicktime"),
    ((".flv",), "video/x-flv"),
)
AUDIO_PACKAGE = r"(?i)-(mp3|m4b|ogg|midi?|wav|wma)\.zip$"
AUDIO_PRIORITY = ("audio/mpeg", "audio/mp4", "audio/ogg", "audio/x-wav", "audio/x-ms-wma", "audio/midi")
ILLUSTRATED_KINDS = (("h-zip", r"(?i)-h\.zip([?#].*)?$"), ("html.images", r"(?i)\.html?\.images([?#].*)?$"), ("epub3.images", r"(?i)\.epub3\.images([?#].*)?$"), ("epub.images", r"(?i)\.epub\.images([?#].*)?$"))


def linked_id(url: Column) -> Column:
    """The number after /ebooks/ or /files/."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/(?:ebooks|files)/(\d+)", 1), F.lit("")).cast("bigint")


def media_type(url: Column, table=TEXT_TYPES) -> Column:
    """The media type of a name's suffix; the first entry that fits wins."""
    low, out = F.lower(url), None
    for suffixes, kind in table:
        test = low.endswith(suffixes[0])
        for s in suffixes[1:]:
            test = test | low.endswith(s)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def audio_type(url: Column) -> Column:
    """As :func:`media_type` for audio only; packages count as unspecified bytes."""
    audio = tuple((s, k) for s, k in TEXT_TYPES if k.startswith("audio/"))
    return F.coalesce(media_type(url, audio), F.when(url.rlike(AUDIO_PACKAGE), "application/octet-stream"))


def is_audio_link(url: Column, kind: Column) -> Column:
    return F.coalesce(kind.startswith("audio/"), F.lit(False)) | (F.coalesce(kind == "application/octet-stream", F.lit(False)) & url.rlike(AUDIO_PACKAGE))


def is_media_type(kind: Column) -> Column:
    return F.coalesce(kind.startswith("audio/") | kind.startswith("video/"), F.lit(False))


def belongs_to(url: Column, identifier: Column) -> Column:
    """Whether a part of the path is the identifier, or starts with it as file names do."""
    i = identifier.cast("string")
    pattern = F.concat(F.lit("/("), i, F.lit("$|(pg)?"), i, F.lit("[.-]|"), i, F.lit("_|"), i, F.lit("/)"))
    return F.coalesce(F.rlike(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), pattern), F.lit(False))


def is_synthesized(url: Column) -> Column:
    """Machine-read audio lies below /<number>-m/."""
    return F.coalesce(url.rlike(r"(?i)/\d+-m/"), F.lit(False))


def is_live_content(url: Column) -> Column:
    """Whether a listed URL is a file of a known kind, and neither metadata nor a warning."""
    path = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    name = F.substring_index(path, "/", -1)
    kind = F.coalesce(media_type(name), audio_type(name))
    return (name != "") & ~name.startswith("readme_warning") & ~name.endswith(".nfo") & ~name.endswith(".rdf") & kind.isNotNull()


def base_of(url: Column) -> Column:
    return F.regexp_replace(url, "[^/]*$", "")


def track_number(url: Column, otherwise: Column) -> Column:
    """The digits before the suffix, else a given place."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"(\d+)\.[^./]+$", 1), F.lit("")).cast("bigint"), otherwise)


def illustrated_kind(url: Column) -> Column:
    out = None
    for name, pattern in ILLUSTRATED_KINDS:
        test = url.rlike(pattern) & (~F.lower(url).contains(".epub.noimages") if name == "epub.images" else F.lit(True))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def rank_in(value: Column, order: tuple[str, ...], last: int = 99) -> Column:
    out = None
    for i, v in enumerate(order):
        out = F.when(value == v, i) if out is None else out.when(value == v, i)
    return out.otherwise(last)


def host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z]+://([^/?#]+)", 1)


def best_article(text: Column) -> Column:
    """The best encyclopedia link in a text: English first, then the shortest, then by name."""
    links = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://[a-z]+\.wikipedia\.org/[^\s\"'<>)]+)"), F.lit(1))
    ranked = F.array_sort(F.transform(links, lambda u: F.struct(F.when(u.contains("//en."), 0).otherwise(1), F.length(u), u.alias("url"))))
    return F.when(F.size(ranked) > 0, F.element_at(ranked, 1)["url"])
