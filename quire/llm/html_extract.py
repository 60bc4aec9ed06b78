"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone: link density, length and
stop-word density make it good or bad or leave it undecided. The second pass gives undecided blocks the label of their
nearest decided neighbours. Markup tells what the densities can't: navigation, footers, asides, forms and elements whose
class, id or role names such a thing are never text, and where a page marks its article, blocks elsewhere are bad and
undecided ones inside are the article's unless their neighbours on both sides are bad. What a page marks as an article
is one by its share of the text: small marked pieces beside a long one, or beside long prose without a mark, are blocks
like all others. Where a page's language is none of the known ones, length and link density decide alone.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Characters: shorter blocks are undecided, longer ones with many stop words are good.
SHORT, LONG = 70, 200
#: Shares of words that are stop words, and of characters inside links.
STOP_LOW, STOP_HIGH, MOST_LINKED = 0.2, 0.3, 0.5
#: A marked article with a smaller share of text than this of the largest one is no article.
SMALL = 0.25

STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its "
    "just like more my no not of on one only or other our out she so some than that the their them then there these they this to up us was we were what "
    "when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas pour qu que qui sa se ses son sont "
    "sur un une vous "
    "aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch "
    "oder sein sich sie sind so und von vor war was wie wir wird zu zum zur "
    "al como con del el ella ellos era eran es esta este fue ha hay las lo los más me mi muy nos o para pero por sin sobre su sus también te ti tu y ya yo".split()
)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside an article such a block may be one link.
PROSE_TAGS = HEADINGS | {"p", "blockquote", "figcaption", "pre"}
#: Elements whose content is no text of a page.
NO_TEXT = "script|style|noscript|template|textarea|iframe|svg|math|canvas|object|audio|video|title|select|datalist"
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button search label".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())
#: Parts of class names and ids.
BOILERPLATE_NAMES = frozenset(
    "ad ads adbox adsense advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright "
    "disclaimer disqus discussion footer footnav form gdpr legal login masthead menu modal nav navbar navigation navlist newsletter notice notification overlay pager "
    "pagination popup promo promoted promotion recommended recommendations related replies reply respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription tagcloud teaser toolbar topbar widget".split()
)
#: Parts that say nothing: a name is boilerplate if it has a part from above and all others are from here or numbers.
NEUTRAL_NAMES = frozenset(
    "area article articles bar blog block body bottom box btn button buttons col column container content entry global group holder icons inner item items left link links list main "
    "module news outer page panel post posts primary right row secondary section site slot stories strip text top unit view wp wrap wrapper".split()
)
#: Such names are boilerplate outside an article only.
HEADER_NAMES = frozenset("header head sitehead siteheader".split())
PHRASE = re.compile(r"©|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bterms of (?:use|service)\b|\bsubscribe\b|\bsign (?:up|in)\b|\blog ?in\b|\badvertisement\b|\bread more\b|\bshare (?:this|on)\b", re.I)

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{NO_TEXT})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NOT_THERE = re.compile(r"\b(?:no|has|with|without|hide|is)[-_]\w+", re.I)
PART = re.compile(r"[a-z]+|\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def is_boilerplate(tag: str, rest: str, in_article: bool) -> bool:
    """Whether an element's tag, role, class, id or visibility says that it holds no main text."""
    if tag in BOILERPLATE_TAGS or (tag == "header" and not in_article):
        return True
    if not rest.strip():
        return False
    found = {a.lower(): (v or "").strip("\"'") for a, v in ATTRIBUTE.findall(rest)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if found.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    wanted = BOILERPLATE_NAMES if in_article else BOILERPLATE_NAMES | HEADER_NAMES
    for name in NOT_THERE.sub("", f"{found.get('class', '')} {found.get('id', '')}").split():
        parts = {p for p in PART.findall(CAMEL.sub("-", name).lower()) if not p.isdigit()}
        if not parts.isdisjoint(wanted) and parts <= wanted | NEUTRAL_NAMES:
            return True
    return False


class Block(NamedTuple):
    """Text, link density, the number of the marked article around it (0: none), and the tag that opened it."""

    text: str
    linked: float
    article: int
    tag: str


def blocks_of(page: str) -> list[Block]:
    """The blocks that are not inside boilerplate markup."""
    found: list[tuple[list[str], list[str], int, str]] = []
    now: tuple[list[str], list[str], int, str] = ([], [], 0, "")
    article, link, number = 0, 0, 0
    skip, depth = "", 0
    at = 0

    def put(raw: str) -> None:
        if not skip and raw:
            now[0].append(raw)
            if link:
                now[1].append(raw)

    for m in TOKEN.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                put(" ")
            continue
        end, rest = bool(m["end"]), m["rest"]
        if skip:
            if tag == skip and not rest.rstrip().endswith("/"):
                depth += -1 if end else 1
                if depth == 0:
                    skip = ""
                continue
            if skip in ("nav", "menu", "header") and not end and tag in ("article", "main"):
                skip = ""  # it was never closed
            elif skip not in ("body", "html") and end and tag in ("article", "main", "body") and article:
                skip = ""  # the article ends, whatever it left open
            else:
                continue
        if tag == "a":
            link = 0 if end else 1
        elif tag == "br":
            put(" ")
        if tag in BLOCK_TAGS:
            found.append(now)
            link = 0 if not end and tag != "a" and link and tag in ("article", "main", "section", "body") else link
            if tag in ("article", "main"):
                number += not end and article == 0
                article = max(0, article - 1) if end else article + 1
            now = ([], [], number if article else 0, "" if end else tag)
        if not end and tag not in ("br", "hr", "img", "input", "meta", "link") and is_boilerplate(tag, rest, article > 0 and tag != "article"):
            if tag == "article":
                article -= 1
            if not rest.rstrip().endswith("/"):
                skip, depth = tag, 1
                if tag not in BLOCK_TAGS:
                    found.append(now)
                    now = ([], [], number if article else 0, "")
    put(page[at:])
    found.append(now)
    out = []
    for parts, in_links, of, tag in found:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, len(" ".join(entities.unescape("".join(in_links)).split())) / len(text), of, tag))
    return out


def weight(text: str) -> int:
    """Length as if written in letters: a character of a script without spaces counts as three."""
    return len(text) + 2 * sum(c >= "\u2e80" for c in text) if not text.isascii() else len(text)


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(1, len(words))


def is_known(blocks: list[Block]) -> bool:
    """Whether the stop words say anything of a page's prose: one of its long blocks has many, or it has no long ones."""
    long = [b.text for b in blocks if b.linked <= MOST_LINKED and weight(b.text) >= LONG]
    return not long or any(stop_share(t) >= STOP_HIGH for t in long)


def articles_of(blocks: list[Block], known: bool) -> set[int]:
    """The numbers of marked articles that hold the page's text: none smaller than SMALL of the largest one or of the prose outside."""
    size: dict[int, int] = {}
    outside = 0
    for b in blocks:
        plain = round(weight(b.text) * (1 - b.linked))
        if b.article:
            size[b.article] = size.get(b.article, 0) + plain
        elif first_pass(b, False, False, known) in ("good", "near"):
            outside += plain
    most = max([outside, *size.values()])
    return {n for n, s in size.items() if s >= SMALL * most and s > 0}


def first_pass(b: Block, inside: bool, marked: bool, known: bool = True) -> str:
    """good, bad, near (undecided, looks like prose) or short (undecided)."""
    long = weight(b.text)
    if marked and not inside:
        return "bad"
    if b.linked > MOST_LINKED and not (inside and b.tag in PROSE_TAGS and not PHRASE.search(b.text)):
        return "bad"
    if not inside and long < LONG and PHRASE.search(b.text):
        return "bad"
    if long < SHORT:
        return "short"
    if not known:
        return "good" if long >= LONG else "near"
    stops = stop_share(b.text)
    if stops >= STOP_HIGH:
        return "good" if long >= LONG else "near"
    if stops >= STOP_LOW or inside:
        return "near"
    return "bad"


def second_pass(labels: list[str], article: list[bool], heading: list[bool]) -> list[bool]:
    """Labels of undecided blocks from their nearest decided neighbours."""
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if labels[i - 1] in ("good", "bad") else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if labels[i + 1] in ("good", "bad") else after[i + 1]
    out = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        left = labels[before[i]] if before[i] >= 0 and article[before[i]] == article[i] else ""
        right = labels[after[i]] if after[i] < n and article[after[i]] == article[i] else ""
        if article[i]:
            out.append(not (left == right == "bad"))
        elif label == "near":
            out.append("good" in (left, right))
        elif heading[i]:
            out.append(right == "good")
        elif left and right and left != right:
            near_left, near_right = i - before[i], after[i] - i
            out.append((left if near_left < near_right else right if near_right < near_left else "bad") == "good")
        else:
            out.append("good" in (left, right) and "bad" not in (left, right))
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    known = is_known(blocks)
    articles = articles_of(blocks, known) if any(b.article for b in blocks) else set()
    inside = [b.article in articles for b in blocks]
    labels = [first_pass(b, i, bool(articles), known) for b, i in zip(blocks, inside, strict=True)]
    keep = second_pass(labels, inside, [b.tag in HEADINGS for b in blocks])
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [main_text(h.as_py()) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    Null, empty and text-less pages give an empty text; ids and urls pass through, null or repeated; pages are read
    whole, however long; other columns of the input play no part; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLE: dict[str, str] = {}
