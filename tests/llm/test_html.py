"""Whole articles of the test pages against a plain reading of their markup, and hand-written pages."""

import html
import re

from quire.llm import html_extract as hx

PROSE = "It was the best of times and it was the worst of times, for all of us who had been there with them, and so we went on to the end of it. " * 2


def by_hand(page):
    """The blocks of these pages' one article: a heading and paragraphs, some of them unclosed."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner))]
    return "\n".join(b for b in blocks if b)


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r for r in hx.extract_pages(pages).collect()}
    for row in pages.collect():
        assert found[row.page_id].text == by_hand(row.html)
        assert found[row.page_id].url == row.url and found[row.page_id].n_chars == len(found[row.page_id].text)


def test_edges(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (2, None, "", 2), (None, "v", "<p>x", 3), (4, "w", "<article><p>" + "word " * 100_000, 4), (5, "x", "a < b <p", 5), (6, "y", "<!-- never closed", 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    found = sorted(hx.extract_pages(pages).collect(), key=lambda r: r.page_id or 0)
    assert [r.text for r in found[1:4]] == ["", "", ""] and found[4].n_chars == 499_999
    assert hx.extract_pages(pages.limit(0)).count() == 0


def test_boilerplate_inside_and_outside():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="no-sidebar"><header><h1>Site</h1></header>
    <div class="menu"><p>{PROSE}</p></div><div id="cookie-notice"><p>{PROSE}</p></div>
    <article><h2>Title &amp; more</h2><p>{PROSE}</p><p>Short.</p><div class="ad"><p>{PROSE}</p></div>
    <ul><li><a href="/1">one link here</a></li><li>Share:</li><li><a href="/2">two</a></li></ul>
    <p>Last<br>line.</p><section id="comments"><article class="comment"><p>{PROSE}</p></article></section></article>
    <aside><p>{PROSE}</p></aside><form><p>{PROSE}</p></form><footer>&copy; Site<p>{PROSE}</p></footer></body></html>"""
    assert hx.main_text(page) == "\n".join(["Title & more", PROSE.strip(), "Short.", "Last line."])


def test_without_article():
    links = "<ul>" + '<li><a href="/x">Some section</a></li>' * 5 + "</ul>"
    page = f"<body>{links}<div><h1>The title</h1><p>{PROSE}</p><p>Then.</p><p>{PROSE}</p></div><p>All rights reserved</p>{links}</body>"
    assert hx.main_text(page) == "\n".join(["The title", PROSE.strip(), "Then.", PROSE.strip()])


def test_second_pass_inherits():
    assert hx.second_pass(["bad", "short", "good", "short", "short", "bad"], [False] * 6, [False] * 6) == [False, False, True, True, False, False]
    assert hx.second_pass(["bad", "short", "good"], [False] * 3, [False, True, False]) == [False, True, True]
    assert hx.second_pass(["bad", "short", "bad", "near"], [True] * 4, [False] * 4) == [False, False, False, True]


FOREIGN = {
    "ru": "Утром рыбаки вышли в море и долго искали косяк у северного берега, где вода ещё не успела прогреться после зимы. Никто не ждал такой удачи. ",
    "it": "La mattina i pescatori presero il largo e cercarono a lungo il banco presso la riva, dove l'acqua non era ancora tiepida dopo l'inverno. Nessuno sperava tanto. ",
    "zh": "清晨渔民出海,在北岸附近寻找鱼群,那里的水在冬天之后还没有变暖。谁也没有想到会有这样的好运气,大家都很高兴,一直忙到天黑才回家。",
    "ja": "朝早く漁師たちは海に出て、冬のあとでまだ水が温まっていない北の岸の近くで長いあいだ魚の群れを探した。誰もこれほどの幸運を期待していなかった。",
    "pl": "Rankiem rybacy wyruszyli w morze i szukali ławicy przy północnym brzegu, gdzie woda jeszcze nie zdążyła się ogrzać po zimie. Nikt nie liczył na takie szczęście. ",
    "fi": "Aamulla kalastajat lähtivät merelle ja etsivät parvea pohjoisrannalta, jossa vesi ei ollut vielä lämmennyt talven jälkeen. Kukaan ei odottanut sellaista onnea. ",
    "de": "Am Morgen fuhren die Fischer auf das Meer und suchten lange nach dem Schwarm an der Küste, wo das Wasser nach dem Winter noch nicht warm war. Es war ein Glück. ",
    "es": "Por la mañana los pescadores salieron al mar y buscaron el banco en la costa, donde el agua no se había calentado todavía con el sol de la primavera. ",
}


def test_languages_without_article():
    links = "<ul>" + '<li><a href="/x">nav nav</a></li>' * 5 + "</ul>"
    for text in FOREIGN.values():
        page = f"<body>{links}<div><p>{text * 2}</p><p>{text * 2}</p></div>{links}</body>"
        assert hx.main_text(page) == "\n".join([(text * 2).strip()] * 2)


def test_linked_blocks_of_the_article():
    page = f'<article><h2><a href="/t">The title</a></h2><p>{PROSE}</p><p><a href="/s">A whole paragraph that is a link to its source.</a></p><p>{PROSE}</p><p><a href="/m">Read more</a></p></article>'
    assert hx.main_text(page) == "\n".join(["The title", PROSE.strip(), "A whole paragraph that is a link to its source.", PROSE.strip()])


def test_small_marked_pieces():
    card = '<article class="card"><h3><a href="/c">Another one</a></h3><p>Few words.</p></article>'
    body = f"<p>{PROSE}</p>" * 3
    want = "\n".join([PROSE.strip()] * 3)
    assert hx.main_text(f'<body><div id="content">{body}</div><div>{card}</div></body>') == want
    assert hx.main_text(f"<body><article>{body}</article>{card}</body>") == want
    assert hx.main_text(f"<body><article>{body}</article><article>{body}</article></body>") == want + "\n" + want


def test_names_with_a_telling_part():
    inner = "".join(f'<div class="{n}"><p>{PROSE}</p></div>' for n in ("share-price", "social-science", "comment-worthy essay", "ad-hoc"))
    gone = "".join(f'<div class="{n}"><p>{PROSE}</p></div>' for n in ("share-bar", "site-footer", "cookie-notice", "ad ad-300", "relatedPosts"))
    assert hx.main_text(f"<article>{inner}{gone}</article>") == "\n".join([PROSE.strip()] * 4)
