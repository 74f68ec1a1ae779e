"""An article's mark is one feature of a block among others."""

import collections
import re

import duckdb

from vitrine.llm import html

PROSE = "and so it was that the people of the town had to be there with all of their things and more of it " * 3
TEXT = " ".join(PROSE.split())


def test_cards_beside_the_main_text():
    cards = "".join(f"<article><h3><a href={i}>Read item {i}</a></h3><p>Item {i} costs nothing, {i} pages, new</p></article>" for i in range(4))
    page = f"<body><nav><a href=x>x</a></nav><div>{PROSE}</div><div>{PROSE}</div><section>{cards}</section><footer>f</footer>"
    assert html.main_text(page) == f"{TEXT}\n{TEXT}"


def test_links_inside_of_an_article():
    advert = "Bargain trousers, quality guaranteed, <a href=x>order online today, free delivery everywhere</a>, limited stock, hurry"
    assert html.main_text(f"<article><p>{PROSE}<p>{advert}<p>{PROSE}</article>") == f"{TEXT}\n{TEXT}"


def test_text_outside_of_an_article():
    page = f"<div>Accept all</div><article><p>Zweck ohne Wert.<p>{PROSE}<p>{PROSE}</article><p>{PROSE}<footer>f</footer>"
    assert html.main_text(page) == f"Zweck ohne Wert.\n{TEXT}\n{TEXT}\n{TEXT}"


def test_words_unknown_inside_of_an_article():
    prose = "lorem ipsum dolor amet " * 20
    page = f"<nav>x</nav><article><h1>Lorem</h1><p>{prose}<p>{prose}</article><footer>f</footer><p>{PROSE}"
    assert html.main_text(page).startswith(f"Lorem\n{prose.strip()}\n{prose.strip()}")


def test_pages_without_marks():
    """The fixture's pages, their articles' tags made plain: stop words, lengths, links and neighbours alone find the text."""
    found = lost = more = 0
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        wanted, got = (collections.Counter(html.main_text(x).split("\n")) for x in (page, re.sub(r"<(/?)article\b", r"<\1div", page)))
        found, lost, more = found + (wanted & got).total(), lost + (wanted - got).total(), more + (got - wanted).total()
    assert found >= 0.95 * (found + lost) and more <= 0.01 * found


def test_language_without_list():
    finnish = "Vanha satama hiljeni iltaisin, kun kalastajat vetivat veneensa rantaan ja sytyttivat pienet tulet kivien vieressa. Lapset juoksivat laiturilla ja laskivat ohi lipuvia pilvia. " * 2
    text = " ".join(finnish.split())
    page = f"<body><div><a href=a>Etusivu</a> <a href=b>Uutiset</a></div><div><h2>Satama</h2><p>{finnish}</p><p>Ilta tuli.</p><p>{finnish}</p></div><div><a href=c>Tietoa meista ja ehdot</a></div>"
    assert html.main_text(page) == f"Satama\n{text}\nIlta tuli.\n{text}"
