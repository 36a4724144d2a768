"""Noise inside articles, frames around them, broken and deep markup."""

import random
import time

import numpy as np
import pytest

from skein.llm import html_extract

P = "<p>" + "Plain words of the article go on and on here. " * 6 + "</p>"
TEXT = " ".join(("Plain words of the article go on and on here. " * 6).split())
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Another story {i}</a></li>" for i in range(9)) + "</ul>"


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<article><h1>Head</h1>{P}{P}{LINKS}</article>", f"Head {TEXT} {TEXT}"),
        (f"<article>{P}<div class=related-work><p>See <a href=/x>there</a> more</p></div>{LINKS}</article>", TEXT),
        (f"<article>{P}<div class='related-work'>{P}</div>{P}</article>", f"{TEXT} {TEXT} {TEXT}"),
        (f"<article class='notice-board'>{P}</article><p>stray</p>", TEXT),
        (f"<p>stray</p><div class='share'><article>{P}</article></div>", TEXT),
        (f"<body><form action=x><div><article>{P}</article><input></div></form>", TEXT),
        (f"<body><form><div>{P}{P}</div></form>", f"{TEXT} {TEXT}"),
        (f"<article>{P}<form><p>Your name</p></form><div class='user-comments'>{P}</div></article>", TEXT),
        (f"<article>{P}</article><div class=comments><article class=comment>{P}</article></div>", TEXT),
        (f"<article>{P}<p>One <a href=/>link</a> in a short line.</p></article>", f"{TEXT} One link in a short line."),
        (f"<![foo[x]]><![if IE]><article>{P}</article><![CDATA[x", TEXT),
    ],
)
def test_cases(html, want):
    assert html_extract.main_text(html)[0] == want


def test_ratios_smoothing_and_clusters_decide(monkeypatch):
    page = f"<article><h1>Head</h1>{P}{P}{LINKS}<div class=related-work><p>{'<i>a</i> ' * 5}</p></div>{P}</article>"
    found = html_extract.main_text(page)[0]
    assert "Another story" not in found
    monkeypatch.setattr(html_extract, "threshold", lambda values: -1.0)
    assert html_extract.main_text(page)[0] != found
    monkeypatch.undo()
    near = f"<article>{P}<p><a href=/r>The whole report</a></p>{P}</article>"  # a link between dense lines stays by smoothing
    assert html_extract.main_text(near)[0] == f"{TEXT} The whole report {TEXT}"
    monkeypatch.setattr(html_extract, "smooth", lambda ratios: ratios)
    assert "report" not in html_extract.main_text(near)[0]


def test_broken_markup_never_raises():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class='ad x'>", "</div>", "<![", "]]>", "<!", "<!--", "-->", "<!doctype", "&#99999999999;", "&am", "<a href='", "<script>", "</script>", "<li>", "<table><td>", "</td", "<", ">", "text ", "\0", "<form>", "<main>", "</article>", "<article>", "<?php", "\ud800", "<svg/>", "<title>", "é"]
    for _ in range(3000):
        text, n = html_extract.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))))
        assert isinstance(text, str) and n >= bool(text)


@pytest.mark.parametrize("unit", ["<div>x", "<p>x<span>", "<article>x", "<li>x<ul>", "<button><p>x", "<b>x</i>", "<section class=ad><main>x"])
def test_deep_pages_take_linear_time(unit):
    began = time.time()
    html_extract.main_text(unit * 20_000)
    assert time.time() - began < 6  # some 0.5 s on a common machine


def test_long_page(spark):
    page = "<html><body><nav>menu</nav><article>" + P * 20_000 + "</article></body></html>"
    rows = html_extract.extract(spark.createDataFrame([(1, "http://a.b/", page)], "page_id long, url string, html string")).collect()
    assert rows[0].n_chars == 20_000 * (len(TEXT) + 1) - 1 and np.char.count(rows[0].text, TEXT) == 20_000
