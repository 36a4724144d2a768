"""Language ID, licence scans, HTML extraction, decontamination and toxicity: held-out accuracy and brute force."""

import random
import re
import zlib

import numpy as np
import pytest

from skein.llm import decontaminate, html_extract, language_id, license_scan, toxicity
from skein.llm.common import read_table

SMALL = "/root/testdata/sf0.01"


def test_language_of_small_corpus(spark):
    docs = read_table(spark, SMALL, "documents")
    records = language_id.document_records(docs).unionByName(language_id.page_records(read_table(spark, SMALL, "pages")))
    model = language_id.fit_text(language_id.document_records(docs), rows=300)
    found = language_id.identify(records, model).collect()
    assert len(found) == docs.count() + read_table(spark, SMALL, "pages").count()
    assert np.mean([r.id_lang == r.id_declared for r in found]) > 0.99 and all(r.id_accepted for r in found)


def test_language_evidence(spark):
    train = [(i, t, lang, src) for i, (t, lang, src) in enumerate([("the house and the garden", "en", "a")] * 40 + [("das haus und der garten", "de", "b")] * 40)]
    odd = [(None, "the garden", None, None), (900, None, "en", "a"), (901, "", "en", "a"), (902, "12 34 !!", "en", "a"), (903, "house", "de", "a"), (904, "漢字漢字漢字漢字", "en", "a"), (905, "haus " * 5000, None, "q"), (905, "haus " * 5000, None, "q")]
    docs = spark.createDataFrame([(*r, 1) for r in train + odd], "doc_id long, text string, lang string, source string, declared int")
    model = language_id.fit_text(language_id.document_records(docs.where("doc_id < 100")))
    found = {r.doc_id: r for r in language_id.identify(language_id.document_records(docs), model).collect()}
    assert found[None].id_lang == "en" and found[0].id_lang == "en" and found[79].id_lang == "de" and found[905].id_lang == "de"
    assert not any(found[i].id_accepted for i in (900, 901, 902, 904)) and found[903].id_text_lang == "en"
    kept = language_id.keep_identified(docs)  # fitted on these rows, the last but one's included
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert language_id.keep_identified(docs.limit(0)).count() == 0


def test_addresses_and_markup():
    assert language_id.address_parts("http://blog.Tion.example.com:80/en/214#top") == ("blog.tion.example.com", "example.com", "com/en")
    assert language_id.address_parts("https://de.example.org/x?y") == ("de.example.org", "example.org", "org/de")
    assert language_id.address_parts(None) == language_id.address_parts("not an address") == (None, None, None)
    assert language_id.declared_in_markup("<!DOCTYPE html><html class=x lang='FR-ca'>") == "fr" and language_id.declared_in_markup(None) is None


def test_priors_decide_only_without_text(spark):
    """The host's share moves a doubtful text, not a clear one."""
    rows = [(i, "the house and the garden", "en", "h") for i in range(50)] + [(100 + i, "das haus und der garten", "de", "g") for i in range(50)] + [(200, "haus", None, "h"), (201, "das haus und der garten", None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    records = language_id.document_records(docs)
    found = {r.doc_id: r for r in language_id.identify(records, language_id.fit_text(records)).collect()}
    assert found[201].id_lang == "de" and found[201].id_posterior > found[200].id_posterior


def test_licences(spark):
    prose = [r.text for r in read_table(spark, SMALL, "documents").limit(150).collect()]
    model = license_scan.fit([p for t in prose for p in license_scan.paragraphs(t)][:1500])
    rows = [(1, "Some prose here.\nLicensed under the Apache License, Version 2.0.\nMore of it."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0."), (4, "Released under the MIT License.\n\nAll rights reserved."), (5, "He had a driving license and an Apache helicopter."), (6, None), (7, ""), (None, "Released under the MIT License."), (1, "x"), (8, "license " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS families")
    found = license_scan.scan(docs, model).collect()
    by = {(r.doc_id, r.n_paragraphs): r for r in found}
    assert len(found) == len(rows)
    assert [by[k].families for k in ((1, 3), (2, 1), (3, 1), (4, 2), (5, 1), (6, 0), (7, 0), (None, 1), (1, 1), (8, 1))] == [["apache-2.0"], ["gpl"], ["cc-by-nc"], ["mit", "proprietary"], [], [], [], ["mit"], [], []]
    assert by[1, 3].paragraphs == [1]
    assert license_scan.scan(docs.limit(0), model).count() == 0
    # Wrapped lines of a long text are one paragraph.
    wrapped = license_scan.TEMPLATES["mit"][2].replace(", to ", ",\nto ").replace("and to", "\nand to")
    assert len(license_scan.paragraphs(wrapped)) == 1


def test_licence_fit_from_a_table(spark):
    docs = read_table(spark, SMALL, "documents")
    found = license_scan.scan(docs, license_scan.fit_on(docs, rows=400)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    notices = {"gpl": "under the GNU General Public License", "proprietary": "All rights reserved.", "cc-by-nc": "under CC BY-NC 4.0", "mit": "under the MIT License", "apache-2.0": "under the Apache License, Version 2.0"}
    want = {i: sorted(f for f, notice in notices.items() if notice in (t or "")) for i, t in texts.items()}
    assert {r.doc_id: r.families for r in found} == want and len({f for fs in want.values() for f in fs}) == 5


def test_licence_confirmation_needs_more_than_a_word_or_two():
    template = license_scan.pairs(license_scan.words_of(license_scan.TEMPLATES["mit"][2]))
    like = lambda text: license_scan._like(license_scan.pairs(license_scan.words_of(text)), template)
    assert like("free of") == like("the") == 0 and like("Permission is hereby granted, free of charge.") == 1
    whole = license_scan.pairs(license_scan.words_of("All rights reserved."))
    assert license_scan._like(whole, whole) == 1  # a template of two pairs counts when it is there as a whole


def test_licence_fit_sample_is_cut_on_the_executors(spark, monkeypatch):
    """The driver gets pieces of FIT_WORDS words, each different text once, however long or frequent the texts are."""
    seen = []
    monkeypatch.setattr(license_scan, "fit", lambda corpus: seen.append(corpus))
    long = " ".join(f"w{i}" for i in range(1_000))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["same text here."] * 50 + [long, None, "", "one.\n\ntwo."])], "doc_id long, text string")
    license_scan.fit_on(docs, rows=100)
    assert sorted(len(p.split(" ")) for p in seen[0]) == [1, 1, 3, 200, 400, 400]
    license_scan.fit_on(docs.limit(0))
    assert seen[1] == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>Head &amp; line</h1><p>One <b>bold</b>word&nbsp;here.<br>Next<p>Unclosed <a href=x>link text</a> stays
in.</p><div class="ad">Buy now</div><form>Name <input></form><ul><li>a<li>b</ul><!-- no --><section id="comments"><p>A reader's comment that is quite long, longer than the article.</p></section></article></main>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def test_html_cases(spark):
    cases = {
        1: (PAGE, "Head & line One boldword here. Next Unclosed link text stays in. a b"),
        2: (None, ""),
        3: ("", ""),
        4: ("plain &lt;text&gt; only", "plain <text> only"),
        5: ("<nav>only <a>a menu</a></nav>", ""),
        6: ("<body><div id=top><a>Home</a> <a>About</a></div><div><p>A paragraph of some length that readers came for, with words.</p><p>Short.</p><p>And a second paragraph that also has a good number of words.</p></div></body>", "A paragraph of some length that readers came for, with words. Short. And a second paragraph that also has a good number of words."),
        8: ("<div class='layout-sidebar'><article><p>Framed text of the article.</p></article></div>", "Framed text of the article."),
        9: ("<div class=with-sidebar><main><p>Framed text of the page.</p><section class=comments><article class=comment><p>A reader says a lot of things here, at length.</p></article></section></main></div>", "Framed text of the page."),
        7: ("<p>" + "word " * 20_000 + "</p>", ("word " * 20_000).strip()),
    }
    rows = [(i, f"u{i}", h, 0) for i, (h, _) in cases.items()] + [(None, None, PAGE, 0), (1, "u1", PAGE, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    found = html_extract.extract(pages).collect()
    assert len(found) == len(rows) and all(r.text == cases[r.page_id or 1][1] and r.n_chars == len(r.text) for r in found)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_of_small_corpus(spark):
    from html import unescape

    pages = read_table(spark, SMALL, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        assert r.text == " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())


def plain_alignment(item, passage):
    """The full table, without tricks."""
    table = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table))


def test_alignment():
    rng = random.Random(0)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 25))] for _ in range(2))
        score, start, end = decontaminate.align(np.array(a), np.array(b))
        assert score == plain_alignment(a, b) and 0 <= start <= end <= len(b)


@pytest.mark.parametrize("broadcast_bytes", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination(spark, broadcast_bytes):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 30)))) for i in range(20)] + [(90, "too short"), (91, None), (0, "the same id with another text of many words")]
    docs = []
    for k in range(60):
        words = [word() for _ in range(rng.randint(0, 120))]
        if k % 3 == 0:
            copy = items[rng.randrange(20)][1].upper().split()
            for _ in range(len(copy) // 6):
                copy[rng.randrange(len(copy))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = copy
        docs.append((k, " ".join(words)))
    docs += [(200, None), (201, ""), (None, items[3][1]), (7, docs[7][1]), (202, (items[5][1] + " filler, ") * 300)]
    t, b = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(t, b, broadcast_bytes=broadcast_bytes).collect()}
    want = {}
    for i, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for j, item in items:
            own = re.findall(r"\w+", (item or "").lower())
            grams = lambda w: {tuple(w[n : n + 3]) for n in range(len(w) - 2)}
            if len(own) >= 3 and grams(own) & grams(words) and (score := plain_alignment(own, words[: 400]) / (2 * len(own))) >= decontaminate.THRESHOLD:
                want[i, j] = max(score, want.get((i, j), 0))
    assert len(want) > 15 and {k: round(r.score, 9) for k, r in found.items()} == {k: round(v, 9) for k, v in want.items()}
    kept = decontaminate.keep_clean(t, b)
    dirty = {i for i, _ in want}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in docs if i not in dirty) and kept.columns == t.columns
    for empty in ((t.limit(0), b), (t, b.limit(0))):
        assert decontaminate.contaminated(*empty, broadcast_bytes=broadcast_bytes).count() == 0


def plain_segments(scores):
    """Ruzzo and Tompa's definition by recursion: the best segment, then those to its left and right."""
    if not any(s > 0 for s in scores):
        return []
    best = max((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
    a, b = best[3], best[4]
    return plain_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in plain_segments(scores[b:])]


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(150):
        scores = [rng.choice((-5, -3, -2.25, 1.5, 2, 4.125)) + rng.random() / 100 for _ in range(rng.randint(0, 25))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(scores))] == plain_segments(scores)


def test_toxicity_held_out(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.1", "documents"), read_table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(r.toxic, scored[r.doc_id] >= 0.7) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    caught = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert len(caught) > 30 and np.mean(caught) > 0.9 and np.mean(clean) < 0.01


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "word", 1), (3, "word", 1), (3, "word", 1), (4, "bad " * 30_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 5)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.fit(docs, known)
        found = toxicity.score(docs, model).collect()
        assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
