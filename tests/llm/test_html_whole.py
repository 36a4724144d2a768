"""Nothing of the main text is left out."""

from skein.llm import html_extract


def words(n, c="word "):
    return (c * (n // len(c) + 1))[:n].strip()


def test_pages_keep_all_dense_text():
    short, long = words(300, "lead "), words(5000)
    assert html_extract.main_text(f"<div><div><p>{short}</p></div><div><p>{long}</p></div></div>")[0] == f"{short} {long}"
    sections = f"<body><nav><a href=/>Home</a></nav><div><section><h2>One</h2><p>{short}</p></section><section><p>{long}</p></section></div></body>"
    assert html_extract.main_text(sections)[0] == f"One {short} {long}"


def test_main_keeps_all_articles():
    short, long = words(300, "lead "), words(5000)
    articles = f"<article><p>{short}</p></article><article><p>{long}</p></article><article>End.</article>"
    for page in (f"<main>{articles}</main>", f"<body>{articles}</body>"):
        assert html_extract.main_text(page)[0] == f"{short} {long} End."
    framed = f"<main><div>Path</div><article><p>{long}</p><p>{long}</p></article></main>"
    assert html_extract.main_text(framed)[0] in (f"{long} {long}", f"Path {long} {long}")
