"""Pages that extraction has to read whole: long attributes, letters that change length in lower case, sections under different parents."""

from __future__ import annotations

import time

from palaver.llm.html_text import extract

P = "<p>A paragraph, with commas, and with length enough to count for something in the end {}.</p>"
T = "A paragraph, with commas, and with length enough to count for something in the end {}."


def test_long_attributes_end_where_their_quote_ends():
    assert extract(f'<article><p title="{"a>" * 30_000}">text</p></article>') == "text"
    assert extract("<article><p title='a>b' class=it's>one</p><p>two</p></article>") == "one\ntwo"
    assert extract('<article><p>one</p><p title="never closed>two</p><p>three</p></article>') == "one\ntwo\nthree"


def test_closing_tags_are_found_in_any_case():
    assert extract("<p>İ before</p><SCRIPT>if (a < b) '</p>'</SCRIPT><p>after</p>") == "İ before\nafter"
    assert extract("<p>a</p><script>x</scripty></SCRIPT ><p>b</p>") == "a\nb"
    assert extract("<p>a</p><style>p{}") == "a"


def test_sections_under_different_parents_stay():
    rows = "".join(f"<div class=row><div class=col>{P.format(k)}{P.format(-k)}</div></div>" for k in range(1, 4))
    want = "\n".join(T.format(x) for k in range(1, 4) for x in (k, -k))
    assert extract(f"<body><nav><a href=/>home</a></nav><div class=page>{rows}</div><footer>f</footer></body>") == want
    assert extract(f"<body>{rows}<div><a href=/a>one</a> <a href=/b>two</a></div></body>") == want


def test_time_grows_with_the_page():
    for page in ('<a "x> "' * 20_000, "<a title='" * 20_000 + ">", '<p a="' * 20_000, "<script>" * 20_000, "<SCRIPT>İ</SCRIPT>" * 20_000, "<!--" * 20_000, "<p title=" + " " * 100_000 + '"x">'):
        began = time.perf_counter()
        extract(page)
        assert time.perf_counter() - began < 5
