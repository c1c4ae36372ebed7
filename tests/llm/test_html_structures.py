"""Page structures: names of layouts, pages without an article, adverts, comments, and what the tree asks."""

import pytest

from millrace.llm import html_text

BODY = "These are words of the main text that go on for a while. " * 5
P = f"<p>{BODY}</p>"
TEXT = BODY.strip()
NAV = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport today</a></li></ul>"


def text(page):
    return html_text.main_text(page, html_text.grown_tree())


@pytest.mark.parametrize("name", ["content sidebar-left", "sidebar", "page-with-sidebar", "modal", "search-page", "widget", "adBox_1", "comment"])
@pytest.mark.parametrize("inner", [P + P, f"<h1>The headline</h1>{P}<p>Short one.</p>{P}", f"<article>{P}</article>"])
def test_layout_names_never_empty_a_page(name, inner):
    page = f"<body><nav>{NAV}</nav><div class='{name}'>{inner}</div><footer>Made by us</footer></body>"
    assert text(page) == text(page.replace(f" class='{name}'", "")) != ""
    assert TEXT in text(page)


def test_form_around_the_page():
    assert text(f"<body><form id=aspnetForm><nav>{NAV}</nav><h1>Head</h1>{P}{P}<div class=footer>Us</div></form></body>") == f"Head {TEXT} {TEXT}"


def test_pages_without_an_article():
    assert text(f"<body>{NAV}<h1>Headline of it</h1><p>By someone.</p>{P}{P}{P}<p>It ended.</p></body>") == f"Headline of it By someone. {TEXT} {TEXT} {TEXT} It ended."
    assert text(f"<body>{NAV}<h1>Head</h1>{P}<p>Quite so.</p><p>It ended.</p>{NAV}</body>").startswith(f"Head {TEXT} Quite so.")
    assert text("<body><p>One short paragraph.</p></body>") == "One short paragraph."
    assert text("Plain text without tags &amp; all.") == "Plain text without tags & all."
    assert text(f"<body>{NAV}</body>") == ""


@pytest.mark.parametrize("beside", ["<div class='adBox_1'>Buy it now</div>", "<ins class='adsbygoogle'>Buy it now</ins>", "<div id='AdSlot3'>Buy it now</div>", "<section class='discussion thread'>" + "<p>I think so too, and more.</p>" * 20 + "</section>",
                                    "<div class='user-comments'><h3>Comments</h3>" + P * 3 + "</div>", "<div class='cookie-notice'>We use cookies.</div>", "<div role=navigation>Up Down</div>"])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div id=post>{}</div>"])
def test_adverts_and_comments_go(beside, frame):
    inner = frame.format(f"<h1>Head</h1>{P}{beside}{P}")
    assert text(f"<body><nav>{NAV}</nav>{inner}<footer>Us</footer></body>") == f"Head {TEXT} {TEXT}"


def test_names_that_speak_of_the_topic_stay():
    for name in ("search-results-analysis", "comment-culture-essay", "menu-items-explained"):
        assert text(f"<body><nav>{NAV}</nav><article>{P}<div class='{name}'><p>Short.</p></div>{P}</article></body>") == f"{TEXT} Short. {TEXT}", name


def test_notices():
    assert text(f"<body><h1>Head</h1>{P}{P}<div>© 2020 The makers. All rights reserved.</div></body>") == f"Head {TEXT} {TEXT}"
    assert text(f"<article><h1>Head</h1>{P}<p>Copyright law is old.</p></article>") == f"Head {TEXT} Copyright law is old."


def used(node, out):
    if not isinstance(node, float):
        out.add(html_text.FEATURES[node[0]])
        used(node[2], out)
        used(node[3], out)
    return out


def test_the_tree_asks_the_neighbours():
    rows = html_text.labelled_rows()
    tree = html_text.grown_tree()
    asked = used(tree.root, set())
    assert {"links", "links_before", "links_after", "words"} <= asked and asked & {"words_before", "words_after"}, asked
    assert (tree.predict(rows[:, :-1]) == rows[:, -1]).mean() > 0.99
    # a label and a menu entry without a link, among links
    assert text(f"<body><div>Sections</div>{NAV}<div>More of it</div>{NAV}<h1>Head</h1>{P}{P}</body>") == f"Head {TEXT} {TEXT}"
