import pytest

from folio.llm import html

TEXT = "A sentence of the article, with some words in it. " * 6
PAGE = f"<h1>Title</h1><p>{TEXT}</p><p>{TEXT}</p>"
WANT = " ".join(["Title", *TEXT.split(), *TEXT.split()])


@pytest.mark.parametrize("start, end", [
    ("<div class='content has-sidebar'>", "</div>"), ("<div class='content-sidebar-wrap'>", "</div>"), ("<article class='post related-posts-on'>", "</article>"),
    ("<form action=x>", "</form>"), ("<form><article>", "</article></form>"), ("<div role=form>", "</div>"), ("<div class=overlay><form>", "</form></div>"),
])
def test_names_dont_cut_the_article(start, end):
    assert html.main_text(f"<body><div class='cookie-notice'>We use</div>{start}{PAGE}{end}<div class=related><a href=1>other</a></div></body>") == WANT


def test_parts_of_one_name_are_judged_together():
    page = "".join(f"<div class='elementor-widget-container'><p>{TEXT}</p></div>" for _ in range(5))
    assert html.main_text(f"<body><div class=share>share it</div>{page}</body>") == " ".join(TEXT.split() * 5)


def test_hidden_is_an_attribute():
    assert html.main_text("<body><p title='his hidden role'>a</p><p data-x=\"y hidden\">b</p><p hidden>c</p><p id=x hidden=''>d</p></body>") == "a b"


def test_boilerplate_still_goes():
    related = "<div class=related><article><a href=1>another one</a></article></div>"
    assert html.main_text(f"<body><div class='page has-sidebar'><article>{PAGE}<form>f</form></article>{related}<div class=comments><article class=comment>no</article></div></div></body>") == WANT
    assert html.main_text("<body><div class=notice>only this</div></body>") == "only this"
