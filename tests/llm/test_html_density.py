import math
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from folio.llm import html

SF = "/root/testdata/sf0.001"
TEXT = " ".join(f"Sentence number {i} of this article is long enough, with some words." for i in range(8))


class Tree(HTMLParser):
    """A plain tree of the test tables' pages: (tag, children, texts); a p ends a p."""

    def __init__(self, page):
        super().__init__()
        self.root = ["body", [], []]
        self.path = [self.root]
        self.feed(page[page.index("<body>") + 6 :])
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div", "article", "footer", "ul", "h1"):
            self.path[-1][2].append("\n")
            while any(n[0] == "p" for n in self.path):
                self.path.pop()
        if tag == "br":
            self.path[-1][2].append("\n")
        elif tag != "b":
            node = [f"{tag} {dict(attrs).get('class', '')}".strip(), [], []]
            self.path[-1][1].append(node)
            self.path[-1][2].append(node)
            self.path.append(node)

    def handle_endtag(self, tag):
        if any(n[0].split()[0] == tag for n in self.path[1:]):
            while self.path.pop()[0].split()[0] != tag:
                pass
            self.path[-1][2].append("\n")

    def handle_data(self, data):
        self.path[-1][2].append(data)


def brute(page):
    root = Tree(page).root
    cut = lambda n: n[0] in ("nav", "footer", "div ad", "script", "style")
    nodes = lambda n: [n, *(x for c in n[1] if not cut(c) for x in nodes(c))]
    text = lambda n: "".join(x if isinstance(x, str) else "" if cut(x) else f"\n{text(x)}\n" for x in n[2])
    chars = lambda n: sum(len(" ".join(x.split())) for m in nodes(n) for x in m[2] if isinstance(x, str))
    share = 0 / max(1, chars(root))  # no links are left

    def density(n):
        c, t = chars(n), max(1, len(nodes(n)) - 1)
        return c / t * math.log(max(c * t, 1.0)) / max(math.log(math.log(share * c + math.e)), 1.0) if c else 0.0

    every = nodes(root)
    sums = [sum(density(c) for c in n[1] if not cut(c)) for n in every]
    best = every[max(range(len(every)), key=lambda i: (sums[i], -i))] if max(sums) else root
    taken = " ".join(text(best).split())
    assert best is root or density(root) <= density(best)
    return taken


def test_every_page_by_brute_force():
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    for page in pages:
        assert html.main_text(page["html"]) == brute(page["html"]), page["page_id"]
        masked = page["html"].replace("<article", "<section").replace("</article", "</section")
        if len(html.main_text(page["html"])) > 200:  # shorter than an advert, only the tag tells an article
            assert html.main_text(masked) == html.main_text(page["html"]), page["page_id"]


@pytest.mark.parametrize("around", ["<div class='content with-sidebar'><article>%s</article></div>", "<div class='post no-comments'>%s</div>", "<article class='post share-enabled'>%s</article>", "<form id='aspnetForm'>%s</form>"])
def test_names_are_no_veto(around):
    page = "<body><nav><a href=1>Home</a></nav>" + around % f"<h1>Title</h1><p>{TEXT}</p><p>{TEXT}</p>" + "<footer>f</footer></body>"
    assert html.main_text(page) == f"Title {TEXT} {TEXT}"


@pytest.mark.parametrize("page", ["<div>" * 8000 + "x</b>" * 8000, "<article>" * 8000 + "t", "<b>" * 8000 + "</i>" * 8000, "<a><b>" * 8000, "<span>" * 10000 + "<p>x" * 10000, "<dd><ul>" + "<b>" * 10000 + "<dt></dt>" * 10000, "<form class=ad>" * 5000 + "text", "<table><tr><td>" * 5000, "<p " * 20000, "<!--" * 20000, "&amp" * 20000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 3  # seconds, on a slow machine; quadratic ways took 4 to 100


def test_very_long_page():
    words = "some words of a very long page that goes on and on " * 20
    page = "<body><nav><a>x</a></nav><div>" + f"<p>{words}</p>" * 2000 + "</div></body>"
    assert html.main_text(page) == " ".join([words.strip()] * 2000)
