from folio.llm import html

TEXT = "A sentence of the article, with some words in it. " * 6
LONG = f"<p>{TEXT}</p>" * 10
WORDS = TEXT.split()
LINKS = "<ul>" + "".join(f"<li><a href={i}>link {i}</a>" for i in range(30)) + "</ul>"


def test_heading_and_lead_before_the_article():
    lead = "The lead tells what it is about, in a few more words than a heading has. " * 3
    page = f"<div><h1>Title</h1><div class=intro><p>{lead}</p></div><div class=text>{LONG}</div></div>"
    assert html.main_text(f"<body>{page}{LINKS}</body>").split() == ["Title", *lead.split(), *WORDS * 10]


def test_two_articles_that_share_one_text():
    page = f"<article><h2>One</h2>{LONG}</article><div>{LINKS}</div><article><h2>Two</h2><p>{TEXT}</p></article>"
    assert html.main_text(f"<body>{page}</body>").split() == ["One", *WORDS * 10, "Two", *WORDS]


def test_a_dense_part_further_down():
    page = f"<div class=text>{LONG}</div><div class=more>{LINKS}<div><p>{TEXT}</p></div></div>"
    assert html.main_text(f"<body>{page}</body>").split() == [*WORDS * 10, *WORDS]


def test_links_stay_out():
    assert html.main_text(f"<body><div>{LINKS}</div><div class=text>{LONG}</div><h3>After</h3>{LINKS}</body>").split() == WORDS * 10


def test_a_large_advert_beside_a_small_article():
    assert html.main_text(f"<body><div class=ad>{TEXT * 2}</div><article><h1>Title</h1><p>Short.</p></article></body>") == "Title Short."
