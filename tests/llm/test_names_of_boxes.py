"""Names of boxes in pages: what they may drop, and what not."""

from ledgerfold.llm import html_text

P = "<p>" + "The river runs through a long valley where people have lived for many years. " * 4 + "</p>"
TEXT = "The river runs through a long valley where people have lived for many years. " * 4
LINKS = "<a href=1>One</a> <a href=2>Two other things</a> and"


def flat(*parts):
    return " ".join(" ".join(p.split()) for p in parts)


PAGES = {
    # a word among others drops nothing inside the article unless the box is links
    f"<article>{P}<div class='share-price'><p>Prices rose on Monday.</p></div>{P}</article>": flat(TEXT, "Prices rose on Monday.", TEXT),
    f"<article>{P}<div class='social-history'><p>Told at length.</p></div></article>": flat(TEXT, "Told at length."),
    f"<main>{P}<div class='related-work'><p>Done before by others.</p></div></main>": flat(TEXT, "Done before by others."),
    f"<article>{P}<div class='share-price'>{LINKS}</div></article>": flat(TEXT),
    f"<div class='content'>{P}{P}<div class='share-of-market'><p>It was large.</p></div></div>": flat(TEXT, TEXT, "It was large."),
    # words of boxes beside the article do
    f"<article>{P}<div class='related-posts'><p>Read this too.</p></div></article>": flat(TEXT),
    f"<article>{P}<div class='newsletter-signup-box-2'><p>Join us.</p></div></article>": flat(TEXT),
    f"<div class='site has-sidebar'><div>{P}{P}</div><div class='sidebar-left'><p>Beside.</p></div></div>": flat(TEXT, TEXT),
    # what is the only thing on the page isn't beside anything
    "<body><div class='notice'><p>Alone on the page.</p></div></body>": "Alone on the page.",
    "<body><div class='comments'><p>Only a comment.</p></div></body>": "",
    # readers' comments are out however much they say
    f"<body><div class='story'>{P}</div><div class='post-comments'>{P}{P}{P}</div></body>": flat(TEXT),
    f"<body><div class='story'>{P}</div><div class='comments-container'><div class='comment'>{P}{P}</div></div></body>": flat(TEXT),
    f"<body><div class='comments-wrapper'><h1>Title</h1>{P}</div></body>": flat("Title", TEXT),
}


def test_names_of_boxes(spark):
    pages = list(PAGES)
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(df).collect()}
    assert {pages[k]: v for k, v in got.items()} == PAGES
