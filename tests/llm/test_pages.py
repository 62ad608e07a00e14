import pytest

from bondmarts.llm import pages
from bondmarts.llm.page_labels import PAGES

SCHEMA = "page_id bigint, url string, html string, text string, _blocks int"


def texts(spark, *htmls):
    df = spark.createDataFrame([(i, f"u{i}", h, "clash", 1) for i, h in enumerate(htmls)], SCHEMA)
    return [r.text for r in pages.main_text(df, keep=("url",)).orderBy("page_id").collect()]


def test_blocks():
    html = "<p>a <b>b</b>\n c<br>d<p>e&amp;f &lt;g&gt; &#233;&nbsp;h<div>x <a href='>'>y z</a></div><script>if (a < b) '</p>'</script><!-- <p>no</p> --><p>i"
    found = pages.blocks(html)
    assert [b["text"] for b in found] == ["a b c d", "e&f <g> é h", "x y z", "i"]
    assert [round(b["links"], 2) for b in found] == [0, 0, 0.67, 0]
    assert pages.blocks("") == [] and pages.blocks("<p> \n </p><div></div>") == []
    assert [b["text"] for b in pages.blocks("plain text < 3 and a<b")] == ["plain text < 3 and a"]
    assert [b["text"] for b in pages.blocks("</p></div>x</b><p hidden>no</p><div style='display: none'><p>no</div><p>y")] == ["x", "y"]


def test_labelled_pages_are_learnt(spark):
    tree = pages.train(spark)
    for html, labels in PAGES:
        found = pages.blocks(html)
        assert [int(tree.predict(__import__("pyspark").ml.linalg.Vectors.dense(x))) for x in pages.features(found)] == labels


def test_article_without_boilerplate(spark):
    article = "<article class=post><h1>Title &amp; more</h1><p>First  paragraph,\n with <a href=x>a link</a>.</p><p>No.</p><ul><li>One</li><li>Two</li></ul></article>"
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site name and slogan of the whole paper</p></header>"
        f"<nav><a href=1>A</a></nav><div class='cookie-banner'>We use cookies.</div>{article}<div id=comments><p>A long comment of a reader, which is not part of it.</p></div>"
        "<aside><p>Other things to read on this site.</p></aside><form><label>Name</label><input><button>Send</button></form><footer><p>Imprint</p></footer></body></html>"
    )
    expected = "Title & more\n\nFirst paragraph, with a link.\n\nNo.\n\nOne\n\nTwo"
    long = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(20000)) + "</article>"
    got = texts(spark, page, page, None, "", "<nav><p>menu</p></nav>", long, article + "<p")
    assert got[:5] == [expected, expected, "", "", ""] and got[5].count("\n\n") == 19999 and got[6] == expected


def test_counts_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>äöü 漢字</p>", "t", 1)], SCHEMA)
    row = pages.main_text(df, keep=("url",)).first()
    assert (row.page_id, row.url, row.text, row.n_chars) == (1, "u", "äöü 漢字", 6)
    assert pages.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<" * 5000, "<a " * 3000, "<p " + "x='" * 3000, "<!--" * 3000, "<div>" * 3000 + "x", "&" * 5000])
def test_odd_pages_end(html):
    pages.blocks(html)


def test_hidden_text_reaches_the_tree(spark):
    """Neither look-alikes of a hidden mark nor real ones cost an article its text."""
    words = "a paragraph of the article that is long enough to be told from a menu by its words"
    page = (
        f"<article style='overflow:hidden' data-title='The hidden valley' class='md:flex hidden lg:block'><p>One, {words}.</p><p>Two, <a href='/the/hidden/x'>linked</a>, {words}.</p>"
        f"<p hidden>Three, {words}.</p><div style='color:red;display: none'><p>Four, {words}.</p></div><p>Five, <span aria-hidden=true>six</span>, {words}.</p></article>"
    )
    expected = [f"One, {words}.", f"Two, linked, {words}.", f"Three, {words}.", f"Four, {words}.", f"Five, six, {words}."]
    assert texts(spark, page) == ["\n\n".join(expected)]
    assert [b["hidden"] for b in pages.all_blocks(page)] == [0, 0, 1, 1, 0]


@pytest.mark.parametrize(
    "name", ["post has-sidebar", "entry-content comments-open", "layout header-fixed", "category-legal", "content-sidebar-wrap", "md:menu-open", "newsroom", "no-sidebar", "page-has-comments"]
)
def test_names_of_a_state_are_no_boilerplate(name):
    assert pages._cue("div", f" class='{name}'")[0] == 0


@pytest.mark.parametrize("name", ["ad", "cookie-banner", "share-links", "sidebar", "comment-body", "site-header", "main-nav", "header--dark", "top-ad-slot", "x related-posts"])
def test_names_of_boilerplate(name):
    assert pages._cue("div", f" class='{name}'")[0] > 0


def test_article_in_a_named_wrapper(spark):
    article = "<h1>Title</h1><p>A first paragraph of the article, with words enough to be one.</p><p>No.</p><p>And a last one that says what came of it all in the end.</p>"
    expected = "Title\n\nA first paragraph of the article, with words enough to be one.\n\nNo.\n\nAnd a last one that says what came of it all in the end."
    kept = [
        f"<body class='single-post no-sidebar'><article>{article}</article>", f"<div class='post has-sidebar'>{article}</div>", f"<div class='entry-content comments-open'>{article}</div>",
        f"<div class='layout header-fixed'><main>{article}</main></div>", f"<div class='right-sidebar'><main>{article}</main><div class=sidebar><p>Other texts of the same week.</p></div></div>",
        f"<form class=search><article>{article}</article></form>", f"<body class=header><nav><a href=1>A</a></nav>{article}",
        *[f"<article class='{c}'>{article}</article>" for c in ("social", "related", "tags", "notice", "search", "legal", "form")],
    ]
    assert texts(spark, *kept) == [expected] * len(kept)
    gone = [f"<article>{article}<div class=advert><p>Buy two lamps today and get a third one free of charge, only here.</p></div></article>", f"{article}<div class=comments><article class=comment-body><p>I was there, and it was not like this at all.</p></article></div>"]
    assert texts(spark, *gone) == [expected] * 2


@pytest.mark.parametrize(
    "html, expected",
    [
        ('<p class="a"">First paragraph here.</p><p class="b">Second.</p>', ["First paragraph here.", "Second."]),
        ("<p title=it's>Para one isn't here</p><p>Two isn't.", ["Para one isn't here", "Two isn't."]),
        ("<p title='open>One</p><p>Two</p>", ["One", "Two"]),
        ("<p title = 'a>b' \">One</p><p data-x=a=\"b>Two</p><p x=\"c\">Three", ["One", "Two", "Three"]),
        ("<p>So <math><msup><mi>c</mi><mn>2</mn></msup></math> is<svg><title>no</title><path d=''/></svg> it.<canvas>drawn</canvas></p>", ["So c2 is it.drawn"]),
        ("<object data=x><p>A table of boats</p></object><svg><style>no{}</style><text>North</text><text>South</text></svg>", ["A table of boats", "North", "South"]),
    ],
)
def test_stray_quotes_and_drawn_text(html, expected):
    assert [b["text"] for b in pages.blocks(html)] == expected
