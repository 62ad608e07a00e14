"""The small labelled table of the block classifier: invented pages, and for each block whether it belongs to the article."""

_LONG = "Over the summer the river fell to a level that nobody in the town remembered, and the old bridge stood dry on both banks."
_MORE = "Boats were moved downstream by the end of July, while the council argued about the price of a new sluice and its keeper."
_SHORT = "Nobody left."

#: (html, labels of its blocks in order)
PAGES = [
    (
        f"<html><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>World news</a></li></ul></nav><article><h1>Low water</h1><p>{_LONG}</p>"
        f"<p>{_SHORT}</p><p>{_MORE}</p></article><footer>&copy; 2020 the town paper, all rights reserved.</footer></body></html>",
        [0, 0, 1, 1, 1, 1, 0],
    ),
    (
        f"<body><header><h1>The Daily Column</h1><p>News since 1901, every morning at your door</p></header><div class='ad'>Buy two lamps today and get the third one free, only here.</div>"
        f"<main><h2>Low water</h2><p>{_LONG} <a href=x>Read the report</a>.</p><blockquote>{_MORE}</blockquote><ul><li>One boat sank.</li><li>Two were sold.</li></ul></main>"
        "<aside><p>Popular this week: how to keep bees in a small garden without being stung.</p></aside></body>",
        [0, 0, 0, 1, 1, 1, 1, 1, 0],
    ),
    (
        f"<body><div id=cookie-notice>We use cookies to make this site work. Read more about them in our policy.</div><div class='post-content'><h1>Dry banks</h1><p>{_MORE}</p>"
        f"<p>Why?</p><p>{_LONG}</p></div><div class='comments'><h3>Comments</h3><p>I was there and it was not like this at all, the bridge never fell dry.</p><p>Agreed.</p></div></body>",
        [0, 1, 1, 1, 1, 0, 0, 0],
    ),
    (
        f"<body><div><a href=1>Start</a> <a href=2>Sport</a> <a href=3>Weather</a></div><div><h1>The sluice</h1><p>{_LONG}</p><p>{_MORE}</p><p>{_LONG}</p></div>"
        "<div><a href=4>About us</a> <a href=5>Contact</a></div></body>",
        [0, 1, 1, 1, 1, 0],
    ),
    (
        f"<article><p>{_LONG}</p><div class='share-links'><a href=t>Share this</a></div><p>{_SHORT}</p><form><p>Sign up for our letter with your name and your address below.</p></form>"
        f"<p>{_MORE}</p><aside>Advertisement: the best boots for dry rivers and wet fields alike.</aside></article>",
        [1, 0, 1, 0, 1, 0],
    ),
    (
        f"<body><div class=sidebar><h4>Archive</h4><ul><li><a href=9>June</a></li><li><a href=8>May</a></li></ul></div><section><h2>Boats</h2><p>{_MORE}</p><p>{_LONG}</p></section>"
        "<div role=contentinfo>Printed by the harbour press, no part may be copied.</div></body>",
        [0, 0, 0, 1, 1, 1, 0],
    ),
    (
        f"<body><article><h1>Short note</h1><p>{_SHORT}</p></article><footer><p>{_LONG}</p></footer></body>",
        [1, 1, 0],
    ),
    (
        f"<article><h1>Links</h1><p><a href=1>{_SHORT}</a></p><p>See <a href=2>the list of boats</a>.</p><table><tr><td>Boat</td><td>Owner</td></tr></table></article><nav><p>{_MORE}</p></nav>",
        [1, 1, 1, 1, 1, 0],
    ),
    (f"<body><h1>Low water</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE}</p></body>", [1, 1, 1, 1]),
    (f"<div id=main><p>{_MORE}</p><p>{_LONG}</p><p>{_SHORT}</p></div>", [1, 1, 1]),
    (f"<article><p>{_LONG}</p><p>See <a href=1>this list</a> and <a href=2>that one</a> of boats.</p></article>", [1, 1]),
    (f"<article><h1>Boats</h1><p>{_SHORT}</p></article>", [1, 1]),
    (f"<article><p>{_SHORT}</p><p>Read <a href=1>more</a>.</p><p><a href=2>Low water</a></p></article>", [1, 1, 1]),
    (
        f"<body><p><a href=1>Start</a> | <a href=2>Sport</a></p><p>{_LONG}</p><p>The <a href=7>sluice</a> is old.</p><p>{_MORE}</p><p><a href=3>Next</a> <a href=4>Last page</a></p></body>",
        [0, 1, 1, 1, 0],
    ),
    (
        f"<body><ul><li><a href=1>Start</a></li><li><a href=2>All boats</a></li></ul><p>{_LONG}</p><ul><li>One <a href=8>boat</a> sank.</li><li>{_SHORT}</li></ul><p><a href=3>Contact</a></p></body>",
        [0, 0, 1, 1, 1, 0],
    ),
    (f"<nav><p>{_LONG}</p></nav><div class=article-body><p>{_SHORT}</p><div class=advert><p>{_MORE}</p></div><p>{_LONG}</p></div>", [0, 1, 0, 1]),
    (
        f"<body class='single-post no-sidebar'><div class='layout header-fixed'><div class='post has-sidebar'><h1>Low water</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE}</p></div></div>"
        "<div class='share-links'>Tell your friends about us.</div></body>",
        [1, 1, 1, 1, 0],
    ),
    (
        f"<body><form id=form><div class='header-wrap'>The Daily Column, since 1901.</div><main><h1>Low water</h1><p>{_LONG}</p><p>{_SHORT}</p><div class=social>Tell your friends about us.</div><p>{_MORE}</p></main></form></body>",
        [0, 1, 1, 1, 0, 1],
    ),
    (
        f"<body><div class='right-sidebar'><article class='post social legal tag-search'><h1>Boats</h1><p>{_LONG}</p><p>{_SHORT}</p></article><div class=widget><p>{_MORE}</p></div></div></body>",
        [1, 1, 1, 0],
    ),
    (
        f"<body><div class=search><main><article><p>{_SHORT}</p><p>{_MORE}</p></article></main></div><div class=related><article class=post><p>{_LONG}</p></article></div></body>",
        [1, 1, 0],
    ),
]
