"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' shape.

A page is cut into flat blocks at block-level tags. Each block has its words, its link density, those of the blocks before and
after it, and cues from the elements around it (Kohlschütter et al., 2010). A decision tree, trained on the small labelled pages of
`page_labels`, tells article from boilerplate; it is compiled to one Spark expression over the array of blocks.
"""

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bondmarts.llm.page_labels import PAGES
from bondmarts.llm.tables import small_batches

# Elements whose content is no text of the page; head ends at body, where its end tag is missing.
RAW = frozenset("script style noscript template iframe textarea title select button head".split())
#: Elements inside a line; all others end a block. br is white space.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input "
    "object canvas svg g path rect circle line polyline polygon ellipse use defs math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom msub msup msubsup "
    "munder mover munderover mmultiscripts menclose semantics annotation".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that hold boilerplate, and names in a class, id or role that say so, or words in them that say article.
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside widget ad ads advert adverts advertisement sponsor sponsored promo promotion "
    "cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments reply replies respond discussion disqus form search toolbar tags copyright legal disclaimer complementary contentinfo pagination pager".split()
)
ARTICLE_WORDS = frozenset("article post entry content main body story text prose".split())
# Of these, an element may hold an article all the same: a form around the page, a wrapper named for its sidebar.
WEAK_ELEMENTS = frozenset("form fieldset".split())
WEAK_WORDS = frozenset(
    "header masthead banner sidebar notice notices notification alert popup modal overlay signup login share sharing social form search toolbar tags copyright legal disclaimer".split()
)
# An article of its own is only these by its name; the others may be what it is about.
OWN_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored widget comment comments reply replies respond disqus".split())
# Words after the one that says what a name like share-links is, and words before it that make the name a state or a subject.
PARTS = frozenset(
    "site page top bottom left right primary secondary main global inner outer wrapper wrap container box block section area list links link items item bar row col column group panel "
    "slot unit buttons button icons icon title heading text content body post posts entry article story blog module region zone holder info meta".split()
)
STATES = frozenset("no not non has have with without is hide show hidden category tag type format status taxonomy".split())

# A quote opens a value only directly after `=`, and only if it is closed; others are plain characters, so that `>` ends the tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?+)?+")
_NAMES = ("class", "id", "role", "itemprop")
_WORD = re.compile(r"[a-z]+")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_SPACE = re.compile(r"\s+")
_ENDS = {n: re.compile(r"</head\s*>|(?=<body[\s>])" if n == "head" else rf"</{n}\s*>", re.I) for n in RAW}

FEATURES = ["words", "links", "boiler", "article", "before_words", "before_links", "after_words", "after_links", "heading", "in_list"]
_NUMBERS = ["words", "links", "boiler", "article", "heading", "in_list"]
_BLOCK = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in _NUMBERS]]))


def _attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values of a start tag; of equal names the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _boiler_word(token: str) -> str | None:
    """The word that makes a whole class, id or role name one of boilerplate: `share` of share-links, none of no-sidebar, header-fixed or comments-open."""
    words = _WORD.findall(token.partition("--")[0])
    for i, word in reversed(list(enumerate(words))):
        if word in BOILER_WORDS:
            state = STATES.intersection(words[:i]) or (word == "sidebar" and "content" in words)  # content-sidebar-wrap holds both
            return None if state else word
        if word not in PARTS:
            return None
    return None


def _cue(name: str, raw: str) -> tuple[int, int, bool, bool]:
    """(boilerplate: 0 no, 1 unless an article is in it, 2 yes; article; hidden; an article of its own) of one start tag."""
    boiler = (1 if name in WEAK_ELEMENTS else 2) if name in BOILERPLATE else 0
    article, hidden, own = int(name in ("article", "main")), False, name in ("article", "main")
    if raw:
        attributes = _attributes(raw)
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_NOT_SHOWN.search(attributes.get("style", "")))
        if name in ("html", "body"):
            return boiler, article, hidden, own
        found = set()
        for n in _NAMES:
            for token in attributes.get(n, "").lower().split():
                if word := _boiler_word(token):
                    found.add(word)
                else:
                    words = set(_WORD.findall(token))
                    article |= bool(words & ARTICLE_WORDS)
                    own |= bool(words & {"article", "post", "entry", "story"}) and words <= PARTS
        own |= attributes.get("role", "").lower() == "main"
        if own:
            found &= OWN_WORDS
        if found:
            boiler = max(boiler, 1 if found <= WEAK_WORDS else 2)
    return boiler, article, hidden, own and not boiler


def blocks(html: str) -> list[dict]:
    """Flat blocks of a page in order, but for those in an element that is marked as hidden."""
    return [b for b in all_blocks(html) if not b["hidden"]]


def all_blocks(html: str) -> list[dict]:
    """Flat blocks of a page in order, without empty ones. End tags without a start tag are passed over; open elements end with the page.

    Hidden ones are among them: articles fold paragraphs away, so being hidden tells nothing against a text.
    """
    found: list[dict] = []
    parts: list[str] = []
    link_parts: list[str] = []
    stack: list[tuple[str, int, int, bool, int]] = []  # (element, boilerplate, article, hidden, articles within the boilerplate), each including what is around it
    open_links = 0

    def end_block():
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                words = len(text.split(" "))
                linked = len(" ".join(link_parts).split())
                boiler, article, within = (stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (0, 0, 0)
                nearness = 1 / (1 + within) if boiler else 0.0
                names = {s[0] for s in stack}
                heading = any(n in names for n in ("h1", "h2", "h3", "h4", "h5", "h6"))
                found.append(
                    {
                        "text": text, "words": float(words), "links": min(linked / words, 1.0), "boiler": nearness, "article": float(article),
                        "heading": float(heading), "in_list": float("li" in names), "hidden": float(bool(stack) and stack[-1][3]),
                    }
                )
            parts.clear()
            link_parts.clear()

    def text_of(piece: str):
        if piece:
            parts.append(piece)
            if open_links:
                link_parts.append(piece)

    at = 0
    while m := _TOKEN.search(html, at):
        text_of(html[at : m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        if name == "br":
            text_of(" ")
            continue
        inline = name in INLINE or (name in ("title", "style") and any(s[0] == "svg" for s in stack))
        if m[1]:
            if not inline:
                end_block()
            if any(s[0] == name for s in stack):
                while stack:
                    gone = stack.pop()[0]
                    open_links -= gone == "a"
                    if gone == name:
                        break
            continue
        if not inline:
            end_block()
        if name in RAW and not m[3].endswith("/"):
            done = _ENDS[name].search(html, at)
            at = done.end() if done else (len(html) if name != "head" else at)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # their end tags may be left out
            while stack and stack[-1][0] in ("p", *([name] if name != "p" else []), *INLINE):
                open_links -= stack.pop()[0] == "a"
        boiler, article, hidden, own = _cue(name, m[3])
        above = stack[-1] if stack else ("", 0, 0, False, 0)
        # An article within a navigation, a sidebar and the like is boilerplate, and boilerplate within an article is, too; but
        # an article within a form or a wrapper of such a name is as far from it as there are articles in between.
        if above[1] == 2 or not boiler:
            within = above[4] + (own and above[1] == 1)
        else:
            within = 0
        stack.append((name, max(above[1], boiler), above[2] or article, above[3] or hidden, within))
        open_links += name == "a"
    text_of(html[at:])
    end_block()
    return found


@F.pandas_udf(_BLOCK)
def _blocks(html: pd.Series) -> pd.Series:
    return pd.Series([all_blocks(h or "") for h in html], index=html.index, dtype=object)


def features(page_blocks: list[dict]) -> list[list[float]]:
    rows = []
    for i, b in enumerate(page_blocks):
        before = page_blocks[i - 1] if i else {"words": 0.0, "links": 0.0}
        after = page_blocks[i + 1] if i + 1 < len(page_blocks) else {"words": 0.0, "links": 0.0}
        own = b | {"before_words": before["words"], "before_links": before["links"], "after_words": after["words"], "after_links": after["links"]}
        rows.append([own[f] for f in FEATURES])
    return rows


def train(spark: SparkSession, pages=PAGES, depth: int = 4):
    """Decision tree of the labelled pages; a page is (html, labels of its blocks in order)."""
    rows = []
    for html, labels in pages:
        found = all_blocks(html)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {[b['text'] for b in found]}")
        rows += [(float(y), *x) for y, x in zip(labels, features(found))]
    data = spark.createDataFrame(rows, ["label", *FEATURES]).coalesce(1)
    data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(data).select("label", "x")
    return DecisionTreeClassifier(labelCol="label", featuresCol="x", maxDepth=depth, maxBins=256, seed=1).fit(data)


def compiled(tree, value) -> Column:
    """The tree as a condition; value(feature) is its column."""

    def walk(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(node.prediction() == 1.0)
        left, right = walk(node.leftChild()), walk(node.rightChild())
        return F.when(value(FEATURES[node.split().featureIndex()]) <= node.split().threshold(), left).otherwise(right)

    return walk(tree._call_java("rootNode"))


def main_text(pages: DataFrame, id: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of pages: id, the columns in `keep`, text and n_chars.

    A null page or one without article has an empty text. Only the named columns are read; equal rows are rows of their own.
    """
    spark = pages.sparkSession
    small_batches(spark)
    tree = train(spark)
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate((id, *keep))]
    rows = pages.select(*named, _blocks(F.coalesce(F.col(html).cast("string"), F.lit(""))).alias("_blocks"))
    around = {"before": -1, "after": 1}

    def is_article(block: Column, i: Column) -> Column:
        def value(name: str) -> Column:
            side, _, what = name.partition("_")
            if side in around and what in ("words", "links"):
                return F.coalesce(F.get("_blocks", i + around[side])[what], F.lit(0.0))
            return block[name]

        return compiled(tree, value)

    article = F.transform(F.filter("_blocks", is_article), lambda b: b["text"])
    rows = rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate((id, *keep))], F.array_join(article, "\n\n").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
