import pytest

from bondmarts.llm import urls

SCHEMA = "page_id bigint, url string, host string, verdict int"
URLS = {
    "http://shop.example.com/fr/x?casino": ("shop.example.com", "/fr/x", "com/fr/", "allow"),
    "https://EXAMPLE.org/es/1#a": ("example.org", "/es/1", "example.org/es/", "block"),
    "https://a.example.org/en/19?x=/es/": ("a.example.org", "/en/19", "example.org/en/1", "block"),
    "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "https://org/": ("org", "/", "org/", "allow"),
    "https://x.org": ("x.org", "", None, "allow"),
    "http://y.com/de/": ("y.com", "/de/", "com/de/", "block"),
    "http://best-casino.net/": ("best-casino.net", "/", None, "block"),
    "http://bestcasino.net/": ("bestcasino.net", "/", None, "allow"),
    "http://free.net/cheap": ("free.net", "/cheap", None, "block"),
    "http://free.net/free/freedom": ("free.net", "/free/freedom", None, "allow"),
    "http://x.net/?q=CASINO": ("x.net", "/", None, "block"),
    "no scheme, one casino": ("", "", None, "block"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "http://": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
}


def frame(spark, found):
    return spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(found)], SCHEMA)


def test_verdicts(spark):
    rows = urls.judged(frame(spark, [*URLS, None, "http://x.net/?q=CASINO"])).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [*URLS.values(), ("", "", None, "allow"), ("x.net", "/", None, "block")]


def test_rules_are_those_of_the_contract(spark):
    words = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert {host + path: word for host, path, word in urls.RULES} == words
    found = {f"http://{sub}{r}{end}": (r, word) for r, word in words.items() for sub in ("", "a.") for end in ("", "casino")}
    assert [(r.rule, r.verdict) for r in urls.judged(frame(spark, found)).orderBy("page_id").collect()] == list(found.values())


def test_boundaries_and_distinct_soft_terms():
    vocabulary = urls.Vocabulary(("bad", "badge"), ("so", "sofa", "soft"))
    assert vocabulary.count("bad badge badger abad bad2 -bad-") == (3, 0)
    assert vocabulary.count("so so sofa, softer soft") == (0, 3)
    assert vocabulary.count("ébad badé") == (0, 0)


def test_forms_of_one_word_are_one_hit_and_escapes_are_read(spark):
    found = {
        "https://shop.net/deals/deal-12": "allow", "https://shop.net/deals/cheap": "block", "http://x.net/c%61sino": "block", "http://x.net/%43ASINO": "block",
        "http://x.net/a%20casino%2Fb": "block", "http://x.net/%zzcasino": "allow", "http://x.net/%ff-casino": "block", "http://x.net/c%2561sino": "allow",
        "http://ads.adserver.net/ad": "allow", "http://ads.tracker.net/": "block", "http://x.net/%E4%BD%A0%E5%A5%BD": "allow", "http://x.net/%": "allow",
    }
    assert [r.verdict for r in urls.judged(frame(spark, found)).orderBy("page_id").collect()] == list(found.values())


def test_host_and_path_are_not_decoded(spark):
    row = urls.judged(frame(spark, ["http://x%2Ecom/%64e/"])).first()
    assert (row.host, row.path, row.rule) == ("x%2ecom", "/%64e/", None)


def test_vocabulary_from_a_table(spark):
    table = spark.createDataFrame(
        [("Rouge", "red", False, 1), ("red", "red", False, 1), ("blue", None, None, 1), ("bad", None, True, 1), (None, "x", True, 1), ("bad", None, True, 1), ("", None, True, 1)],
        "term string, word string, strict boolean, verdict int",
    )
    vocabulary = urls.Vocabulary.from_table(table)
    assert [vocabulary.count(u) for u in ("red rouge", "red/blue", "BAD", "casino")] == [(0, 1), (0, 2), (1, 0), (0, 0)]
    pages = frame(spark, ["http://h/red-rouge", "http://h/red-blue", "http://h/casino"])
    assert [r.verdict for r in urls.judged(pages, vocabulary=vocabulary).orderBy("page_id").collect()] == ["allow", "block", "allow"]
    with pytest.raises(ValueError):
        urls.Vocabulary.from_table(table, limit=2)
    assert urls.Vocabulary.from_table(table.limit(0)).count("casino free cheap") == (0, 0)


def test_empty_table_and_long_url(spark):
    assert urls.judged(frame(spark, [])).count() == 0
    assert urls.judged(frame(spark, ["http://x.net/" + "a/" * 200_000 + "casino"])).first().verdict == "block"


@pytest.mark.parametrize("text, expected", [("://h/p?q", ("h", "/p")), ("x://H#f", ("h", "")), ("x://h?a/b", ("h", "")), ("x://h\n/y", ("h\n", "/y"))])
def test_parts(spark, text, expected):
    row = spark.createDataFrame([(text,)], "u string").select(urls.host(spark_col("u")).alias("h"), urls.path(spark_col("u")).alias("p")).first()
    assert tuple(row) == expected


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
