"""URL filter: rules for hosts and paths, and a weighted vocabulary counted by an Aho-Corasick automaton.

A term counts where no letter or digit stands directly before or after it, in the URL with its percent escapes decoded once. Terms belong to
groups, such as the forms of one word. One strict term rejects a URL, as do soft terms of SOFT_HITS different groups; rules for single hosts come
before the vocabulary.
"""

from collections.abc import Sequence
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from bondmarts.llm.tables import LOWER, UPPER, small_batches

# Groups of terms of the vocabulary, lower case, each the forms of one word. Strict ones reject alone.
STRICT = (("casino", "casinos"), ("porn", "porno"), ("xxx",), ("viagra",), ("cialis",), ("malware",), ("phishing",), ("warez",), ("torrent", "torrents"), ("spam",), ("escort", "escorts"))
SOFT = (
    ("bet", "bets", "betting"), ("win", "wins"), ("free",), ("cheap",), ("pill", "pills"), ("pharmacy",), ("ad", "ads", "adserver"), ("track", "tracker", "tracking"),
    ("click", "clicks"), ("farm",), ("bonus",), ("jackpot",), ("poker",), ("slots",), ("loan", "loans"), ("adult",), ("sex",), ("cam", "cams"), ("crack",), ("keygen",),
    ("hack",), ("promo",), ("deal", "deals"), ("offer", "offers"), ("sale",), ("buy",), ("discount",), ("popup",), ("banner",), ("affiliate",),
)
SOFT_HITS = 2
# Rules (host and its subdomains, prefix of the path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Terms that a vocabulary table may have: it goes to every task.
MAX_TERMS = 100_000


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; without :// empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(host and path prefix, verdict) of the longest rule that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, prefix, decision in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name = F.when(fits, F.lit(domain + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


class Vocabulary:
    """Strict and soft groups of terms; a term by itself is a group of its own. A term of two groups belongs to the first, strict ones before soft ones."""

    def __init__(self, strict: Sequence[str | Sequence[str]] = STRICT, soft: Sequence[str | Sequence[str]] = SOFT):
        self.terms: dict[str, tuple[str, bool]] = {}
        for groups, is_strict in ((strict, True), (soft, False)):
            for group in groups:
                forms = (group,) if isinstance(group, str) else group
                for term in forms:
                    self.terms.setdefault(term.translate(_TO_LOWER), (forms[0], is_strict))
        self.terms.pop("", None)
        self.automaton = None

    @classmethod
    def from_table(cls, terms: DataFrame, limit: int = MAX_TERMS) -> "Vocabulary":
        """Of the columns term, word (its group; null: the term itself) and strict; other columns are not read, null terms not counted."""
        rows = terms.filter("term is not null").select("term", F.coalesce("word", "term").alias("word"), F.coalesce("strict", F.lit(False)).alias("strict")).distinct()
        rows = rows.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"a vocabulary has at most {limit} terms")
        groups: dict[bool, dict[str, list[str]]] = {True: {}, False: {}}
        for r in sorted(rows):
            groups[r.strict].setdefault(r.word, []).append(r.term)
        return cls(tuple(groups[True].values()), tuple(groups[False].values()))

    def __getstate__(self):
        return {"terms": self.terms, "automaton": None}

    def count(self, url: str) -> tuple[int, int]:
        """(strict hits, different soft groups) of a URL in any case."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for term, (group, is_strict) in self.terms.items():
                self.automaton.add_word(term, (term, group, is_strict))
            self.automaton.make_automaton()
        text = (unquote(url, errors="replace") if "%" in url else url).translate(_TO_LOWER)
        strict, soft = 0, set()
        for end, (term, group, is_strict) in self.automaton.iter(text) if self.terms else ():
            start = end + 1 - len(term)
            if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            if is_strict:
                strict += 1
            else:
                soft.add(group)
        return strict, len(soft)


_TO_LOWER = str.maketrans(UPPER, LOWER)


def judged(pages: DataFrame, id: str = "page_id", url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS, vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, strict_hits and soft_hits. Only the two named columns are read.

    A null URL, or one without ://, has an empty host and path; its verdict is that of the vocabulary, which reads the whole URL. Host, path
    and rules take the URL as it is, without decoding. `vocabulary`, such as one read from a table, comes in place of `strict` and `soft`.
    """
    small_batches(pages.sparkSession, 4096)
    vocabulary = vocabulary or Vocabulary(strict, soft)

    @F.pandas_udf("strict bigint, soft bigint")
    def hits(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vocabulary.count(u or "") for u in urls], columns=["strict", "soft"])

    rows = pages.select(F.col(id).alias("_id"), F.col(url).cast("string").alias("_url"))
    rows = rows.select("_id", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), hits(F.coalesce("_url", F.lit(""))).alias("hits"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rejected = (F.col("hits.strict") > 0) | (F.col("hits.soft") >= soft_hits)
    own = F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("_id").alias(id), "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("hits.strict").alias("strict_hits"), F.col("hits.soft").alias("soft_hits"))
