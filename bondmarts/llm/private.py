"""Personal data by weak supervision: fixed patterns, and spans that labelers vote for.

Every digit run or token with digits of a text is a candidate. Regex, gazetteer and context labelers vote on it: personal, not
personal or no opinion. Over the counts of all vote patterns of the corpus, expectation-maximisation estimates how reliable each
labeler is (Dawid and Skene, 1979); the posteriors then train a logistic regression on the shape of the spans. Spans that
it accepts are added to those of the fixed patterns, which always stay.

Votes and shapes have a fixed number of patterns, so only their counts reach the driver, whatever the size of the corpus.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bondmarts.llm.tables import small_batches
from bondmarts.storage import store

# Kinds in the order in which they are listed, then those of added spans.
KINDS = ["email", "ip", "card", "phone", "secret", "number"]
# Gazetteers of words near a span, lower case.
PERSONAL_CUES = set("token key secret password passwd pwd pin phone tel call mobile fax mail email card account iban ssn ip address id".split())
OTHER_CUES = set("version license licence by nc sa cc chapter page figure table section vol volume no public year part step".split())
VOTES = 5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_PART = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9](?:[ .()-]{0,2}[0-9])*+")
_WORDS_BEFORE = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[Span]:
    # Each @ has one possible match: the run of local characters before it, back to the end of the last match.
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end(), "email"
        free = m.end() if m else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[Span]:
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts = list(_PART.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(parts) - 3, 4):
            numbers = [p[0].lstrip("0") for p in parts[i : i + 4]]
            if all(len(n) <= 3 and int(n or 0) <= 255 for n in numbers):
                yield parts[i].start(), parts[i + 3].end(), "ip"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.start(), m.end(), "card"


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.start(), m.end(), "phone"


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns in code points, by start and then kind as listed."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [*_ips(text), *_cards(text)]
        if "+" in text:
            found += _phones(text)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, int]]:
    """(start, end, vote pattern, shape) of digit runs and of tokens with digits that no base span covers, and of base spans.

    A vote pattern has a base-3 digit per labeler (0 no opinion, 1 not personal, 2 personal), a shape is a number below 64.
    """
    found: list[tuple[int, int, bool]] = [(s, e, True) for s, e, _ in base]
    covered = sorted((s, e) for s, e, _ in base)
    at, k = 0, 0
    while m := _DIGIT.search(text, at):
        start = m.start()
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if k < len(covered) and covered[k][0] <= start:
            at = covered[k][1]
            continue
        limit = covered[k][0] if k < len(covered) else len(text)
        left, right = start, start
        while left > at and text[left - 1].isascii() and text[left - 1].isalnum():
            left -= 1
        while right < limit and text[right].isascii() and text[right].isalnum():
            right += 1
        if left == start and not any(c.isalpha() for c in text[left:right]):
            right = min(_NUMBER.match(text, start).end(), limit)
            while not "0" <= text[right - 1] <= "9":
                right -= 1
        found.append((left, right, False))
        at = right
    return [(s, e, *_votes(text, s, e, fixed)) for s, e, fixed in found]


def _votes(text: str, start: int, end: int, fixed: bool) -> tuple[int, int]:
    span = text[start:end]
    digits = sum("0" <= c <= "9" for c in span)
    letters = sum(c.isalpha() for c in span)
    before = text[max(0, start - 40) : start]
    words = [w.lower() for w in _WORDS_BEFORE.findall(before)][-2:]
    cue = any(w in PERSONAL_CUES for w in words) - any(w in OTHER_CUES for w in words)
    near = before.rstrip(" \"'")[-1:]
    votes = [
        1 if fixed else 0,  # regex: a fixed pattern
        1 if digits >= 12 else -1 if digits <= 3 and not letters else 0,  # regex: how many digits
        cue,  # gazetteer
        1 if near and near in "=:#" else 0,  # context: an assignment
        1 if letters >= 6 and digits >= 4 and len(span) >= 16 else -1 if len(span) <= 4 else 0,  # regex: a long mixed token
    ]
    shape = min(digits // 4, 3) + 4 * (letters > 0) + 8 * (len(span) >= 16) + 16 * (cue < 0) + 32 * (cue > 0 or (near != "" and near in "=:#"))
    return sum((0, 2, 1)[v] * 3**i for i, v in enumerate(votes)), int(shape)


def _extract(keep: int):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    marks = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("shape", pa.int32()), ("kind", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, hashes, more = [], [], []
            for cell in batch.column(keep):
                text = cell.as_py() or ""
                own = base_spans(text)
                base.append([{"start": s, "kind": KINDS.index(k), "end": e} for s, e, k in own])
                hashes.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in own).encode()).hexdigest())
                more.append(
                    [
                        {"start": s, "end": e, "votes": v, "shape": f, "kind": KINDS.index("secret" if f & 4 else "number"), "base": i < len(own)}
                        for i, (s, e, v, f) in enumerate(candidates(text, own))
                    ]
                )
            yield pa.record_batch(
                [*[batch.column(i) for i in range(keep)], pa.array(base, spans), pa.array(hashes, pa.string()), pa.array(more, marks)],
                names=[str(i) for i in range(keep + 3)],
            )

    return run


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray]:
    """Vote pattern counts to the probability of personal data per pattern, and [class, labeler, vote] probabilities."""
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    votes = np.stack([patterns // 3**i % 3 for i in range(VOTES)], 1)
    balance = (votes == 2).sum(1) - (votes == 1).sum(1)
    p = 1 / (1 + np.exp(-2.0 * balance))  # the majority vote starts
    table = np.zeros((2, VOTES, 3))
    for _ in range(rounds):
        for c, weight in enumerate((n * (1 - p), n * p)):
            for i in range(VOTES):
                table[c, i] = np.bincount(votes[:, i], weights=weight, minlength=3) + 0.5
                table[c, i] /= table[c, i].sum()
        prior = np.clip((n * p).sum() / max(n.sum(), 1), 0.01, 0.99)
        logs = [np.log(table[c][np.arange(VOTES), votes]).sum(1) for c in (0, 1)]
        p = 1 / (1 + np.exp(np.clip(np.log(1 - prior) + logs[0] - np.log(prior) - logs[1], -50, 50)))
    return dict(zip(patterns.tolist(), p.tolist())), table


def _shape_features(shapes: np.ndarray) -> np.ndarray:
    digits = shapes % 4
    return np.stack([np.ones(len(shapes)), *[(digits == i) for i in (1, 2, 3)], *[(shapes >> b) & 1 for b in (2, 3, 4, 5)]], 1).astype(float)


def classifier(counts: dict[tuple[int, int], int], posterior: dict[int, float], rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on span shapes with the posteriors as soft labels (Newton steps)."""
    if not counts:
        return np.zeros(8)
    shapes = np.array([s for _, s in counts])
    y = np.array([posterior[v] for v, _ in counts])
    n = np.array(list(counts.values()), float)
    x, w = _shape_features(shapes), np.zeros(8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(8), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def spans(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id, base (start, kind, end), base_sha256 and spans, the base ones and those added.

    Null and empty texts have no spans. No span is added where one of the fixed patterns is. Equal rows are rows of their own;
    an empty table gives no rows. Only the two named columns are read.
    """
    small_batches(docs.sparkSession)
    one = "array<struct<start:bigint,kind:int,end:bigint>>"
    many = "array<struct<start:bigint,end:bigint,votes:int,shape:int,kind:int,base:boolean>>"
    id_type = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = store(rows.mapInArrow(_extract(1), f"id {id_type}, base {one}, base_sha256 string, marks {many}"))
    seen = rows.select(F.explode("marks").alias("m")).groupBy("m.votes", "m.shape").count().collect()  # at most 3^VOTES * 64 rows
    counts = {(r.votes, r.shape): r["count"] for r in sorted(seen)}
    by_votes: dict[int, int] = {}
    for (v, _), n in counts.items():
        by_votes[v] = by_votes.get(v, 0) + n
    posterior, _ = reliabilities(by_votes) if by_votes else ({}, None)
    weights = classifier(counts, posterior)
    shapes = np.arange(64)
    chosen = shapes[1 / (1 + np.exp(-_shape_features(shapes) @ weights)) >= threshold].tolist() if counts else []
    accepted = F.array(*[F.lit(s) for s in chosen]).cast("array<int>")
    added = F.filter("marks", lambda m: ~m["base"] & F.array_contains(accepted, m["shape"]))
    added = F.transform(added, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    return rows.select(F.col("id").alias(id), "base", "base_sha256", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(column: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(column: str, kind: str) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
