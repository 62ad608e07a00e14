import hashlib
import random
import re

from hypothesis import given, settings, strategies as st

from bondmarts.llm import private

PIECES = ["1", "2", "55", ".", "..", "@", "a", "b.c", "_", "-", " ", "+", "(", ")", "4111111111111111", "255", "256", "é", "%", "+1 (980) 555-6268", "x@y.z"]


def brute(text):
    """The patterns as given, by re.finditer."""
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], private.KINDS.index(s[2])))


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans(text):
    assert private.base_spans(text) == brute(text)
    found = private.candidates(text, brute(text))
    assert all(s < e <= len(text) and text[e - 1].isalnum() for s, e, _, _ in found[len(brute(text)) :])


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "+1 " * 100_000, "1 " * 150_000, "a@" * 100_000, "a.b@c." * 50_000, "x1" * 100_000):
        private.candidates(text, private.base_spans(text))


def test_em_finds_the_labeler_that_is_wrong():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = [truth if rng.random() < p else not truth for p in (0.95, 0.9, 0.85, 0.5, 0.9)]
        key = sum((2 if v else 1) * 3**i for i, v in enumerate(votes))
        counts[key] = counts.get(key, 0) + 1
    posterior, table = private.reliabilities(counts)
    right = table[1, :, 2] / (table[1, :, 1] + table[1, :, 2])
    assert right[0] > 0.85 and abs(right[3] - 0.5) < 0.1
    assert posterior[sum(2 * 3**i for i in range(5))] > 0.95 and posterior[sum(3**i for i in range(5))] < 0.05


def test_spans_of_a_table(spark):
    token = 'my token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" here'
    texts = [token, "mail joe@example.org now", "Version 2.0. of 12 pages, CC BY 4.0.", "call +1 (980) 555-6268 or 10.0.0.1", None, "", "x" * 50_000, "card 4111 1111 1111 1111"] * 12
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "a@b.cd", "", ""), (1, texts[1], "", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, base string")
    found = private.spans(df).select("doc_id", "base", "base_sha256", private.joined("spans").alias("spans"), private.of_kind("base", "phone").alias("n"))
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else "a@b.cd"
        base = ",".join(f"{k}:{s}:{e}" for s, e, k in brute(text or ""))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        listed = r.spans.split(",") if r.spans else []
        assert set(base.split(",")) - {""} <= set(listed)
        assert listed == sorted(listed, key=lambda s: (int(s.split(":")[1]), private.KINDS.index(s.split(":")[0])))
        if text == token:
            assert f"secret:{token.index('0b96')}:{token.index('0b96') + 40}" in listed
        if text and text.startswith("Version"):
            assert listed == []
        assert r.n == (1 if text and "+1" in text else 0)


def test_empty_table(spark):
    assert private.spans(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_whole_tokens_are_read():
    """Digits and letters count wherever they are in a token, however long it is."""
    late = "1" * 400 + "abcdefgh"
    (start, end, votes, shape) = private.candidates(f"x {late} y", [])[0]
    assert (start, end) == (2, 2 + len(late)) and shape & 4
    near = private._votes("z" * 300 + "1234", 0, 304, False)
    assert near == private._votes("z" * 20 + "1234", 0, 24, False)
