"""The registered queries of this subpackage, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bondmarts.llm import audit, chat, exact, jaccard, mixing, pages, private, rules, simhash, tiling, toxicity, urls, variants
from bondmarts.llm.tables import crc32_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = rules.train(docs, labels, "quality", learn=crc32_mod("doc_id", 5) != 0)
    rows = rules.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(
    "op2_mixing",
    r"""
    WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    d AS (
        SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS size,
            greatest(1, 20 - CAST(floor((length(text) - length(translate(text, '#$%&*|!', ''))) * 80 / greatest(length(text), 1)) AS BIGINT)) AS level,
            (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496 AS u
        FROM t),
    s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid
        FROM d GROUP BY source),
    w AS (SELECT *, CAST([3, 1, 2][(sid - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 2 AS most FROM s),
    r AS (
        SELECT *, coalesce(sum(most) OVER before, 0) AS most_before, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left,
            sum(source_size) OVER () AS all_words
        FROM w WINDOW before AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, most * weight_left * 2 <= weight * (all_words * 3 - most_before * 2) AS capped FROM r),
    x AS (
        SELECT source, source_size, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE
            CAST(CAST(weight * (all_words * 3 - 2 * sum(CASE WHEN capped THEN most ELSE 0 END) OVER ()) AS BIGINT) AS DOUBLE)
            / CAST(2 * sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS BIGINT) END AS target
        FROM c),
    y AS (
        SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words,
            coalesce(sum(size) OVER (
                PARTITION BY d.source ORDER BY -ln(u) * 20 / level, doc_id NULLS FIRST, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before
        FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
    SELECT doc_id, size, source_size, target,
        CASE WHEN source_size = 0 THEN 0 ELSE CAST(words // source_size * size
            + greatest(0, least(size, words % source_size - words_before)) AS BIGINT) END AS taken
    FROM y""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op3_chat_format",
    """
    WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
    c AS (
        SELECT conv_id, count(*) AS n, list(struct_pack(t := turn, r := role, x := text) ORDER BY turn NULLS LAST, role, text) AS turns
        FROM t GROUP BY conv_id),
    kept AS (
        SELECT conv_id FROM c a WHERE NOT EXISTS (
            SELECT 1 FROM c b WHERE b.turns[1] = a.turns[1] AND list_slice(b.turns, 1, a.n) = a.turns
                AND (b.n > a.n OR (b.n = a.n AND b.conv_id < a.conv_id))))
    SELECT conv_id, CAST(coalesce(turn, 4611686018427387903) // 512 AS BIGINT) AS part, count(*) AS n_turns,
        string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
            || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS text
    FROM t JOIN kept USING (conv_id) GROUP BY 1, 2""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"), keep=("url",))


@query("op5_toxicity_ftrl")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, "toxic", learn=crc32_mod("doc_id", 3) != 1)
    rows = toxicity.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query(
    "op6_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW same AS (PARTITION BY norm)""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query(
    "op7_ngram_jaccard_join",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE w END, ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
    FROM (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "item_id", "coverage", "contaminated")


def _url_sql() -> str:
    """Every group of terms as a pattern with a boundary on both sides, over the decoded URL; host and path split by pattern."""
    text = "translate(url_decode(coalesce(url, '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda group: f"regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}])({'|'.join(group)})([^\\p{{L}}\\p{{N}}]|$)')"
    strict = " OR ".join(hit(t) for t in urls.STRICT)
    soft = " + ".join(f"CAST({hit(t)} AS INTEGER)" for t in urls.SOFT)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
    return f"""
    WITH u AS (
        SELECT page_id, {text} AS t,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
        FROM pages),
    rules(domain, prefix, decision) AS (VALUES {rules}),
    best AS (
        SELECT page_id, arg_max(domain || prefix, length(domain || prefix)) AS rule, arg_max(decision, length(domain || prefix)) AS decision
        FROM u JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY page_id)
    SELECT page_id, host, path, rule,
        coalesce(decision, CASE WHEN {strict} OR {soft} >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict
    FROM u LEFT JOIN best USING (page_id)"""


@query("op9_url_filter", _url_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = private.spans(table(spark, sf_dir, "documents"))
    counts = [private.of_kind("base", kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return rows.select("doc_id", *counts, "base_sha256", private.joined("spans").alias("spans"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


@query("op12_simhash_near_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op13_filter_audit",
    r"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
    l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
    f AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
            [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
                regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails
        FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, fails),
    x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
    o AS (
        SELECT [a.i, b.i, c.i, d.i, e.i] AS way FROM x a, x b, x c, x d, x e
        WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    s AS (
        SELECT part, way, x.i AS step, way[x.i] AS own, n, good, bad, fails[way[x.i]] AS fails_own,
            len(list_filter(way[1:x.i - 1], lambda k: fails[k])) > 0 AS earlier, len(list_filter(fails, lambda k: k)) = 1 AS once
        FROM c, o, x),
    g AS (
        SELECT part, array_to_string(list_transform(way, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step, own,
            sum(CASE WHEN NOT earlier AND NOT fails_own THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN NOT earlier AND fails_own THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN earlier AND fails_own THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN once AND fails_own THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN NOT earlier AND fails_own THEN good ELSE 0 END) AS good_lost,
            sum(CASE WHEN NOT earlier AND fails_own THEN bad ELSE 0 END) AS toxic_lost
        FROM s GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
        CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
        CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM g""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.drop("filter").withColumnRenamed("bad_lost", "toxic_lost")
