"""The registered queries on the smallest given tables, and the pipeline."""

import pytest

import corpus_pipeline
from bondmarts.llm.queries import QUERIES, SQL
from bondmarts.llm import jaccard, tiling
from bondmarts.storage import store
from parity.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) == []


@pytest.mark.parametrize("name, columns", [
    ("op1_quality_rules", "doc_id held_out score predicted"), ("op5_toxicity_ftrl", "doc_id held_out score predicted"),
    ("op4_html_extraction", "page_id url text n_chars"), ("op8_benchmark_decontamination", "doc_id item_id coverage contaminated"),
    ("op10_personal_data", "doc_id n_email n_ip n_card n_phone base_sha256 spans"),
])
def test_a_row_for_every_input_row(spark, name, columns):
    found = QUERIES[name](spark, SF_DIR)
    assert found.columns == columns.split()
    assert found.count() == spark.read.parquet(f"{SF_DIR}/{'pages' if columns.startswith('page') else 'documents'}.parquet").count()


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = store(stage(spark, docs, SF_DIR))
        assert number == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        assert docs.select(*columns).exceptAll(tables[-1].select(*columns)).count() == 0
        tables.append(docs)
    by_stage = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = [i for i in by_stage[0] if labels.get(i) == 1]
    assert sum(i in by_stage[1] for i in good) >= 0.97 * len(good)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    text = {r.doc_id: lower(r.text) for r in tables[1].collect()}
    largest = {}
    for i, t in text.items():
        largest[t] = max(i, largest.get(t, i))
    assert by_stage[2] == set(largest.values())
    groups = {}
    for r in jaccard.similarity_classes(tables[2]).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    assert by_stage[3] == set(groups)
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert tiling.matches(tables[4], benchmark).filter(f"coverage >= {tiling.COVERAGE}").count() == 0
    assert docs.columns == [*columns, "mix_words"] and docs.filter("mix_words < 1").count() == 0
