"""Plans that must hold at scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import parity
from bondmarts.operators import issuers, kpi, underwriter
from bondmarts.plans import serving
from bondmarts.sources import snapshots
from conftest import rows
from parity import projection as P

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(parity.QUERIES))
def test_no_pairing_joins_and_no_python(spark, name):
    text = plan(parity.QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "ObjectHashAggregate(keys=[]"):
        assert bad not in text


def test_scan_reads_only_needed_columns_and_pushes_filters(spark):
    text = formatted(kpi.province_kpi(P.bond(spark, SF_DIR)))
    assert "ReadSchema: struct<issuer:string,province:string,city:string,issue_amount:double,coupon:double,rating:string,issuer_agency:string>" in text
    assert "IsNotNull(province)" in text


def test_dedup_prunes_before_the_shuffle(spark):
    text = plan(issuers.enriched(P.bond(spark, SF_DIR), P.fiscal(spark, SF_DIR)))
    partial, exchange, final = (text.index(s) for s in ("row_number(), 1, Partial", "Exchange hashpartitioning(issuer", "row_number(), 1, Final"))
    assert final < exchange < partial
    assert "IsNotNull(rating)" in text


def test_underwriters_are_summed_before_any_shuffle(spark):
    cells = plan(underwriter.underwriter_cells(P.bond(spark, SF_DIR), ["province"]))
    assert cells.count("Exchange") == 1 and "partial_count" in cells


def test_bands_join_bonds_and_not_their_underwriters(spark):
    text = plan(underwriter.underwriter_slices(P.bond(spark, SF_DIR), issuers.enriched(P.bond(spark, SF_DIR), None)))
    assert text.index("Generate explode(split(underwriters") < text.index("Join")


def test_city_cells_are_counted_once(spark):
    assert "WindowGroupLimit" not in plan(parity.QUERIES["city_rank_join"](spark, SF_DIR))


def test_raw_bonds_are_projected_once(spark, tmp_path, monkeypatch):
    """The older raw file is a part of the newer one as written; the tables are not joined again for it."""
    raw = spark.range(20).select(F.expr("uuid()").alias("证券代码"), F.expr("date_add(date'1999-12-25', cast(id as int))").alias("财务最新报告期"))
    monkeypatch.setattr(P, "raw_bond", lambda *_: raw)
    monkeypatch.setattr(P, "raw_fiscal", lambda *_: spark.createDataFrame([("c", "1", "P")], "`地区名称` string, `2021年一般公共预算收入` string, `省份` string"))
    folder = P.raw_files(spark, str(tmp_path))
    codes = [{r[0] for r in spark.read.parquet(f"{folder}/bond/{P.SOURCE.replace(P.ACTIVE, d)}").select("证券代码").collect()} for d in (P.ACTIVE, P.EARLIER)]
    assert len(codes[0]) == 20 and len(codes[1]) == 7 and codes[1] <= codes[0]


def test_large_fiscal_side_is_not_broadcast(spark):
    """Without a hint, a side above the limit is sort-merged."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(issuers.enriched(P.bond(spark, SF_DIR), P.fiscal(spark, SF_DIR)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_served_views_answer_in_published_names(spark):
    root = P.warehouse(spark, SF_DIR)
    serving.activate(spark, root, P.ACTIVE)
    assert spark.table("v_bond").count() == P.bond(spark, SF_DIR).count() and spark.table("v_fiscal").count() == 25
    for name, labels in serving.VIEW_LABELS.items():
        columns = spark.table(name).columns
        assert not [c for c in columns if c in labels and labels[c] != c and name != "v_fiscal"], name
    top = spark.sql("SELECT `评级机构`, `主体数` FROM v_agency_market_share WHERE `省份` LIKE '%ASIA%' ORDER BY `主体数` DESC")
    assert top.count() > 0
    with pytest.raises(ValueError, match="available"):
        serving.activate(spark, root, "19990101")


def test_rollback_changes_the_views(spark):
    root = P.warehouse(spark, SF_DIR)
    serving.activate(spark, root, P.EARLIER)
    older = spark.table("v_bond").count()
    assert snapshots.active(spark, root) == (P.EARLIER, None)
    serving.activate(spark, root, snapshots.latest_snapshot(spark, root))
    assert older < spark.table("v_bond").count()
    serving.activate(spark, root, P.EARLIER, P.FISCAL_YEAR)
    assert serving.resume(spark, root) == P.EARLIER and spark.table("v_bond").count() == older


def test_a_switch_to_written_marts_sorts_nothing(spark):
    """Once a snapshot has its marts, activation reads schemas and notes; no job of it has a shuffle of the data."""
    root = P.warehouse(spark, SF_DIR)
    serving.write_marts(spark, root, P.ACTIVE)
    tracker, group = spark.sparkContext.statusTracker(), "switch"
    spark.sparkContext.setJobGroup(group, group)
    serving.activate(spark, root, P.ACTIVE)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert all(tracker.getStageInfo(s).numTasks <= 25 for s in stages if tracker.getStageInfo(s))
    for name in serving.VIEW_LABELS:
        assert "Sort " not in plan(spark.table(name)) and "Exchange" not in plan(spark.table(name)) or name == "v_fiscal"


def test_province_analysis(spark):
    result = serving.province_analysis(P.bond(spark, SF_DIR), P.fiscal(spark, SF_DIR), "EUROPE")
    assert rows(result["province_kpi"], "province") == [("EUROPE",)]
    assert {r.province for r in result["issuers"].collect()} == {"EUROPE"}
    assert result["bonds"].count() == rows(result["province_kpi"], "bonds")[0][0]
    for name in ("agencies", "agency_names", "underwriters", "join_audit"):
        assert result[name].count() > 0, name
    result["platform_mismatch"].count()
