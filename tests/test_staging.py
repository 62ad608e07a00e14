import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bondmarts.schema import BOND
from bondmarts.sources import export, snapshots, staging
from bondmarts import storage
from bondmarts.operators import filters
from bondmarts.plans import build
from conftest import rows


def test_first_present_header_wins_and_missing_is_null(spark):
    raw = spark.createDataFrame([("省", "x", "地市", 1.0)], ["城投行政级别（Wind）", "其他", "城投行政级别", "发行总额\n[单位] 亿元"])
    df = staging.resolve_headers(raw)
    assert df.columns == BOND.names[:22]
    assert rows(df, "admin_level", "issue_amount", "issuer", "coupon") == [("省", 1.0, None, None)]
    assert staging.resolve_headers(raw, keep_other=True).columns[22:] == ["其他", "城投行政级别"]


def test_stage_bond(spark):
    raw = spark.createDataFrame(
        [("1", "地市", " 联合资信 ", "AA+", float("nan"), dt.datetime(2022, 9, 30, 13, 0))],
        ["证券代码", "城投行政级别(Wind)", "主体评级机构", "主体评级", "总资产 亿元", "财务最新报告期"],
    )
    staged = staging.stage_bond(raw, "20230216", "f.csv")
    assert staged.columns == BOND.names
    assert rows(staged, "admin_level", "issuer_agency", "total_assets", "report_date", "level_rank", "rating_rank", "_snapshot_date") == [
        ("地市级", "联合资信评估股份有限公司", None, "2022-09-30", 5, 4, "20230216")
    ]
    assert not [c for c in staging.drop_lineage(staged).columns if c.startswith("_")]


def test_unparseable_report_date_fails(spark):
    raw = spark.createDataFrame([("1", "soon")], ["证券代码", "财务最新报告期"])
    with pytest.raises(PySparkException):
        staging.stage_bond(raw, "20230216", "f").collect()


def test_fiscal_headers_take_the_first_hit(spark):
    raw = spark.createDataFrame([("甲市", "乙", "1", "2")], ["地区名称", "城市", "一般公共预算收入", "一般公共预算收入增速"])
    df = staging.resolve_fiscal_headers(raw)
    assert df.columns == ["city", "城市", "revenue", "一般公共预算收入增速"]
    assert rows(df, "city", "revenue") == [("甲市", "1")]


def test_snapshot_date_needs_a_date(spark):
    names = spark.createDataFrame([("全国城投债数据_截止20230216.xlsx",)], "n string")
    assert names.select(staging.snapshot_date_of(F.col("n"))).first()[0] == "20230216"
    with pytest.raises(PySparkException, match="20YYMMDD"):
        spark.createDataFrame([("bonds.xlsx",)], "n string").select(staging.snapshot_date_of(F.col("n"))).collect()


def write_text(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_fiscal_files_to_lake(spark, tmp_path):
    folder, root = str(tmp_path / "raw"), str(tmp_path / "lake")
    os.makedirs(folder)
    write_text(f"{folder}/2021年四川省财力.csv", "地区,一般公共预算收入(亿元)\n成都市,1697.9\n绵阳市,-\n")
    write_text(f"{folder}/2021年浙江省财力.csv", "序号,城市名称,2021一般公共预算收入\n1,杭州市,2386.6\n")
    write_text(f"{folder}/2021年江苏省财力.csv", "城市,一般公共预算收入\n南京市,1\n南京市,2\n")
    write_text(f"{folder}/2021年山东省财力.csv", "城市,一般公共预算收入\n,1\n")
    write_text(f"{folder}/2021年云南省财力.csv", "城市,收入\n昆明市,1\n")
    write_text(f"{folder}/2020年云南省财力.csv", "城市,一般公共预算收入\n昆明市,1\n")
    staged = snapshots.read_fiscal_files(spark, folder, "2021")
    problems = snapshots.write_fiscal(staged, root)
    assert rows(problems, "province", "problem", "detail") == [
        ("云南省", "column missing", "revenue"), ("山东省", "city missing", None), ("江苏省", "city repeated", "南京市"),
    ]
    expected = [("四川省", "成都市", 1697.9), ("四川省", "绵阳市", None), ("浙江省", "杭州市", 2386.6)]
    assert rows(snapshots.fiscal(spark, root), "province", "city", "revenue") == expected
    assert rows(snapshots.fiscal(spark, root, "浙江省"), "city") == [("杭州市",)]
    assert snapshots.available_provinces(spark, root, "2021") == ["四川省", "浙江省"]
    assert snapshots.available_provinces(spark, root, "2020") == []
    # Again: what is there stays, a repaired file is added.
    write_text(f"{folder}/2021年江苏省财力.csv", "城市,一般公共预算收入\n南京市,1\n")
    snapshots.write_fiscal(snapshots.read_fiscal_files(spark, folder, "2021"), root)
    assert rows(snapshots.fiscal(spark, root), "province", "city", "revenue") == sorted([*expected, ("江苏省", "南京市", 1.0)], key=repr)


def full(**more):
    return {
        "security_name": "b", "issuer": "i", "province": "四川", "city": "成都市", "rating": "AA",
        "issuer_agency": "x", "admin_level": "地市级", **more,
    }


def test_snapshots_are_immutable_and_listed(spark, bonds, tmp_path):
    root = str(tmp_path)
    assert snapshots.list_snapshots(spark, root) == [] and snapshots.latest_snapshot(spark, root) is None
    assert snapshots.write_snapshot(bonds(full()), root, "20230216")
    assert snapshots.write_snapshot(bonds(full(), full()), root, "20220930")
    assert not snapshots.write_snapshot(bonds(full(), full()), root, "20230216")
    assert snapshots.bond(spark, root, "20230216").count() == 1
    assert snapshots.list_snapshots(spark, root) == ["20220930", "20230216"]
    assert snapshots.latest_snapshot(spark, root) == "20230216"
    # What a failed job left behind is no snapshot and is replaced.
    os.makedirs(f"{root}/bond/snapshot_date=20240101/_temporary")
    assert snapshots.latest_snapshot(spark, root) == "20230216"
    assert snapshots.write_snapshot(bonds(full()), root, "20240101")
    assert snapshots.latest_snapshot(spark, root) == "20240101"
    with pytest.raises(ValueError, match="20220930, 20230216, 20240101"):
        snapshots.require_snapshot(spark, root, "20200101")


def test_half_written_province_is_rebuilt(spark, tmp_path):
    """Files without a mark, as a job leaves them that dies in its commit, are neither served nor kept."""
    folder, root = str(tmp_path / "raw"), str(tmp_path / "lake")
    os.makedirs(folder)
    write_text(f"{folder}/2021年四川省财力.csv", "地区,一般公共预算收入(亿元)\n成都市,1\n绵阳市,2\n")
    half = spark.createDataFrame([("成都市", 9.0, "四川省", "2021")], "city string, revenue double, province string, fiscal_year string")
    half.write.partitionBy("province", "fiscal_year").parquet(f"{root}/fiscal")
    assert snapshots.fiscal(spark, root).count() == 0 and snapshots.written_fiscal(spark, root) == set()
    snapshots.write_fiscal(snapshots.read_fiscal_files(spark, folder, "2021"), root)
    assert rows(snapshots.fiscal(spark, root), "city", "revenue") == [("成都市", 1.0), ("绵阳市", 2.0)]


def test_snapshot_reads_its_source_once(spark, bonds, tmp_path):
    """Every row of the source is evaluated once, and a failing source leaves nothing behind."""
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = bonds(*[full(issuer=f"i{i}") for i in range(200)], full(city=None))
    counted = source.mapInArrow(counting, source.schema).withColumn("备注", F.lit("x"))
    notes = snapshots.build_snapshot(counted, str(tmp_path), "20230216")
    assert seen.value == 201 and notes[0].startswith("city: 1 rows without value dropped")
    stored = snapshots.bond(spark, str(tmp_path), "20230216", other="`备注` string")
    assert stored.count() == 200 and {r["备注"] for r in stored.collect()} == {"x"}
    with pytest.raises(ValueError, match="city is null"):
        snapshots.build_snapshot(bonds(*[full(city=None if i < 9 else "c") for i in range(100)]), str(tmp_path), "20240101")
    assert snapshots.list_snapshots(spark, str(tmp_path)) == ["20230216"] and os.listdir(f"{tmp_path}/_draft") == []


def test_newest_bond_file_by_date_in_its_name(spark, tmp_path):
    for name in ("债券.csv", "z_20220930.csv", "a_20230216.csv", "20240101.xlsx"):
        write_text(str(tmp_path / name), "x\n1\n")
    assert build.newest_bond_file(spark, str(tmp_path)) == "a_20230216.csv"
    with pytest.raises(ValueError, match="no bond file"):
        build.newest_bond_file(spark, str(tmp_path / "none"))


def test_stored_tables_are_released(spark):
    df = spark.createDataFrame([(1,)], "x int")
    before = set(storage.list_names(spark, storage.shared_dir(spark)))
    with storage.temporary(spark):
        assert storage.store(df).count() == 1
        assert len(storage.list_names(spark, storage.shared_dir(spark))) == len(before) + 1
    assert set(storage.list_names(spark, storage.shared_dir(spark))) == before


def test_only_the_asked_snapshot_is_read(spark, bonds, tmp_path):
    root = str(tmp_path)
    for date in ("20220930", "20230216"):
        snapshots.write_snapshot(bonds(full()), root, date)
    plan = snapshots.bond(spark, root, "20230216").select("issuer")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan and "ReadSchema: struct<issuer:string>" in plan


def test_build_record(spark, bonds, tmp_path):
    root = str(tmp_path)
    notes = snapshots.build_snapshot(bonds(full(), full()), root, "20230216")
    snapshots.record_build(spark, root, "20230216", "2021", notes)
    r = snapshots.builds(spark, root).first()
    assert (r.active_snapshot, r.snapshots) == ("20230216", ["20230216"])
    assert [n.split(":")[0] for n in r.notes] == ["total_assets", "net_assets", "revenue", "net_profit", "leverage"]


def test_export_keeps_order_and_headers(spark, bonds, tmp_path):
    df = bonds(full(issuer="a", issue_amount=1.0), full(issuer="b", issue_amount=2.0)).withColumn("city_fiscal", F.lit(5.0))
    cases = filters.case_list(df, "x")
    export.export_cases(cases, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert [(r["序号"], r["发行人中文名称"], r["发行总额(亿元)"]) for r in back.orderBy("序号").collect()] == [("1", "b", "2.0"), ("2", "a", "1.0")]
    export.export_cases(cases, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2
