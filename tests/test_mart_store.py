"""Marts that follow the fiscal lake, and the note of the active snapshot."""

import os
import threading

import pytest

from bondmarts import storage
from bondmarts.plans import build, serving
from bondmarts.plans.mart_store import ENRICHED, MartStore
from bondmarts.sources import snapshots
from conftest import rows

DATE, YEAR = "20230216", "2021"


def write_text(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def bond(issuer, province, city, **more):
    return {
        "issuer": issuer, "province": province, "city": city, "security_name": "b", "rating": "AA", "issuer_agency": "x,y", "admin_level": "地市级",
        "underwriters": "U,V", "issue_amount": 1.5, "coupon": 2.0, "total_assets": 10.0, **more,
    }


@pytest.fixture
def lake(spark, bonds, tmp_path):
    """Four provinces, one of which shares a city name with another; an issuer with bonds in two provinces."""
    root, folder = str(tmp_path / "lake"), str(tmp_path / "raw")
    df = bonds(
        bond("甲", "四川省", "成都市"), bond("乙", "四川省", "绵阳市", underwriters="V"), bond("丙", "浙江省", "杭州市"), bond("丁", "江苏省", "南京市"),
        bond("丁", "山东省", "济南市", underwriters="W"), bond("戊", "山东省", "济南市", rating=" "), bond("己", "福建省", "同名市"), bond("庚", "云南省", "同名市"),
        bond("辛", "a/b 省", "远市"),
    )
    snapshots.write_snapshot(df, root, DATE)
    write_text(f"{folder}/2021年四川省财力.csv", "城市,一般公共预算收入\n成都市,1697.9\n绵阳市,150\n")
    write_text(f"{folder}/2021年云南省财力.csv", "城市,一般公共预算收入\n同名市,120\n")
    write_text(f"{folder}/2021年江苏省财力.csv", "城市,一般公共预算收入\n南京市,1\n南京市,2\n")  # fails: city repeated
    return root, folder


def load(spark, root, folder):
    snapshots.write_fiscal(snapshots.read_fiscal_files(spark, folder, YEAR), root)


def full(spark, root):
    fiscal = snapshots.fiscal(spark, root).filter(f"fiscal_year = '{YEAR}'")
    return serving.marts(snapshots.bond(spark, root, DATE).drop("snapshot_date"), fiscal)


def same_as_computed(spark, root, store, key):
    """Every view, written in part or at once, has the rows that a computation of all has."""
    computed = full(spark, root)
    for view, df in store.tables(key).items():
        assert df.columns == computed[view].columns, view
        assert rows(df) == rows(computed[view]), view


def written_files(store):
    return {os.path.join(f, n): os.stat(os.path.join(f, n)).st_mtime_ns for f, _, names in os.walk(store.path) for n in names if n.endswith(".parquet") and "manifest" not in f}


def test_a_province_that_fails_first_and_is_mended(spark, lake):
    root, folder = lake
    store = MartStore(spark, root, DATE, YEAR)
    load(spark, root, folder)
    first = store.write(serving.marts)
    same_as_computed(spark, root, store, first)
    assert rows(store.table(store.manifest(first)[ENRICHED]).filter("city_fiscal is null"), "issuer") == [("丁",), ("丙",), ("辛",)]
    before, files = store.manifest(first), written_files(store)
    write_text(f"{folder}/2021年江苏省财力.csv", "城市,一般公共预算收入\n南京市,1700.5\n")
    load(spark, root, folder)
    second = store.write(serving.marts)
    assert second != first
    same_as_computed(spark, root, store, second)
    after = store.manifest(second)
    changed = {view: {store.table(after[view], [p]).first().province for p, k in after[view].parts.items() if before[view].parts.get(p) != k} for view in after}
    assert changed == {
        **{view: {"江苏省"} for view in ("v_fiscal", ENRICHED, "v_issuer_profile", "v_agency_competitive_landscape", "v_city_credit_overview")},
        # The issuer has a bond in another province too, whose slice takes the new band.
        "v_underwriter_stats": {"江苏省", "山东省"},
        **{view: set() for view in ("v_agency_market_share", "v_financial_bench", "v_partner_network", "v_province_kpi", serving.CUBE)},
    }
    now = written_files(store)
    assert files.items() <= now.items()


def test_a_late_file_reaches_a_city_of_that_name_elsewhere(spark, lake):
    """Revenue is joined on the city's name, and the larger of two revenues counts: both provinces are written again, or none."""
    root, folder = lake
    store = MartStore(spark, root, DATE, YEAR)
    load(spark, root, folder)
    first = store.manifest(store.write(serving.marts))
    write_text(f"{folder}/2021年福建省财力.csv", "城市,一般公共预算收入\n同名市,300\n")
    load(spark, root, folder)
    key = store.write(serving.marts)
    same_as_computed(spark, root, store, key)
    second = store.manifest(key)
    assert sum(first[ENRICHED].parts[p] != k for p, k in second[ENRICHED].parts.items()) == 2
    write_text(f"{folder}/2021年贵州省财力.csv", "城市,一般公共预算收入\n同名市,5\n")
    load(spark, root, folder)
    key = store.write(serving.marts)
    same_as_computed(spark, root, store, key)
    assert store.manifest(key)[ENRICHED].parts == second[ENRICHED].parts


def test_no_fiscal_data_at_first(spark, lake):
    root, folder = lake
    serving.activate(spark, root, DATE, YEAR)
    assert spark.table("v_fiscal").count() == 0 and spark.table(ENRICHED).filter("`城市财力_亿元` is not null").count() == 0
    load(spark, root, folder)
    assert serving.resume(spark, root) == DATE
    assert spark.table("v_fiscal").count() == 3 and spark.table(ENRICHED).filter("`城市财力_亿元` is not null").count() == 4
    store = MartStore(spark, root, DATE, YEAR)
    same_as_computed(spark, root, store, store.write(serving.marts))


def test_an_unfinished_refresh_changes_nothing_and_is_done_again(spark, lake, monkeypatch):
    root, folder = lake
    store = MartStore(spark, root, DATE, YEAR)
    load(spark, root, folder)
    first = store.write(serving.marts)
    write_text(f"{folder}/2021年浙江省财力.csv", "城市,一般公共预算收入\n杭州市,2386.6\n")
    load(spark, root, folder)
    with monkeypatch.context() as broken:
        broken.setattr(MartStore, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.write(serving.marts)
    assert rows(store.tables(first)[ENRICHED].filter("issuer = '丙'"), "city_fiscal") == [(None,)]
    second = store.write(serving.marts)
    same_as_computed(spark, root, store, second)
    assert rows(store.tables(second)[ENRICHED].filter("issuer = '丙'"), "city_fiscal") == [(2386.6,)]


def test_a_switch_computes_no_mart(spark, lake):
    """Before marts are written every view is a plan with the same rows; once they are, the views read them."""
    root, folder = lake
    load(spark, root, folder)
    store = MartStore(spark, root, DATE, YEAR)
    stored = len(storage.list_names(spark, storage.shared_dir(spark)))
    serving.activate(spark, root, DATE, YEAR, labelled=False)
    assert not storage.exists(spark, f"{root}/marts") and not store.written()
    assert len(storage.list_names(spark, storage.shared_dir(spark))) == stored
    computed = full(spark, root)
    for view in serving.VIEW_LABELS:
        assert spark.table(view).columns == computed[view].columns and spark.table(view).dtypes == computed[view].dtypes, view
        assert rows(spark.table(view)) == rows(computed[view]), view
    serving.write_marts(spark, root, DATE, YEAR)
    serving.activate(spark, root, DATE, YEAR, labelled=False)
    for view in serving.VIEW_LABELS:
        assert rows(spark.table(view)) == rows(computed[view]), view
    assert store.written() and all(f"{store.path}/v_partner_network" in f for f in spark.table("v_partner_network").inputFiles())


def test_scoring_writes_the_cube_alone(spark, lake):
    """The marts take over a cube that was written by itself, and a cube written with the marts is not written again."""
    root, folder = lake
    load(spark, root, folder)
    store = MartStore(spark, root, DATE, YEAR)
    cube = rows(serving.write_cube(spark, root, DATE, YEAR))
    assert cube == rows(full(spark, root)[serving.CUBE]) and not store.written()
    assert storage.list_names(spark, store.path) == [serving.CUBE, "manifest_of"]
    files = written_files(store)
    key = store.write(serving.marts)
    same_as_computed(spark, root, store, key)
    now = written_files(store)
    assert files.items() <= now.items() and [f for f in now if f"/{serving.CUBE}/" in f and f not in files] == []
    assert rows(serving.write_cube(spark, root, DATE, YEAR)) == cube and written_files(store) == now


def test_switches_at_once_have_numbers_of_their_own(spark, tmp_path):
    root, numbers = str(tmp_path), []
    threads = [threading.Thread(target=lambda i=i: numbers.append((snapshots.set_active(spark, root, f"2023010{i}", YEAR), f"2023010{i}"))) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n, _ in numbers) == [1, 2, 3, 4, 5, 6]
    assert snapshots.active(spark, root) == (max(numbers)[1], YEAR)
    # A switch that died while it wrote its note was never made.
    assert storage.create(spark, f"{root}/active/{7:012d}.json", '{"date": "2024')
    assert snapshots.active(spark, root) == (max(numbers)[1], YEAR)
    assert snapshots.set_active(spark, root, "20240101") == 8 and snapshots.active(spark, root) == ("20240101", None)


def test_a_file_is_created_once(spark, tmp_path):
    path = str(tmp_path / "a" / "note")
    assert storage.create(spark, path, "é\n") and not storage.create(spark, path, "other")
    assert storage.read_text(spark, path) == "é\n"


def test_build_follows_the_files(spark, lake, tmp_path):
    """The same bond file with one fiscal file more: served at once by the second build."""
    root, folder = str(tmp_path / "again"), lake[1]
    bond_folder = str(tmp_path / "bond")
    headers = {
        "issuer": "发行人中文名称", "province": "省份", "city": "城市", "admin_level": "城投行政级别(Wind)", "rating": "主体评级", "issuer_agency": "主体评级机构",
        "security_name": "证券简称", "security_code": "证券代码",
    }
    raw = snapshots.bond(spark, lake[0], DATE).filter("rating = 'AA'").select(*headers).withColumnsRenamed(headers)
    raw.write.parquet(f"{bond_folder}/债券_{DATE}.parquet")
    build.build(spark, root, bond_folder, folder, YEAR)
    assert rows(spark.table(ENRICHED).filter("`省份` = '浙江省'"), "城市财力_亿元") == [(None,)]
    write_text(f"{folder}/2021年浙江省财力.csv", "城市,一般公共预算收入\n杭州市,2386.6\n")
    build.build(spark, root, bond_folder, folder, YEAR)
    assert rows(spark.table(ENRICHED).filter("`省份` = '浙江省'"), "城市财力_亿元") == [(2386.6,)]
