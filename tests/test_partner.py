import parity
from bondmarts.operators import partner
from conftest import rows

BASE = {"province": "P", "city": "C", "rating": "AA", "admin_level": "地市级"}


def bond(issuer, underwriters, **more):
    return {**BASE, "issuer": issuer, "underwriters": underwriters, **more}


def network_bonds(bonds):
    return bonds(
        bond("甲", "U, V", issuer_agency="x"), bond("乙", "U", issuer_agency="x,y"), bond("丙", "U", bond_agency="x"),
        bond("丙", "U", bond_agency="x"), bond("丁", "W"), bond("戊", "U", rating=" ", issuer_agency="x"),
        bond("甲", "V", province="Q", issuer_agency="x"), bond("己", None, issuer_agency="x"), bond("庚", "U", province=None, issuer_agency="x"),
    )


def test_partner_network(spark, bonds):
    got = partner.partner_network(network_bonds(bonds), lists=True)
    assert rows(got, "province", "agency", "underwriter", "total_issuers", "total_list", "shared_issuers", "shared_list", "grade") == [
        ("P", "x", "U", 3, "丙、乙、甲", 3, "丙、乙、甲", "主要合作伙伴"),
        ("P", "x", "V", 1, "甲", 1, "甲", "初步合作对象"),
        ("P", "y", "U", 3, "丙、乙、甲", 1, "乙", "初步合作对象"),
        ("P", "未知评级机构", "W", 1, "丁", 0, "", "待开拓合作关系"),
        ("Q", "x", "V", 1, "甲", 1, "甲", "初步合作对象"),
    ]
    assert [r.underwriter for r in partner.partner_listing(got).filter("province = 'P'").collect()] == ["U", "U", "V", "W"]


def test_counts_only_network_has_the_same_numbers(spark, bonds):
    df = network_bonds(bonds)
    columns = ["province", "agency", "underwriter", "total_issuers", "shared_issuers", "grade"]
    counts = partner.partner_network(df)
    assert counts.columns == columns
    assert rows(counts) == rows(partner.partner_network(df, lists=True), *columns)
    assert rows(partner.shared_clients(df).groupBy("province", "agency", "underwriter").count(), "agency", "underwriter", "count") == sorted(
        [("x", "U", 3), ("x", "V", 1), ("y", "U", 1), ("x", "V", 1)], key=repr
    )


def test_grade_threshold_is_a_parameter(spark, bonds):
    got = partner.partner_network(network_bonds(bonds), main_at=1, lists=False)
    assert {r.grade for r in got.collect()} == {"主要合作伙伴", "待开拓合作关系"}


def test_blank_names_stay_in_the_network(spark, bonds):
    got = partner.partner_network(bonds(bond("甲", "U,", issuer_agency="x, ")), lists=False)
    assert rows(got, "agency", "underwriter") == [("", ""), ("", "U"), ("x", ""), ("x", "U")]


def test_agency_partners(spark, bonds):
    df = bonds(
        bond("甲", "U,V,", issuer_agency="大x公司"), bond("乙", "U", bond_agency="y,大x公司"), bond("乙", "W"), bond("丙", "W", issuer_agency="y"),
        bond("丁", "V", issuer_agency="大x公司", admin_level="省级"), bond("戊", "Z", rating=None),
    )
    found, clients = partner.agency_partners(df, "大x", main_at=2, lists=True)
    assert rows(clients) == [("P", "丁"), ("P", "乙"), ("P", "甲")]
    assert rows(found) == [
        ("P", "U", 2, 2, "乙、甲", "主要合作伙伴"), ("P", "V", 2, 2, "丁、甲", "主要合作伙伴"),
        ("P", "W", 2, 1, "乙", "初步合作对象"), ("P", "Z", 1, 0, "", "待开拓合作关系"),
    ]
    sliced, own = partner.agency_partners(df, "大x", lists=False, admin_level="省级")
    assert (rows(sliced, "underwriter", "shared_issuers"), rows(own, "issuer")) == ([("V", 1)], [("丁",)])


def test_merged_clients(spark):
    df = spark.createDataFrame([("U", 3), ("U", 2), ("V", 1), ("W", 1)], "underwriter string, total_issuers int")
    names = spark.createDataFrame([("U", "甲"), ("U", "乙"), ("U", "乙"), ("U", "丙")], "underwriter string, issuer string")
    assert rows(partner.merged_clients(df, names)) == [("U", 3, 3, "主要合作伙伴"), ("V", 1, 0, "待开拓合作关系"), ("W", 1, 0, "待开拓合作关系")]


def test_advice_keeps_all_unless_asked(spark):
    data = [("P", f"m{i:02d}", 5, 4, "主要合作伙伴") for i in range(10)] + [("P", f"u{i:02d}", i, 0, "待开拓合作关系") for i in range(12)]
    df = spark.createDataFrame(data, "province string, underwriter string, total_issuers int, shared_issuers int, grade string")
    assert partner.advice(df).count() == 22
    got = partner.advice(df, first=8)
    assert got.filter("grade = '主要合作伙伴'").count() == 10
    assert rows(got.filter("shared_issuers = 0"), "underwriter") == [(f"u{i:02d}",) for i in range(4, 12)]


def test_names_behind_the_merged_counts(spark):
    names = spark.createDataFrame([("P", "U", "a"), ("Q", "U", "a"), ("Q", "U", "b"), ("P", "V", "a")], "province string, underwriter string, issuer string")
    assert rows(partner.merged_names(names)) == [("U", "a"), ("U", "b"), ("V", "a")]
    assert {"client_names", "merged_names"} <= set(parity.QUERIES) & set(parity.SQL)


def test_large_lists_are_pages_of_bounded_size(spark, bonds, monkeypatch):
    """A text has at most PAGE names; rows beyond the first of a group carry the next pages, in order and complete."""
    monkeypatch.setattr(partner, "PAGE", 10)
    names = [f"发行人{i:03d}" for i in range(47)]
    df = bonds(*[bond(n, "U,V" if i % 2 else "U", issuer_agency="x" if i % 3 else "y") for i, n in enumerate(names)], bond("独", "W"))
    got = partner.partner_network(df, lists=True)
    found = {(r.agency, r.underwriter, r.page): r for r in got.collect()}
    assert {k[2] for k in found if k[1] == "U"} == {1, 2, 3, 4, 5} and {k[2] for k in found if k[1] == "V"} == {1, 2, 3} and len(found) == 5 * 2 + 3 * 2 + 1
    assert all(len(t.split("、")) <= 10 for r in found.values() for t in (r.total_list, r.shared_list))
    for agency, rest in (("x", (1, 2)), ("y", (0,))):
        text = [found[agency, "U", p].shared_list for p in range(1, 6)]
        assert [n for t in text if t for n in t.split("、")] == [n for i, n in enumerate(names) if i % 3 in rest]
        assert [n for p in range(1, 6) for n in found[agency, "U", p].total_list.split("、")] == names
    first = got.filter("page = 1").drop("page", "total_list", "shared_list")
    assert rows(first) == rows(partner.partner_network(df).select(*first.columns))


def test_lists_of_an_underwriter_come_from_one_shuffle_without_joins(spark, bonds, monkeypatch):
    df = bonds(*[bond(f"i{i:02d}", "U,V" if i % 2 else "U", issuer_agency="x" if i % 3 else "y") for i in range(30)], bond("独", "W"))
    got = partner.partner_network(df, lists=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    # Underwriters of more pairs than TASK go by pages of a numbered table: the same rows.
    monkeypatch.setattr(partner, "PAGE", 7)
    paged = rows(partner.partner_network(df, lists=True))
    for most in (1, 20, 50):
        monkeypatch.setattr(partner, "TASK", most)
        assert rows(partner.partner_network(df, lists=True)) == paged
    assert partner.partner_network(df.limit(0), lists=True).count() == 0


def test_planned_lists_are_the_stored_ones(spark, bonds, monkeypatch):
    """Pages, underwriters without agency, blank names and repeated and nameless bonds: the same rows without any table written."""
    df = bonds(
        *[bond(f"i{i:02d}", "U,V" if i % 2 else "U", issuer_agency="x" if i % 3 else "y", bond_agency="z," if i < 4 else None) for i in range(30)],
        bond("i01", "U, U", issuer_agency="x"), bond("独", "W"), bond("独", "W,"), bond(None, "U", issuer_agency="x"),
    )
    for page in (1, 7, 10, 1000):
        monkeypatch.setattr(partner, "PAGE", page)
        stored = partner.partner_network(df, lists=True)
        planned = partner.partner_network(df, lists=True, stored=False)
        assert planned.columns == stored.columns and rows(planned) == rows(stored)


def test_hot_issuers_give_each_pair_once(spark, bonds, monkeypatch):
    """An issuer of many underwriters and agencies, dealt into parts, beside light ones and one without name."""
    agencies, names = ",".join(f"a{i}" for i in range(7)), ",".join(f"U{i}" for i in range(25))
    df = bonds(bond("热", names, issuer_agency=agencies), bond("热", "U3,U30", bond_agency="a1,b"), bond("冷", "U1", issuer_agency="a1"), bond(None, names, issuer_agency=agencies))
    plain = rows(partner.shared_clients(df), "province", "underwriter", "agency", "issuer")
    monkeypatch.setattr(partner, "BLOCK", 4)
    dealt = partner.shared_clients(df)
    assert rows(dealt, "province", "underwriter", "agency", "issuer") == plain and len(plain) == len(set(plain)) == 26 * 8 + 1
    hot = rows(partner._hot_issuers(partner.scope(df)), "issuer", "parts", "agency_parts")
    assert hot == [("热", 7, 3)]
    # No more issuers are told to all tasks than the limit, whatever the block.
    monkeypatch.setattr(partner, "HOT", 0)
    assert partner._hot_issuers(partner.scope(df)).count() == 0
    assert rows(partner.shared_clients(df), "province", "underwriter", "agency", "issuer") == plain
