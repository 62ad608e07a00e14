"""Filters, joins, issuers, lists and sets."""

from pyspark.sql import Window as W, functions as F

from bondmarts import storage
from bondmarts.operators import agency, city, filters, issuers, lists, partner, ranking, underwriter
from bondmarts.sources import snapshots
from parity import projection as P
from parity.base import query

OWN = "中诚信国际信用评级有限责任公司"
_LISTING = "city_fiscal DESC NULLS LAST, level_rank DESC, rating_rank DESC"


def with_fiscal(spark, sf):
    return issuers.with_city_fiscal(P.bond(spark, sf), P.fiscal(spark, sf), ("province", "city"))


def enriched(spark, sf):
    return issuers.enriched(P.bond(spark, sf), P.fiscal(spark, sf))


@query("province_slice", "SELECT security_code, province, city FROM bond WHERE province = 'ASIA'")
def _(spark, sf):
    return filters.province_slice(P.bond(spark, sf), "ASIA").select("security_code", "province", "city")


@query(
    "optional_equality",
    "SELECT security_code, issuer, city, rating, admin_level FROM bond WHERE rating = 'AA' AND admin_level = '地市级'",
)
def _(spark, sf):
    bonds = filters.filter_eq(P.bond(spark, sf), city="", rating="AA", admin_level="地市级", province=None)
    return bonds.select("security_code", "issuer", "city", "rating", "admin_level")


@query("rated_issuers", "SELECT security_code, issuer, rating FROM rated")
def _(spark, sf):
    return filters.rated(P.bond(spark, sf)).select("security_code", "issuer", "rating")


@query(
    "agency_clients",
    "SELECT DISTINCT issuer FROM bond WHERE contains(issuer_agency, '鹏元') OR contains(bond_agency, '鹏元')",
)
def _(spark, sf):
    return filters.agency_clients(P.bond(spark, sf), "鹏元")


@query(
    "agency_client_counts",
    """SELECT province, count(DISTINCT issuer) AS client_issuers FROM bond
    WHERE contains(issuer_agency, '鹏元') OR contains(bond_agency, '鹏元') GROUP BY province""",
)
def _(spark, sf):
    return filters.agency_client_counts(P.bond(spark, sf), "鹏元")


@query(
    "case_list",
    f"""SELECT province, row_number() OVER (PARTITION BY province ORDER BY {_LISTING}, issue_amount DESC NULLS LAST, security_code) AS seq,
        issuer, city, city_fiscal, admin_level, rating, security_code, security_name, underwriters, bond_class,
        issue_amount, coupon
    FROM bond_fiscal WHERE contains(issuer_agency, '中诚信国际')""",
)
def _(spark, sf):
    return filters.case_list(with_fiscal(spark, sf), "中诚信国际")


@query(
    "issuer_list",
    f"""SELECT *, row_number() OVER (PARTITION BY province ORDER BY {_LISTING}, total_assets DESC NULLS LAST, issuer) AS seq
    FROM enriched WHERE admin_level = '地市级'""",
)
def _(spark, sf):
    return filters.issuer_list(enriched(spark, sf), admin_level="地市级", rating="")


@query(
    "case_lists_indexed",
    f"""SELECT wanted, province, row_number() OVER (PARTITION BY wanted, province ORDER BY {_LISTING}, issue_amount DESC NULLS LAST, security_code) AS seq,
        issuer, rating, security_code, issue_amount
    FROM bond_fiscal JOIN (VALUES ('中诚信国际', ''), ('鹏元', 'AA'), ('大公国际', '')) AS w(wanted, rated) ON contains(issuer_agency, wanted)
        AND (rated = '' OR rating = rated)""",
)
def _(spark, sf):
    """Case lists of three agencies from one sort of the bonds."""
    index = filters.case_index(with_fiscal(spark, sf))
    columns = ["province", "seq", "issuer", "rating", "security_code", "issue_amount"]
    lists = [
        index.listing(filters.is_case(name, rating=rating)).select(F.lit(name).alias("wanted"), *columns)
        for name, rating in (("中诚信国际", ""), ("鹏元", "AA"), ("大公国际", None))
    ]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


@query(
    "case_page",
    f"""SELECT * FROM (SELECT province, row_number() OVER (ORDER BY {_LISTING}, issue_amount DESC NULLS LAST, security_code) AS seq,
        issuer, city, city_fiscal, admin_level, rating, security_code, security_name, underwriters, bond_class, issue_amount, coupon
    FROM bond_fiscal WHERE contains(issuer_agency, '中诚信国际') AND province = 'ASIA') WHERE seq BETWEEN 51 AND 150""",
)
def _(spark, sf):
    """The second and third page of fifty of one agency's cases in one province."""
    index = filters.case_index(with_fiscal(spark, sf))
    page = index.page(51, 100, {"province": "ASIA"}, filters.is_case("中诚信国际"))
    return page.select("province", "seq", *filters.CASE_COLUMNS)


@query(
    "issuer_lists_indexed",
    f"""SELECT part, province, issuer, row_number() OVER (PARTITION BY part, province ORDER BY {_LISTING}, total_assets DESC NULLS LAST, issuer) AS seq
    FROM enriched JOIN (VALUES ('all', ''), ('AA', 'AA')) AS w(part, wanted) ON wanted = '' OR rating = wanted
    UNION ALL SELECT 'page', province, issuer, seq FROM (SELECT province, issuer,
        row_number() OVER (ORDER BY {_LISTING}, total_assets DESC NULLS LAST, issuer) AS seq FROM enriched WHERE province = 'EUROPE') WHERE seq BETWEEN 11 AND 30""",
)
def _(spark, sf):
    """All issuers, those of one rating and a page of one province from one sort."""
    index = filters.issuer_index(enriched(spark, sf))
    parts = {"all": index.listing(), "AA": index.listing(filters.matches(rating="AA")), "page": index.page(11, 20, {"province": "EUROPE"})}
    named = [rows.select(F.lit(part).alias("part"), "province", "issuer", F.col("seq").cast("long").alias("seq")) for part, rows in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    "financial_coverage",
    """SELECT province, count(*) AS issuers, count(*) FILTER (WHERE total_assets > 0) AS with_financials,
        CAST(count(*) FILTER (WHERE total_assets > 0) * 100 AS DOUBLE) / count(*) AS coverage_pct
    FROM enriched GROUP BY province""",
)
def _(spark, sf):
    return filters.financial_coverage(enriched(spark, sf))


@query("fiscal_point", "SELECT city, revenue FROM fiscal WHERE province = 'ASIA'")
def _(spark, sf):
    return snapshots.fiscal(spark, P.warehouse(spark, sf), "ASIA").select("city", "revenue")


# --- joins -----------------------------------------------------------------------------------------


@query("enriched_issuers", "SELECT * FROM enriched")
def _(spark, sf):
    return enriched(spark, sf)


@query("bond_fiscal_join", "SELECT security_code, province, city, city_fiscal FROM bond_fiscal")
def _(spark, sf):
    return with_fiscal(spark, sf).select("security_code", "province", "city", "city_fiscal")


@query(
    "bond_band_join",
    """SELECT security_code, b.issuer, coalesce(fiscal_band, '财力未知') AS fiscal_band
    FROM bond b LEFT JOIN enriched e ON b.issuer = e.issuer""",
)
def _(spark, sf):
    bonds = P.bond(spark, sf).select("security_code", "issuer")
    return underwriter.with_band(bonds, enriched(spark, sf))


@query(
    "city_rank_join",
    """SELECT d.province, d.city, rating, rating_issuers, city_issuers, city_fiscal, fiscal_rank, cities FROM
    (SELECT province, city, rating, count(*) AS rating_issuers,
        CAST(sum(count(*)) OVER (PARTITION BY province, city) AS BIGINT) AS city_issuers
     FROM enriched GROUP BY province, city, rating) d
    JOIN (SELECT province, city, city_fiscal,
        dense_rank() OVER (PARTITION BY province ORDER BY city_fiscal DESC NULLS LAST) AS fiscal_rank,
        count(*) OVER (PARTITION BY province) AS cities
     FROM enriched GROUP BY province, city, city_fiscal) r ON d.province = r.province AND d.city = r.city""",
)
def _(spark, sf):
    cells = storage.store(city.rating_levels(enriched(spark, sf)))
    return city.rating_totals(cells).join(city.city_ranks(cells), ["province", "city"])


_SCOPE = "SELECT * FROM rated WHERE province IS NOT NULL AND underwriters IS NOT NULL AND underwriters <> ''"
_UNDERWRITERS = "SELECT DISTINCT province, issuer, trim(unnest(string_split(underwriters, ','))) AS underwriter FROM scope"
_AGENCIES = """SELECT province, issuer, trim(unnest(string_split(issuer_agency, ','))) AS agency FROM scope
    WHERE issuer_agency IS NOT NULL AND issuer_agency <> ''
    UNION SELECT province, issuer, trim(unnest(string_split(bond_agency, ','))) AS agency FROM scope
    WHERE bond_agency IS NOT NULL AND bond_agency <> ''"""
NETWORK = {"scope": _SCOPE, "uw": _UNDERWRITERS, "ag": _AGENCIES}


@query(
    "shared_client_join",
    """SELECT province, agency, count(*) AS pairs, count(DISTINCT issuer) AS issuers,
        count(DISTINCT underwriter) AS underwriters
    FROM uw JOIN ag USING (province, issuer) GROUP BY province, agency""",
    NETWORK,
)
def _(spark, sf):
    shared = partner.shared_clients(P.bond(spark, sf))
    return shared.groupBy("province", "agency").agg(
        F.count("*").alias("pairs"), F.count_distinct("issuer").alias("issuers"),
        F.count_distinct("underwriter").alias("underwriters"),
    )


@query(
    "issuer_bond_counts",
    """SELECT agency, province, count(DISTINCT issuer) AS issuers, count(*) AS bonds,
        round(count(DISTINCT issuer) * 100.0 / nullif(sum(count(DISTINCT issuer)) OVER (PARTITION BY province), 0), 1) AS issuer_share_pct,
        round(CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT issuer), 0), 2) AS bonds_per_issuer,
        row_number() OVER (PARTITION BY province ORDER BY count(DISTINCT issuer) DESC, agency) AS seq
    FROM (SELECT province, issuer, trim(issuer_agency) AS agency FROM bond) WHERE agency <> '' GROUP BY agency, province""",
)
def _(spark, sf):
    return agency.agency_ranking(agency.agency_market_share(P.bond(spark, sf), drop_blank=True))


@query(
    "located_cities",
    "SELECT DISTINCT e.city, lon, lat FROM enriched e JOIN coords c ON e.city = c.city",
)
def _(spark, sf):
    return enriched(spark, sf).select("city").distinct().join(P.coords(spark, sf), "city")


@query(
    "empty_cities",
    """SELECT city FROM (SELECT city FROM enriched UNION SELECT city FROM fiscal) WHERE city NOT IN
    (SELECT city FROM enriched WHERE admin_level = '省级' AND rating = 'A+')""",
)
def _(spark, sf):
    return city.empty_cities(enriched(spark, sf), P.fiscal(spark, sf), admin_level="省级", rating="A+")


# --- issuers ---------------------------------------------------------------------------------------


@query(
    "issuer_dedup",
    "SELECT issuer, security_code, province, admin_level, level_rank, issuer_agency FROM deduped",
)
def _(spark, sf):
    columns = ["issuer", "security_code", "province", "admin_level", "level_rank", "issuer_agency"]
    return issuers.first_bond(filters.rated(P.bond(spark, sf)).select(*columns))


@query(
    "issuer_view",
    f"""SELECT issuer, issuer_short, controller, province, city, admin_level, rating, issuer_agency, total_assets,
        net_assets, revenue, net_profit, leverage, report_date, level_rank, rating_rank, city_fiscal,
        row_number() OVER (PARTITION BY province ORDER BY {_LISTING}, total_assets DESC NULLS LAST, issuer) AS seq
    FROM (SELECT * FROM bond_fiscal WHERE rating IS NOT NULL AND trim(rating) <> ''
        QUALIFY row_number() OVER (PARTITION BY province, issuer ORDER BY level_rank DESC, security_code) = 1)""",
)
def _(spark, sf):
    return issuers.issuer_view(with_fiscal(spark, sf))


@query("city_max_fiscal", "SELECT city, city_fiscal FROM city_fiscal")
def _(spark, sf):
    return issuers.city_fiscal(P.fiscal(spark, sf))


@query("fiscal_bands", "SELECT fiscal_band, count(*) AS issuers FROM enriched GROUP BY fiscal_band")
def _(spark, sf):
    return enriched(spark, sf).groupBy("fiscal_band").agg(F.count("*").alias("issuers"))


@query("issuer_profile", "SELECT * FROM enriched")
def _(spark, sf):
    return issuers.issuer_profile(enriched(spark, sf))


@query(
    "nulls_last_sort",
    """SELECT *, row_number() OVER (ORDER BY city_fiscal DESC NULLS LAST, level_rank DESC, rating_rank DESC, total_assets DESC NULLS LAST, issuer) AS place
    FROM enriched""",
)
def _(spark, sf):
    order = [*filters.strongest_first("total_assets"), F.col("issuer")]
    return ranking.numbered(issuers.issuer_profile(enriched(spark, sf)), order, name="place")


# --- lists and sets --------------------------------------------------------------------------------


@query(
    "split_underwriters",
    "SELECT security_code, trim(unnest(string_split(underwriters, ','))) AS underwriter FROM bond",
)
def _(spark, sf):
    return lists.exploded(P.bond(spark, sf).select("security_code", "underwriters"), "underwriters", "underwriter")


@query("split_agencies", "SELECT security_code, trim(unnest(string_split(bond_agency, ','))) AS agency FROM bond")
def _(spark, sf):
    return lists.exploded(P.bond(spark, sf).select("security_code", "bond_agency"), "bond_agency", "agency")


@query(
    "split_name_list",
    "SELECT DISTINCT province, agency, issuer FROM uw JOIN ag USING (province, issuer)",
    NETWORK,
)
def _(spark, sf):
    network = partner.partner_network(P.bond(spark, sf), lists=True)
    return lists.list_names(network, "shared_list", ["province", "agency"])


@query("client_union", "SELECT province, issuer, agency FROM ag", NETWORK)
def _(spark, sf):
    return partner.agency_issuers(partner.scope(P.bond(spark, sf)))


@query(
    "set_operations",
    """SELECT coalesce(a.issuer, b.issuer) AS issuer,
        CASE WHEN b.issuer IS NULL THEN 'a' WHEN a.issuer IS NULL THEN 'b' ELSE 'both' END AS side
    FROM (SELECT DISTINCT issuer FROM bond WHERE issuer_agency <> '') a
    FULL JOIN (SELECT DISTINCT issuer FROM bond WHERE bond_agency <> '') b ON a.issuer = b.issuer""",
)
def _(spark, sf):
    bonds = P.bond(spark, sf)
    return lists.key_sets(bonds.filter("issuer_agency != ''"), bonds.filter("bond_agency != ''"), "issuer")


@query(
    "top_rows",
    """SELECT province, underwriter, bonds FROM
    (SELECT province, trim(u) AS underwriter, count(*) AS bonds FROM
        (SELECT province, unnest(string_split(underwriters, ',')) AS u FROM bond) WHERE trim(u) <> '' GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY province ORDER BY bonds DESC, underwriter) <= 8""",
)
def _(spark, sf):
    totals = underwriter.underwriter_province_totals(P.bond(spark, sf)).select("province", "underwriter", "bonds")
    return ranking.top_rows(totals, 8, [F.desc("bonds"), F.col("underwriter")], by=["province"])


@query(
    "top_row",
    """SELECT issuer, count(*) AS bonds FROM bond GROUP BY issuer ORDER BY bonds DESC, issuer LIMIT 1""",
)
def _(spark, sf):
    counts = P.bond(spark, sf).groupBy("issuer").agg(F.count("*").alias("bonds"))
    return ranking.top_rows(counts, 1, [F.desc("bonds"), F.col("issuer")])


@query(
    "category_order",
    """SELECT category, CASE category WHEN 'AAA' THEN 1 WHEN 'AA+' THEN 2 WHEN 'AA' THEN 3 WHEN 'AA-' THEN 4
        WHEN 'A+' THEN 5 END AS category_order, row_number() OVER (ORDER BY min(-rating_rank)) AS place
    FROM (SELECT rating AS category, rating_rank FROM rated) GROUP BY category""",
)
def _(spark, sf):
    shown = agency.categories(with_fiscal(spark, sf), "rating").select("category").distinct()
    ordered = shown.withColumn("category_order", agency.category_order("category", "rating"))
    return ordered.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("category_order")).cast("bigint"))
