"""Which underwriters share clients with which rating agency."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bondmarts import constants as K
from bondmarts.constants import LIST_MARK
from bondmarts.functions.text import joined_names, trim_spaces
from bondmarts.operators.filters import filter_eq, rated
from bondmarts.operators.lists import exploded
from bondmarts.operators.ranking import numbered, top_rows
from bondmarts.storage import store

#: Underwriters or agencies of one issuer that are joined in one task, and hot issuers that are told to all tasks.
BLOCK, HOT = 2_000, 100_000
#: Names in one text.
PAGE = 1_000
#: Pairs whose names one task puts together, and the most of an underwriter that does not go by `name_pages`.
TASK = 250_000


def scope(bond: DataFrame) -> DataFrame:
    """Bonds with province, rating and underwriter."""
    return rated(bond.filter("province is not null and underwriters is not null and underwriters != ''"))


def agency_issuers(bond: DataFrame, with_all: bool = False) -> DataFrame:
    """Distinct province, issuer and agency, from issuer and bond ratings, in one scan.

    with_all adds one row without agency for every issuer.
    """
    none = F.array().cast("array<string>")
    names = [F.when(F.col(c) != "", F.split(c, ",")).otherwise(none) for c in ("issuer_agency", "bond_agency")]
    if with_all:
        names.append(F.array(F.lit(None).cast("string")))
    rows = bond.select("province", "issuer", F.explode(F.concat(*names)).alias("agency"))
    return rows.withColumn("agency", trim_spaces("agency")).distinct()


def underwriter_issuers(bond: DataFrame, drop_blank: bool = False) -> DataFrame:
    """Distinct province, issuer and underwriter."""
    rows = bond.select("province", "issuer", "underwriters")
    return exploded(rows, "underwriters", "underwriter", drop_blank=drop_blank).distinct()


def _hot_issuers(rows: DataFrame) -> DataFrame:
    """(province, issuer, parts, agency_parts) of issuers that may have more than BLOCK underwriters or agencies.

    Going by the names listed in their bonds, repeats included: one sum, combined in the map tasks. There are no more such
    issuers than BLOCK goes into the listed names; BLOCK is doubled until they are at most HOT.
    """
    listed = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.size(F.split(c, ","))).otherwise(0)
    names = {"underwriters": F.sum(listed("underwriters")), "agencies": F.sum(listed("issuer_agency") + listed("bond_agency") + 1)}
    found = rows.filter("issuer IS NOT NULL").groupBy("province", "issuer").agg(*[n.alias(c) for c, n in names.items()])
    block, hot = BLOCK, store(found.filter(F.greatest(*names) > BLOCK))
    while hot.filter(F.greatest(*names) > block).count() > HOT:
        block *= 2
    parts = [F.ceil(F.col(c) / block).alias(a) for c, a in (("underwriters", "parts"), ("agencies", "agency_parts"))]
    return hot.filter(F.greatest(*names) > block).select("province", "issuer", *parts)


def _clients(rows: DataFrame, with_all: bool = False) -> DataFrame:
    """Distinct province, issuer, underwriter and agency, of underwriters and agencies that share an issuer.

    Light issuers are joined plainly. The underwriters of a hot issuer are dealt into parts and so are its agencies; every pair of
    parts is a key of its own, so the issuer's pairs, which may be most of the result, go to many tasks. Both sides
    hold an issuer once per name, so each result row comes out once.
    """
    left, right, key = underwriter_issuers(rows), agency_issuers(rows, with_all), ["province", "issuer"]
    hot = _hot_issuers(rows)
    if hot.isEmpty():
        return left.join(right, key)
    hot = F.broadcast(hot)  # at most HOT rows
    light = left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key)
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    part = lambda name, parts: F.pmod(F.xxhash64(name), F.col(parts))
    dealt_left = left.join(hot, key).select(*key, "underwriter", part("underwriter", "parts").alias("_i"), upto("agency_parts").alias("_j"))
    dealt_right = right.join(hot, key).select(*key, "agency", part("agency", "agency_parts").alias("_j"), upto("parts").alias("_i"))
    heavy = dealt_left.join(dealt_right, [*key, "_i", "_j"]).drop("_i", "_j")
    return light.unionByName(heavy)


def shared_clients(bond: DataFrame) -> DataFrame:
    """Distinct province, agency, underwriter and issuer served by both."""
    return _clients(scope(bond))


def name_pages(pairs: DataFrame, by: Sequence[str], page: int = 0) -> DataFrame:
    """(by, page, names): the issuers of each group in order, joined to texts of at most `page` names (PAGE if 0), pages from 1.

    Groups of up to a page are collected. Larger ones are numbered by the counts of sorted blocks and cut, so no text, row or task
    grows with a group. `pairs` are distinct, and should be stored.
    """
    by, page = list(by), page or PAGE
    large = store(pairs.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > page).select(*[F.col(c).alias(f"_{c}") for c in by]))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    names = joined_names("issuer").alias("names")
    small = pairs.join(large, same, "left_anti").groupBy(*by, F.lit(1).cast("long").alias("page")).agg(names)
    if large.isEmpty():
        return small
    counted = numbered(pairs.join(large, same, "left_semi"), [F.col("issuer")], by=by, name="_seq")
    return small.unionByName(counted.groupBy(*by, F.ceil(F.col("_seq") / page).alias("page")).agg(names))


def grade(shared: Column, main_at: int) -> Column:
    return (
        F.when(shared >= main_at, K.MAIN_PARTNER)
        .when(shared >= K.FIRST_CONTACT_AT, K.FIRST_CONTACT)
        .otherwise(F.lit(K.UNDEVELOPED))
    )


def partner_network(bond: DataFrame, main_at: int = K.MAIN_PARTNER_AT, lists: bool = False, stored: bool = True) -> DataFrame:
    """Clients of each underwriter and those shared with each agency, by province.

    Every issuer has a row without agency beside those of its agencies, so one join and one aggregation give
    the shared clients and, in the group without agency, all clients. The names are rows of `shared_clients` and
    `underwriter_issuers`. With lists, as in the published view, they are also texts of at most PAGE names: a row has
    page 1 of both lists, and only where an underwriter has more clients than that, further rows have the next pages.
    Without `stored` the lists are a plan that runs only when queried.
    """
    if lists and not stored:
        rows = scope(bond)
        pairs = underwriter_issuers(rows).join(agency_issuers(rows, with_all=True), ["province", "issuer"])
        return _graded(_planned(pairs), main_at, lists=True)
    pairs = _clients(scope(bond), with_all=True)
    if not lists:
        return _graded(_placed(pairs), main_at)
    pairs, key = store(pairs), ["province", "underwriter"]
    sizes = store(pairs.groupBy(*key).agg(F.count("*").alias("_pairs")))
    heavy = F.col("_pairs") > TASK
    light, most = sizes.agg(F.coalesce(F.sum(F.when(~heavy, F.col("_pairs"))), F.lit(0)), F.coalesce(F.max("_pairs"), F.lit(0))).first()
    tasks = light // TASK + 1
    if most <= TASK:
        found = _listed(pairs, tasks)
    else:
        large = store(sizes.filter(heavy).select(*key))
        found = _listed(pairs.join(large, key, "left_anti"), tasks).unionByName(_paged(store(pairs.join(large, key, "left_semi"))))
    return _graded(found, main_at, lists=True)


def _placed(pairs: DataFrame) -> DataFrame:
    """(province, underwriter, agency, n, total_issuers) of each agency, and of no agency where an underwriter has none."""
    clients = pairs.groupBy("province", "underwriter", "agency").agg(F.count("*").alias("n"))
    # A window over the few agencies of one underwriter.
    underwriter = W.partitionBy("province", "underwriter")
    total = F.max(F.when(F.col("agency").isNull(), F.col("n"))).over(underwriter)
    placed = clients.select("*", total.alias("total_issuers"), F.count("agency").over(underwriter).alias("_agencies"))
    return placed.filter("agency is not null or _agencies = 0").drop("_agencies")


def _listed(pairs: DataFrame, tasks: int) -> DataFrame:
    """As `_placed`, with the pages of both lists, of underwriters of at most TASK pairs each.

    The pairs are shuffled once, by underwriter: names are collected after that and not in the map tasks, which would sort and spill
    them, and both lists of an underwriter come from the same task, so no text is joined.
    """
    key = ["province", "underwriter"]
    names = pairs.repartition(tasks, *key).groupBy(*key, "agency").agg(F.sort_array(F.collect_list("issuer")).alias("_own"))
    everyone, underwriter = F.col("agency").isNull(), W.partitionBy(*key)
    rows = names.select(
        "*",
        F.max(F.when(everyone, F.col("_own"))).over(underwriter).alias("_all"),
        F.count("agency").over(underwriter).alias("_agencies"),
    ).filter("agency is not null or _agencies = 0")
    pages = F.sequence(F.lit(1), F.ceil(F.size("_all") / PAGE).cast("int"))
    text = lambda c: F.array_join(F.slice(c, (F.col("page") - 1) * PAGE + 1, PAGE), LIST_MARK)
    return rows.select("*", F.explode(pages).alias("page")).select(
        *key, "agency",
        F.size("_own").cast("long").alias("n"),
        F.size("_all").cast("long").alias("total_issuers"),
        text("_all").alias("total_list"),
        F.when(everyone, "").otherwise(text("_own")).alias("shared_list"),
        F.col("page").cast("long").alias("page"),
    )


def _planned(pairs: DataFrame) -> DataFrame:
    """As `_listed`, of underwriters of any size, from pairs that are not stored.

    The pairs are shuffled once, by underwriter, sorted and numbered; a text never holds more than a page, and a task of many pairs spills.
    """
    key = ["province", "underwriter"]
    agency, underwriter = W.partitionBy(*key, "agency"), W.partitionBy(*key)
    everyone, last = F.col("agency").isNull(), F.max("page").over(agency)
    counted = pairs.repartition(*key).withColumn("_seq", F.row_number().over(agency.orderBy("issuer")))
    texts = counted.groupBy(*key, "agency", F.ceil(F.col("_seq") / PAGE).alias("page")).agg(
        joined_names("issuer").alias("_names"), F.count("*").alias("_rows")
    )
    total = F.max(F.when(everyone, F.col("n"))).over(underwriter)
    pages = F.max(F.when(everyone, F.col("page"))).over(underwriter)
    texts = texts.select("*", F.sum("_rows").over(agency).alias("n"), last.alias("_last")).select(
        "*", total.alias("total_issuers"), pages.alias("_pages"), F.max((~everyone).cast("int")).over(underwriter).alias("_agencies")
    )
    # After its last own page an agency has rows without names, up to the last page of all clients.
    ahead = F.when(F.col("page") == F.col("_last"), F.sequence("page", "_pages")).otherwise(F.array("page"))
    rows = texts.select("*", F.posexplode(ahead).alias("_after", "_page"))
    names = F.when(F.col("_after") == 0, F.col("_names")).otherwise("")
    rows = rows.select(*key, "agency", "n", "total_issuers", "_agencies", names.alias("_names"), F.col("_page").alias("page"))
    shown = F.max(F.when(everyone, F.col("_names"))).over(W.partitionBy(*key, "page"))
    rows = rows.withColumn("total_list", shown).filter("agency is not null or _agencies = 0")
    return rows.select(*key, "agency", "n", "total_issuers", "total_list", F.when(everyone, "").otherwise(F.col("_names")).alias("shared_list"), "page")


def _paged(pairs: DataFrame) -> DataFrame:
    """As `_listed`, of underwriters of any size."""
    key = ["province", "underwriter"]
    pages = store(name_pages(pairs, [*key, "agency"]))
    total = pages.filter("agency IS NULL").select(*key, "page", F.col("names").alias("total_list"))
    own = pages.filter("agency IS NOT NULL").withColumnRenamed("names", "shared_list")
    found = _placed(pairs).join(total, key).join(own, [*key, "agency", "page"], "left")
    return found.withColumn("shared_list", F.coalesce("shared_list", F.lit("")))


def _graded(placed: DataFrame, main_at: int, lists: bool = False) -> DataFrame:
    shared = F.when(F.col("agency").isNull(), F.lit(0)).otherwise(F.col("n"))
    return placed.select(
        "province",
        F.coalesce("agency", F.lit(K.UNKNOWN_AGENCY)).alias("agency"),
        "underwriter", "total_issuers",
        *(["total_list"] if lists else []),
        shared.alias("shared_issuers"),
        *(["shared_list"] if lists else []),
        grade(shared, main_at).alias("grade"),
        *(["page"] if lists else []),
    )


def partner_order() -> list[Column]:
    return [F.col("province"), F.desc("shared_issuers"), F.desc("total_issuers"), F.col("agency"), F.col("underwriter")]


def partner_listing(network: DataFrame) -> DataFrame:
    return network.orderBy(*partner_order())


def agency_partners(
    bond: DataFrame, agency: str, main_at: int = K.MAIN_PARTNER_AT, lists: bool = False, by=("province",), **wanted
) -> tuple[DataFrame, DataFrame]:
    """Underwriters seen from one agency, and the agency's client set.

    Clients are issuers whose issuer or bond agency contains the name, within the filtered bonds of a province.
    """
    by = list(by)
    rows = filter_eq(bond, **wanted)
    match = F.coalesce(F.col("issuer_agency").contains(agency) | F.col("bond_agency").contains(agency), F.lit(False))
    clients = rows.filter(match & F.col("issuer").isNotNull()).select(*by, "issuer").distinct()
    listed = rows.filter("underwriters is not null").select(*by, "issuer", "underwriters")
    pairs = exploded(listed, "underwriters", "underwriter", drop_blank=True).distinct()
    flagged = pairs.join(clients.withColumn("mine", F.lit(1)), [*by, "issuer"], "left")
    shared = F.count("mine")
    names = [joined_names(F.when(F.col("mine") == 1, F.col("issuer"))).alias("shared_list")] if lists else []
    found = flagged.groupBy(*by, "underwriter").agg(
        F.count("issuer").alias("total_issuers"),
        shared.alias("shared_issuers"),
        *names,
    )
    return found.withColumn("grade", grade(F.col("shared_issuers"), main_at)), clients


def merged_clients(network: DataFrame, shared: DataFrame, by=("underwriter",), main_at: int = K.MAIN_PARTNER_AT) -> DataFrame:
    """Clients of several slices merged per underwriter and counted again.

    `shared` are the clients of the same slices as rows, see `shared_clients`; an issuer counts once per row of the result.
    """
    most = network.groupBy(*by).agg(F.max("total_issuers").alias("total_issuers"))
    merged = merged_names(shared, by).groupBy(*by).agg(F.count("issuer").alias("n"))
    count = F.coalesce("n", F.lit(0)).cast("long")
    return most.join(merged, list(by), "left").select(*by, "total_issuers", count.alias("shared_issuers"), grade(count, main_at).alias("grade"))


def merged_names(shared: DataFrame, by=("underwriter",)) -> DataFrame:
    """The names behind the shared clients of `merged_clients`, each once per row of its result."""
    return shared.select(*by, "issuer").distinct()


def advice(partners: DataFrame, by=("province",), first: int | None = None) -> DataFrame:
    """Partners to talk to: all main and first contacts, and the undeveloped ones, all or the first few of each slice."""
    order = [F.desc("shared_issuers"), F.desc("total_issuers"), F.col("underwriter")]
    found = partners.select(*by, "grade", "underwriter", "total_issuers", "shared_issuers")
    if first is None:
        return found
    others = top_rows(found.filter(F.col("grade") == K.UNDEVELOPED), first, order, by)
    return found.filter(F.col("grade") != K.UNDEVELOPED).unionByName(others)
