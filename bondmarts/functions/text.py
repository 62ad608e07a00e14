"""Text expressions: trimming, label lookups, names and comma lists."""

from pyspark.sql import Column, functions as F

from bondmarts.constants import (
    AGENCY_NAMES,
    AGENCY_SHORT_NAMES,
    LEVEL_RANK,
    LEVEL_SUFFIX,
    LIST_MARK,
    LONG_CITY_NAMES,
    PROVINCE_SUFFIXES,
    RATING_RANK,
)

# Unicode space separators: what SQL TRIM removes in the results to match. Spark's trim knows only U+0020.
SPACES = "\u0020\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
# All Unicode white space, line breaks and separators included.
WHITE_SPACE = SPACES + "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"


def trim_spaces(c) -> Column:
    return F.btrim(c, F.lit(SPACES))


def strip_text(c) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def not_blank(c) -> Column:
    """Present and more than spaces; never null itself."""
    return F.coalesce(trim_spaces(c) != "", F.lit(False))


def lookup(c, table: dict) -> Column:
    """Value of a small literal table, null when the key is missing."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(c) if isinstance(c, str) else c)


def normalize_agency(c) -> Column:
    """Full agency name for any known spelling of the whole cell; other names only lose outer space."""
    name = strip_text(c)
    return F.coalesce(lookup(name, AGENCY_NAMES), name)


def agency_short(c) -> Column:
    return F.coalesce(lookup(c, AGENCY_SHORT_NAMES), F.substring(c, 1, 4))


def city_short(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    label = F.substring(c, 1, 2)
    for name in reversed(LONG_CITY_NAMES):
        label = F.when(c.contains(name), F.lit(name)).otherwise(label)
    return label


def province_key(c) -> Column:
    """Province without its kind, so 四川省 and 四川 are one; a name that is only a kind stays."""
    name = strip_text(c)
    return F.regexp_replace(name, f"(?<=.)({'|'.join(PROVINCE_SUFFIXES)})$", "")


def with_level_suffix(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~c.endswith(LEVEL_SUFFIX), F.concat(c, F.lit(LEVEL_SUFFIX))).otherwise(c)


def level_rank(c) -> Column:
    return F.coalesce(lookup(c, LEVEL_RANK), F.lit(0))


def rating_rank(c) -> Column:
    return F.coalesce(lookup(c, RATING_RANK), F.lit(0))


def joined_names(c) -> Column:
    """Aggregate: distinct names in order, as one text."""
    return F.array_join(F.sort_array(F.collect_set(c)), LIST_MARK)
