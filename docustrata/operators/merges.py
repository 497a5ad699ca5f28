"""Maps put together from entries: of one name the last value counts, or those already there are kept and gaps filled.

Both are aggregates over (key, name) that may be taken in any order and in parts, since an entry's order decides; names stand in the
order in which they first come. ``merged`` does the same for the entries of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound


def last_wins(entries: DataFrame, key: list[str], order: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """(key, name, value, first): of each name the value with the highest order, and the lowest order of the name. Null names are left out."""
    at = F.struct(*order)
    return entries.where(F.col(name).isNotNull()).groupBy(*key, F.col(name).alias("name")).agg(F.max_by(value, at).alias("value"), F.min(at).alias("first"))


def fill_missing(kept: DataFrame, more: DataFrame, key: list[str], empty_too: bool = False) -> DataFrame:
    """(key, name, value, first) of ``kept``, and of ``more`` where ``kept`` lacks the name (or has an empty or null value there, if ``empty_too``)."""
    side = lambda df, n: df.select(*key, "name", "value", F.struct(F.lit(n).alias("side"), "first").alias("first"))
    both = side(kept, 0).unionByName(side(more, 1))
    lacking = F.when(F.lit(empty_too) & (F.coalesce("value", F.lit("")) == ""), 1).otherwise(0)
    return both.groupBy(*key, "name").agg(F.min_by("value", F.struct(lacking, "first")).alias("value"), F.min("first").alias("first"))


def as_map(entries: DataFrame, key: list[str], column: str = "properties") -> DataFrame:
    """(key, map) of entries (key, name, value, first), names by their first order."""
    sorted_ = F.array_sort(F.collect_list(F.struct("first", "name", "value")))
    return entries.groupBy(*key).agg(F.map_from_entries(F.transform(sorted_, lambda e: F.struct(e["name"], e["value"]))).alias(column))


def merged(entries: Column, name: str = "name", value: str = "value") -> Column:
    """Map of a row's array of entries: the last value of each name, names by their first place. One sort, whatever the number of entries."""
    placed = F.sort_array(F.transform(entries, lambda e, i: F.struct(e[name].alias("k"), i.alias("i"), e[value].alias("v"))))
    begins = lambda p, e, i: ~F.get(p, i - 1)["k"].eqNullSafe(e["k"])
    ends = lambda p, e, i: ~F.get(p, i + 1)["k"].eqNullSafe(e["k"])
    pairs = lambda p: F.arrays_zip(F.filter(p, lambda e, i: begins(p, e, i)).alias("a"), F.filter(p, lambda e, i: ends(p, e, i)).alias("b"))
    by_first = F.sort_array(F.transform(bound(placed, pairs), lambda p: F.struct(p["a"]["i"].alias("i"), p["b"]["k"].alias("k"), p["b"]["v"].alias("v"))))
    return F.map_from_entries(F.transform(F.filter(by_first, lambda e: e["k"].isNotNull()), lambda e: F.struct(e["k"], e["v"])))
