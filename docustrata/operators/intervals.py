"""Joins by place: points in intervals, and the n-th of one list with the n-th of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound


def interval_join(points: DataFrame, intervals: DataFrame, key: list[str], at: str = "offset", start: str = "start", end: str = "end", width: int = 128) -> DataFrame:
    """Pairs of points and intervals [start, end) of the same key that hold them; columns of both, names must differ but for the key.

    Places are cut into bins of ``width``: a point has one, an interval those that it touches, so this is an equi-join with the exact test behind
    it, and each pair is found in one bin only. A key with very many points is spread by its bins. Intervals that are empty or null hold nothing.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    wide = intervals.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))
    placed = points.withColumn("_bin", F.floor(F.col(at) / width))
    return placed.join(wide, [*key, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def ordinal_join(left: DataFrame, right: DataFrame, key: list[str], left_order: list, right_order: list, how: str = "inner") -> DataFrame:
    """The n-th row of the left with the n-th row of the right of the same key, each in its own order; ``ordinal`` from 0. Rows without a partner follow ``how``."""
    number = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return left.withColumn("ordinal", number(left_order)).join(right.withColumn("ordinal", number(right_order)), [*key, "ordinal"], how)


def set_bits(mask: Column, names: dict[int, str]) -> Column:
    """(bit, name) of the named bits that are set, by bit."""
    return F.filter(F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(n).alias("name")) for b, n in sorted(names.items()))), lambda x: F.getbit(mask, x["bit"]) == 1)


#: How far behind a record its stream data is looked for; texts shown of a record and of its stream data.
REACH, RECORD_TEXTS, STREAM_TEXTS = 128, 12, 8


def record_texts(records: DataFrame, strings: DataFrame, key: list[str]) -> DataFrame:
    """Strings inside and right behind each record (offset, size, stream_size): key, record_ord, place (``Record`` or ``StreamData``), n, offset, value.

    Inside: behind the record's eight bytes of header; of these the first twelve, and of those up to 128 bytes behind it the first eight, by offset.
    """
    to = F.col("offset") + F.col("size")
    each = records.select(
        *key,
        "record_ord",
        F.explode(
            F.array(
                F.struct(F.lit("Record").alias("place"), (F.col("offset") + 8).alias("start"), to.alias("end"), F.lit(RECORD_TEXTS).alias("most")),
                F.struct(F.lit("StreamData").alias("place"), to.alias("start"), F.least(F.col("stream_size"), to + REACH).alias("end"), F.lit(STREAM_TEXTS).alias("most")),
            )
        ).alias("i"),
    ).select(*key, "record_ord", "i.*")
    found = interval_join(strings.select(*key, F.col("offset").alias("at"), "encoding", "value"), each, key, at="at")
    order = F.row_number().over(Window.partitionBy(*key, "record_ord", "place").orderBy("at", "encoding")) - 1
    return found.withColumn("n", order).where("n < most").select(*key, "record_ord", "place", "n", F.col("at").alias("offset"), "value")


def texts_of_record(record: Column, strings: Column) -> Column:
    """``record_texts`` of one record (offset, size, stream_size) whose strings (offset, value; by offset) lie in its row: inside ones, then those behind, both by offset."""
    to = record["offset"] + record["size"]
    between = lambda start, end, most: F.slice(F.filter(strings, lambda s: (s["offset"] >= start) & (s["offset"] < end)), 1, most)
    return F.concat(between(record["offset"] + 8, to, RECORD_TEXTS), between(to, F.least(record["stream_size"], to + REACH), STREAM_TEXTS))


def values_by_mask(rows: DataFrame, key: list[str], mask: Column, strings: Column, names: dict[int, str]) -> DataFrame:
    """``strings_by_mask`` where a key has one row with its strings (offset, value) in a list, by offset: nothing is shuffled."""
    named = bound(set_bits(mask, names), lambda bits: F.transform(strings, lambda s, i: F.struct(F.get(bits, i).alias("b"), s.alias("s"))))
    each = rows.select(*key, F.explode_outer(named).alias("v")).where("v is not null")  # of an inner explode Spark would make the list twice
    return each.select(*key, "v.b.bit", "v.b.name", "v.s.offset", "v.s.value")


def ordinal_properties(masks: DataFrame, strings: DataFrame, key: list[str], names: dict[int, str]) -> DataFrame:
    """Values of the properties whose bits are set (mask), in the order of the bits, from the strings (offset, value) in theirs: key, bit, name, offset, value.

    A property without a string has none and gives no row.
    """
    bits = masks.select(*key, F.explode(set_bits(F.col("mask"), names)).alias("b")).select(*key, "b.bit", "b.name")
    return ordinal_join(bits, strings.select(*key, "offset", "value"), key, ["bit"], ["offset"]).select(*key, "bit", "name", "offset", "value")


def left_over(strings: DataFrame, taken: DataFrame, key: list[str]) -> DataFrame:
    """The strings that no property took: an anti-join by their place, so equal texts elsewhere stay."""
    return strings.join(taken.select(*key, "offset"), [*key, "offset"], "left_anti")


def strings_by_mask(masks: DataFrame, strings: DataFrame, key: list[str], names: dict[int, str]) -> DataFrame:
    """``ordinal_properties`` with what they leave over, in one join: key, bit, name, offset, value of every string; no bit and no name where no property took it.

    Strings of a key stand at places of their own.
    """
    bits = masks.select(*key, F.posexplode(set_bits(F.col("mask"), names)).alias("ordinal", "b")).select(*key, "ordinal", "b.bit", "b.name")
    number = F.row_number().over(Window.partitionBy(*key).orderBy("offset")) - 1
    return strings.select(*key, "offset", "value", number.alias("ordinal")).join(bits.hint("merge"), [*key, "ordinal"], "left").select(*key, "bit", "name", "offset", "value")
