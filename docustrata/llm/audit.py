"""Filter interaction audit: what each filter removes in every order of five, from one relational pass over words.

Words are exploded and aggregated by (document, word), then by document, for totals and distinct words. The other flags
are joined to these, and 32 conditional counts a part (one for each set of failed filters) hold all that the 120
orders need: the orders are expanded from the counts, never from the documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_WORDS = r"[\x20\x09-\x0D]+"


def word_totals(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, n_distinct) of each different (doc_id, h); docs has doc_id, text and h, a hash of the text.

    Texts are dealt once by document and input partition; both aggregations then run where the words are, so neither words
    nor counts are shuffled. Rows that repeat an id and a text meet only if they share an input partition; the totals are
    divided by how many they are.
    """
    key = ["doc_id", "h", "own"]
    dealt = docs.select("doc_id", "h", F.spark_partition_id().alias("own"), "text").repartition(*key)
    # a null before the words of a row: its count is the number of rows
    words = F.concat(F.array(F.lit(None).cast("string")), F.filter(F.split("text", _WORDS), lambda w: w != ""))
    pairs = dealt.select(*key, F.explode(words).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("n"))
    word = F.col("word").isNotNull()
    texts = pairs.groupBy(*key).agg(F.sum(F.when(word, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(word, 0).otherwise(F.col("n"))).alias("copies"), F.count("word").alias("n_distinct"))
    return texts.groupBy("doc_id", "h").agg(F.any_value(F.expr("n div copies")).alias("n_words"), F.any_value("n_distinct").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, copies): documents with a part, id and text, and the filters that they fail, A being bit 0."""
    base = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    upper = 100 * F.regexp_count("text", F.lit("[A-Z]")) > 5 * F.length("text")
    marks = F.col("text").rlike(r"[#$%&*|]")
    flags = base.select("part", "doc_id", "h", F.unhex(F.sha2("text", 256)).alias("digest"), upper.alias("c"), marks.alias("d"))
    flags = flags.groupBy("part", "doc_id", "h", "digest", "c", "d").agg(F.count("*").alias("copies"))
    # a document is the first of its text if it meets the smallest id there: the key holds the id, so copies of one text are spread
    least = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("doc_id is not null")
    joined = flags.join(_renamed(word_totals(base), "doc_id", "h"), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")), "left")
    joined = joined.join(least, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    fails = {
        "A": F.col("n_words") < 50,
        "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"),
        "C": F.col("c"),
        "D": F.col("d"),
        "E": F.col("doc_id").isNotNull() & F.col("first").isNull(),
    }
    mask = F.lit(0)
    for i, name in enumerate(FILTERS):
        mask = mask + F.when(fails[name], 1 << i).otherwise(0)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return joined.select("part", mask.alias("mask"), yes("good"), yes("toxic"), "copies")


def _renamed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in columns})


def conditional_counts(found: DataFrame) -> DataFrame:
    """(part, n, good, toxic): per part three arrays of 32 counts, by mask: documents, those of high quality, toxic ones."""
    counts = found.groupBy("part", "good", "toxic").agg(*(F.sum(F.when(F.col("mask") == k, F.col("copies")).otherwise(0)).alias(f"m{k}") for k in range(32)))
    total = lambda where: F.array(*(F.sum(F.when(where, F.col(f"m{k}")).otherwise(0)) for k in range(32)))
    return counts.groupBy("part").agg(total(F.lit(True)).alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))


def _places() -> F.Column:
    """All orders and steps, with the step's bit and the bits before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(f"struct('{''.join(order)}' as filter_order, {step} as step, {bit} as bit, {before} as before)")
            before |= bit
    return F.expr(f"array({', '.join(out)})")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What five filters remove from each part, in all 120 orders, step by step.

    part, filter_order, step, then long counts: kept, removed, redundant (failing here, removed earlier), unique_fails
    (failing this filter only), good_lost, toxic_lost, shapley (the filter's removed, over all orders). The filters: A under 50 words; B fewer than
    65 % distinct words; C over 5 % of A-Z; D any of ``#$%&*|``; E a text that a smaller id has as well.

    A null text is empty: it fails A. A null part is the empty string. A null id has no smaller id and no label. Each
    row is a document, repeated rows too; of one id with several labels, any 1 counts. An empty table gives an
    empty result; other columns are ignored. Two texts of one id count as one if their 64-bit hashes agree.
    """
    counts = conditional_counts(failures(docs, labels, id_col, text_col, part_col))
    at = counts.select("part", "n", "good", "toxic", F.explode(_places()).alias("at")).select("part", "n", "good", "toxic", "at.*")
    has = lambda k, bits: k.bitwiseAND(bits) != 0
    bit, before = F.col("bit"), F.col("before")
    masks = F.sequence(F.lit(0), F.lit(31))

    def total(column: str, which, weight=lambda k: F.lit(1)):
        return F.aggregate(F.zip_with(column, masks, lambda c, k: F.when(which(k), c * weight(k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda t, c: t + c)

    removed = lambda k: has(k, bit) & ~has(k, before)
    return at.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda k: ~has(k, bit.bitwiseOR(before))).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda k: has(k, bit) & has(k, before)).alias("redundant"),
        total("n", lambda k: k == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # of the orders, one in as many as a document has failures begins with this filter among them
        total("n", lambda k: has(k, bit), lambda k: (120 / F.bit_count(k)).cast("long")).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Per source, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), f AS (
  SELECT doc_id, part,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
     regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails
  FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), x AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM x GROUP BY ALL
), i AS (
  SELECT unnest(range(1, 6)) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), p AS (
  SELECT o, s.i AS step, o[s.i] AS own, o[1:s.i - 1] AS prior FROM o, i s
), q AS (
  SELECT part, o, step, own, n, g, x, fails, fails[own] AS here, coalesce(list_bool_or(list_transform(prior, lambda k: fails[k])), false) AS gone FROM c, p
), r AS (
  SELECT part, o, step, own, sum(n) FILTER (NOT here AND NOT gone) AS kept, sum(n) FILTER (here AND NOT gone) AS removed, sum(n) FILTER (here AND gone) AS redundant,
    sum(n) FILTER (here AND list_sum(list_transform(fails, lambda b: b::INT)) = 1) AS unique_fails,
    sum(g) FILTER (here AND NOT gone) AS good_lost, sum(x) FILTER (here AND NOT gone) AS toxic_lost
  FROM q GROUP BY part, o, step, own
)
SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, step::INT AS step,
  coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM r
"""
