"""Trees from parent links: pre-order places, depths, sizes of what lies below, and subtrees as intervals of places.

Links are followed by pointer doubling: every round joins each node with what its topmost known ancestor knows,
so a tree of depth d takes log2(d) joins, whatever its width. Damaged links are defined: a parent that is absent makes a
root, and of a loop the first node (by order, then path) is the root of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ancestors(nodes: DataFrame, key: list[str], path: str = "path", parent: str = "parent_path", order: str = "control_ord") -> DataFrame:
    """(key, path, chain) of every node: chain is the node itself and its ancestors up to its root, as (order, path).

    ``key`` names the columns of one tree. Paths are unique within a key; of repeated ones the first by order counts.
    """
    spark = nodes.sparkSession
    keep = spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    base = nodes.select(*key, F.col(path).alias("path"), F.struct(F.col(order).cast("long").alias("order"), F.col(path).alias("path")).alias("own"), F.col(parent).alias("up"))
    base = base.where("path is not null").groupBy(*key, "path").agg(F.min_by(F.struct("own", "up"), "own").alias("n")).select(*key, "path", F.array("n.own").alias("chain"), F.col("n.up").alias("up"), F.lit(False).alias("done"))
    at, rounds = base, 0
    while True:
        other = at.select(*key, F.col("path").alias("up"), F.col("chain").alias("chain2"), F.col("up").alias("up2"))
        both = at.join(other, [*key, "up"], "left")
        # a node that stands in the chain twice closes a loop; what is joined on later adds nothing new
        chain = F.when(F.col("done") | F.col("chain2").isNull(), F.col("chain")).otherwise(F.concat("chain", "chain2"))
        more = ~F.col("done") & F.col("chain2").isNotNull() & F.col("up2").isNotNull()
        both = both.select(*key, "path", chain.alias("chain"), F.when(more, F.col("up2")).alias("up"))
        at = both.withColumn("done", F.col("up").isNull() | (F.size(F.array_distinct("chain")) < F.size("chain")))
        at = at.withColumn("up", F.when(~F.col("done"), F.col("up")))
        at = at.checkpoint() if keep else at.persist()
        rounds += 1
        if not at.where("not done").limit(1).count():
            break
    size = F.size("chain")
    again = F.filter(F.sequence(F.lit(1), size), lambda i: F.array_position("chain", F.element_at("chain", i)).cast("int") < i)
    second = F.get(again, F.lit(0))
    first = F.array_position("chain", F.element_at("chain", second)).cast("int")
    loop = F.when(second.isNotNull(), F.slice("chain", first, second - first))
    top = F.array_min(loop)
    cut = F.when(second.isNull(), F.col("chain")).otherwise(F.slice("chain", F.lit(1), F.array_position("chain", top).cast("int")))
    return at.select(*key, "path", cut.alias("chain"))


def preorder(nodes: DataFrame, key: list[str], path: str = "path", parent: str = "parent_path", order: str = "control_ord") -> DataFrame:
    """Every node with position (from 0, its tree's roots and each node's children by order, then path), depth (1 at a root) and n_below.

    The nodes below one are those at the next ``n_below`` positions. Places are numbered in one task per key.
    """
    own = ancestors(nodes, key, path, parent, order)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.reverse("chain"))) - 1
    below = own.select(*key, F.explode(F.slice("chain", F.lit(2), F.greatest(F.size("chain") - 1, F.lit(0)))).alias("a")).groupBy(*key, F.col("a.path").alias("path")).agg(F.count("*").alias("n_below"))
    out = own.select(*key, "path", place.alias("position"), F.size("chain").alias("depth"), F.when(F.size("chain") > 1, F.get("chain", F.lit(1))["path"]).alias("parent_path"))
    return out.join(below, [*key, "path"], "left").withColumn("n_below", F.coalesce("n_below", F.lit(0)))


def below(tree: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """(key, root, path, depth_below): what lies below each root (key, path) of a pre-ordered tree, itself included: an interval of places, no walk."""
    chosen = roots.select(*key, "path").distinct().join(tree, [*key, "path"]).select(*key, F.col("path").alias("root"), F.col("position").alias("first"), (F.col("position") + F.col("n_below")).alias("last"), F.col("depth").alias("top"))
    return tree.join(chosen, key).where("position between first and last").select(*key, "root", "path", (F.col("depth") - F.col("top")).alias("depth_below"))
