"""Where the operators keep tables between jobs."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder (``spark.checkpoint.dir``, or what ``setCheckpointDir`` set).

    Only a session in one process (``local[...]``, as in tests) may go without: a temporary folder serves there. On a
    cluster every executor would write to its own disk, so that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_docustrata_scratch", None)
    if not top and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        top = own.get()
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark._docustrata_scratch = tempfile.mkdtemp(prefix="docustrata-")
    path = f"{top.rstrip('/')}/docustrata/{name}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    return path


_written: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that operators store inside it. Results are lazy: write them within."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there, and executors may be lost later."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list, as (node, root): root is the component's smallest node.

    Alternates the large-star and small-star steps (Kiveris et al. 2014): edges never grow in
    number. A hub's neighbours meet it by one key; Spark's adaptive join splits such a key, and the minima are partial aggregates.
    Each round is written to the shared folder. Nodes without edges are not in the result.
    Empty input gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = stored(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
