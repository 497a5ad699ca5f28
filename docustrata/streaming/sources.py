"""The source analysis over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import decode_cp1252
from ..operators import source_code as S


def arriving_sources(spark: SparkSession, path: str, at_once: int = 1000) -> DataFrame:
    """A stream of loose source files (doc_id, file_ord, name, kind, source_path, text)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{bas,cls,frm}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_once).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.sha2("path", 256).alias("doc_id"), F.lit(0).alias("file_ord"), name.alias("name"), F.when(F.endswith(name, F.lit(".frm")), "frm").otherwise("vba").alias("kind"), F.col("path").alias("source_path"), decode_cp1252(F.col("content")).alias("text"))


def arriving_risks(spark: SparkSession, path: str) -> DataFrame:
    """Risk markers of arriving sources: every operator up to here works inside a row, so there is no state to keep."""
    return S.risk_markers(arriving_sources(spark, path))
