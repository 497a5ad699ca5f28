"""Token counts with a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens). A run joins the digests of
its texts to it, encodes one row of each distinct content that misses, and appends those counts.
"""

from __future__ import annotations

import hashlib
import json
import os

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunks
from .session import shared_dir, stored
from .words import runs

CACHE = "content_digest binary, tokenizer_digest binary, n_tokens long"
_kept: dict[str, tuple[object, Chunks, list[str]]] = {}


def _tokenizer(path: str):
    """One per worker process."""
    if path not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        tok.no_truncation()
        tok.no_padding()
        _kept[path] = tok, Chunks(lambda chunks: [len(e.ids) for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]), special
    return _kept[path]


def parts_at_space(path: str) -> bool:
    """Whether the tokenizer's file says that it is a byte-level one whose pattern never joins a word with what follows it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    level = spec["pre_tokenizer"] or {}
    return spec["normalizer"] is None and level.get("type") == "ByteLevel" and bool(level.get("use_regex")) and not level.get("add_prefix_space") and not spec["model"].get("dropout")


def _counted(path: str, by_chunk: bool):
    def run(batches):
        tok, chunks, special = _tokenizer(path)
        whole = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
        for batch in batches:
            for a, b, values in runs(batch.column("text")):
                texts = [t or "" for t in values]
                plain = [by_chunk and not any(s in t for s in special) for t in texts]
                counts = chunks.values([t for t, p in zip(texts, plain, strict=True) if p])
                n = [sum(next(counts)) if p else whole(t) for t, p in zip(texts, plain, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("content_digest").slice(a, b - a), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    return run


def tokenizer_digest(path: str) -> bytes:
    """Names the tokenizer's version: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", by_chunk: bool | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    ``cache``: folder of the cache table, created when missing and appended to. The content digest is
    that of the text as it is, a null being empty: byte-level counts depend on every byte, so any
    further normalisation would give wrong counts. ``by_chunk``: the tokenizer never joins a word with
    what follows it (default: where its file says so, see ``parts_at_space``); otherwise whole texts are
    encoded. Texts that hold a special string are always encoded whole.

    Repeated rows and null ids are ordinary rows, other columns are ignored, an empty table gives an
    empty result and leaves the cache as it was. A run that is repeated after a failure appends nothing
    twice: what an unfinished write left is not read.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    by_chunk = parts_at_space(path) if by_chunk is None else by_chunk
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = base.withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    rows = stored(keyed.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    try:
        known = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException:  # no cache yet
        known = spark.createDataFrame([], CACHE)
    known = known.where(F.col("tokenizer_digest") == F.lit(version)).select("content_digest", "n_tokens")
    # one row of each distinct content that misses; the id finds its text again without a shuffle of all copies
    new = rows.join(known, "content_digest", "left_anti").groupBy("content_digest").agg(F.min("doc_id").alias("i"))
    mine = base.join(new, F.col("doc_id").eqNullSafe(F.col("i")), "inner").where(F.unhex(F.sha2("text", 256)) == F.col("content_digest")).select("content_digest", "text")
    counted = mine.mapInArrow(_counted(path, by_chunk), "content_digest binary, n_tokens long").dropDuplicates(["content_digest"])  # rows may repeat
    counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == F.lit(version)).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(known, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. The cache is new in each call, so all counts are made."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-cache"))
