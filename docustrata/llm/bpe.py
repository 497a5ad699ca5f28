"""Byte-level BPE encoding and decoding of text columns by the transducer."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunks
from .transducer import Transducer, decode_stream, load_ranks

_kept: dict[tuple[str, str], tuple[Transducer, Chunks]] = {}


def encoder(path: str, pattern: str) -> tuple[Transducer, Chunks]:
    """One per worker process and vocabulary."""
    if (path, pattern) not in _kept:
        fst, cut = Transducer(load_ranks(path)), regex.compile(pattern)
        pieces: dict[str, bytes] = {}

        def encode(chunks: list[str]) -> list[bytes]:
            if len(pieces) > 800_000:
                pieces.clear()
            out = []
            for c in chunks:
                got = []
                for p in cut.findall(c):
                    ids = pieces.get(p)
                    if ids is None:
                        ids = np.array(fst.encode(p.encode()), "<u4").tobytes()
                        if len(p) < 64:
                            pieces[p] = ids
                    got.append(ids)
                out.append(b"".join(got))
            return out

        _kept[path, pattern] = fst, Chunks(encode)
    return _kept[path, pattern]


def _runs(column, limit: int = 1 << 20):
    """Runs of a text column's values, about ``limit`` characters each; null is empty."""
    part, size, at = [], 0, 0
    for i, x in enumerate(column):
        part.append(x.as_py() or "")
        size += len(part[-1])
        if size >= limit:
            yield at, part
            part, size, at = [], 0, i + 1
    if part:
        yield at, part


def _encoded(path: str, pattern: str, digests: bool):
    def run(batches):
        fst, chunks = encoder(path, pattern)
        for batch in batches:
            for at, texts in _runs(batch.column("text")):
                ids = [b"".join(x) for x in chunks.values(texts)]
                key = batch.column("doc_id").slice(at, len(texts))
                if not digests:
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])
                    continue
                back = []
                for x in ids:
                    sha = hashlib.sha256()
                    for data in decode_stream(np.frombuffer(x, "<u4").tolist(), fst.token):
                        sha.update(data)
                    back.append(sha.hexdigest())
                yield pa.RecordBatch.from_arrays([key, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text, without special tokens.

    A null or empty text has no ids. Repeated rows and null ids are ordinary rows; other columns are
    ignored; an empty table gives an empty result. ``path`` must exist on every executor.
    """
    return _base(docs, id_col, text_col).mapInArrow(_encoded(path, pattern, False), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every list of ids; bytes that are no UTF-8 become U+FFFD. A null list gives an empty text; an unknown id is an error."""

    def run(batches):
        token = {i: t for t, i in load_ranks(path).items()}
        for batch in batches:
            text = [b"".join(decode_stream(x.as_py() or [], token)).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256 (of the bytes decoded from them), by ``encode``'s rules."""
    return _base(docs, id_col, text_col).mapInArrow(_encoded(path, pattern, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
