"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

import corpus_pipeline

from . import audit, bpe, counts, fingerprints, minhash, packing, privacy, quality, repetition, secrets, substrings, vectors, whitening


def queries():
    return {
        "op1_quality": quality.op1_quality,
        "op2_bpe": bpe.op2_bpe,
        "op3_token_counts": counts.op3_token_counts,
        "op4_minhash": minhash.op4_minhash,
        "op5_secrets": secrets.op5_secrets,
        "op6_repetition": repetition.op6_repetition,
        "op7_substrings": substrings.op7_substrings,
        "op8_privacy": privacy.op8_privacy,
        "op9_vectors": vectors.op9_vectors,
        "op10_packing": packing.op10_packing,
        "op11_whitening": whitening.op11_whitening,
        "op12_filter_audit": audit.op12_filter_audit,
        "op13_fingerprints": fingerprints.op13_fingerprints,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op4_minhash": minhash.ORACLE_SQL,
        "op6_repetition": repetition.ORACLE_SQL,
        "op7_substrings": substrings.ORACLE_SQL,
        "op9_vectors": vectors.ORACLE_SQL,
        "op12_filter_audit": audit.ORACLE_SQL,
    }
