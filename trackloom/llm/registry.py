"""The queries of the text operators and their SQL twins."""

from __future__ import annotations

import corpus_pipeline

from . import archives, fingerprints, leaks, lines, mixing, near, negatives, passages, phrases, pii, quality, secrets, substrings


def queries():
    return {"op1_passages": passages.op1_passages, "op2_near_duplicates": near.op2_near_duplicates, "op3_personal_data": pii.op3_personal_data, "op4_secrets": secrets.op4_secrets, "op5_quality": quality.op5_quality, "op6_leaks": leaks.op6_leaks, "op7_mix_sources": mixing.op7_mix_sources, "op8_substrings": substrings.op8_substrings, "op9_fingerprints": fingerprints.op9_fingerprints, "op10_line_dedup": lines.op10_line_dedup, "op11_negatives": negatives.op11_negatives, "op12_phrases": phrases.op12_phrases, "op13_warc": archives.op13_warc, "pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op11_negatives": negatives.SQL, "op12_phrases": phrases.SQL, "op13_warc": archives.SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
