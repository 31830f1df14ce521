"""The subpackage's queries and their DuckDB twins."""

from __future__ import annotations

from . import decontam, exact_dedup, line_dedup, near_dedup, packing, pii, quality, substring_dedup, token_files, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality": quality.op3_quality,
    "op4_packing": packing.op4_packing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_token_files": token_files.op7_token_files,
    "op8_pii": pii.op8_pii,
    "op9_warc": warc.op9_warc,
    "op10_decontam": decontam.op10_decontam,
}


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

ORACLE = {"op1_exact_dedup": exact_dedup.ORACLE, "op2_substring_dedup": substring_dedup.ORACLE, "op9_warc": warc.ORACLE}
