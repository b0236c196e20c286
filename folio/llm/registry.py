"""Queries of the training-data operators for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline
from folio.llm import classlm, decontaminate, flac, html, language, pieces, rollup, simhash, tokens, toxicity


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_token_files": tokens.op2_token_files,
        "op3_flac": flac.op3_flac,
        "op4_language": language.op4_language,
        "op5_class_lm": classlm.op5_class_lm,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_html": html.op7_html,
        "op8_pieces": pieces.op8_pieces,
        "op9_token_rollup": rollup.op9_token_rollup,
        "op10_toxicity": toxicity.op10_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    own = {"op6_decontaminate": decontaminate.ORACLE}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
