"""Queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

import corpus_pipeline

from .alignment import op11_cross_tokenizer_alignment
from .decontaminate import op5_decontamination
from .embeddings import ORACLE_SQL as EMBEDDINGS_SQL
from .embeddings import op10_embedding_dedup
from .lines import ORACLE_SQL as LINES_SQL
from .lines import op4_line_dedup
from .packing import op12_best_fit_packing
from .passages import op9_repeated_passages
from .quality import op7_quality
from .sentencepieces import op8_sentencepiece
from .simhash import op3_simhash
from .token_records import op6_token_records
from .token_trees import op2_token_counts
from .warc import op1_warc_derivatives
from .whitening import op13_embedding_whitening


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_warc_derivatives": op1_warc_derivatives,
        "op2_token_counts": op2_token_counts,
        "op3_simhash": op3_simhash,
        "op4_line_dedup": op4_line_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_token_records": op6_token_records,
        "op7_quality": op7_quality,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_repeated_passages": op9_repeated_passages,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**pipeline, "op4_line_dedup": LINES_SQL, "op10_embedding_dedup": EMBEDDINGS_SQL}
