"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import embed_dedup, line_dedup, ngram_join
from .decontam import op3_benchmark_decontamination
from .embed_dedup import op6_embedding_near_dedup
from .language import op8_language_id
from .licenses import op9_license_scan
from .line_dedup import op4_line_dedup
from .ngram_join import op1_ngram_jaccard_join
from .packing import op10_best_fit_packing
from .pii import op7_pii
from .quality import op2_quality_classifier
from .tokens import op5_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_line_dedup": op4_line_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_pii": op7_pii,
        "op8_language_id": op8_language_id,
        "op9_license_scan": op9_license_scan,
        "op10_best_fit_packing": op10_best_fit_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL}
    sql |= {
        "op1_ngram_jaccard_join": ngram_join.ORACLE_SQL,
        "op4_line_dedup": line_dedup.ORACLE_SQL,
        "op6_embedding_near_dedup": embed_dedup.ORACLE_SQL,
    }
    return {name: x for name, x in sql.items() if x}
