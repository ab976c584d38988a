"""The queries of this subpackage, by the names that ``__spark_entry__`` registers, and their SQL where it exists."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import contamination, html, langid, minhash, packing, pii, quality, sentences, sharding, substrings


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.append(top)
    return {
        "op1_quality_trees": quality.query,
        "op2_html_templates": html.query,
        "op3_packing": packing.query,
        "op4_language_spans": langid.query,
        "op5_personal_data": pii.query,
        "op6_suffix_dedup": substrings.query,
        "op7_decontamination": contamination.query,
        "op8_sentence_spans": sentences.query,
        "op9_near_duplicates": minhash.query,
        "op10_sharding": sharding.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": contamination.SQL, "op8_sentence_spans": sentences.SQL}
