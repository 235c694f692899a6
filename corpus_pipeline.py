"""A corpus pipeline of five stages over ``documents``, each a decision of one operator that takes effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm.bpe import bpe_stage
from sluice.llm.common import Scratch
from sluice.llm.jaccard import jaccard_stage
from sluice.llm.langid import language_stage
from sluice.llm.lines import line_stage
from sluice.llm.mixing import mix_stage

STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing", mix_stage),
    ("BPE", bpe_stage),
]

#: Language ID, the seeded mix and BPE have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage{k + 1}")
    return docs
