"""The corpus pipeline: toxic documents go, repeated lines go, one of each group of near duplicates stays, documents with
benchmark windows go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
reads again as the next stage's documents. Filters run before the line and near-duplicate stages' shuffles. A null text,
an empty table and repeated rows pass as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import decontaminate, linedup, neardup, sentencepiece_wfst, toxicity
from folioforge.llm.scratch import Scratch

STAGES = [
    ("toxicity", toxicity.stage_toxicity),
    ("line dedup", linedup.stage_linedup),
    ("near-duplicates", neardup.stage_neardup),
    ("decontamination", decontaminate.stage_decontaminate),
    ("sentencepiece", sentencepiece_wfst.stage_encode),
]

#: A trained model and a piece model are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage-{k}")
        if k > 0:
            scratch.drop(f"stage-{k - 1}")
    return docs
