"""Query definitions by family; each module registers its queries when imported."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..catalog import query
from ..session import load


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query given as Spark SQL over {table} placeholders; the oracle is the same text unless given."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", text)))

    @query(name, oracle if oracle is not None else re.sub(r"\{(\w+)\}", r"\1", text))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: load(spark, sf_dir, t) for t in tables})
