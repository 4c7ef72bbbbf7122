"""The training-data pipeline: STAGES one after the other, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm._common import delete, shared_folder
from linkloom.llm.pipeline import STAGES

#: Tokens of the last stage can't be had in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in the folder that spark.checkpoint.dir names. What a stage wrote is deleted once the
    next one has read it; the last one's pieces stay, as the result reads them."""
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
