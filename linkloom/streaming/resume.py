"""Candidates as records arrive, with resume.

Reference records stream from files; each micro-batch is blocked, scored and pruned against the candidate records and
appended. The checkpoint remembers which files are done; its folder is named by the parameters, so a run with others
starts anew instead of mixing results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring
from ..plans.presets import Preset, run_preset


def config_hash(preset: Preset, top_k: int) -> str:
    parts = [preset.name, top_k, preset.min_len, preset.suffixes, preset.prefilter, [(s.name, s.bit, s.cap, s.ratio, s.floor) for s in preset.strategies]]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:16]


def start(spark: SparkSession, source: str, schema: str, candidates: DataFrame, out: str, checkpoint: str, preset: Preset, top_k: int = 50, files_per_batch: int = 1) -> StreamingQuery:
    """Appends (s1_id, candidates) of new files in source to the Parquet folder out, until all there now are done."""
    key = config_hash(preset, top_k)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def batch(records: DataFrame, number: int) -> None:
        # a batch that runs again after a failure replaces its own folder
        ranked = run_preset(records, candidates, preset, top_k)
        lists = scoring.nested(ranked, records.selectExpr("entity_id as s1_id"))
        lists.write.mode("overwrite").parquet(f"{out}/config={key}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/{key}").trigger(availableNow=True).start()
