"""Linking records as they arrive: each micro-batch is normalized and meets a static table of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize_records
from ..operators.blocking import key_block


def link_stream(arriving: DataFrame, targets: DataFrame, out: str, checkpoint: str, most: int = 50):
    """Key-blocked pairs of a stream of raw S1 records with normalized ``targets``, appended to ``out``.
    A batch that runs again after a failure overwrites its own folder. Returns the started query."""

    def batch(rows: DataFrame, number: int) -> None:
        recs = normalize_records(rows.withColumn("src", F.lit("S1"))).unionByName(targets)
        key_block(recs, most).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
