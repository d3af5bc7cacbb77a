"""Results as they come: files that arrive in a folder are resolved batch by batch, and each batch's rows are handed on
at once. A callback that fails doesn't stop the stream; its error is kept with the batch's number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators.batch_scan import known_early, reported_once, scan

FILES = "batch_id string, name string, content binary"


def watch(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None], errors: list | None = None, early: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Watches a folder of Parquet files of (batch_id, name, content); each file set that arrives is one micro-batch. With
    early, what is known of single files is handed to it first, and each gets the rest."""

    def guarded(call: Callable[[DataFrame, int], None], rows: DataFrame, number: int) -> None:
        try:
            call(rows, number)
        except Exception as e:
            if errors is not None:
                errors.append((number, str(e)))

    def run(files: DataFrame, number: int) -> None:
        if early is None:
            guarded(each, scan(files), number)
            return
        known = known_early(files)
        guarded(early, known, number)
        guarded(each, reported_once(scan(files), known.selectExpr("batch_id", "names[0] AS name")), number)

    stream = spark.readStream.schema(FILES).parquet(folder)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
