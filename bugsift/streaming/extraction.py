"""Incremental extraction as a Structured Streaming job.

New report files arriving in a folder are turned into prompts and completed
micro-batch by micro-batch. Each micro-batch's results are written to
``<sink>/batch_id=<epoch>`` with dynamic partition overwrite, so a replayed
epoch (after a failure) replaces its own output instead of duplicating it;
the stream's checkpoint location records which files are done. This is the
streaming form of the batch-and-snapshot loop (a snapshot is a read of the
sink with ``batch_id <= i``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import prompts as P
from ..operators.complete import batch_complete


def extraction_batch(batch: DataFrame, epoch_id: int, *, id_col: str, text_col: str, style: str,
                     completer_factory: Callable, sink: str, retries: int = 1) -> None:
    prompts = batch.select(F.col(id_col), P.build_prompt(F.col(text_col), style).alias("messages"))
    res = batch_complete(prompts, id_col=id_col, completer_factory=completer_factory, retries=retries)
    parsed = res.select("id", "reply", "status", "attempts", P.parse_triple(F.col("reply")).alias("t")) \
                .select("id", "reply", "status", "attempts", F.col("t.status").alias("triple_status"),
                        "t.scene", "t.operation", "t.defect") \
                .withColumn("batch_id", F.lit(int(epoch_id)).cast("long"))
    (parsed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(sink))


def start_extraction_stream(spark: SparkSession, *, source: str, schema, sink: str, checkpoint: str,
                            completer_factory: Callable, id_col: str = "doc_id", text_col: str = "text",
                            style: str = "prefix_one_shot", max_files_per_trigger: int = 1,
                            trigger_once: bool = False) -> StreamingQuery:
    """Start the stream over parquet files in ``source``; returns the query."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source))
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda b, e: extraction_batch(b, e, id_col=id_col, text_col=text_col, style=style,
                                      completer_factory=completer_factory, sink=sink))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
