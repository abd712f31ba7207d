"""Completion of reports as a stateful stream with retries over triggers.

State is the attempts made of each report, as keys (id, attempt). A row is admitted
if its attempt was not made yet: a new report carries 0, a retry the number of
attempts that failed. So a report that comes twice is asked once, and a retry that
is replayed counts once. Admitted rows are answered in Arrow batches and go to
one attempt log, ``<log>/epoch-<n>``, written once per epoch: a replayed epoch
finds it complete and only rebuilds its state. The log is also the stream's second
source: its ``waiting`` rows are the retries of the next trigger. ``ok`` and
``failed`` rows are final, one per id.

Null texts are asked without text, null ids are refused, rows that share an id are
one report (which one is asked is open if their texts differ).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import prompts as P
from ..operators.complete import _to_messages

_LOG = "id long, text string, attempts int, status string, reply string, epoch long"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def ask(asked: DataFrame, completer_factory: Callable, style: str, retries: int) -> DataFrame:
    """Answers of the admitted rows, as rows of the attempt log without epoch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = completer_factory()
        for pdf in batches:
            for attempt, own in pdf.groupby("attempt", sort=True):
                if hasattr(complete, "attempt"):
                    complete.attempt = int(attempt)
                try:
                    got = complete([_to_messages(m) for m in own["messages"].values])
                except Exception:  # noqa: BLE001 - the whole call failed: every item failed once
                    got = [None] * len(own)
                good = [isinstance(r, str) for r in got]
                last = attempt >= retries
                yield pd.DataFrame({
                    "id": own["id"].values, "text": [None if g or last else t for g, t in zip(good, own["text"])],
                    "attempts": int(attempt) + 1, "status": ["ok" if g else "failed" if last else "waiting" for g in good],
                    "reply": [r if g else " " if last else None for g, r in zip(good, got)]})
    return asked.select("id", "text", "attempt", P.build_prompt(F.coalesce("text", F.lit("")), style).alias("messages")) \
        .mapInPandas(run, "id long, text string, attempts int, status string, reply string")


def start_requests(reports: DataFrame, *, log: str, checkpoint: str, completer_factory: Callable,
                   style: str = "prefix_one_shot", retries: int = 1) -> StreamingQuery:
    """One availableNow run over the streaming table ``reports`` (id, text): new
    reports and the retries that wait in the log."""
    spark = reports.sparkSession
    fs, at = _path(spark, log)
    fs.mkdirs(at)
    # never null on either side: the state's schema must not depend on which source has rows
    again = (spark.readStream.schema(_LOG).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
             .parquet(log).where("status = 'waiting'")
             .select("id", "text", F.coalesce("attempts", F.lit(0)).alias("attempt")))
    new = reports.select(F.when(F.col("id").isNull(), F.raise_error(F.lit("null report id")).cast("long"))
                         .otherwise(F.col("id").cast("long")).alias("id"),
                         F.col("text").cast("string").alias("text"), F.lit(0).alias("attempt"))
    asked = new.unionByName(again).dropDuplicates(["id", "attempt"])

    def write(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        folder = f"{log}/epoch-{epoch:08d}"
        files, done = _path(own, f"{folder}/_SUCCESS")
        if files.exists(done):
            batch.write.format("noop").mode("overwrite").save()        # the state of the epoch
            return
        ask(batch, completer_factory, style, retries).withColumn("epoch", F.lit(epoch).cast("long")) \
            .write.mode("overwrite").parquet(folder)

    return (asked.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).foreachBatch(write).start())


def attempts(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(_LOG).option("recursiveFileLookup", "true").parquet(log)


def answers(spark: SparkSession, log: str) -> DataFrame:
    """(id, status, attempts, reply) of every report that is done."""
    return attempts(spark, log).where("status <> 'waiting'").select("id", "status", "attempts", "reply")


def waiting(spark: SparkSession, log: str) -> int:
    """Reports whose last attempt waits for a retry."""
    last = attempts(spark, log).groupBy("id").agg(F.max_by("status", "attempts").alias("status"))
    return last.where("status = 'waiting'").count()


def complete_stream(reports: Callable[[], DataFrame], *, log: str, checkpoint: str, completer_factory: Callable,
                    style: str = "prefix_one_shot", retries: int = 1) -> DataFrame:
    """Runs until no report waits; ``reports`` opens the streaming table anew for a run."""
    for _ in range(retries + 1):
        table = reports()
        start_requests(table, log=log, checkpoint=checkpoint, completer_factory=completer_factory, style=style,
                       retries=retries).awaitTermination()
        if not waiting(table.sparkSession, log):
            break
    return answers(table.sparkSession, log)
