"""Streaming forms of the periodic and request-driven jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corelode.functions import scalars as S
from corelode.operators import validate as V
from corelode.operators.models import Trained
from corelode.operators.scoring import AT, score_points
from corelode.session import keep
from corelode.sources.readers import MODEL_DOCUMENT, registry_rows
from corelode.sources.writers import flat_predictions

# Fixed value: seconds for which a prediction stays valid.
TIME_TO_LIVE = 3600
# Groups of request keys that share a state.
BUCKETS = 1024
HISTORY = "period long, status string, issues long, rows long"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, file_format: str = "parquet", files_per_batch: int = 100, pattern: str | None = None) -> DataFrame:
    """Files of a folder as a stream; the number of files bounds a batch."""
    reader = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def _run(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def stream_quality(samples: DataFrame, history: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Adds one validation line per batch to the history table.

    The line carries the batch number; a batch that is repeated after a failure
    overwrites its own folder, so no line is counted twice.
    """

    def check(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        lines = keep(V.validation_lines(batch))  # read twice: for the status and for the issues
        status = V.overall(lines).select(
            F.lit(number).cast("long").alias("period"), F.col("overall_status").alias("status"), F.col("total_issues").alias("issues"))
        rows = batch.agg(F.count("*")).scalar()
        status.withColumn("rows", rows).coalesce(1).write.mode("overwrite").parquet(f"{history}/batch={number}")
        batch.unpersist()

    return _run(samples.writeStream.foreachBatch(check), checkpoint, once)


def read_history(spark: SparkSession, history: str) -> DataFrame:
    return spark.read.schema(HISTORY).option("recursiveFileLookup", True).parquet(history)


def with_request_key(requests: DataFrame) -> DataFrame:
    return requests.withColumn("request_key", S.request_key(*[
        F.col(c) for c in ("latitude", "longitude", "depth_from", "depth_to", "element")]))


def _decided(keys: list, times: list, lasts: dict, ttl_us: int) -> list[bool]:
    """Which rows, in the order of their time, are served; ``lasts`` (key to time, in microseconds) is kept up to date.

    A row without a time is served if its key has not been, and lets the next one be.
    """
    served = []
    for key, at in zip(keys, times):
        fresh = key not in lasts or (at is not None and (lasts[key] is None or at - lasts[key] >= ttl_us))
        if fresh:
            lasts[key] = at
        served.append(fresh)
    return served


def serve_once(requests: DataFrame, ttl: int = TIME_TO_LIVE, buckets: int = BUCKETS) -> DataFrame:
    """Requests (event_id, ts, request_key) with ``served``: true when no
    prediction of the same key was served in the last ``ttl`` seconds.

    Keys are dealt to ``buckets`` by their hash, and a bucket is one state: the
    keys served and the time of each one's last served request, which is dropped
    when the watermark has passed it by ``ttl``. A state of its own for each key
    would start Python's frames anew for every few rows. A checkpoint
    keeps its number of buckets.
    """
    schema = "event_id long, request_key string, ts timestamp, served boolean"
    ttl_us = ttl * 1_000_000

    def decide(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.getCurrentWatermarkMs()
        known = zip(*state.get) if state.exists else ()
        lasts = {key: at for key, at in known if at + ttl_us > mark * 1000}
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        # the key's column may hold None or NaN for null: both are one key
        keys = [key if isinstance(key, str) else None for key in rows["request_key"]]
        times = [None if at != at else int(at) for at in rows["at"].tolist()]
        served = _decided(keys, times, lasts, ttl_us)
        # a request without a time is remembered until the watermark moves
        lasts = {key: mark * 1000 - ttl_us + 1 if at is None else at for key, at in lasts.items()}
        state.update((list(lasts), list(lasts.values())))
        state.setTimeoutTimestamp(max(max(lasts.values()) // 1000 + ttl * 1000, mark + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "request_key": keys, "ts": rows["ts"], "served": served})

    timed = requests.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "request_key").withWatermark("ts", "10 minutes").withColumns({
        "at": F.unix_micros("ts"), "bucket": F.pmod(F.xxhash64("request_key"), F.lit(buckets))})
    return timed.groupBy("bucket").applyInPandasWithState(
        decide, schema, "keys array<string>, lasts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def request_dedup(requests: DataFrame, out: str, checkpoint: str, ttl: int = TIME_TO_LIVE, once: bool = False) -> StreamingQuery:
    return _run(serve_once(with_request_key(requests), ttl).writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, once)


def served_share(decided: DataFrame) -> DataFrame:
    """Requests served and repeated, and the share of repeats."""
    return decided.agg(
        F.count_if("served").alias("served"), F.count_if(~F.col("served")).alias("repeated"),
        F.avg((~F.col("served")).cast("double")).alias("hit_rate"))


def stream_score(requests: DataFrame, trained: Trained, out: str, errors: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Scores arriving points, a record for each; those with errors also go to an error table.

    The model brings its holes and fitted statistics, so a batch reads nothing
    of the samples. Both tables are written from the batch's own records, which
    a repeated batch replaces.
    """
    def score(batch: DataFrame, number: int) -> None:
        records = flat_predictions(score_points(batch, trained, strict=False), [c for c in batch.columns if c not in AT])
        target = f"{out}/batch={number}"
        records.write.mode("overwrite").parquet(target)
        written = batch.sparkSession.read.schema(records.schema).parquet(target)
        written.filter("errors <> ''").write.mode("overwrite").parquet(f"{errors}/batch={number}")

    return _run(requests.writeStream.foreachBatch(score), checkpoint, once)


def stream_registry(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False, one_per_file: bool = True) -> StreamingQuery:
    """Newest model per element, kept up to date in the table ``out`` as documents arrive
    (one to a file, or one to a line): each batch is a folder of its own, and
    :func:`newest_registry` reads the last that is complete."""
    documents = spark.readStream.schema(MODEL_DOCUMENT).option("multiLine", one_per_file).option("pathGlobFilter", "*.json").json(folder)
    newest = registry_rows(documents).groupBy("element").agg(
        F.max_by(F.struct("trained", "model_path", "r2"), "trained").alias("m")).select("element", "m.*")

    def replace(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _run(newest.writeStream.outputMode("complete").foreachBatch(replace), checkpoint, once)


def newest_registry(spark: SparkSession, out: str) -> DataFrame:
    """The registry of the last complete batch; readers never see a table that is being replaced."""
    every = spark.read.option("recursiveFileLookup", True).parquet(out)
    last = every.agg(F.max("_batch")).scalar()
    return every.filter(F.col("_batch") == last).drop("_batch")
