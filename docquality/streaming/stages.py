"""The same operators over streams: uploads, duplicates, job states, routing and stage metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 8 * 1024 * 1024
# How files of the accepted kinds begin, in hexadecimal.
MAGIC = {"jpg": "FFD8FF", "png": "89504E47", "bmp": "424D", "tif": "49492A00"}
JPG_END, PNG_END = "FFD9", "49454E44AE426082"
STATES = ("Uploaded", "Processing", "Quarantine", "Waiting Human Review", "Completed")


def uploads(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Files as they arrive, a bounded number at a time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(folder)


def validity(length: Column, content: Column) -> Column:
    """`ok`, or why an upload goes to quarantine."""
    start, end = F.hex(F.substring(content, 1, 4)), F.hex(F.substring(content, -12, 12))
    kind = {k: start.startswith(magic) for k, magic in MAGIC.items()}
    known = kind["jpg"] | kind["png"] | kind["bmp"] | kind["tif"]
    whole = F.when(kind["jpg"], end.endswith(JPG_END)).when(kind["png"], end.endswith(PNG_END)).otherwise(True)
    return F.when(length > MOST_BYTES, "too_large").when(length == 0, "empty").when(~known, "unknown_format").when(~whole, "truncated").otherwise("ok")


def with_validity(files: DataFrame) -> DataFrame:
    return files.withColumn("validity", validity(F.col("length"), F.col("content")))


def upload_sinks(accepted: Callable[[DataFrame, int], None], quarantine: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on with_validity(): valid uploads to one sink, all others with their reason to the other."""
    both = to_sinks("__sink", {"accepted": accepted, "quarantine": quarantine})
    return lambda batch, number: both(batch.withColumn("__sink", F.when(F.col("validity") == "ok", "accepted").otherwise("quarantine")), number)


def without_duplicates(files: DataFrame, time: str = "modificationTime", delay: str = "1 hour") -> DataFrame:
    """Uploads with bytes that were not seen within the delay; state is dropped beyond it."""
    return files.withColumn("hash", F.sha2("content", 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])


def stage_metrics(events: DataFrame, time: str = "ts", stage: str = "event_type", value: str = "value", window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Throughput, mean time and error share of each stage in each window. Works on tables and on streams."""
    x = events.withWatermark(time, delay) if events.isStreaming else events
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return x.groupBy(w.alias("w"), F.col(stage).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(value), 6).alias("mean_value"), F.max(value).alias("max_value")).select(F.col("w.start").alias("window_start"), "stage", "n", "mean_value", "max_value")


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    x = events.withWatermark(time, delay) if events.isStreaming else events
    return x.groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def route(confidence: Column, fallback_confidence: Column, least: float = 55.0) -> Column:
    """Where a result goes: accepted, to the fallback if it has not run, or to a person."""
    return F.when(confidence >= least, "accept").when(fallback_confidence.isNull(), "fallback").when(fallback_confidence >= least, "accept").otherwise("human_review")


def to_sinks(column: str, sinks: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each route's rows to its sink; the batch is computed once."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, sink in sinks.items():
                sink(kept.filter(F.col(column) == name), number)
        finally:
            kept.unpersist()

    return write


def next_state(state: str | None, event: str) -> str:
    """A job's state after an event; unknown events change nothing."""
    if event == "upload" and state is None:
        return "Uploaded"
    moves = {
        ("Uploaded", "start"): "Processing", ("Uploaded", "reject"): "Quarantine", ("Processing", "reject"): "Quarantine",
        ("Processing", "low_confidence"): "Waiting Human Review", ("Processing", "done"): "Completed", ("Waiting Human Review", "review"): "Completed",
    }
    return moves.get((state, event), state or "Uploaded")


def job_states(events: DataFrame, job: str = "job_id", event: str = "event", time: str = "ts", keep_completed: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """(job_id, state, changes) after each micro-batch, from a stream of (job_id, ts, event).

    A job's state goes `keep_completed` after it was completed, and `keep` after its last event in any case (processing
    time), so state follows the jobs that are under way."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    millis = {name: int(pd.Timedelta(span).total_seconds() * 1000) for name, span in (("done", keep_completed), ("any", keep))}

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state, changes = held.get if held.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for name in rows["event"]:
            new = next_state(state, name)
            changes += new != state
            state = new
        held.update((state, int(changes)))
        held.setTimeoutDuration(millis["done" if state == STATES[-1] else "any"])
        yield pd.DataFrame({"job_id": [str(key[0])], "state": [state], "changes": [int(changes)]})

    x = events.select(F.col(job).cast("string").alias("job_id"), F.col(time).alias("ts"), F.col(event).alias("event"))
    return x.groupBy("job_id").applyInPandasWithState(run, "job_id string, state string, changes long", "state string, changes long", "update", GroupStateTimeout.ProcessingTimeTimeout)
