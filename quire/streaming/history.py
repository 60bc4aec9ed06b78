"""Streaming twins of the history and queue operators: each micro-batch makes the next snapshot from the last one.

A snapshot lies in a folder named by its batch, so a batch that is run again writes the same folder again: results are
exactly once. State is per user and book, so it grows with them and not with events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of finished snapshots below a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and _exists(spark, f"{path}/{n}/_SUCCESS"))


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The last finished snapshot."""
    found = _batches(spark, path)
    return spark.read.parquet(f"{path}/batch={found[-1]}") if found else None


def keep_history(events: DataFrame, path: str, checkpoint: str, keep: int = state.KEEP_RECENT) -> StreamingQuery:
    """Keeps the newest ``keep`` books of each user from a stream of events (id, user_id, book_id, media_type, position, updated_at)."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in _batches(spark, path) if n < number]
        rows = state.normalized_history(batch)
        if earlier:
            rows = rows.unionByName(spark.read.parquet(f"{path}/batch={earlier[-1]}"))
        state.recent(rows, keep).drop("place").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_queue(outcomes: DataFrame, seed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Applies a stream of outcomes (queue_key, bookid, status, delta, error, at) to a work queue; of several for a book in one batch the last counts, their deltas add up."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in _batches(spark, path) if n < number]
        queue = spark.read.parquet(f"{path}/batch={earlier[-1]}") if earlier else seed
        last = batch.groupBy("queue_key", "bookid").agg(F.max_by(F.struct("status", "error"), "at").alias("_l"), F.sum("delta").alias("delta")).select("queue_key", "bookid", "_l.status", "delta", "_l.error")
        state.queue_transition(queue, last).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return outcomes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_stream(lines: DataFrame, size: int, summarize) -> DataFrame:
    """Chunk summaries of a stream of texts (blob, text): blob, chunk (from 1) and summary. Stateless, so it runs as it is on streams and tables."""
    from ..operators.texts import char_chunks

    cut = lines.select("blob", F.posexplode(char_chunks(F.col("text"), size)).alias("i", "piece"))
    return cut.select("blob", (F.col("i") + 1).alias("chunk"), summarize(F.col("piece")).alias("summary"))
