"""Continuous ingestion and event-time windows on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import bm25, chunking
from docloom.plans.tables import materialize
from docloom.sources.store import PARTS, TableStore


def part_of(source: str = "source") -> Column:
    return F.pmod(F.xxhash64(source), F.lit(PARTS)).cast("int")


def ingest(documents: DataFrame, store: TableStore, checkpoint: str, max_tokens: int = 250):
    """Start a query that chunks streamed documents (source, text and, if versions can come together, modified) and keeps the tables chunks and postings current.

    A batch replaces the chunks and postings of its sources, of several versions of one the latest. Tables are kept in PARTS by hash of
    the source: a batch writes new files of the parts its sources fall into, the others are carried over as they lie. One pointer names the
    parts of both tables and moves last, so readers never see half a batch or tables of two batches, a failure before it changes
    nothing, and a batch that is run again gives the same tables. A document whose text can't be chunked is listed in ``failed`` and
    leaves the others alone, and what was there of it stays.
    """

    def batch(rows: DataFrame, _: int) -> None:
        apply_batch(rows, store, max_tokens)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_batch(rows: DataFrame, store: TableStore, max_tokens: int = 250) -> dict[str, dict[str, str]]:
    """One batch of :func:`ingest`; returns the new state."""
    order = F.col("modified") if "modified" in rows.columns else F.lit(0)
    latest = rows.groupBy("source").agg(F.max_by("text", F.struct(order.alias("m"), "text")).alias("text"))
    chunks = materialize(chunking.chunk_documents(latest.where(F.col("text").isNotNull()), max_tokens=max_tokens, tolerant=True), "chunks")
    good = chunks.select("source").distinct()
    failed = latest.select("source").join(good, "source", "left_anti").withColumn("status", F.lit("failed"))
    posts = bm25.postings(chunks).join(chunks.select(F.col("chunk_id").alias("id"), "source"), "id")
    store.replace("failed", failed)
    return store.update_parts({"chunks": chunks, "postings": posts}, good.withColumn("part", part_of()))


def remove_sources(store: TableStore, sources: DataFrame) -> None:
    """Take sources out of both tables, which change together."""
    store.update_parts({"chunks": None, "postings": None}, sources.select("source").distinct().withColumn("part", part_of()))


def reindex_plan(produced: DataFrame, indexed: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """(chunk_id, action): 'add' what is produced and not indexed, 'delete' what is indexed and no longer produced, except chunks of ``protected`` sources, whose parsing failed."""
    new = produced.select("chunk_id").distinct().join(indexed.select("chunk_id").distinct(), "chunk_id", "left_anti").withColumn("action", F.lit("add"))
    gone = indexed.select("chunk_id", "source").distinct().join(produced.select("chunk_id").distinct(), "chunk_id", "left_anti")
    if protected is not None:
        gone = gone.join(protected.select("source").distinct(), "source", "left_anti")
    return new.unionByName(gone.select("chunk_id", F.lit("delete").alias("action")))


def embed_missing(chunks: DataFrame, cached: DataFrame, encode, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, embedding) of all chunks: the cached vectors of those that have one, ``encode(text) -> Column`` for the others alone. Cached vectors of chunks that are gone are left out."""
    have = cached.select(id_col, "embedding").dropDuplicates([id_col])
    known = have.join(chunks.select(id_col).distinct(), id_col, "left_semi")
    new = chunks.select(id_col, text_col).dropDuplicates([id_col]).join(have.select(id_col), id_col, "left_anti")
    return known.unionByName(new.select(id_col, encode(F.col(text_col)).alias("embedding")))


def job_outcome(results: DataFrame) -> DataFrame:
    """(job_id, outcome, failed, documents): succeeded, partial or failed by the share of failed documents."""
    bad = F.sum(F.when(F.col("status") == "failed", 1).otherwise(0))
    outcome = F.when(bad == 0, "succeeded").when(bad == F.count("*"), "failed").otherwise("partial")
    return results.groupBy("job_id").agg(outcome.alias("outcome"), bad.alias("failed"), F.count("*").alias("documents"))


def queue_state(log: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(job_id, state, attempts): the last event of each job; a job that is still running after a restart goes back to the queue, or fails at the last attempt."""
    last = log.groupBy("job_id").agg(F.max_by("state", "ts").alias("state"), F.sum(F.when(F.col("state") == "running", 1).otherwise(0)).alias("attempts"))
    state = F.when((F.col("state") == "running") & (F.col("attempts") >= max_attempts), "failed").when(F.col("state") == "running", "queued").otherwise(F.col("state"))
    return last.select("job_id", state.alias("state"), "attempts")


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "30 minutes", stream: bool = True) -> DataFrame:
    """Extension: (window_start, event_type, n, total) of tumbling or sliding event-time windows with a watermark."""
    rows = events.withWatermark("ts", late) if stream else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", stream: bool = True) -> DataFrame:
    """Extension: (user_id, session_start, n) of sessions that end after ``gap`` without an event."""
    rows = events.withWatermark("ts", late) if stream else events
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def run_to_memory(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain what a stream has into an in-memory table; for tests and small demonstrations."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
