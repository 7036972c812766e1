"""Problem 3: lines repeated across the documents of one source."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, column_type, map_arrow, materialize, table, word_hash

#: A line is boilerplate from so many documents of its source, and from one in so many of them, on.
MIN_DOCS, ONE_IN = 3, 5
#: Counters of one summary of one source.
COUNTERS = 1024
#: Counters a worker holds over all its sources before it hands its summaries on.
FLUSH = 1_000_000
#: Confirmed lines are broadcast up to this many; beyond it they are joined.
BROADCAST_ROWS = 200_000
#: Tasks over which a source's documents are spread where the sets are joined.
SALTS = 32

_NO_LETTER = re.compile(r"[\W\d_]+")


def line_key(line: str) -> int:
    """Hash of the letters alone, in lower case; 0 for a line without any letter."""
    letters = _NO_LETTER.sub("", unicodedata.normalize("NFC", line).lower())
    return _signed(word_hash(letters)) if letters else 0


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def line_keys(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, keys): one key per line, in order, 0 where the line has no letter. Rows without text or source are left out; equal rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            keys = [[line_key(line) for line in text.split("\n")] for text in batch.column(2).to_pylist()]
            yield [batch.column(0), batch.column(1), keys]

    some = documents.select(id_col, source_col, text_col).where(F.col(text_col).isNotNull() & F.col(source_col).isNotNull())
    return map_arrow(some, run, f"`{id_col}` {column_type(documents, id_col)}, `{source_col}` string, keys array<bigint>").distinct()


class Summary:
    """Misra-Gries summary: every count is too low by at most ``error``; two summaries merge by adding counts and errors."""

    __slots__ = ("counts", "error", "docs")

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.error = self.docs = 0

    def add(self, keys, capacity: int) -> None:
        self.docs += 1
        counts = self.counts
        for key in keys:
            counts[key] = counts.get(key, 0) + 1
        if len(counts) > 2 * capacity:
            self.shrink(capacity)

    def shrink(self, capacity: int) -> None:
        """Lower all counts by the largest that does not fit, as the merge of summaries does."""
        if len(self.counts) > capacity:
            least = int(np.partition(np.fromiter(self.counts.values(), np.int64, len(self.counts)), -capacity - 1)[-capacity - 1])
            self.counts = {k: c - least for k, c in self.counts.items() if c > least}
            self.error += least


def summarize(keys: DataFrame, source_col: str = "source", counters: int = COUNTERS) -> DataFrame:
    """Merged summaries: (source, key, low) with a last row of key null per source that carries (docs, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held: dict[str, Summary] = {}
        size = 0
        for batch in batches:
            for source, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                summary = held.setdefault(source, Summary())
                before = len(summary.counts)
                summary.add({k for k in line if k}, counters)
                size += len(summary.counts) - before
            if size > FLUSH:
                yield from emit(held)
                held, size = {}, 0
        yield from emit(held)

    def emit(held: dict[str, Summary]) -> Iterator[list]:
        for source, s in held.items():
            s.shrink(counters)
            n = len(s.counts)
            yield [[source] * (n + 1), [*s.counts, None], [*s.counts.values(), 0], [0] * n + [s.docs], [0] * n + [s.error]]

    parts = map_arrow(keys.select(source_col, "keys"), run, f"`{source_col}` string, key bigint, low bigint, docs bigint, error bigint")
    return parts.groupBy(source_col, "key").agg(F.sum("low").alias("low"), F.sum("docs").alias("docs"), F.sum("error").alias("error"))


def repeated_lines(keys: DataFrame, id_col: str = "doc_id", source_col: str = "source", min_docs: int = MIN_DOCS, one_in: int = ONE_IN, counters: int = COUNTERS) -> DataFrame:
    """(source, key, n_docs, source_docs) of the lines in at least ``min_docs`` and one in ``one_in`` documents of their source.

    First pass: mergeable heavy-hitter summaries per source, built where the documents lie, so that a hot source moves no more
    than ``counters`` rows a task. Second pass: exact document counts of the candidates alone. A summary can only lose lines in
    at most ``error`` documents; sources whose error reaches the threshold are counted exactly over all their lines.
    """
    merged = materialize(summarize(keys, source_col, counters), "summaries")
    sources = merged.where(F.col("key").isNull()).select(source_col, "docs", "error")
    least = F.greatest(F.lit(min_docs), F.ceil(F.col("docs") / F.lit(one_in)))
    weak = sources.where(F.col("error") >= least).select(source_col)
    strong = sources.where(F.col("error") < least)
    candidates = merged.where(F.col("key").isNotNull()).select(source_col, "key", "low").join(strong, source_col).where(F.col("low") + F.col("error") >= least).select(source_col, "key")
    candidates = materialize(candidates, "candidates")
    lines = keys.select(source_col, F.explode(F.array_distinct("keys")).alias("key")).where(F.col("key") != 0)
    counted = lines.join(broadcast_if_small(candidates, candidates.count(), BROADCAST_ROWS), [source_col, "key"], "left_semi")
    if not weak.isEmpty():
        counted = counted.unionByName(lines.join(weak, source_col, "left_semi"))
    counts = counted.groupBy(source_col, "key").agg(F.count("*").alias("n_docs"))
    return counts.join(sources.select(source_col, F.col("docs").alias("source_docs")), source_col).where((F.col("n_docs") >= min_docs) & (F.col("n_docs") * one_in >= F.col("source_docs")))


def find_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, source, line_no, n_docs, source_docs) of every repeated line, ``line_no`` counted from 1 with empty lines.

    Null texts and sources and lines without a letter give nothing; equal rows count once; an empty table gives an empty result.
    """
    keys = materialize(line_keys(documents, id_col, text_col, source_col), "line-keys")
    lines = materialize(repeated_lines(keys, id_col, source_col, **options), "lines")
    placed = keys.select(id_col, source_col, F.posexplode("keys").alias("at", "key")).where(F.col("key") != 0)
    found = placed.join(broadcast_if_small(lines, lines.count(), BROADCAST_ROWS), [source_col, "key"])
    return found.select(id_col, source_col, (F.col("at") + 1).alias("line_no"), "n_docs", "source_docs")


def remove_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``documents`` with the repeated lines taken out of ``text_col``; all rows and columns stay, null texts and sources as they are.

    The confirmed lines come as one set per source: each is in a fifth of its documents, so a set holds at most five times as many lines
    as a document has on average. The sets are broadcast while all together have at most BROADCAST_ROWS lines; beyond that they are
    joined by source and a salt, so that a hot source spreads over SALTS tasks. Each row's own lines are judged either way.
    """
    keys = materialize(line_keys(documents, id_col, text_col, source_col), "line-keys")
    lines = materialize(repeated_lines(keys, id_col, source_col, **options), "lines")
    sets = lines.groupBy(F.col(source_col).alias("__source")).agg(F.collect_set("key").alias("__lines"))

    @F.pandas_udf("string")
    def without(text, gone):
        return text.combine(gone, lambda t, keys: "\n".join(line for line in t.split("\n") if line_key(line) not in own) if t is not None and keys is not None and len(own := set(keys)) else t)

    if lines.count() <= BROADCAST_ROWS:
        joined = documents.join(F.broadcast(sets), F.col(source_col) == F.col("__source"), "left")
    else:
        sets = sets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = documents.withColumn("__own", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(sets, (F.col(source_col) == F.col("__source")) & (F.col("__own") == F.col("__salt")), "left")
    return joined.withColumn(text_col, F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(without(text_col, "__lines"))).select(documents.columns)


def lines_found(spark, sf_dir: str) -> DataFrame:
    return find_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no")


def cleaned_documents(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "source", F.md5("text").alias("digest"))
