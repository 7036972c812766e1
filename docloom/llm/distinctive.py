"""Problem 6: how distinctive a term is per record."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, broadcast_if_small, column_type, map_arrow, materialize, table
from .lookalikes import FIXED, canonical

#: Topics whose terms are broadcast together; more are handled in blocks.
TOPIC_BLOCK = 100_000
#: Terms in at most this many records give the first candidates of a topic. Any value gives the same result.
SEED_DOCS = 64
#: Repeated ids, and terms of the collection, that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(raw: str) -> tuple[str, ...]:
    """Terms of a whitespace-separated piece: runs of letters and digits, in lower case, look-alike characters in their ordinary form."""
    out, run = [], []
    if not raw.isascii() and FIXED.is_suspect(raw):
        raw = canonical(raw)[0]
    for ch in raw.lower():
        if ch.isalnum():
            run.append(ch)
        elif run:
            out.append("".join(run))
            run = []
    if run:
        out.append("".join(run))
    return tuple(out)


def term_counts(df: DataFrame, text_col: str = "text", terms: frozenset[str] | None = None) -> DataFrame:
    """(term, df, cf): records with the term and its occurrences, counted within each Arrow batch before the only shuffle. ``terms`` restricts the terms, not the records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        cache = WordCache(words if terms is None else lambda raw: tuple(w for w in words(raw) if w in terms))
        look = cache.__getitem__
        for batch in batches:
            records: Counter = Counter()
            total: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    own = Counter(chain.from_iterable(map(look, text.split())))
                    records.update(own.keys())
                    total.update(own)
            if total:
                yield [list(total), [records[t] for t in total], list(total.values())]

    return map_arrow(df.select(text_col), run, "term string, df bigint, cf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def with_weights(counts: DataFrame, records: int) -> DataFrame:
    """Adds ``idf`` = -log2(df/N) and ``ridf``, the idf less the one a Poisson distribution of cf occurrences over N records would give."""
    n = F.lit(float(max(records, 1)))
    idf = F.log2(n / F.col("df"))
    expected = -F.log2(-F.expm1(-F.col("cf") / n))
    return counts.withColumn("idf", idf).withColumn("ridf", idf - expected)


def distinct_records(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """One row per id; a repeat of a record counts once.

    Only ids are shuffled to find the repeated ones; the other rows stay where they lie, and of the repeated ones alone the texts move
    (of all, where more than BROADCAST_ROWS ids repeat).
    """
    some = df.select(id_col, text_col).where(F.col(id_col).isNotNull())
    repeated = materialize(some.groupBy(id_col).count().where("count > 1").select(id_col), "repeated")
    n = repeated.count()
    if n > BROADCAST_ROWS:
        return some.dropDuplicates([id_col])
    again = F.broadcast(repeated)
    return some.join(again, id_col, "left_anti").unionByName(some.join(again, id_col, "left_semi").dropDuplicates([id_col])) if n else some


def term_weights(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", terms: frozenset[str] | None = None) -> DataFrame:
    """(term, df, cf, idf, ridf) over the whole collection; repeats of a record count once, null texts have no terms."""
    return with_weights(term_counts(distinct_records(df, id_col, text_col), text_col, terms), df.select(id_col).where(F.col(id_col).isNotNull()).distinct().count())


def score_terms(df: DataFrame, weights: DataFrame, id_col: str = "chunk_id", text_col: str = "text", weight: str = "ridf") -> DataFrame:
    """(id, term, tf, score) with ``score = tf * weight`` of every term of every record.

    ``weight`` is ``ridf`` (residual inverse document frequency: terms concentrated in few records) or ``idf``. The weights of up to
    BROADCAST_ROWS terms are broadcast, so no token moves; more are joined by term, where a hot term is spread by adaptive skew
    handling, as each of its rows stands alone.
    """
    weights = materialize(weights.select("term", F.col(weight).alias("__w")), "weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        look = WordCache(words).__getitem__
        for batch in batches:
            own = [Counter(chain.from_iterable(map(look, (t or "").split()))) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, c in enumerate(own) for _ in c], pa.int64())
            if len(at):
                yield [batch.column(0).take(at), [t for c in own for t in c], [n for c in own for n in c.values()]]

    tf = map_arrow(distinct_records(df, id_col, text_col), run, f"`{id_col}` {column_type(df, id_col)}, term string, tf int")
    return tf.join(broadcast_if_small(weights, weights.count(), BROADCAST_ROWS), "term").select(id_col, "term", "tf", (F.col("tf") * F.col("__w")).alias("score"))


class TopicIndex:
    """A block of topics: their terms, the terms' weights, and for each opening term the topics it opens."""

    def __init__(self, topics: dict[int, list[str]], weights: dict[str, tuple[int, float]]):
        self.weights = {t: w for t, (_, w) in weights.items()}
        self.topics = {k: frozenset(t for t in ts if t in self.weights) for k, ts in topics.items()}
        self.opens: dict[str, list[int]] = {}

    def open_with(self, chosen: dict[int, list[str]]) -> TopicIndex:
        self.opens = {}
        for topic, terms in chosen.items():
            for t in terms:
                self.opens.setdefault(t, []).append(topic)
        return self

    def score(self, topic: int, record: set[str]) -> float:
        return math.fsum(self.weights[t] for t in self.topics[topic] & record)


def _candidates(df: DataFrame, index: TopicIndex, id_col: str, text_col: str) -> DataFrame:
    """(topic, id, score) of every record that has an opening term of a topic; the best record of each topic within each batch."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        idx = shared.value
        known = idx.weights
        look = WordCache(lambda raw: tuple(w for w in words(raw) if w in known)).__getitem__
        for batch in batches:
            best: dict[int, tuple[float, int]] = {}
            ids = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text or ids[i] is None:
                    continue
                record = set(chain.from_iterable(map(look, text.split())))
                for topic in {k for t in record if t in idx.opens for k in idx.opens[t]}:
                    s = idx.score(topic, record)
                    was = best.get(topic)
                    if was is None or (-s, ids[i]) < (-was[0], ids[was[1]]):
                        best[topic] = (s, i)
            if best:
                yield [list(best), batch.column(0).take(pa.array([i for _, i in best.values()], pa.int64())), [s for s, _ in best.values()]]

    return map_arrow(df.select(id_col, text_col), run, f"topic bigint, `{id_col}` {column_type(df, id_col)}, score double")


def _best(candidates: DataFrame, id_col: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), F.asc(id_col)))
    return candidates.withColumn("__r", rank).where("__r = 1").drop("__r")


def best_records(df: DataFrame, topics: DataFrame, id_col: str = "chunk_id", text_col: str = "text", topic_id: str = "topic_id", question: str = "question", weight: str = "idf", seed_docs: int = SEED_DOCS, block: int = TOPIC_BLOCK) -> DataFrame:
    """(topic_id, id, score): for each topic the record whose shared terms weigh most, ties by the smaller id; topics that share no term have no row.

    The topics are a stated query set, handled in blocks of at most ``block`` and broadcast as an index. A record is scored for a
    topic only if it has one of the topic's opening terms, and the opening terms are chosen so that nothing is lost: first the
    terms in at most ``seed_docs`` records (and always the rarest); a topic is done when all its other terms together weigh
    less than its best score. The rest get a second pass opened by as many of their weightiest terms as that needs.
    """
    rows = topics.select(topic_id, question).where(F.col(topic_id).isNotNull() & F.col(question).isNotNull()).distinct()
    n_blocks = -(-max(rows.count(), 1) // block)
    records = df.select(id_col).where(F.col(id_col).isNotNull()).distinct().count()
    parts = []
    for b in range(n_blocks):
        own: dict[int, set[str]] = {}
        for k, q in rows.where(F.pmod(F.xxhash64(topic_id), F.lit(n_blocks)) == b).toLocalIterator():
            own.setdefault(k, set()).update(w for raw in q.split() for w in words(raw))
        vocabulary = frozenset(chain.from_iterable(own.values()))
        counted = with_weights(term_counts(distinct_records(df, id_col, text_col), text_col, vocabulary), records)
        weights = {r["term"]: (r["df"], r[weight]) for r in counted.collect()}
        index = TopicIndex({k: sorted(ts) for k, ts in own.items()}, weights)
        ranked = {k: sorted(ts, key=lambda t: (-index.weights[t], t)) for k, ts in index.topics.items() if ts}
        seeds = {k: [t for i, t in enumerate(ts) if i == 0 or weights[t][0] <= seed_docs] for k, ts in ranked.items()}
        first = materialize(_best(_candidates(df, index.open_with(seeds), id_col, text_col), id_col), "topics")
        open_again: dict[int, list[str]] = {}
        for r in first.toLocalIterator():
            k = r["topic"]
            others = [t for t in ranked[k] if t not in set(seeds[k])]
            rest = math.fsum(max(index.weights[t], 0.0) for t in others)
            if rest < r["score"]:
                continue
            need = list(seeds[k])
            for t in others:
                if rest < r["score"]:
                    break
                need.append(t)
                rest -= max(index.weights[t], 0.0)
            open_again[k] = need
        parts.append(first)
        if open_again:
            parts.append(_candidates(df, index.open_with(open_again), id_col, text_col))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _best(out, id_col).select(F.col("topic").cast(column_type(topics, topic_id)).alias(topic_id), id_col, "score")


def topic_chunks(spark, sf_dir: str) -> DataFrame:
    return best_records(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "pool_topics")).select("topic_id", "chunk_id")


def chunk_term_weights(spark, sf_dir: str) -> DataFrame:
    return term_weights(table(spark, sf_dir, "chunks")).select("term", "df", "cf", F.round("ridf", 6).alias("ridf"))


def chunk_term_scores(spark, sf_dir: str) -> DataFrame:
    """Every term of every chunk with its frequency there times its residual idf."""
    chunks = table(spark, sf_dir, "chunks")
    return score_terms(chunks, term_weights(chunks)).withColumn("score", F.round("score", 6))
