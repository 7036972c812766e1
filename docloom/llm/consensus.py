"""Problem 1: consensus from several annotators' labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, column_type, map_arrow, materialize, table
from .distinctive import words

CLASSES = 3
#: Annotators of a model, at most; nine sums of each come to the driver in Arrow's form (15 MB for the most) and go to the tasks.
MAX_ANNOTATORS = 100_000
#: Rounds of expectation-maximisation, at most, and the largest change of a confusion probability (a tenth of it of a weight) that ends them.
ROUNDS, TOLERANCE = 40, 2e-3
#: Pull of the classifier's weights to zero, and counts added to each confusion matrix (off and on its diagonal).
RIDGE, SMOOTH, TRUST = 2.0, 0.5, 1.0
#: Judged records are broadcast up to this many to pick their texts, joined beyond.
BROADCAST_ROWS = 500_000


def standing_grades(judgments: DataFrame) -> DataFrame:
    """(topic_id, chunk_id, pass_no, grade): per topic, record and pass the row of the highest ``ts``, if it is a grade.

    Of rows with equal ``ts`` an undo counts, then the highest grade. Null keys, null ``ts`` only beside no other, and grades
    outside 0 to 2 give no grade.
    """
    keys = ["topic_id", "chunk_id", "pass_no"]
    last = F.max(F.struct(F.coalesce("ts", F.lit(float("-inf"))).alias("ts"), F.coalesce("undo", F.lit(False)).alias("undo"), F.coalesce("grade", F.lit(-1)).alias("grade")))
    rows = judgments.where(F.col("topic_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("pass_no").isNotNull())
    return rows.groupBy(*keys).agg(last.alias("last")).where(~F.col("last.undo") & F.col("last.grade").between(0, CLASSES - 1)).select(*keys, F.col("last.grade").alias("grade"))


def item_features(items: DataFrame, topics: DataFrame, records: DataFrame) -> DataFrame:
    """(topic_id, chunk_id, features): how much of the topic's question the record's text shares.

    Words weigh by how few questions have them. Features: the shared weight, the largest shared weight and the shared number of
    words, each as a share of the question's. A missing topic or text gives zeros.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            rows = [(i, w) for i, q in enumerate(batch.column(1).to_pylist()) for w in {w for raw in (q or "").split() for w in words(raw)}]
            if rows:
                at, terms = zip(*rows)
                yield [batch.column(0).take(pa.array(at, pa.int64())), terms]

    known = topics.select("topic_id", "question").where(F.col("topic_id").isNotNull()).dropDuplicates(["topic_id"])
    terms = materialize(map_arrow(known, tokens, f"topic_id {column_type(topics, 'topic_id')}, term string"), "terms")
    n = max(1, known.count())
    weight = terms.groupBy("term").agg(F.log2(F.lit(n + 1.0) / F.count("*")).alias("w"))
    weighed = terms.join(weight, "term").groupBy("topic_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    judged = items.select("chunk_id").distinct()
    texts = records.select("chunk_id", "text").join(broadcast_if_small(judged, judged.count(), BROADCAST_ROWS), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    pairs = items.select("topic_id", "chunk_id").join(weighed, "topic_id", "left").join(texts, "chunk_id", "left")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            out = []
            for terms, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = {w for raw in (text or "").split() for w in words(raw)}
                ws = np.array([t["w"] for t in terms or []])
                hit = np.array([t["term"] in own for t in terms or []], bool)
                out.append([float(ws[hit].sum() / ws.sum()), float(ws[hit].max() / ws.max()) if hit.any() else 0.0, float(hit.mean())] if len(ws) and ws.sum() else [0.0] * 3)
            yield [batch.column(0), batch.column(1), out]

    return map_arrow(pairs.select("topic_id", "chunk_id", "terms", "text"), overlap, f"topic_id {column_type(items, 'topic_id')}, chunk_id {column_type(items, 'chunk_id')}, features array<double>")


@dataclass
class ConsensusModel:
    """Annotators' confusion matrices and the classifier whose output is the prior of an item's grade."""

    annotators: np.ndarray  # sorted pass numbers
    confusion: np.ndarray  # annotator x true x given, rows sum to one
    weights: np.ndarray  # class x (1 + features), the first class is the base

    def prior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.T
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def posterior(self, x: np.ndarray, item: np.ndarray, who: np.ndarray, grade: np.ndarray) -> np.ndarray:
        log = np.log(self.prior(x) + 1e-12)
        np.add.at(log, item, np.log(self.confusion[who, :, grade]))
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _unpack(batch: pa.RecordBatch, annotators: np.ndarray):
    """Feature matrix with its constant, and item, annotator and grade of every vote."""
    votes = batch.column("votes")
    sizes = np.diff(votes.offsets.to_numpy())
    flat = votes.flatten()
    who = np.searchsorted(annotators, flat.field("pass_no").to_numpy(zero_copy_only=False))
    grade = flat.field("grade").to_numpy(zero_copy_only=False).astype(np.int64)
    features = batch.column("features").flatten().to_numpy(zero_copy_only=False)
    n = batch.num_rows
    x = np.column_stack([np.ones(n), features.reshape(n, -1)]) if n else np.ones((0, 1))
    return x, np.repeat(np.arange(n), sizes), who, grade


def _statistics(items: DataFrame, model: ConsensusModel, first: bool, size: int) -> np.ndarray:
    """One expectation step over all items: sums of the votes' posteriors per annotator, the classifier's gradient and curvature, and the change."""
    shared = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        m = shared.value
        a, d = len(m.annotators), m.weights.shape[1]
        counts = np.zeros((a, CLASSES, CLASSES))
        gradient, curve = np.zeros((CLASSES, d)), np.zeros((CLASSES * d, CLASSES * d))
        scale = np.zeros(3)
        for batch in batches:
            x, item, who, grade = _unpack(batch, m.annotators)
            if first:
                p = np.full((len(x), CLASSES), 0.1)
                np.add.at(p, (item, grade), 1.0)
                p /= p.sum(1, keepdims=True)
            else:
                p = m.posterior(x, item, who, grade)
            for k in range(CLASSES):
                np.add.at(counts[:, k, :], (who, grade), p[item, k])
            q = m.prior(x)
            gradient += (p - q).T @ x
            for k in range(CLASSES):
                for j in range(CLASSES):
                    h = q[:, k] * ((k == j) - q[:, j])
                    curve[k * d : (k + 1) * d, j * d : (j + 1) * d] += (x * h[:, None]).T @ x
            scale += [len(x), p.max(1).sum(), np.log(np.maximum(p.max(1), 1e-12)).sum()]
        flat = np.concatenate([counts.ravel(), gradient.ravel(), curve.ravel(), scale])
        at = np.flatnonzero(flat)
        if len(at):
            yield [at, flat[at]]

    sums = map_arrow(items, run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    shared.unpersist()
    flat = np.zeros(size)
    flat[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    return flat


def fit_consensus(items: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> ConsensusModel:
    """Expectation-maximisation over ``items`` (votes array<struct<pass_no, grade>>, features array<double>).

    A round is one pass of the items: each task sums its own statistics and only their fixed number of sums is shuffled, however
    many items there are. The maximisation step takes the smoothed confusion matrices and one damped Newton step of the
    ridge-regularised multinomial classifier on the posteriors.
    """
    names = [r[0] for r in items.select(F.explode("votes.pass_no").alias("p")).distinct().limit(MAX_ANNOTATORS + 1).collect()]
    if len(names) > MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    annotators = np.array(sorted(names))
    head = items.select(F.size("features").alias("n")).first()
    a, d = len(annotators), 1 + (head["n"] if head else 0)
    model = ConsensusModel(annotators, np.full((a, CLASSES, CLASSES), 1 / CLASSES), np.zeros((CLASSES, d)))
    sizes = np.cumsum([a * CLASSES * CLASSES, CLASSES * d, (CLASSES * d) ** 2, 3])
    for r in range(rounds if a else 0):
        flat = _statistics(items, model, r == 0, int(sizes[-1]))
        counts, gradient, curve, _ = np.split(flat, sizes[:-1])
        smoothed = counts.reshape(a, CLASSES, CLASSES) + SMOOTH + TRUST * np.eye(CLASSES)
        confusion = smoothed / smoothed.sum(2, keepdims=True)
        pull = np.tile(np.r_[1e-3, np.full(d - 1, RIDGE)], CLASSES)
        step = np.linalg.solve(curve.reshape(CLASSES * d, -1) + np.diag(pull + 1e-6), gradient - pull * model.weights.ravel()).reshape(CLASSES, d)
        weights = model.weights + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        change = max(np.abs(confusion - model.confusion).max(), 0.1 * np.abs(weights - model.weights).max())
        model = ConsensusModel(annotators, confusion, weights)
        if r and change < tolerance:
            break
    return model


def label_items(items: DataFrame, model: ConsensusModel) -> DataFrame:
    """(topic_id, chunk_id, grade, confidence, agreement, n_passes) of every item. ``agreement`` is the share of pairs of passes with the same grade (1 for a single pass); of equally likely grades the lower one wins."""
    shared = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            x, item, who, grade = _unpack(batch, shared.value.annotators)
            p = shared.value.posterior(x, item, who, grade)
            votes = np.zeros((len(x), CLASSES))
            np.add.at(votes, (item, grade), 1.0)
            n = votes.sum(1)
            same = (votes * (votes - 1)).sum(1) / np.maximum(n * (n - 1), 1)
            yield [batch.column("topic_id"), batch.column("chunk_id"), p.argmax(1), p.max(1), np.where(n > 1, same, 1.0), n.astype(np.int64)]

    return map_arrow(items, run, f"topic_id {column_type(items, 'topic_id')}, chunk_id {column_type(items, 'chunk_id')}, grade int, confidence double, agreement double, n_passes int")


def reliabilities(model: ConsensusModel) -> list[tuple[int, float, float]]:
    """(pass_no, accuracy, information) of each annotator: the chance of giving the true grade, and the bits an answer tells of a grade, grades being equally likely."""
    out = []
    for who, c in zip(model.annotators, model.confusion):
        given = c.mean(0)
        out.append((int(who), float(np.trace(c) / CLASSES), float((c * np.log2(c / given)).sum() / CLASSES)))
    return out


def consensus_items(judgments: DataFrame, topics: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """(topic_id, chunk_id, votes, features): the standing grades of each item with its features; without ``topics`` and ``records`` the features are empty and the classifier is the grades' shares."""
    grades = materialize(standing_grades(judgments), "grades")
    items = grades.groupBy("topic_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("pass_no", "grade"))).alias("votes"))
    if topics is None or records is None:
        return materialize(items.withColumn("features", F.array().cast("array<double>")), "items")
    return materialize(items.join(item_features(items, topics, records), ["topic_id", "chunk_id"]), "items")


def derive_consensus(judgments: DataFrame, topics: DataFrame | None = None, records: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(consensus, reliability): see :func:`label_items` and :func:`reliabilities`.

    Method: feature-assisted consensus. A regularised classifier of item features and the annotators' confusion matrices are fitted
    jointly by expectation-maximisation; the classifier's output is the prior of an item's grade. Annotators who are worse than
    chance in a regular way still count, with their answers turned.

    One item's votes lie in one row: an item has at most one per annotator. Empty tables give empty results.
    """
    items = consensus_items(judgments, topics, records)
    model = fit_consensus(items)
    rows = reliabilities(model)
    spark = judgments.sparkSession
    reliability = spark.createDataFrame(rows, "pass_no int, accuracy double, information double")
    return label_items(items, model), reliability


def consensus_grades(spark, sf_dir: str) -> DataFrame:
    found, _ = derive_consensus(table(spark, sf_dir, "judgments"), table(spark, sf_dir, "pool_topics"), table(spark, sf_dir, "chunks"))
    return found.where("n_passes >= 3").select("topic_id", "chunk_id", "grade")


def annotator_reliability(spark, sf_dir: str) -> DataFrame:
    return derive_consensus(table(spark, sf_dir, "judgments"), table(spark, sf_dir, "pool_topics"), table(spark, sf_dir, "chunks"))[1]
