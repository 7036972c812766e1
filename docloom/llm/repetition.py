"""Problem 10: repetition inside a single document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, column_type, hash_sample, map_arrow, table, word_hash

#: Words of a passage that counts as repeated.
PASSAGE_WORDS = 8
#: Share of repeated words from which a document counts as repetitive.
LIMIT = 0.4
#: Labelled documents the classifier is fitted on, at most.
TRAIN_ROWS = 3000
#: Calibrated probability from which the classifier alone would call a document repetitive.
EVEN_ODDS = 0.5
WORD_GRAMS = (1, 2, 4, 8)
CHAR_GRAM = 10
BUCKETS = 2048

_DIGITS = re.compile(r"\d+")


def normal_words(text: str) -> list[str]:
    """Words without case and digits; a word of digits only is no word."""
    return [w for w in (_DIGITS.sub("", raw) for raw in text.lower().split()) if w]


def repeated_share(words: list, n: int = PASSAGE_WORDS) -> float:
    """Exact share of words in passages of ``n`` or more words, or in loops of a shorter phrase, that occurred earlier in the text.

    A loop of a phrase of p < n words counts from its second round on where the rounds together have at least n words beyond the first.
    An empty text has share 0.
    """
    size = len(words)
    if size < n:
        return 0.0
    covered = bytearray(size)
    seen: set = set()
    for i in range(size - n + 1):
        key = tuple(words[i : i + n])
        if key in seen:
            covered[i : i + n] = b"\1" * n
        else:
            seen.add(key)
    return sum(covered) / size


def covered_shares(code: np.ndarray, start: np.ndarray, doc: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """:func:`repeated_share` of many texts at once, by 64-bit hashes of their n-grams: ``code``, place and text of every n-gram, and the number of words of each text."""
    places = int(words.sum())
    order = np.lexsort((start, code, doc))
    again = np.zeros(len(code), bool)
    again[order[1:]] = (code[order[1:]] == code[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    edge = np.zeros(places + 1, np.int64)
    np.add.at(edge, start[again], 1)
    np.add.at(edge, start[again] + n, -1)
    covered = np.cumsum(edge[:-1]) > 0
    ends = np.cumsum(words)
    total = np.concatenate([[0], np.cumsum(covered)])
    return (total[ends] - total[ends - words]) / np.maximum(words, 1)


class FeatureExtractor:
    """Hashed word and character n-gram features of a batch of texts, all in NumPy.

    Every n-gram is hashed into BUCKETS counters of its document. For each n the features are the log-odds that two n-grams of
    the document fall together and the share of the fullest counter; with them the logarithm of the length, and last the share of
    words in PASSAGE_WORDS-grams whose whole hash came before. Whole texts count.
    """

    width = 2 * (len(WORD_GRAMS) + 1) + 2

    def __init__(self):
        self.cache = WordCache(lambda raw: word_hash(w) if (w := _DIGITS.sub("", raw)) else 0)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        look = self.cache.__getitem__
        each = [list(map(look, text.lower().split())) for text in texts]
        flat = np.fromiter(chain.from_iterable(each), np.uint64, sum(map(len, each)))
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, each), np.int64, len(each)))
        keep = flat != 0
        return flat[keep], doc[keep]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for a in range(0, len(texts), 256):
            part = texts[a : a + 256]
            flat, doc = self.ids(part)
            cols = [np.log1p(np.bincount(doc, minlength=len(part)))]
            code, n = np.zeros(0, np.uint64), 0
            for size in WORD_GRAMS:
                while n < size:
                    code = flat.copy() if n == 0 else code[:-1] * _MIX + flat[n:]
                    n += 1
                m = max(0, len(flat) - size + 1)
                same = doc[:m] == doc[size - 1 : size - 1 + m]
                cols += _evenness(code[:m][same], doc[:m][same], len(part))
                if size == PASSAGE_WORDS:
                    share = covered_shares(code[:m][same], np.flatnonzero(same), doc[:m][same], np.bincount(doc, minlength=len(part)), size)
            cols += [*self._chars(part), share]
            out[a : a + len(part)] = np.column_stack(cols)
        return out

    def _chars(self, texts: list[str]) -> list[np.ndarray]:
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        flat = np.concatenate([*raw, np.zeros(0, np.uint32)]).astype(np.uint64)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(r) for r in raw])
        m = max(0, len(flat) - CHAR_GRAM + 1)
        code = flat[:m].copy()
        for k in range(1, CHAR_GRAM):
            code *= _MIX
            code += flat[k : k + m]
        same = doc[:m] == doc[CHAR_GRAM - 1 : CHAR_GRAM - 1 + m]
        return _evenness(code[same], doc[:m][same], len(texts))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _evenness(code: np.ndarray, doc: np.ndarray, docs: int) -> list[np.ndarray]:
    slot = ((code * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(53)).astype(np.int64)
    count = np.bincount(doc * BUCKETS + slot, minlength=docs * BUCKETS).reshape(docs, BUCKETS)
    n = np.maximum(count.sum(1), 2).astype(float)
    pairs = np.einsum("ij,ij->i", count, count, dtype=float) - count.sum(1)
    return [np.log(pairs / (n * (n - 1)) + 1e-6), count.max(1) / n]


@dataclass
class RepetitionModel:
    """Regularised logistic regression with Platt calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = self.margin(features) * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def margin(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return x @ self.weights[1:] + self.weights[0]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's method; the intercept isn't shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pull = np.zeros(x.shape[1]), np.r_[1e-3, np.full(x.shape[1] - 1, ridge)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], ridge: float = 1.0) -> RepetitionModel | None:
    """Fit on two thirds of the texts and calibrate on the rest; labels are whether the exact share reaches LIMIT. None where only one class occurs."""
    if len(texts) < 12:
        return None
    x = FeatureExtractor()(texts)
    y = np.array([repeated_share(normal_words(t)) >= LIMIT for t in texts], float)
    fold = np.arange(len(texts)) % 3 == 2
    if min(y[fold].sum(), (1 - y[fold]).sum(), y[~fold].sum(), (1 - y[~fold]).sum()) == 0:
        return None
    mean, scale = x[~fold].mean(0), x[~fold].std(0) + 1e-9
    model = RepetitionModel(mean, scale, _logistic((x[~fold] - mean) / scale, y[~fold], ridge), 1.0, 0.0)
    shift, slope = _logistic(model.margin(x[fold])[:, None], y[fold], 0.1)
    model.slope, model.shift = max(float(slope), 1e-3), float(shift)
    return model


def training_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> list[str]:
    """The texts of a bounded sample of ``rows`` documents (at most twice as many where ids repeat), the same on every run."""
    return [r[0] for r in hash_sample(documents, id_col, rows).where(F.col(text_col).isNotNull()).select(text_col).limit(2 * rows).collect()]


def measure_repetition(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, probability, likely, share, repetitive) of every document.

    Method: hashed word and character n-gram logistic regression, fitted on at most ``train_rows`` documents labelled by the
    exact measure (no labelled table is given), probability-calibrated on a held-out third, and scored in Arrow batches:
    ``likely`` is a probability of at least EVEN_ODDS. The share of repeated words is counted in the same pass for every document
    and decides: ``repetitive`` is ``share >= LIMIT``, as a fitted border lies near it but not on it. Equal n-grams are told by
    64-bit hashes.

    Null or empty text: probability 0, share 0, not repetitive. Without enough labels of both kinds for a fit the probability is the
    share's verdict. Repeated rows give repeated rows. No shuffle.
    """
    model = fit(training_texts(documents, id_col, text_col, train_rows))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        features = FeatureExtractor()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            x = features(texts)
            share = x[:, -1]
            prob = shared.value.probability(x) if shared.value else (share >= LIMIT).astype(float)
            prob = np.where([bool(t) for t in texts], prob, 0.0)
            yield [batch.column(0), prob, prob >= EVEN_ODDS, share, share >= LIMIT]

    schema = f"`{id_col}` {column_type(documents, id_col)}, probability double, likely boolean, share double, repetitive boolean"
    return map_arrow(documents.select(id_col, text_col), run, schema)


def repetitive_documents(spark, sf_dir: str) -> DataFrame:
    return measure_repetition(table(spark, sf_dir, "documents")).where("repetitive").select("doc_id").distinct()


def repetition_shares(spark, sf_dir: str) -> DataFrame:
    return measure_repetition(table(spark, sf_dir, "documents")).select("doc_id", F.round("share", 6).alias("share"), "repetitive").distinct()


def classifier_check(spark, sf_dir: str) -> DataFrame:
    """How far the classifier alone agrees with the measure: (likely, repetitive, documents)."""
    return measure_repetition(table(spark, sf_dir, "documents")).groupBy("likely", "repetitive").agg(F.count("*").alias("documents"))
