"""Retrieval metrics, paired tests and annotation agreement."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import bigrams
from docloom.operators import bm25
from docloom.plans.tables import carried, ranged

KS = (1, 3, 5, 10)
#: Places of a resampling that are in memory at once.
DRAWN = 1_000_000


def per_query_metrics(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, f1, hit, mrr, map, ndcg) at ``k`` for every query with at least one relevant id.

    Precision divides by k, MAP by min(relevant, k), nDCG has binary gains and min(relevant, k) ideal ones. Queries without hits score 0.
    """
    relevant = qrels.select("query_id", "id").distinct()
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    top = run.where(F.col("rank") <= k).select("query_id", "rank", "id")
    hits = top.join(relevant, ["query_id", "id"], "left_semi")
    so_far = F.count("*").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    sums = hits.withColumn("so_far", so_far).groupBy("query_id").agg(
        F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(F.col("so_far") / F.col("rank")).alias("ap"), F.sum(F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg")
    )
    ideal = F.element_at(F.array(*(F.lit(sum(1 / math.log2(i + 1) for i in range(1, n + 1))) for n in range(1, k + 1))), F.least(F.col("n_rel"), F.lit(k)).cast("int"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.col("hits") / F.lit(float(k))), zero(F.col("hits") / F.col("n_rel"))
    return total.join(sums, "query_id", "left").select(
        "query_id",
        p.alias("precision"),
        r.alias("recall"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        zero(1.0 / F.col("first")).alias("mrr"),
        zero(F.col("ap") / F.least("n_rel", F.lit(k))).alias("map"),
        zero(F.col("dcg") / ideal).alias("ndcg"),
    )


def mean_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, digits: int = 4) -> DataFrame:
    """Means over the graded queries, a row per k."""
    out = None
    for k in ks:
        names = ["precision", "recall", "f1", "hit", "mrr", "map", "ndcg"]
        row = per_query_metrics(run, qrels, k).agg(*(F.round(F.avg(c), digits).alias(c) for c in names)).select(F.lit(k).alias("k"), *names)
        out = row if out is None else out.unionByName(row)
    return out


def first_rank(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, first): rank of the first relevant row, null where there is none; every graded query has a row."""
    relevant = qrels.select("query_id", "id").distinct()
    found = run.join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return relevant.select("query_id").distinct().join(found, "query_id", "left")


def recall_by_depth(run: DataFrame, qrels: DataFrame, depths: tuple[int, ...] = (1, 3, 5, 10, 30, 100)) -> DataFrame:
    """(depth, hit_rate, queries) from the first relevant ranks."""
    firsts = first_rank(run, qrels)
    exploded = firsts.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    return exploded.groupBy("depth").agg(F.round(F.avg(F.when(F.col("first") <= F.col("depth"), 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.count("*").alias("queries"))


def failure_causes(run: DataFrame, qrels: DataFrame, sources: DataFrame, k: int = 10) -> DataFrame:
    """(cause, queries): 'hit', 'wrong_clause' where a relevant source but no relevant record is in the top ``k``, else 'wrong_document'. ``sources`` maps id to source."""
    relevant = qrels.select("query_id", "id").distinct()
    of = sources.select("id", "source").dropDuplicates(["id"])
    top = run.where(F.col("rank") <= k).select("query_id", "id")
    hit = top.join(relevant, ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    near = top.join(of, "id").select("query_id", "source").distinct().join(relevant.join(of, "id").select("query_id", "source").distinct(), ["query_id", "source"], "left_semi")
    near = near.select("query_id").distinct().withColumn("near", F.lit(1))
    judged = relevant.select("query_id").distinct().join(hit, "query_id", "left").join(near, "query_id", "left")
    cause = F.when(F.col("hit") == 1, "hit").when(F.col("near") == 1, "wrong_clause").otherwise("wrong_document")
    return judged.groupBy(cause.alias("cause")).agg(F.count("*").alias("queries"))


def mcnemar(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (both, only_a, only_b, neither, p_value) of two (query_id, hit) tables over their common queries; the exact two-sided binomial test.

    The tail is summed from log-binomials, so it needs no statistics library and doesn't underflow.
    """
    pairs = a.select("query_id", F.col("hit").alias("x")).join(b.select("query_id", F.col("hit").alias("y")), "query_id")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    x, y = F.col("x") > 0, F.col("y") > 0
    counts = pairs.agg(n(x & y).alias("both"), n(x & ~y).alias("only_a"), n(~x & y).alias("only_b"), n(~x & ~y).alias("neither"))

    @F.pandas_udf("double")
    def exact(b_: pd.Series, c_: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(u), int(v)) for u, v in zip(b_, c_)])

    return counts.withColumn("p_value", exact("only_a", "only_b"))


def binomial_tail(b: int, c: int) -> float:
    """Two-sided exact McNemar p-value of the discordant counts; 1 where there are none."""
    n = b + c
    if not n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    return min(1.0, 2 * math.fsum(math.exp(log(i)) for i in range(min(b, c) + 1)))


def draws(n: int, rounds: int, seed: int) -> np.ndarray:
    """``rounds`` x ``n`` places below ``n``, those that Python's generator of that seed gives one ``randrange(n)`` after the other."""
    return np.concatenate([np.zeros((0, n), np.int32), *draw_blocks(n, rounds, seed)])


def draw_blocks(n: int, rounds: int, seed: int, size: int = DRAWN) -> Iterator[np.ndarray]:
    """The rounds of :func:`draws` in blocks of at most ``size`` places, one round at least.

    The Mersenne Twister's words come from NumPy in bulk: a place is the top bits of a word, and words that give none below ``n`` are passed over.
    """
    version, state, _ = random.Random(seed).getstate()
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    shift, most, rest = np.uint64(32 - n.bit_length()), max(1, size // n), np.zeros(0, np.int32)
    while rounds > 0:
        some = min(rounds, most)
        parts, have, need = [rest], len(rest), n * some
        while have < need:
            words = bits.random_raw(int((need - have) * (1 << n.bit_length()) / n) + 64) >> shift
            parts.append(words[words < n].astype(np.int32))
            have += len(parts[-1])
        places = np.concatenate(parts)
        yield places[:need].reshape(some, n)
        rest, rounds = places[need:], rounds - some


def _resampled(rounds: int, seed: int, *columns: np.ndarray) -> list[np.ndarray]:
    """For each column of values its means over the rounds, all by the same draws; a block of draws at a time is in memory."""
    means: list[list[np.ndarray]] = [[] for _ in columns]
    for places in draw_blocks(len(columns[0]), rounds, seed):
        for values, out in zip(columns, means):
            out.append(values[places].mean(axis=1))
    return [np.concatenate(out) for out in means]


def bootstrap(values: DataFrame, column: str, rounds: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(mean, low, high): percentile interval of a mean by resampling the metric of each query, queries in order of id.

    The sample is one number a query and comes into one task on purpose: resampling needs the generator's exact sequence. No rows, no result.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        xs = frame.sort_values("query_id")["v"].to_numpy(float)
        means = np.sort(_resampled(rounds, seed, xs)[0])
        tail = alpha / 2
        return pd.DataFrame([(xs.mean(), means[int(tail * rounds)], means[min(int((1 - tail) * rounds), rounds - 1)])], columns=["mean", "low", "high"])

    one = values.select("query_id", F.col(column).cast("double").alias("v"), F.lit(1).alias("g"))
    return one.groupBy("g").applyInPandas(run, "mean double, low double, high double")


def paired_test(a: DataFrame, b: DataFrame, column: str = "hit", rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """(n, diff, low, high, p_value) of the mean of ``b`` less that of ``a`` over their common queries.

    The 95 % interval is the percentile one of the resampled differences; the p-value is the share of resamples of the centred
    differences at least as far from zero as what was seen. Both begin with the seed. One task, as for :func:`bootstrap`.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        d = frame.sort_values("query_id")["v"].to_numpy(float)
        seen = d.mean()
        moved, centred = _resampled(rounds, seed, d, d - seen)
        moved, p = np.sort(moved), (np.abs(centred) >= abs(seen) - 1e-15).mean()
        return pd.DataFrame([(len(d), seen, moved[int(0.025 * rounds)], moved[int(0.975 * rounds) - 1], p)], columns=["n", "diff", "low", "high", "p_value"])

    x = a.select("query_id", F.col(column).cast("double").alias("x")).join(b.select("query_id", F.col(column).cast("double").alias("y")), "query_id")
    return x.select("query_id", (F.col("y") - F.col("x")).alias("v"), F.lit(1).alias("g")).groupBy("g").applyInPandas(run, "n int, diff double, low double, high double, p_value double")


def latest_judgments(log: DataFrame) -> DataFrame:
    """Last row per (topic, record, pass) by time; withdrawn grades are dropped."""
    keys = ["topic_id", "chunk_id", "pass_no"]
    last = log.groupBy(*keys).agg(F.max(F.struct("ts", F.coalesce("undo", F.lit(False)).alias("undo"), F.coalesce("grade", F.lit(-1)).alias("grade"))).alias("last"))
    return last.where("not last.undo and last.grade >= 0").select(*keys, F.col("last.grade").alias("grade"))


def kappa(log: DataFrame, pass_a: int, pass_b: int) -> DataFrame:
    """(levels, n, agreement, kappa) of two passes' standing grades on the records both judged, for three levels and for relevant or not; kappa is 1 where chance agreement is 1."""
    standing = latest_judgments(log)
    pick = lambda p, c: standing.where(F.col("pass_no") == p).select("topic_id", "chunk_id", F.col("grade").alias(c))
    pairs = pick(pass_a, "x").join(pick(pass_b, "y"), ["topic_id", "chunk_id"])
    both = pairs.select(F.lit(3).alias("levels"), "x", "y").unionByName(pairs.select(F.lit(2).alias("levels"), (F.col("x") >= 1).cast("int").alias("x"), (F.col("y") >= 1).cast("int").alias("y")))
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    total = F.count("*")
    chance = sum((n(F.col("x") == g) / total * (n(F.col("y") == g) / total) for g in (1, 2)), n(F.col("x") == 0) / total * (n(F.col("y") == 0) / total))
    table = both.groupBy("levels").agg(total.alias("n"), (n(F.col("x") == F.col("y")) / total).alias("po"), chance.alias("pe"))
    value = F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return table.select("levels", "n", F.round("po", 6).alias("agreement"), F.round(value, 6).alias("kappa"))


def judging_stats(log: DataFrame) -> DataFrame:
    """(pass_no, judged, topics, share0, share1, share2, relevant_per_topic) of the standing grades."""
    share = lambda g: F.round(F.avg(F.when(F.col("grade") == g, 1.0).otherwise(0.0)), 6).alias(f"share{g}")
    relevant = F.sum(F.when(F.col("grade") >= 1, 1).otherwise(0))
    return latest_judgments(log).groupBy("pass_no").agg(F.count("*").alias("judged"), F.count_distinct("topic_id").alias("topics"), share(0), share(1), share(2), F.round(relevant / F.count_distinct("topic_id"), 6).alias("relevant_per_topic"))


def graded_truth(log: DataFrame, pass_no: int = 1) -> DataFrame:
    """(topic_id, relevant_ids, primary_ids, n_pooled) of one pass: relevant from grade 1, primary grade 2, by falling grade then id."""
    rows = latest_judgments(log).where(F.col("pass_no") == pass_no)
    ids = lambda least: F.transform(F.array_sort(F.collect_list(F.when(F.col("grade") >= least, F.struct((-F.col("grade")).alias("g"), "chunk_id")))), lambda s: s["chunk_id"])
    return rows.groupBy("topic_id").agg(ids(1).alias("relevant_ids"), ids(2).alias("primary_ids"), F.count("*").alias("n_pooled"))


def answer_recall(pairs: DataFrame, reference: str = "reference", answer: str = "answer") -> DataFrame:
    """Adds ``answer_recall``: share of the reference's word pairs in the answer; 0 for a reference without pairs."""
    ref = bigrams(F.coalesce(F.col(reference), F.lit("")))
    found = F.size(F.array_intersect(ref, bigrams(F.coalesce(F.col(answer), F.lit("")))))
    return pairs.withColumn("answer_recall", F.when(F.size(ref) > 0, found / F.size(ref)).otherwise(0.0))


def rouge(pairs: DataFrame, reference: str = "reference", answer: str = "answer") -> DataFrame:
    """Adds ``rouge1`` and ``rouge_l`` (F1, no stemmer) of lower-case words; Arrow UDF, as the longest common subsequence is a recurrence."""

    @F.pandas_udf("struct<rouge1: double, rouge_l: double>")
    def both(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rouge_scores(r or "", h or "") for r, h in zip(ref, hyp)], columns=["rouge1", "rouge_l"])

    return pairs.withColumn("__r", both(reference, answer)).select(*pairs.columns, "__r.rouge1", "__r.rouge_l")


def rouge_scores(reference: str, answer: str) -> tuple[float, float]:
    from collections import Counter

    a, b = ["".join(c if c.isalnum() else " " for c in t.lower()).split() for t in (reference, answer)]
    f1 = lambda hit: 2 * hit / (len(a) + len(b)) if a and b else 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return f1(sum((Counter(a) & Counter(b)).values())), f1(row[-1])


def fuzzy_recall(pairs: DataFrame, reference: str = "reference", answer: str = "answer", least: float = 0.65) -> DataFrame:
    """Adds ``fuzzy_recall``: share of the reference's sentences that stand in the answer or resemble it by at least ``least`` (difflib ratio)."""
    from difflib import SequenceMatcher

    def one(ref: str, hyp: str) -> float:
        import re

        sentences = [s.strip().lower() for s in re.split(r"(?<=[.!?;:])\s+|\n+", ref) if len(s.strip()) >= 15]
        low = hyp.lower()
        return sum(s in low or SequenceMatcher(None, s, low).ratio() >= least for s in sentences) / len(sentences) if sentences else 0.0

    @F.pandas_udf("double")
    def share(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        return pd.Series([one(r or "", h or "") for r, h in zip(ref, hyp)])

    return pairs.withColumn("fuzzy_recall", share(reference, answer))


def latency_stats(times: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, mean, p50, p95, p99, per_second): percentiles are the sorted value at floor(n p) - 1, not interpolated.

    Rows are ranged over partitions by group and value, so a group of any size spreads over many tasks; each adds the counts of the
    partitions before it, which are one row per partition and group.
    """
    key = F.struct(*group).alias("__key") if len(group) > 1 else F.col(group[0]).alias("__key")
    rows, w = ranged(times.select(key, F.col(value).alias("__v")), "__key", ["__v"])
    sums = rows.groupBy("__p", "__key").agg(F.count("*").alias("__c"), F.sum("__v").alias("__s"))
    parts = Window.partitionBy("__key")
    sums = sums.withColumn("__before", F.coalesce(F.sum("__c").over(parts.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.sum("__c").over(parts)).withColumn("__mean", F.sum("__s").over(parts) / F.sum("__c").over(parts))
    placed = carried(rows, sums.select("__p", "__key", "__before", "__n", "__mean"), "__key").withColumn("__r", F.row_number().over(w) + F.col("__before"))
    at = lambda p: F.max(F.when(F.col("__r") == F.greatest(F.floor(F.col("__n") * p), F.lit(1)), F.col("__v")))
    out = placed.groupBy("__key").agg(F.max("__n").alias("n"), F.max("__mean").alias("__mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    names = [F.col(f"__key.{g}").alias(g) for g in group] if len(group) > 1 else [F.col("__key").alias(group[0])]
    return out.select(*names, "n", F.round("__mean", 6).alias("mean"), "p50", "p95", "p99", F.round(1000.0 / F.col("__mean"), 6).alias("per_second"))


def pool(runs: DataFrame, depths: dict[str, int]) -> DataFrame:
    """(query_id, id, runs): the union of each run's first ranks, with the names of the runs that found a record."""
    deep = F.lit(False)
    for name, depth in depths.items():
        deep = deep | ((F.col("run") == name) & (F.col("rank") <= depth))
    return runs.where(deep).groupBy("query_id", "id").agg(F.array_sort(F.collect_set("run")).alias("runs"))


def strict_truth(questions: DataFrame, records: DataFrame, least: float = 0.5, most: int = 5, digits: int = 6) -> DataFrame:
    """(query_id, rank, id, coverage): records that hold at least ``least`` of a reference answer's word pairs, at most ``most`` a query by (coverage, id) falling.

    The answers' pairs are broadcast in blocks and a document's pairs scored in one place (:func:`docloom.operators.bm25.ranked`), so a
    pair that all share makes no rows of questions and records.
    """
    asked = questions.select("query_id", F.explode(bigrams(F.col("answer"))).alias("term"))
    size = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    wanted = asked.join(size, "query_id").select("query_id", "term", (F.lit(1.0) / F.col("n")).alias("weight"))
    have = records.select("id", F.explode(bigrams(F.col("text"))).alias("term")).select("term", "id", F.lit(1).alias("tf"), F.lit(1).alias("dl"))
    best = bm25.ranked(have, wanted, lambda tf, dl: np.ones(len(tf)), most, digits)
    return best.where(F.col("score") >= least).select("query_id", "rank", "id", F.col("score").alias("coverage"))
