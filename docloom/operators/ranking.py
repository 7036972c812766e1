"""Fusion, deduplication, diversification, tiers and footnotes of ranked lists.

A run is (query_id, rank, id, ...); every operator works on all queries at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
PREFIX_CHARS, MAX_PER_SOURCE, TOP_K = 80, 5, 10
TIER_MIN, TIER_GAP = 0.05, 0.30


def fuse(runs: DataFrame, k: int = RRF_K, limit: int | None = None, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_no, rank, id): (query_id, rank, id, score).

    Each listing adds 1 / (k + rank), also repeated ones of one list; ties keep the order of first appearance (list, then rank).
    """
    scores = runs.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), digits).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list_no", "first.rank", "id"))
    out = scores.withColumn("rank", rank)
    return (out.where(F.col("rank") <= limit) if limit else out).select("query_id", "rank", "id", "score")


def fuse_with_payload(runs: DataFrame, payload: list[str], k: int = RRF_K) -> DataFrame:
    """As :func:`fuse`, with the payload columns of the last list that has the document."""
    last = runs.groupBy("query_id", "id").agg(F.max_by(F.struct(*payload), F.struct("list_no", "rank")).alias("p"))
    return fuse(runs, k).join(last, ["query_id", "id"]).select("query_id", "rank", "id", "score", *(F.col(f"p.{c}").alias(c) for c in payload))


def prefix_dedup(run: DataFrame, text: str = "text", chars: int = PREFIX_CHARS) -> DataFrame:
    """First row of each text prefix per query, for runs whose ids are unique; ranks are closed up."""
    first = F.row_number().over(Window.partitionBy("query_id", F.substring(F.trim(F.col(text)), 1, chars)).orderBy("rank"))
    kept = run.withColumn("__n", first).where("__n = 1").drop("__n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def dedup(run: DataFrame, text: str = "text", chars: int = PREFIX_CHARS) -> DataFrame:
    """General form for runs with repeated ids: a row goes if its id, or the prefix of its text, was kept before; a row that goes for its prefix doesn't register its id.

    Order-dependent, so it folds over each query's list, which is as long as the retrieval depth.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        ids: set = set()
        prefixes: set = set()
        keep = []
        frame = frame.sort_values("rank")
        for i, (key, body) in enumerate(zip(frame["id"], frame[text])):
            prefix = (body or "").strip()[:chars]
            if key in ids or prefix and prefix in prefixes:
                continue
            keep.append(i)
            ids.add(key)
            prefixes.add(prefix)
        out = frame.iloc[keep].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return run.groupBy("query_id").applyInPandas(fold, run.schema)


def diversify(run: DataFrame, k: int = TOP_K, per_source: int = MAX_PER_SOURCE) -> DataFrame:
    """The best ``k`` with at most ``per_source`` of a source first; places left over go to the skipped rows in rank order."""
    nth = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))
    later = run.withColumn("__late", (nth > per_source).cast("int"))
    new = F.row_number().over(Window.partitionBy("query_id").orderBy("__late", "rank"))
    return later.withColumn("rank", new).where(F.col("rank") <= k).drop("__late")


def rerank(run: DataFrame, scorer, text: str = "text", chars: int = 512, k: int = TOP_K, per_source: int = MAX_PER_SOURCE, min_score: float = 0.0) -> DataFrame:
    """Deduplicate, score the pairs that are left with ``scorer(question, text) -> Column``, sort, apply the floor, diversify.

    ``run`` needs question, source and text. Without a scorer it is the deduplicated list cut to ``k``, and has no ``score_rerank``.
    """
    unique = prefix_dedup(run, text)
    if scorer is None:
        return unique.where(F.col("rank") <= k)
    scored = unique.withColumn("score_rerank", scorer(F.col("question"), F.substring(F.col(text), 1, chars)))
    if min_score > 0:
        scored = scored.where(F.col("score_rerank") >= min_score)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score_rerank"), "rank"))
    return diversify(scored.withColumn("rank", order), k, per_source)


def overlap_scorer(question, text):
    """Stand-in for a cross-encoder, which is not available here: share of the question's topical words in the text."""
    from docloom.functions.text import content_tokens

    q = content_tokens(question)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, content_tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def classify_tiers(run: DataFrame, min_score: float = TIER_MIN, gap: float = TIER_GAP) -> DataFrame:
    """(query_id, tier) from (query_id, rank, score, source, article).

    tier4: no rows or the best score below ``min_score``; tier1: a single row, or the first leads by ``gap``; tier2: the first four
    share source and a non-empty article; tier3: the rest.
    """
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    head = F.col("rank") <= 4
    same = run.groupBy("query_id").agg(
        at(1, "score").alias("s1"),
        at(2, "score").alias("s2"),
        F.count("*").alias("n"),
        F.count_distinct(F.when(head, F.struct(F.coalesce("source", F.lit("")), F.coalesce("article", F.lit(""))))).alias("kinds"),
        at(1, "article").alias("article"),
    )
    tier = (
        F.when(F.col("s1") < min_score, "tier4")
        .when((F.col("n") == 1) | (F.round(F.col("s1") - F.col("s2"), 9) >= gap), "tier1")
        .when((F.col("kinds") == 1) & (F.coalesce("article", F.lit("")) != ""), "tier2")
        .otherwise("tier3")
    )
    return same.select("query_id", tier.alias("tier"))


def footnotes(run: DataFrame) -> DataFrame:
    """(query_id, source, footnote, page): sources numbered by first appearance, with the page of that row; empty and unknown sources have none."""
    some = run.where(F.coalesce("source", F.lit("")).isin("", "unknown") == F.lit(False))
    first = some.groupBy("query_id", "source").agg(F.min("rank").alias("first"), F.min_by("page", "rank").alias("page"))
    return first.select("query_id", "source", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).alias("footnote"), "page")
