"""Projections for callers, comparisons of runs and answers, and search in the library of files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import headings, names
from docloom.functions.text import strip
from docloom.operators import metrics

# The columns a caller gets of a hit, of a source of an answer, and the characters of its text.
HIT_COLUMNS = ("chunk_id", "source", "page", "text", "score_rrf", "score_rerank", "score_dense", "score_sparse", "doc_group", "doc_type", "doc_number", "issuing_body", "section_type", "chapter", "chapter_title", "article", "article_title", "khoan", "level_labels", "file_type", "language")
SOURCE_COLUMNS = ("chunk_id", "source", "page", "article", "khoan", "text", "score_rrf", "score_rerank", "level_labels", "file_type", "language")
SHOWN_CHARS, BRIEF_CHARS = 800, 500


def project(rows: DataFrame, columns: tuple[str, ...] = HIT_COLUMNS, chars: int = SHOWN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with just ``keep`` and ``columns``; the text is cut, an internal ``_score_x`` stands for ``score_x`` where the column exists, and missing columns are null."""
    have = set(rows.columns)

    def one(c: str) -> Column:
        if c == "text":
            return F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text")
        name = f"_{c}" if f"_{c}" in have else c
        return (F.col(name) if name in have else F.lit(None).cast("double" if c.startswith("score") else "string")).alias(c)

    return rows.select(*keep, *map(one, columns))


def from_sources(rows: DataFrame, sources: list[str]) -> DataFrame:
    """Rows of the stated sources; none stated, all rows. The condition reaches the scan."""
    return rows.where(F.col("source").isin(sources)) if sources else rows


def cleaned_metadata(rows: DataFrame, fields: list[str], chars: int = 300) -> DataFrame:
    """``fields`` trimmed and cut; null is ''."""
    return rows.withColumns({f: F.substring(strip(F.coalesce(f, F.lit(""))), 1, chars) for f in fields})


def ablation(stages: dict[str, DataFrame], qrels: DataFrame, ks: tuple[int, ...] = metrics.KS) -> DataFrame:
    """(stage, k, precision, recall, f1, hit, mrr, map, ndcg): each stage's own ranking (query_id, rank, id) scored against the same truth."""
    out = None
    for name, run in stages.items():
        rows = metrics.mean_metrics(run, qrels, ks).withColumn("stage", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("stage", *(c for c in out.columns if c != "stage"))


def sweep(values: list, search: Callable, exact: DataFrame) -> DataFrame:
    """(setting, recall, pairs): an approximate search at each setting, measured against the exact neighbours (query_id, id)."""
    out = None
    for v in values:
        hit = exact.select("query_id", "id").join(search(v).select("query_id", "id").withColumn("hit", F.lit(1.0)), ["query_id", "id"], "left")
        row = hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"), F.count("*").alias("pairs")).select(F.lit(str(v)).alias("setting"), "recall", "pairs")
        out = row if out is None else out.unionByName(row)
    return out


def compare_answers(before: DataFrame, after: DataFrame) -> DataFrame:
    """(version, answers, mean_chars, max_chars, quotes, fragments, partial, tier1, tier2, tier3, tier4) of two tables (query_id, tier, answer, quotes, fragments, partial).

    A fragment is a quoted part of a longer clause that wasn't assembled. Only questions both have count.
    """
    common = before.select("query_id").join(after.select("query_id"), "query_id").distinct()
    both = before.withColumn("version", F.lit("before")).unionByName(after.withColumn("version", F.lit("after"))).join(common, "query_id", "left_semi")
    size = F.length("answer")
    tiers = [F.sum((F.col("tier") == t).cast("int")).alias(t) for t in ("tier1", "tier2", "tier3", "tier4")]
    return both.groupBy("version").agg(F.count("*").alias("answers"), F.round(F.avg(size), 3).alias("mean_chars"), F.max(size).alias("max_chars"), F.sum("quotes").alias("quotes"), F.sum("fragments").alias("fragments"), F.sum("partial").alias("partial"), *tiers)


def generation_means(scored: DataFrame, columns: list[str]) -> DataFrame:
    """One row of the means of answer scores, nulls left out, and the number of answers."""
    return scored.agg(*(F.round(F.avg(c), 4).alias(c) for c in columns), F.count("*").alias("answers"))


def extractive(run: DataFrame) -> DataFrame:
    """(query_id, answer): the hits of each question (query_id, rank, source, page, text, score_rerank, and the fields of a locator) as a numbered list of quotations with their places and scores."""
    place = headings.locator(*(F.col(c) for c in ("chapter", "chapter_title", "article", "article_title", "khoan", "level_labels", "language")))
    rows = run.withColumn("__place", place)
    where = F.concat(F.lit("**["), F.col("rank"), F.lit("] "), F.coalesce("source", F.lit("?")), F.lit(" — trang "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.when(F.col("__place") != "", F.concat(F.lit(" · "), F.col("__place"))).otherwise(""), F.lit("**"))
    score = F.coalesce(F.format_string(" · rerank=%.3f", F.col("score_rerank").cast("double")), F.lit(""))
    score = F.when(F.col("score_rerank").isNull(), "").otherwise(score)
    quote = F.concat(where, score, F.lit("\n> "), strip(F.coalesce("text", F.lit(""))), F.lit("\n"))
    own = rows.select("query_id", "rank", quote.alias("quote")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "quote"))).alias("q"))
    head = F.format_string("**Trả lời trích xuất từ %d đoạn liên quan nhất:**\n", F.size("q"))
    return own.select("query_id", F.concat_ws("\n", head, F.array_join(F.transform("q", lambda x: x["quote"]), "\n")).alias("answer"))


def unique_names(files: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(file_id, name, unique_name) of (file_id, name) in order of id: the first file of a stem keeps its name if no ``taken`` (name) has the stem, the others get -2, -3 and so on, passing over taken ones.

    Stems compare without case and extension. A stem's files are numbered by a window over that stem alone.
    """
    own = files.withColumn("__stem", names.stem_key_col(F.col("name")))
    root = F.regexp_replace("name", r"\.[^.]*$", "")
    used = (taken if taken is not None else files.limit(0)).select(names.stem_key_col(F.col("name")).alias("__used")).distinct()
    numbers = used.select(F.regexp_extract("__used", r"^(.*?)(?:-(\d+))?$", 1).alias("__stem"), F.coalesce(F.regexp_extract("__used", r"-(\d+)$", 1).try_cast("int") if hasattr(Column, "try_cast") else F.regexp_extract("__used", r"-(\d+)$", 1).cast("int"), F.lit(1)).alias("n"))
    plain = used.select(F.col("__used").alias("__stem"), F.lit(1).alias("n"))
    gone = numbers.unionByName(plain).groupBy("__stem").agg(F.collect_set("n").alias("__gone"))
    nth = F.row_number().over(Window.partitionBy("__stem").orderBy("file_id"))
    rows = own.withColumn("__n", nth).join(gone, "__stem", "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(1), F.col("__n") + F.size("__gone")), "__gone")
    number = F.get(free, F.col("__n") - 1)
    ext = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    return rows.select("file_id", "name", F.when(number == 1, F.col("name")).otherwise(F.concat(root, F.lit("-"), number, ext)).alias("unique_name"))


def first_of_content(files: DataFrame) -> DataFrame:
    """(sha, source, copies) of (source, sha): the first source in name order of each content, and how many files have it."""
    return files.where(F.col("sha").isNotNull()).groupBy("sha").agg(F.min("source").alias("source"), F.count("*").alias("copies"))


def within(groups: DataFrame, allowed: DataFrame, key: str = "file", member: str = "source") -> DataFrame:
    """(key) of the groups all of whose members are in ``allowed``: those without any other member."""
    other = groups.join(allowed.select(member).distinct(), member, "left_anti").select(key).distinct()
    return groups.select(key).distinct().join(other, key, "left_anti")


def fold(column: Column) -> Column:
    """Lower case without accents; an Arrow UDF, as Spark has no normal forms."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.str.lower().str.replace("đ", "d").str.normalize("NFD").str.replace("[̀-ͯ]", "", regex=True)

    return plain(column)


def search_library(files: DataFrame, words: str, fields: list[str]) -> DataFrame:
    """Files in whose fields every word stands, without regard to case and accents; no words, all files."""
    asked = files.sparkSession.range(1).select(fold(F.lit(words)).alias("w")).first()["w"].split()
    text = fold(F.concat_ws(" ", *fields))
    return files.withColumn("__text", text).where(F.forall(F.array(*map(F.lit, asked)), lambda w: F.contains(F.col("__text"), w))).drop("__text") if asked else files


def facets(files: DataFrame, chosen: dict[str, list[str]], fields: list[str]) -> DataFrame:
    """(facet, value, files): how many files each value of each facet would give, the choices in the other facets applied and those in its own not."""
    out = None
    for f in fields:
        rows = files
        for other, values in chosen.items():
            if other != f and values:
                rows = rows.where(F.col(other).isin(values))
        one = rows.where(F.col(f).isNotNull()).groupBy(F.col(f).cast("string").alias("value")).agg(F.count("*").alias("files")).select(F.lit(f).alias("facet"), "value", "files")
        out = one if out is None else out.unionByName(one)
    return out
