"""Reassembly of clauses that were cut into several chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import is_heading_only
from docloom.plans.tables import carried, fill_forward, ranged

MAX_CHARS = 3000
#: Order of the chunks of a file.
PLACE = ["chunk_index", "chunk_id"]
# How a section begins that is no provision.
SECTION_STARTS = ("phụ lục", "cộng hòa xã hội", "đại học quốc gia", "kính gửi", "đơn đề nghị", "mẫu số", "biểu mẫu")


def starts_section(text):
    head = F.substring(F.lower(F.trim(text)), 1, 60)
    cond = F.startswith(head, F.lit(SECTION_STARTS[0]))
    for s in SECTION_STARTS[1:]:
        cond = cond | F.startswith(head, F.lit(s))
    return cond


def clause_runs(chunks: DataFrame) -> DataFrame:
    """(source, article, khoan, run_no, first_index, last_index, parts, chars): maximal runs of adjacent chunks of a clause.

    Adjacent: the next index, the same or the next page, and no new section. Chunks without article or clause number have no run.
    """
    c = chunks.where("article <> '' and khoan <> ''").dropDuplicates(["chunk_id"])
    w = Window.partitionBy("source", "article", "khoan").orderBy("page", "chunk_index", "chunk_id")
    joins = (F.col("chunk_index") - F.lag("chunk_index").over(w) == 1) & (F.col("page") - F.lag("page").over(w)).between(0, 1) & ~starts_section(F.col("text"))
    marked = c.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("run_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("source", "article", "khoan", "run_no").agg(F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.count("*").alias("parts"), F.sum(F.length("text")).alias("chars"))


def assemble(hits: DataFrame, chunks: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Hits (query_id, rank, chunk_id) with ``text`` of the whole run around each: (query_id, rank, chunk_id, run_id, text, assembled, partial, parts_used, parts_total).

    A run within ``max_chars`` is joined whole; of a longer one the parts around the hit are taken while they fit, the part before
    first. Runs of one part, and those that begin a section, stay as they are. Runs are bounded by a clause, and only clauses with hits are read.
    """
    c = chunks.select("chunk_id", "source", "article", "khoan", "page", "chunk_index", "text").dropDuplicates(["chunk_id"])
    found = hits.join(c, "chunk_id")
    clause = (F.coalesce("article", F.lit("")) != "") & (F.coalesce("khoan", F.lit("")) != "")
    plain = found.where(~clause)
    keys = found.where(clause).select("source", "article", "khoan").distinct()
    parts = c.where(clause).join(keys, ["source", "article", "khoan"], "left_semi").groupBy("source", "article", "khoan").agg(F.array_sort(F.collect_list(F.struct("page", "chunk_index", "chunk_id", "text"))).alias("parts"))

    @F.pandas_udf("struct<run_id: string, text: string, assembled: boolean, partial: boolean, parts_used: int, parts_total: int>")
    def join_run(anchor: pd.Series, all_parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_join(a, list(p)) for a, p in zip(anchor, all_parts)], columns=["run_id", "text", "assembled", "partial", "parts_used", "parts_total"])

    def _join(anchor: str, all_parts: list) -> tuple:
        runs: list[list] = []
        for p in all_parts:
            last = runs[-1][-1] if runs else None
            fits = last is not None and p["chunk_index"] - last["chunk_index"] == 1 and 0 <= p["page"] - last["page"] <= 1 and not _starts(p["text"] or "")
            runs[-1].append(p) if fits else runs.append([p])
        run = next(r for r in runs if any(p["chunk_id"] == anchor for p in r))
        at = next(i for i, p in enumerate(run) if p["chunk_id"] == anchor)
        own = run[at]["text"]
        if len(run) == 1 or _starts(run[0]["text"] or ""):
            return anchor, own, False, False, 1, 1
        texts = [(p["text"] or "").strip() for p in run]
        joined = lambda some: "\n\n".join(filter(None, some))
        if sum(map(len, texts)) + 2 * (len(texts) - 1) <= max_chars:
            return run[0]["chunk_id"], joined(texts), True, False, len(run), len(run)
        first, end, room = at, at + 1, max_chars - len(texts[at])
        while room > 0:  # a part must fit the room that is left; what joins it is paid afterwards
            new = next((i for i in (first - 1, end) if 0 <= i < len(texts) and len(texts[i]) <= room), None)
            if new is None:
                break
            first, end, room = min(first, new), max(end, new + 1), room - len(texts[new]) - 2
        return run[0]["chunk_id"], joined(texts[first:end]), True, True, end - first, len(run)

    joined = found.where(clause).drop("text").join(parts, ["source", "article", "khoan"]).withColumn("r", join_run("chunk_id", "parts"))
    columns = ["query_id", "rank", "chunk_id"]
    whole = joined.select(*columns, "r.*")
    same = plain.select(*columns, F.col("chunk_id").alias("run_id"), "text", F.lit(False).alias("assembled"), F.lit(False).alias("partial"), F.lit(1).alias("parts_used"), F.lit(1).alias("parts_total"))
    return whole.unionByName(same)


def _starts(text: str) -> bool:
    return text.strip().lower()[:60].startswith(SECTION_STARTS)


def collapse_runs(assembled: DataFrame) -> DataFrame:
    """First row of each run per query among the assembled rows; the others pass."""
    first = F.row_number().over(Window.partitionBy("query_id", "assembled", F.when(F.col("assembled"), F.col("run_id")).otherwise(F.col("chunk_id"))).orderBy("rank"))
    return assembled.withColumn("__n", first).where(~F.col("assembled") | (F.col("__n") == 1)).drop("__n")


def merge_headings(chunks: DataFrame) -> DataFrame:
    """(source, chunk_index, text): heading-only chunks go before the next chunk of their file; headings with nothing after them are dropped."""
    c = chunks.dropDuplicates(["chunk_id"]).where(F.col("source").isNotNull()).select("source", "chunk_index", "chunk_id", F.trim("text").alias("text"), (~is_heading_only(F.coalesce("text", F.lit("")))).cast("int").alias("__body"))
    rows, w = ranged(c, "source", PLACE)
    sums = rows.groupBy("__p", "source").agg(F.sum("__body").alias("n"))
    earlier = sums.select("__p", "source", F.sum("n").over(Window.partitionBy("source").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    local = F.coalesce(F.sum("__body").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = carried(rows.withColumn("__local", local), earlier, "source").withColumn("__g", F.col("__local") + F.coalesce("__before", F.lit(0)))
    parts = groups.groupBy("source", "__g").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("p"), F.max("__body").alias("body"), F.max(F.when(F.col("__body") == 1, F.col("chunk_index"))).alias("chunk_index"))
    return parts.where("body = 1").select("source", "chunk_index", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def page_fallback(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source, page_filled): the page, or where it is null the last page before it in the file, else 1."""
    some = chunks.where(F.col("source").isNotNull()).select("source", "chunk_index", "chunk_id", "page")
    return fill_forward(some, "source", PLACE, "page", "page_filled").select("chunk_id", "source", F.coalesce("page_filled", F.lit(1)).alias("page_filled"))
