"""Batch retrieval and verbatim answers with citations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import headings
from docloom.functions.text import STOPWORDS_EN, STOPWORDS_VI
from docloom.operators import bm25, clauses, ranking
from docloom.plans.tables import materialize

NOT_FOUND = "Không tìm thấy quy định phù hợp trong các tài liệu hiện có."
MODES = ("sparse", "dense", "hybrid", "hybrid_rerank")
MAX_CLAUSES, MAX_MIXED = 6, 4


def retrieve(questions: DataFrame, chunks: DataFrame, mode: str = "hybrid_rerank", k: int = 10, dense_run: DataFrame | None = None, scorer=ranking.overlap_scorer) -> DataFrame:
    """(query_id, rank, id, score, source, article, khoan, page, text, ...) of every question (query_id, text).

    sparse: BM25; dense: the given run of a vector search (query_id, rank, id, score); hybrid: reciprocal rank fusion of both,
    30 deep, cut to 20; hybrid_rerank: deduplicated, scored and diversified as well. An unknown mode is an error.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode in ("dense",) and dense_run is None:
        raise ValueError("a dense run is needed; embedding models are plug-ins")
    unique = chunks.dropDuplicates(["chunk_id"])
    if mode == "dense":
        run = dense_run.where(F.col("rank") <= k)
    else:
        sparse = bm25.search(bm25.build(chunks), questions, 30)
        if mode == "sparse":
            run = sparse.where(F.col("rank") <= k)
        else:
            lists = materialize(sparse, "sparse").select("query_id", F.lit(2).alias("list_no"), "rank", "id")
            if dense_run is not None:
                lists = lists.unionByName(dense_run.where("rank <= 30").select("query_id", F.lit(1).alias("list_no"), "rank", "id"))
            run = ranking.fuse(lists, limit=20)
    columns = ["source", "page", "article", "article_title", "khoan", "chapter", "chapter_title", "doc_number", "language", "level_labels", "text"]
    rows = run.join(unique.select(F.col("chunk_id").alias("id"), *columns), "id")
    if mode != "hybrid_rerank":
        return rows.where(F.col("rank") <= k)
    asked = rows.join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    return ranking.rerank(asked, scorer, k=k).withColumn("score", F.col("score_rerank"))


def split_sentences(text: str, least: int = 20) -> list[str]:
    parts = re.split(r"(?<=[.!?;:])\s+(?=[A-ZÁĂÂĐÉÊÍÓÔƠÚƯÝ\d])|\n+", text.strip())
    return [p.strip() for p in parts if len(p.strip()) >= least]


def highlight(question: str, text: str, english: bool = False, n: int = 1) -> str:
    """``text`` with its ``n`` most relevant sentences in bold: words shared with the question over the root of the sentence's length; earlier sentences win ties."""
    stop = set(STOPWORDS_VI) | (set(STOPWORDS_EN) if english else set())
    words = lambda t: {w for w in re.findall(r"\w+", t.lower()) if len(w) > 1 and w not in stop}
    q = words(question)
    scored = [(len(q & words(s)) / max(1, len(words(s))) ** 0.5, -i, s) for i, s in enumerate(split_sentences(text, 15))]
    for score, _, s in sorted(scored, reverse=True)[:n]:
        if score > 0:
            text = text.replace(s, f"**{s}**", 1)
    return text


def highlight_runs(run: DataFrame, n: int = 1) -> DataFrame:
    """Adds ``quote`` to rows with question and text."""

    @F.pandas_udf("string")
    def marked(question: pd.Series, text: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([highlight(q or "", t or "", lang == "en", n) for q, t, lang in zip(question, text, language)])

    return run.withColumn("quote", marked("question", "text", "language"))


def answer(questions: DataFrame, chunks: DataFrame, dense_run: DataFrame | None = None, scorer=ranking.overlap_scorer) -> DataFrame:
    """(query_id, tier, answer): retrieval, clause reassembly, tier, then a quotation of the clauses with locators and numbered sources.

    One row a question; the rows of a question are at most the retrieval depth, so each is rendered in one group.
    """
    hits = materialize(retrieve(questions, chunks, "hybrid_rerank", dense_run=dense_run, scorer=scorer), "hits")
    whole = clauses.collapse_runs(clauses.assemble(hits.select("query_id", "rank", F.col("id").alias("chunk_id")), chunks))
    rows = whole.select("query_id", "rank", F.col("chunk_id").alias("id"), F.col("text").alias("full"), "partial", "parts_used", "parts_total").join(hits.drop("text", "rank"), ["query_id", "id"])
    rows = materialize(rows, "rows")
    tiers = ranking.classify_tiers(rows.select("query_id", F.dense_rank().over(_by_rank()).alias("rank"), "score", "source", "article"))
    fields = ("chapter", "chapter_title", "article", "article_title", "khoan", "level_labels", "language")
    place = lambda *shown: headings.locator(*(F.col(c) if c in (*shown, "level_labels", "language") else F.lit("") for c in fields))
    leaf = F.coalesce(F.nullif(place("khoan"), F.lit("")), F.concat(F.lit("Khoản "), F.trim("khoan")))
    named = {"locator": place(*fields), "section": place("article", "article_title"), "leaf": F.when(F.coalesce(F.trim("khoan"), F.lit("")) != "", leaf).otherwise("")}
    joined = rows.join(tiers, "query_id").withColumns(named).drop("level_labels")
    schema = f"query_id {questions.schema['query_id'].dataType.simpleString()}, tier string, answer string"
    answered = joined.groupBy("query_id").applyInPandas(_render, schema)
    rest = questions.select("query_id").join(rows.select("query_id"), "query_id", "left_anti")
    return answered.unionByName(rest.select("query_id", F.lit("tier4").alias("tier"), F.lit(NOT_FOUND).alias("answer")))


def _by_rank():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy("rank")


def _clause_order(khoan: str) -> tuple:
    k = (khoan or "").strip()
    numbers = tuple(map(int, re.findall(r"\d+", k)))
    return (-1, (), "") if not k else (0, numbers, k) if numbers else (1, (), k)


def _sections(rows: list, notes: dict[str, int]) -> list[str]:
    """Quotations under numbered headings, one per article or else document: sources by their best score, articles of one by their first, clauses in order."""
    own: dict[tuple[str, str], list] = {}
    for r in rows:
        mine = own.setdefault((r.source, r.article or ""), [])
        if not any(r.khoan == o.khoan and r.full[:80] == o.full[:80] for o in mine):
            mine.append(r)
    best: dict[str, float] = {}
    for r in rows:
        best[r.source] = max(best.get(r.source, r.score), r.score)
    places = {source: n for n, source in enumerate(best)}
    out = []
    for n, key in enumerate(sorted(own, key=lambda k: (-best[k[0]], places[k[0]], -own[k][0].score)), 1):
        first = own[key][0]
        label = first.section or (f"{first.doc_number.strip()} – {first.source}" if (first.doc_number or "").strip() else first.source)
        lines, said = [f"**{n}. {label}**" + (f" [{notes[first.source]}]" if first.source in notes else "")], None
        for r in sorted(own[key], key=lambda r: _clause_order(r.khoan)):
            if r.leaf and r.leaf != said:
                lines.append(f"*{r.leaf}:*")
            said = r.leaf
            lines.append(f"> {highlight(r.question, r.full, r.language == 'en')}" + (f"\n\n*(Trích {r.parts_used}/{r.parts_total} phần)*" if r.partial else ""))
        out.append("\n\n".join(lines))
    return out


def _render(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("rank")
    tier, query = frame["tier"].iloc[0], frame["query_id"].iloc[0]
    if tier == "tier4":
        return pd.DataFrame([(query, tier, NOT_FOUND)], columns=["query_id", "tier", "answer"])
    notes: dict[str, int] = {}
    foot = []
    for r in frame.itertuples():
        if r.source and r.source != "unknown" and r.source not in notes:
            notes[r.source] = len(notes) + 1
            label = f"{r.doc_number.strip()} – {r.source}" if (r.doc_number or "").strip() else r.source
            foot.append(f"[{notes[r.source]}]: {label} — trang {r.page or '?'}")

    def quote(r) -> str:
        where = r.locator
        note = f"\n\n*(Trích {r.parts_used}/{r.parts_total} phần)*" if r.partial else ""
        mark = f" [{notes[r.source]}]" if r.source in notes else ""
        body = highlight(r.question, r.full, r.language == "en")
        return (f"**{where}**{mark}\n\n" if where else "") + f"> {body}{note}"

    rows = list(frame.itertuples())
    if tier == "tier1":
        parts = [quote(rows[0])]
    elif tier == "tier2":
        seen, same = set(), []
        for r in rows:
            if (r.source, r.article) == (rows[0].source, rows[0].article) and r.full[:80] not in seen:
                seen.add(r.full[:80])
                same.append(r)
        parts = [quote(r) for r in sorted(same, key=lambda r: _clause_order(r.khoan))[:MAX_CLAUSES]]
        if len(same) > MAX_CLAUSES:
            parts.append(f"*(còn {len(same) - MAX_CLAUSES} khoản khác)*")
    else:
        parts = _sections(rows[:MAX_MIXED], notes)
    text = "\n\n".join(parts) + ("\n\n---\n**Tài liệu đính kèm:**\n" + "\n".join(foot) if foot else "")
    return pd.DataFrame([(query, tier, text)], columns=["query_id", "tier", "answer"])
