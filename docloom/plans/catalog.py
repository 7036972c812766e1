"""The library's own queries over the test tables, and their SQL twins, by name."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import headings, names, text
from docloom.operators import answers, bm25, chunking, clauses, collection, dense, layout, metrics, ranking, reports
from docloom.plans.tables import materialize, read
from docloom.sources import docx
from docloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
DEPTH = 30


def chunks(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "chunks").dropDuplicates(["chunk_id"])


def questions(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "pool_topics").select(F.col("topic_id").alias("query_id"), F.col("question").alias("text"))


def index_of(s: SparkSession, d: str) -> bm25.Bm25Index:
    """The index of the chunks of ``d``, built once in a session and read by all its queries."""
    if not hasattr(s, "_docloom_indexes"):
        s._docloom_indexes = {}
    if d not in s._docloom_indexes:
        s._docloom_indexes[d] = bm25.build(read(s, d, "chunks"))
    return s._docloom_indexes[d]


def bm25_run(s: SparkSession, d: str, k: int) -> DataFrame:
    return materialize(bm25.search(index_of(s, d), questions(s, d), k), "run")


def coverage_run(s: SparkSession, d: str, k: int) -> DataFrame:
    """A second ranking of the chunks: how many of the question's distinct words they have, divided by the number of the question's words."""
    asked = questions(s, d).select("query_id", F.explode(F.array_distinct(text.long_tokens(F.col("text")))).alias("term"))
    size = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    wanted = asked.join(size, "query_id").select("query_id", "term", (F.lit(1.0) / F.col("n")).alias("weight"))
    return materialize(bm25.ranked(index_of(s, d).postings, wanted, lambda tf, dl: np.ones(len(tf)), k, larger_id_first=False), "run")


def run_rows(s: SparkSession, d: str, k: int = DEPTH) -> DataFrame:
    """The BM25 run with what the ranking operators need."""
    c = chunks(s, d).select(F.col("chunk_id").alias("id"), "source", "article", "khoan", "page", "text")
    return bm25_run(s, d, k).join(c, "id")


def qrels(s: SparkSession, d: str) -> DataFrame:
    standing = metrics.latest_judgments(read(s, d, "judgments")).where("grade >= 1")
    return materialize(standing.groupBy(F.col("topic_id").alias("query_id"), F.col("chunk_id").alias("id")).agg(F.max("grade").alias("grade")), "qrels")


def both_lists(s: SparkSession, d: str) -> DataFrame:
    a = coverage_run(s, d, DEPTH).select("query_id", F.lit(1).alias("list_no"), "rank", "id")
    return a.unionByName(bm25_run(s, d, DEPTH).select("query_id", F.lit(2).alias("list_no"), "rank", "id"))


def every_20th(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = read(s, d, "embeddings")
    return v, v.where("vec_id % 20 = 0")


def vector_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    hit = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1.0)), ["query_id", "id"], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"), F.count("*").alias("pairs"))


def documents_as_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(read(s, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))


def incremental_equals_full(s: SparkSession, d: str) -> DataFrame:
    """Postings kept by source, with some sources taken out and put back, against a full rebuild: terms whose statistics differ (none)."""
    c = chunks(s, d)
    part = F.pmod(F.xxhash64("source"), F.lit(5)) == 0
    of = c.select(F.col("chunk_id").alias("id"), "source")
    kept = bm25.postings(c).join(of.where(~part), "id").drop("source")
    again = bm25.postings(c.where(part))
    new = bm25.from_postings(kept.unionByName(again.select(kept.columns))).terms.select("term", "df", "cf", F.round("idf", 9).alias("idf"))
    full = bm25.build(c).terms.select("term", "df", "cf", F.round("idf", 9).alias("idf"))
    return new.exceptAll(full).unionByName(full.exceptAll(new)).agg(F.count("*").alias("different_terms"))


def stores(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three views of the collection that differ by what the catalogue and the judgments know."""
    c = chunks(s, d).select("chunk_id", "source")
    listed = read(s, d, "catalogue").select("source")
    judged = read(s, d, "judgments").select("chunk_id").distinct()
    return c, c.join(listed, "source", "left_semi"), c.join(judged, "chunk_id", "left_semi")


def page_lookup(s: SparkSession, d: str) -> DataFrame:
    """The page of every second chunk place of a file, from where its pages begin."""
    c = chunks(s, d)
    starts = c.groupBy("source", "page").agg(F.min("chunk_index").alias("start"))
    return layout.page_of(c.groupBy("source").agg(F.max("chunk_index").alias("m")).select("source", F.explode(F.expr("sequence(0, m, 2)")).alias("pos")), starts)


def uploads(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").select(F.col("doc_id").alias("upload_id"), F.concat(F.coalesce("title", F.lit("untitled")), F.lit(".pdf")).alias("name"), "doc_group", F.sha2("text", 256).alias("sha"))
    corpus = read(s, d, "catalogue").select(F.concat("title", F.lit(".docx")).alias("source"), F.lit("so-tay").alias("doc_group"), F.sha2("source", 256).alias("sha"))
    return collection.upload_conflicts(docs, corpus)


def text_flags(s: SparkSession, d: str) -> DataFrame:
    flagged = text.with_flags(chunks(s, d).select("chunk_id", "text")).drop("text")
    return flagged.withColumn("diacritics", F.round("diacritics", 6)).withColumn("stopwords", F.round("stopwords", 6))


def hits_at_1(run: DataFrame, rel: DataFrame) -> DataFrame:
    return metrics.per_query_metrics(run, rel, 1).select("query_id", "hit")


def clause_locators(s: SparkSession, d: str) -> DataFrame:
    c = chunks(s, d)
    return c.select("chunk_id", headings.locator(*(F.col(x) for x in ("chapter", "chapter_title", "article", "article_title", "khoan", "level_labels", "language"))).alias("locator"))


def best_answers(s: SparkSession, d: str) -> DataFrame:
    """The best chunk of each topic that has a reference answer, with the recall of the answer's word pairs."""
    first = bm25_run(s, d, 1).join(chunks(s, d).select(F.col("chunk_id").alias("id"), F.col("text").alias("answer")), "id")
    refs = read(s, d, "pool_topics").where("reference_answer is not null").select(F.col("topic_id").alias("query_id"), F.col("reference_answer").alias("reference"))
    return refs.join(first, "query_id")


def strict(s: SparkSession, d: str) -> DataFrame:
    refs = read(s, d, "pool_topics").where("reference_answer is not null").select(F.col("topic_id").alias("query_id"), F.col("reference_answer").alias("answer"))
    return metrics.strict_truth(refs, chunks(s, d).select(F.col("chunk_id").alias("id"), "text"))


def quantised(s: SparkSession, d: str, kind: str) -> DataFrame:
    v, q = every_20th(s, d)
    transform = dense.signs if kind == "binary" else dense.int8(dense.int8_scale(v))
    return dense.rescored_topk(v, q, transform, 10, max(2.0, dense.tuned_oversampling(v, transform, 10)))


def docx_files(s: SparkSession, d: str) -> DataFrame:
    """A DOCX file of every document, a paragraph a line; made here, as the test tables hold no files."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        def one(text: str) -> bytes:
            body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body>{body}</w:body></w:document>')
            return out.getvalue()

        return texts.map(one)

    clean = F.regexp_replace("text", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", " ")
    return read(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("source"), packed(clean).alias("content"))


def table_lines(s: SparkSession, d: str) -> DataFrame:
    """A table per issuing body out of the catalogue: a header line and a line per file in order of its name."""
    c = read(s, d, "catalogue").where("issuing_body is not null").select(F.col("issuing_body").alias("source"), F.array("source", "title", F.coalesce("doc_number", F.lit(""))).alias("cells"), F.col("source").alias("name"))
    lines = c.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("name")) + 1).alias("line_no"), "cells", F.lit(False).alias("header"))
    head = c.select("source").distinct().select("source", F.lit(1).alias("line_no"), F.array(F.lit("Tệp"), F.lit("Tên"), F.lit("Số")).alias("cells"), F.lit(True).alias("header"))
    return lines.unionByName(head).withColumn("table_no", F.lit(1)).withColumn("page", F.lit(1))


def queries() -> dict[str, Query]:
    return {
        "ablation": lambda s, d: reports.ablation({"bm25": bm25_run(s, d, 10), "coverage": coverage_run(s, d, 10)}, qrels(s, d)),
        "hit_projection": lambda s, d: reports.project(run_rows(s, d, 10).withColumnsRenamed({"id": "chunk_id", "score": "score_sparse"}), ("chunk_id", "source", "page", "text", "score_sparse", "article", "khoan"), keep=("query_id", "rank")).withColumn("text", F.md5("text")),
        "first_of_content": lambda s, d: reports.first_of_content(read(s, d, "documents").select(F.col("doc_id").alias("source"), F.sha2("text", 256).alias("sha"))),
        "unique_names": lambda s, d: reports.unique_names(read(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.coalesce("title", F.lit("untitled")), F.lit(".pdf")).alias("name"))),
        "facets": lambda s, d: reports.facets(read(s, d, "documents").withColumn("year", F.year("fetched_at")), {"lang": ["vi"], "year": [2024, 2025]}, ["lang", "doc_group", "year"]),
        "docx_texts": lambda s, d: docx.docx_text(docx.docx_blocks(docx_files(s, d))).select("source", F.md5("text").alias("digest")),
        "table_rows": lambda s, d: chunking.table_chunks(table_lines(s, d), continued=False).select("source", "row_no", "text"),
        "ivf_sweep": lambda s, d: reports.sweep([1, 4, 8], lambda probes: dense.ivf_topk(*every_20th(s, d), 10, probes=probes), dense.dense_topk(*every_20th(s, d), 10)),
        "term_stats": lambda s, d: index_of(s, d).terms.select("term", "df", "cf", F.round("idf", 6).alias("idf")),
        "bm25_stats": lambda s, d: index_of(s, d).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf")),
        "bm25_topk": lambda s, d: bm25_run(s, d, 10),
        "coverage_topk": lambda s, d: coverage_run(s, d, 10),
        "dense_topk": lambda s, d: dense.dense_topk(*every_20th(s, d), 10),
        "rrf_fusion": lambda s, d: ranking.fuse(both_lists(s, d), limit=20),
        "prefix_dedup": lambda s, d: ranking.prefix_dedup(run_rows(s, d)).select("query_id", "rank", "id"),
        "diversify": lambda s, d: ranking.diversify(run_rows(s, d), 10, 2).select("query_id", "rank", "id", "source"),
        "tier_classify": lambda s, d: ranking.classify_tiers(run_rows(s, d, 10), 5.0, 8.0),
        "footnotes": lambda s, d: ranking.footnotes(run_rows(s, d, 10)),
        "retrieval_metrics": lambda s, d: metrics.mean_metrics(bm25_run(s, d, 10), qrels(s, d)),
        "recall_by_depth": lambda s, d: metrics.recall_by_depth(bm25_run(s, d, 100), qrels(s, d)),
        "failure_causes": lambda s, d: metrics.failure_causes(bm25_run(s, d, 10), qrels(s, d), chunks(s, d).select(F.col("chunk_id").alias("id"), "source")),
        "mcnemar": lambda s, d: metrics.mcnemar(hits_at_1(bm25_run(s, d, 1), qrels(s, d)), hits_at_1(coverage_run(s, d, 1), qrels(s, d))).drop("p_value"),
        "mcnemar_test": lambda s, d: metrics.mcnemar(hits_at_1(bm25_run(s, d, 1), qrels(s, d)), hits_at_1(coverage_run(s, d, 1), qrels(s, d))).withColumn("p_value", F.round("p_value", 9)),
        "bootstrap_ci": lambda s, d: metrics.bootstrap(metrics.per_query_metrics(bm25_run(s, d, 10), qrels(s, d), 10), "ndcg"),
        "paired_test": lambda s, d: metrics.paired_test(hits_at_1(coverage_run(s, d, 1), qrels(s, d)), hits_at_1(bm25_run(s, d, 1), qrels(s, d))),
        "latest_judgments": lambda s, d: metrics.latest_judgments(read(s, d, "judgments")),
        "judging_stats": lambda s, d: metrics.judging_stats(read(s, d, "judgments")),
        "kappa": lambda s, d: metrics.kappa(read(s, d, "judgments"), 1, 3),
        "graded_truth": lambda s, d: metrics.graded_truth(read(s, d, "judgments"), 1),
        "pooling": lambda s, d: metrics.pool(bm25_run(s, d, 10).select("query_id", "rank", "id", F.lit("bm25").alias("run")).unionByName(coverage_run(s, d, 10).select("query_id", "rank", "id", F.lit("coverage").alias("run"))), {"bm25": 10, "coverage": 3}),
        "answer_recall": lambda s, d: metrics.answer_recall(best_answers(s, d)).select("query_id", "id", F.round("answer_recall", 6).alias("answer_recall")),
        "rouge": lambda s, d: metrics.rouge(best_answers(s, d)).select("query_id", F.round("rouge1", 6).alias("rouge1"), F.round("rouge_l", 6).alias("rouge_l")),
        "rouge1": lambda s, d: metrics.rouge(best_answers(s, d)).select("query_id", F.round("rouge1", 6).alias("rouge1")),
        "fuzzy_recall": lambda s, d: metrics.fuzzy_recall(best_answers(s, d)).select("query_id", F.round("fuzzy_recall", 6).alias("fuzzy_recall")),
        "strict_truth": strict,
        "latency_stats": lambda s, d: metrics.latency_stats(read(s, d, "events").where("value > 0"), ["event_type"], "value"),
        "text_flags": text_flags,
        "chunk_keys": lambda s, d: chunks(s, d).select("chunk_id", text.chunk_id(F.col("source"), F.col("chunk_index"), F.col("text")).alias("key"), text.point_id(F.col("chunk_id")).cast("string").alias("point_id")),
        "clause_locators": clause_locators,
        "unwrapped": lambda s, d: chunks(s, d).select("chunk_id", F.md5(text.unwrap(F.col("text"))).alias("digest")),
        "content_tokens": lambda s, d: chunks(s, d).select("chunk_id", F.size(text.content_tokens(F.col("text"), F.coalesce("language", F.lit("")) == "en")).alias("topical"), F.size(text.bigrams(F.col("text"))).alias("pairs")),
        "defect_audit": lambda s, d: collection.defect_audit(chunks(s, d)),
        "worst_sources": lambda s, d: collection.worst_sources(chunks(s, d)),
        "corpus_stats": lambda s, d: collection.corpus_stats(chunks(s, d)),
        "source_listing": lambda s, d: collection.source_listing(chunks(s, d)),
        "group_list": lambda s, d: collection.group_list(read(s, d, "doc_groups"), chunks(s, d)),
        "group_metadata": lambda s, d: collection.with_group_metadata(read(s, d, "documents").select("doc_id", "doc_group"), read(s, d, "doc_groups")),
        "index_health": lambda s, d: collection.index_health(*stores(s, d)),
        "registry_status": lambda s, d: collection.registry_status(read(s, d, "catalogue"), chunks(s, d)),
        "registry_summary": lambda s, d: collection.registry_summary(collection.registry_status(read(s, d, "catalogue"), chunks(s, d))),
        "orphans": lambda s, d: collection.orphans(chunks(s, d), read(s, d, "catalogue")),
        "stem_conflicts": lambda s, d: collection.stem_conflicts(read(s, d, "catalogue").select("source").unionByName(chunks(s, d).select(F.regexp_replace("source", r"\.pdf$", ".docx").alias("source")))),
        "upload_conflicts": uploads,
        "checked_catalogue": lambda s, d: collection.checked_catalogue(read(s, d, "catalogue")),
        "file_catalogue": lambda s, d: collection.with_catalogue(read(s, d, "catalogue").select("source", (F.coalesce("size", F.lit(0)) + F.coalesce(F.col("year") % 2, F.lit(0))).alias("size")), read(s, d, "catalogue")),
        "clause_stats": lambda s, d: collection.clause_stats(chunks(s, d)),
        "clause_runs": lambda s, d: clauses.clause_runs(chunks(s, d)),
        "merged_headings": lambda s, d: clauses.merge_headings(chunks(s, d)).select("source", "chunk_index", F.md5("text").alias("digest")),
        "page_fallback": lambda s, d: clauses.page_fallback(chunks(s, d).withColumn("page", F.when(F.col("section_type") != "khoan", F.col("page")))).select("chunk_id", "page_filled"),
        "page_lookup": page_lookup,
        "document_numbers": lambda s, d: read(s, d, "documents").select("doc_id", layout.document_number(F.col("text")).alias("number"), layout.usable_caption(text.squash(F.split("text", "\n")[0])).alias("caption")),
        "section_words": lambda s, d: chunks(s, d).select("chunk_id", F.md5(text.normalize_headers(F.col("text"))).alias("headers"), F.md5(layout.clean_recognised(F.col("text"))).alias("recognised")),
        "evenly_spaced": lambda s, d: layout.evenly_spaced(read(s, d, "pool_topics").select("topic_id"), 10, ["topic_id"]),
        "stale_ids": lambda s, d: collection.stale_ids(stores(s, d)[0], stores(s, d)[2]),
        "reindex_plan": lambda s, d: ingest.reindex_plan(stores(s, d)[1], stores(s, d)[2]),
        "incremental_equals_full": incremental_equals_full,
        "binary_topk": lambda s, d: quantised(s, d, "binary"),
        "int8_topk": lambda s, d: quantised(s, d, "int8"),
        "ivf_recall": lambda s, d: vector_recall(dense.ivf_topk(*every_20th(s, d), 10), dense.dense_topk(*every_20th(s, d), 10)),
        "ivf_topk": lambda s, d: dense.ivf_topk(*every_20th(s, d), 10),
        "int8_recall": lambda s, d: vector_recall(quantised(s, d, "int8"), dense.dense_topk(*every_20th(s, d), 10)),
        "binary_recall": lambda s, d: vector_recall(quantised(s, d, "binary"), dense.dense_topk(*every_20th(s, d), 10)),
        "document_chunks": documents_as_chunks,
        "answers": lambda s, d: answers.answer(questions(s, d), chunks(s, d)),
        "highlights": lambda s, d: answers.highlight_runs(run_rows(s, d, 3).join(questions(s, d).select("query_id", F.col("text").alias("question")), "query_id").withColumn("language", F.lit("vi"))).select("query_id", "rank", "quote"),
        "group_slugs": lambda s, d: read(s, d, "doc_groups").select("doc_group", names.slug_col(F.col("label")).alias("slug"), names.safe_filename_col(F.concat("label", F.lit(".PDF"))).alias("file_name")),
        "clause_order": lambda s, d: _clause_order(chunks(s, d)),
        "tumbling_counts": lambda s, d: ingest.windowed_counts(read(s, d, "events"), stream=False),
        "sliding_counts": lambda s, d: ingest.windowed_counts(read(s, d, "events"), "1 hour", "30 minutes", stream=False),
        "session_counts": lambda s, d: ingest.session_counts(read(s, d, "events"), stream=False),
        "pricing_summary": pricing_summary,
        "segment_revenue": segment_revenue,
    }


def _clause_order(c: DataFrame) -> DataFrame:
    one = c.where("article <> ''").groupBy("source", "article", "khoan").agg(F.count("*").alias("n"))
    key = text.khoan_key(F.col("khoan"))
    w = Window.partitionBy("source", "article").orderBy(key["kind"], key["numbers"], key["text"])
    return one.select("source", "article", "khoan", "n", F.row_number().over(w).alias("place"))


def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    """Extension: sums per return flag and line status."""
    li = read(s, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.count("*").alias("n"))


def segment_revenue(s: SparkSession, d: str) -> DataFrame:
    """Extension: revenue per market segment and nation."""
    li, o, c, n = (read(s, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.groupBy("c_mktsegment", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


def oracle_sql() -> dict[str, str]:
    from docloom.plans.oracles import sql

    return sql()
