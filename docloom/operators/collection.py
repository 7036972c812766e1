"""Statistics, joins and checks over the collection, its catalogue and its index stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(doc_group, chunks, sources): counts per group and, with group null, of all; empty and null groups are 'unknown'."""
    group = F.when(F.coalesce("doc_group", F.lit("")) == "", "unknown").otherwise(F.col("doc_group"))
    return chunks.withColumn("doc_group", group).rollup("doc_group").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"))


def source_listing(chunks: DataFrame) -> DataFrame:
    """(source, doc_group, doc_type, doc_number, chunks, max_page): the metadata of the first chunk of each source."""
    first = lambda c: F.min_by(c, F.struct("chunk_index", "chunk_id")).alias(c)
    return chunks.groupBy("source").agg(first("doc_group"), first("doc_type"), first("doc_number"), F.count("*").alias("chunks"), F.max("page").alias("max_page"))


def group_list(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_group, label, files, chunks) of registered groups and of those that only occur."""
    seen = chunks.groupBy("doc_group").agg(F.count_distinct("source").alias("files"), F.count("*").alias("chunks"))
    return registry.select("doc_group", "label").join(seen, "doc_group", "full_outer").select("doc_group", F.coalesce("label", "doc_group").alias("label"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def with_group_metadata(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds label, type and body of the document's group; a missing group is labelled by its name, or 'ungrouped'."""
    r = registry.select("doc_group", F.col("label").alias("group_label"), F.col("doc_type").alias("group_type"), F.col("issuing_body").alias("group_body"))
    out = docs.join(r, "doc_group", "left")
    named = F.when(F.coalesce("doc_group", F.lit("")) == "", "ungrouped").otherwise(F.col("doc_group"))
    return out.withColumn("group_label", F.coalesce("group_label", named)).withColumn("group_type", F.coalesce("group_type", F.lit(""))).withColumn("group_body", F.coalesce("group_body", F.lit("")))


def index_health(jsonl: DataFrame, sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """(source, jsonl, bm25, vectors): sources whose chunk counts differ between the three stores; a missing source counts 0."""
    count = lambda df, name: df.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias(name))
    joined = count(jsonl, "jsonl").join(count(sparse, "bm25"), "source", "full_outer").join(count(dense, "vectors"), "source", "full_outer")
    filled = joined.select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("jsonl", "bm25", "vectors")))
    return filled.where("jsonl <> bm25 or jsonl <> vectors")


def registry_status(files: DataFrame, chunks: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """(source, status, chunks): files joined with what is indexed; chunks without a file are 'orphan', files without chunks 'not_indexed'. An active job's status goes first."""
    indexed = chunks.groupBy("source").agg(F.count("*").alias("chunks"))
    both = files.select("source").distinct().withColumn("__file", F.lit(True)).join(indexed, "source", "full_outer")
    derived = F.when(F.col("__file").isNull(), "orphan").when(F.col("chunks").isNull(), "not_indexed").otherwise("indexed")
    if jobs is not None:
        both = both.join(jobs.select("source", F.col("status").alias("__job")), "source", "left")
        derived = F.when(F.col("__job").isin("queued", "processing", "removing"), F.col("__job")).otherwise(derived)
    return both.select("source", derived.alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def registry_summary(status: DataFrame) -> DataFrame:
    """One row of counts by status; orphans are not in the total."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    return status.agg(F.sum(F.when(F.col("status") != "orphan", 1).otherwise(0)).alias("total"), n("indexed"), n("not_indexed"), n("orphan"), F.sum("chunks").alias("chunks"))


def orphans(indexed: DataFrame, files: DataFrame) -> DataFrame:
    """Sources that are indexed but have no file; names compare without case and extension."""
    stem = lambda c: F.lower(F.regexp_replace(c, r"\.[^.]*$", ""))
    have = files.select(stem(F.col("source")).alias("stem")).distinct()
    return indexed.select("source").distinct().withColumn("stem", stem(F.col("source"))).join(have, "stem", "left_anti").select("source")


def stem_conflicts(files: DataFrame) -> DataFrame:
    """(source, stem, winner): files whose stem a file earlier in name order already has."""
    stem = F.lower(F.regexp_replace("source", r"\.[^.]*$", ""))
    w = Window.partitionBy("stem").orderBy("source")
    ranked = files.select("source").distinct().withColumn("stem", stem).withColumn("n", F.row_number().over(w)).withColumn("winner", F.first("source").over(w))
    return ranked.where("n > 1").select("source", "stem", "winner")


def upload_conflicts(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """(upload_id, verdict) of (upload_id, name, doc_group, sha) against (source, doc_group, sha).

    In this order: 'duplicate_corpus' (same content indexed), 'duplicate_batch' (same content earlier in the batch), 'name_batch',
    'name_same_group', 'name_other_group' (same stem), else 'ok'. The first of a content or stem comes from an aggregate, so one that all share is no hot window.
    """
    stem = lambda c: F.lower(F.regexp_replace(c, r"\.[^.]*$", ""))
    b = batch.withColumn("stem", stem(F.col("name")))
    for key in ("sha", "stem"):
        first = b.groupBy(key).agg(F.min("upload_id").alias("__first"))
        b = b.join(first, key, "left").withColumn(f"{key}_again", F.col("upload_id") != F.col("__first")).drop("__first")
    known = corpus.select(F.col("sha")).distinct().withColumn("known", F.lit(True))
    stems = corpus.select(stem(F.col("source")).alias("stem"), F.col("doc_group").alias("g")).groupBy("stem").agg(F.collect_set("g").alias("groups"))
    out = b.join(known, "sha", "left").join(stems, "stem", "left")
    verdict = (
        F.when(F.col("known"), "duplicate_corpus")
        .when(F.col("sha_again"), "duplicate_batch")
        .when(F.col("stem_again"), "name_batch")
        .when(F.array_contains("groups", F.col("doc_group")), "name_same_group")
        .when(F.col("groups").isNotNull(), "name_other_group")
        .otherwise("ok")
    )
    return out.select("upload_id", verdict.alias("verdict"))


def clause_stats(chunks: DataFrame) -> DataFrame:
    """One row: clauses (source, article, khoan all present), those in several chunks, and the largest."""
    groups = chunks.where("article <> '' and khoan <> ''").groupBy("source", "article", "khoan").agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("clauses"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("split_clauses"), F.max("n").alias("largest"))


def with_defects(chunks: DataFrame) -> DataFrame:
    """Adds ``defects``, the array of a chunk's defects: empty (then no other), ocr_corrupt, form_blank, stub, mislabelled, over_budget.

    ocr_corrupt needs both signs, digits inside words and missing diacritics, in a text that isn't short; mislabelled is a clause number
    on a form. What several rules need is computed once, in stages.
    """
    staged = chunks.withColumn("__t", T.strip(F.coalesce("text", F.lit(""))))
    staged = staged.withColumn("__form", T.is_form(F.col("__t"), T.AUDIT_MARKERS)).withColumn("__words", T.word_count(F.col("__t")))
    t, form, words = F.col("__t"), F.col("__form"), F.col("__words")
    flag = lambda cond, name: F.when((t != "") & cond, F.lit(name))
    opening = F.lower(F.substring(t, 1, 40)).rlike(f"^(?:{'|'.join(T.AUDIT_OPENINGS)})")
    rules = F.array(
        F.when(t == "", F.lit("empty")),
        flag((F.length(t) > T.AUDIT_MIN_CHARS) & (T.digit_in_word_share(t) > T.AUDIT_DIGITS) & (T.diacritic_ratio(t) < T.AUDIT_DIACRITICS), "ocr_corrupt"),
        flag(form, "form_blank"),
        flag((words < T.STUB_WORDS) | (F.length(t) < T.STUB_CHARS), "stub"),
        flag((F.concat(F.coalesce("article", F.lit("")), F.coalesce("khoan", F.lit(""))) != "") & (form | opening), "mislabelled"),
        flag(F.floor(words * F.lit(T.TOKENS_PER_WORD)) > T.AUDIT_TOKENS, "over_budget"),
    )
    return staged.withColumn("defects", F.array_compact(rules)).drop("__t", "__form", "__words")


def defect_audit(chunks: DataFrame) -> DataFrame:
    """(defect, chunks, share): how many chunks have each defect; a chunk can have several."""
    total = F.lit(chunks.count())
    flagged = with_defects(chunks).select(F.explode("defects").alias("defect"))
    return flagged.groupBy("defect").agg(F.count("*").alias("chunks"), F.round(F.count("*") / total, 6).alias("share"))


def worst_sources(chunks: DataFrame, k: int = 8, kinds: int = 3) -> DataFrame:
    """(source, rank, defects, defect_rank, defect, n): the ``k`` sources with most defects and the ``kinds`` commonest of each."""
    flagged = with_defects(chunks).select("source", F.explode("defects").alias("defect"))
    per = flagged.groupBy("source", "defect").agg(F.count("*").alias("n"))
    totals = per.groupBy("source").agg(F.sum("n").alias("defects"))
    top = totals.orderBy(F.desc("defects"), "source").limit(k)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("defects"), "source")))
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "defect"))
    return per.join(F.broadcast(top), "source").withColumn("defect_rank", nth).where(F.col("defect_rank") <= kinds).select("source", "rank", "defects", "defect_rank", "defect", "n")


# The longest texts of a catalogue entry, and its years.
CATALOGUE_CHARS, CATALOGUE_YEARS = {"title": 300, "title_en": 300, "doc_number": 80, "issuing_body": 120}, (1900, 2100)


def checked_catalogue(catalogue: DataFrame) -> DataFrame:
    """(source, size, title, title_en, doc_number, issuing_body, issued, year) of the entries with any valid field; invalid ones are null.

    Texts are trimmed and may be empty, which hides a wrong value, but not too long; ``issued`` has the shape of a date; ``year`` is in range.
    """
    text = lambda c, most: F.when(F.length(F.trim(c)) <= most, F.trim(c)).alias(c)
    issued = F.when(F.trim("issued").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim("issued")).alias("issued")
    year = F.when(F.col("year").between(*CATALOGUE_YEARS), F.col("year")).alias("year")
    out = catalogue.select("source", "size", *(text(c, most) for c, most in CATALOGUE_CHARS.items()), issued, year)
    return out.where(F.coalesce(*CATALOGUE_CHARS, "issued", F.col("year").cast("string")).isNotNull())


def with_catalogue(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``files`` (source, size, ...) with the valid fields of their catalogue entry; an entry that records another size is of another file of that name and adds nothing."""
    entries = checked_catalogue(catalogue).withColumnRenamed("size", "__size")
    clash = [c for c in entries.columns if c in files.columns and c != "source"]
    e = entries.drop(*clash).withColumnRenamed("source", "__source")
    return files.join(e, (F.col("source") == F.col("__source")) & (F.col("__size").isNull() | (F.col("__size") == F.col("size"))), "left").drop("__source", "__size")


def stale_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that are indexed but no longer produced."""
    return before.select("chunk_id").distinct().join(after.select("chunk_id").distinct(), "chunk_id", "left_anti")
