"""Projections, comparisons, names, library search, stored seeds and side files."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import reports
from docloom.sources import jsonl, store
from docloom.streaming import ingest


def test_projection_cuts_and_prefers_internal_scores(spark):
    rows = spark.createDataFrame([("c", "x" * 900, 0.5, None, 0.1)], "chunk_id string, text string, score_rrf double, _score_rerank double, score_rerank double")
    got = reports.project(rows).first()
    assert len(got) == 21 and len(got.text) == 800 and got.score_rrf == 0.5 and got.score_rerank is None and got.khoan is None
    assert len(reports.project(rows, reports.SOURCE_COLUMNS, reports.BRIEF_CHARS).first().text) == 500
    df = spark.createDataFrame([("a", "  x  "), ("b", None)], "source string, title string")
    assert reports.from_sources(df, ["a"]).count() == 1 and reports.from_sources(df, []).count() == 2
    assert [r.title for r in reports.cleaned_metadata(df, ["title"]).orderBy("source").collect()] == ["x", ""]


def test_names_become_unique(spark):
    files = spark.createDataFrame([(1, "a.pdf"), (2, "A.docx"), (3, "a.pdf"), (4, "b.pdf"), (5, "c")], "file_id int, name string")
    taken = spark.createDataFrame([("a-3.pdf",), ("b.docx",)], "name string")
    got = {r.file_id: r.unique_name for r in reports.unique_names(files, taken).collect()}
    assert got == {1: "a.pdf", 2: "A-2.docx", 3: "a-4.pdf", 4: "b-2.pdf", 5: "c"}
    assert {r.unique_name for r in reports.unique_names(files).where("file_id <= 3").collect()} == {"a.pdf", "A-2.docx", "a-3.pdf"}


def test_contents_and_subsets(spark):
    files = spark.createDataFrame([("b", "1"), ("a", "1"), ("c", "2"), ("d", None)], "source string, sha string")
    assert {(r.sha, r.source, r.copies) for r in reports.first_of_content(files).collect()} == {("1", "a", 2), ("2", "c", 1)}
    groups = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a")], "file string, source string")
    assert [r.file for r in reports.within(groups, files.where("source = 'a'").select("source")).collect()] == ["g"]


def test_library_search_folds_and_facets_leave_their_own_choice_out(spark):
    files = spark.createDataFrame([("a", "Quy chế Đào tạo", "qc", 2020), ("b", "Quy định học phí", "qd", 2020), ("c", "Hướng dẫn đào tạo", "hd", 2021)], "source string, title string, kind string, year int")
    assert {r.source for r in reports.search_library(files, "dao TẠO", ["title"]).collect()} == {"a", "c"} and reports.search_library(files, " ", ["title"]).count() == 3
    got = {(r.facet, r.value): r.files for r in reports.facets(files, {"kind": ["qc"], "year": []}, ["kind", "year"]).collect()}
    assert got == {("kind", "qc"): 1, ("kind", "qd"): 1, ("kind", "hd"): 1, ("year", "2020"): 1}


def test_answers_are_compared_and_quoted(spark):
    schema = "query_id int, tier string, answer string, quotes int, fragments int, partial int"
    a = spark.createDataFrame([(1, "tier1", "x" * 10, 2, 2, 0), (2, "tier3", "y" * 20, 1, 1, 0), (3, "tier4", "", 0, 0, 0)], schema)
    b = spark.createDataFrame([(1, "tier1", "x" * 6, 1, 0, 1), (2, "tier2", "y" * 8, 1, 0, 0)], schema)
    got = {r.version: r for r in reports.compare_answers(a, b).collect()}
    assert (got["before"].answers, got["before"].mean_chars, got["before"].fragments, got["after"].max_chars, got["after"].partial, got["after"].tier2) == (2, 15.0, 3, 8, 1, 1)
    hits = [(1, 1, "a.pdf", 3, " Đoạn. ", 0.5, "5", "2"), (1, 2, None, None, "Hai", None, "", "")]
    run = spark.createDataFrame(hits, "query_id int, rank int, source string, page int, text string, score_rerank double, article string, khoan string")
    run = run.withColumns({c: F.lit("") for c in ("chapter", "chapter_title", "article_title", "language")}).withColumn("level_labels", F.lit(None).cast("struct<chapter: string, article: string, khoan: string>"))
    assert reports.extractive(run).first().answer == "**Trả lời trích xuất từ 2 đoạn liên quan nhất:**\n\n**[1] a.pdf — trang 3 · Điều 5, Khoản 2** · rerank=0.500\n> Đoạn.\n\n**[2] ? — trang ?**\n> Hai\n"
    assert reports.generation_means(spark.createDataFrame([(1.0,), (None,)], "x double"), ["x"]).first().asDict() == {"x": 1.0, "answers": 2}


def test_seeds_are_checked(spark, tmp_path):
    v = spark.createDataFrame([(f"c{i}", [float(i), 1.0]) for i in range(9)], "chunk_id string, embedding array<float>")
    path = str(tmp_path / "seed")
    store.export_seed(v, path, "m")
    assert store.import_seed(spark, path, "m", 2).count() == 9
    assert store.import_seed(spark, path, "other", 2) is None and store.import_seed(spark, path, "m", 3) is None
    have, rest = store.split_by_seed(spark.createDataFrame([("c1",), ("z",)], "chunk_id string"), v)
    assert [r[0] for r in have.collect()] == ["c1"] and [r[0] for r in rest.collect()] == ["z"]
    v.limit(8).write.mode("overwrite").parquet(path + "/vectors")
    with pytest.raises(ValueError):
        store.import_seed(spark, path, "m", 2)
    tables = store.TableStore(spark, str(tmp_path / "t"))
    assert not tables.ensure_vectors("v", 2)
    before = tables.replace("v", v)
    assert tables.ensure_vectors("v", 2) and tables.read("v").count() == 9
    assert not tables.ensure_vectors("v", 3) and tables.read("v").count() == 0
    tables.rollback("v", before)
    assert tables.read("v").count() == 9


def test_side_files(spark, tmp_path):
    (tmp_path / "a.pdf.meta.json").write_text(json.dumps({"title": "Quy chế", "size_bytes": 5}))
    (tmp_path / "b.docx.meta.json").write_text("no json")
    assert {r.source: (r.title, r.size_bytes) for r in jsonl.read_sidecars(spark, str(tmp_path), "title: string, size_bytes: bigint").collect()} == {"a.pdf": ("Quy chế", 5), "b.docx": (None, None)}
    (tmp_path / "catalog.json").write_text(json.dumps({"version": 1, "documents": {"x.pdf": {"title": "T", "year": 2020}}}))
    assert [tuple(r) for r in jsonl.read_catalogue(spark, str(tmp_path / "catalog.json"), "title: string, year: int").collect()] == [("x.pdf", "T", 2020)]
    assert jsonl.read_catalogue(spark, str(tmp_path / "none.json"), "title: string").count() == 0
    for n in (1, 2):
        (tmp_path / f"summary_{n}.json").write_text(str(n))
    import os

    os.utime(tmp_path / "summary_1.json", (2e9, 2e9))
    assert jsonl.latest_result(spark, str(tmp_path)).first().value == "1"


def test_only_missing_vectors_are_made(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "yy"), ("b", "yy")], "chunk_id string, text string")
    cached = spark.createDataFrame([("a", [9.0]), ("gone", [1.0])], "chunk_id string, embedding array<double>")
    got = ingest.embed_missing(chunks, cached, lambda t: F.array(F.length(t).cast("double")))
    assert {r.chunk_id: r.embedding for r in got.collect()} == {"a": [9.0], "b": [2.0]} and got.count() == 2
