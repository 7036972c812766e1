import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import answers, chunking, clauses, collection
from docloom.sources import files, jsonl
from docloom.sources.store import TableStore
from docloom.streaming import ingest

BODY = "Quy định chung\n" + "\n".join(f"Điều {i}. Đối tượng áp dụng\n1. Sinh viên hệ chính quy nộp đơn trước khi học kỳ bắt đầu hai tuần.\n2. Giảng viên xét đơn và trả lời bằng văn bản trong bảy ngày làm việc.\n3. Phòng đào tạo lưu hồ sơ theo quy định hiện hành của trường." for i in range(1, 5))


def test_structure_gives_clauses_with_their_article():
    kind, labels, chunks = chunking.chunk_text(BODY)
    assert kind == "structure" and labels == {2: "DIEU_VN", 3: "NUM_DOT"}
    assert {(c["article"], c["khoan"]) for c in chunks if c["khoan"]} == {(str(a), str(k)) for a in range(1, 5) for k in (2, 3)}
    # a short heading takes up the first clause; still short, it leads the second
    assert all("1. Sinh viên" in c["text"] and c["text"].startswith("Điều") for c in chunks if c["khoan"] == "2")
    assert all(c["article_title"] == "Đối tượng áp dụng" for c in chunks if c["khoan"])


def test_long_paragraphs_are_cut_at_sentences_with_one_sentence_of_overlap():
    s = [f"Câu số {'x' * 60} thứ {chr(97 + i)} nói về việc học." for i in range(12)]
    got = [c["text"] for c in chunking.split_paragraphs(" ".join(s))]
    assert len(got) > 1 and got[1].startswith(s[[i for i, x in enumerate(s) if got[0].endswith(x)][0]])


def test_budget_rebalances_the_tail():
    words = "từ " * 330
    parts = chunking.fit_budget(words.strip(), 250)
    assert [len(p.split()) for p in parts] == [156, 87, 87]
    assert " ".join(parts).split() == words.split()
    assert chunking.fit_budget("ngắn") == ["ngắn"]


def test_headings_lead_the_next_chunk_and_forms_lose_their_clause():
    meta = {"section_type": "khoan", "chapter": "", "chapter_title": "", "article": "1", "article_title": "", "khoan": "2"}
    got = chunking.finish([{**meta, "text": "Điều 1. Phạm vi"}, {**meta, "text": "Nội dung của điều này."}, {**meta, "text": "Kính gửi: ......................"}, {**meta, "text": "Điều 9."}], 250)
    assert [c["text"] for c in got] == ["Điều 1. Phạm vi\nNội dung của điều này.", "Kính gửi: ......................"]
    assert (got[1]["section_type"], got[1]["khoan"]) == ("form", "")


def test_chunk_documents_handles_null_and_empty(spark):
    docs = spark.createDataFrame([("a.pdf", BODY), ("b.pdf", None), ("c.pdf", "")], "source string, text string")
    got = chunking.chunk_documents(docs)
    assert {r.source for r in got.collect()} == {"a.pdf"}
    assert got.select("chunk_id").distinct().count() == got.count()


def test_table_rows_continue_over_lines(spark):
    rows = [("a", 1, 1, 1, ["STT", "Tên", ""]), ("a", 1, 2, 1, ["1", "Học", "x"]), ("a", 1, 3, 2, ["", "phí", ""]), ("a", 1, 4, 2, ["2", "Thi", ""])]
    df = spark.createDataFrame(rows, "source string, table_no int, line_no int, page int, cells array<string>")
    got = [r.text for r in chunking.table_chunks(df).orderBy("row_no").collect()]
    assert got == ["[Bảng 1 · trang 1 · dòng 1]\nSTT: 1\nTên: Học phí\nTên: x", "[Bảng 1 · trang 2 · dòng 2]\nSTT: 2\nTên: Thi"]


def chunk_rows(spark):
    rows = [("c0", "s", "5", "2", 1, 0, "Đoạn một của khoản."), ("c1", "s", "5", "2", 1, 1, "Đoạn hai của khoản."), ("c2", "s", "5", "2", 2, 2, "Đoạn ba của khoản."), ("c3", "s", "5", "2", 9, 9, "Nơi khác."), ("c4", "s", "", "", 3, 3, "Văn bản tự do.")]
    return spark.createDataFrame(rows, "chunk_id string, source string, article string, khoan string, page int, chunk_index int, text string")


def test_clauses_are_reassembled_around_the_hit(spark):
    c = chunk_rows(spark)
    assert sorted((r.first_index, r.parts) for r in clauses.clause_runs(c).collect()) == [(0, 3), (9, 1)]
    hits = spark.createDataFrame([(1, 1, "c1"), (1, 2, "c2"), (1, 3, "c4")], "query_id int, rank int, chunk_id string")
    got = {r.chunk_id: r for r in clauses.assemble(hits, c).collect()}
    assert got["c1"].text == "Đoạn một của khoản.\n\nĐoạn hai của khoản.\n\nĐoạn ba của khoản." and got["c1"].run_id == got["c2"].run_id == "c0"
    assert not got["c4"].assembled
    small = {r.chunk_id: r for r in clauses.assemble(hits, c, max_chars=45).collect()}
    assert small["c1"].partial and small["c1"].text.startswith("Đoạn một")
    assert sorted(r.chunk_id for r in clauses.collapse_runs(clauses.assemble(hits, c)).collect()) == ["c1", "c4"]


def test_answers_quote_and_cite(spark):
    docs = spark.createDataFrame([("a.pdf", BODY)], "source string, text string")
    c = chunking.chunk_documents(docs).withColumns({"page": F.lit(3), "doc_number": F.lit("12/QĐ"), "language": F.lit("vi"), "level_labels": F.lit(None).cast("struct<chapter:string,article:string,khoan:string>")})
    q = spark.createDataFrame([(1, "Giảng viên xét đơn trong mấy ngày?"), (2, "zzzz")], "query_id int, text string")
    got = {r.query_id: r for r in answers.answer(q, c).collect()}
    assert "Khoản 2" in got[1].answer and "[1]: 12/QĐ – a.pdf — trang 3" in got[1].answer
    assert got[2].tier == "tier4" and got[2].answer == answers.NOT_FOUND
    with pytest.raises(ValueError):
        answers.retrieve(q, c, "magic")


def test_upload_verdicts(spark):
    batch = spark.createDataFrame([(1, "a.pdf", "g", "s1"), (2, "b.pdf", "g", "s2"), (3, "c.pdf", "g", "s2"), (4, "B.docx", "g", "s4"), (5, "d.pdf", "h", "s5"), (6, "e.pdf", "h", "s6")], "upload_id int, name string, doc_group string, sha string")
    corpus = spark.createDataFrame([("x.pdf", "g", "s1"), ("d.docx", "g", "zz")], "source string, doc_group string, sha string")
    got = {r.upload_id: r.verdict for r in collection.upload_conflicts(batch, corpus).collect()}
    assert got == {1: "duplicate_corpus", 2: "ok", 3: "duplicate_batch", 4: "name_batch", 5: "name_other_group", 6: "ok"}


def docx(lines):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" if x != "BREAK" else '<w:p><w:r><w:br w:type="page"/></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p></w:body></w:document>')
    return out.getvalue()


def test_raw_files_are_listed_validated_and_read(spark, tmp_path):
    (tmp_path / "luat").mkdir()
    (tmp_path / "_tmp").mkdir()
    (tmp_path / "luat" / "a.docx").write_bytes(docx(["Một", "BREAK", "Hai"]))
    (tmp_path / "luat" / "b.pdf").write_bytes(b"not a pdf")
    (tmp_path / "luat" / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "_tmp" / "c.docx").write_bytes(b"x")
    found = files.list_documents(spark, str(tmp_path))
    assert sorted((r.source, r.doc_group) for r in found.select("source", "doc_group").collect()) == [("a.docx", "luat"), ("b.pdf", "luat")]
    assert {r.source: r.code for r in files.validate(found).collect()} == {"a.docx": None, "b.pdf": "wrong_type"}
    pages = [(r.page, r.text) for r in files.extract_documents(found.where("source = 'a.docx'")).orderBy("page").collect()]
    assert pages == [(1, "Một"), (2, "Hai")]
    assert files.find_document(found, "A.DOCX").first().source == "a.docx"


def test_json_lines_and_maps(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"chunk_id": "1", "text": "x", "extra": 5}) + "\nbroken\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text(json.dumps({"chunk_id": "2", "text": "y"}) + "\n", encoding="utf-8")
    assert sorted(r.chunk_id for r in jsonl.read_chunks(spark, str(tmp_path), tolerant=True).collect() if r.chunk_id) == ["1", "2"]
    assert [r.chunk_id for r in jsonl.read_chunks(spark, str(tmp_path), ["b.jsonl"]).collect()] == ["2"]
    (tmp_path / "g.json").write_text(json.dumps({"luat": {"label": "Luật", "doc_type": "law"}}), encoding="utf-8")
    assert [tuple(r) for r in jsonl.read_map(spark, str(tmp_path / "g.json"), "doc_group", "label string, doc_type string").collect()] == [("luat", "Luật", "law")]
    assert jsonl.read_map(spark, str(tmp_path / "none.json"), "k", "v string").count() == 0


def test_store_publishes_whole_versions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert store.read("t") is None
    store.replace("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    opened = store.read("t")
    store.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert opened.count() == 2
    store.delete("t", spark.createDataFrame([(1,)], "k int"), ["k"])
    assert store.read("t").count() == 2


def test_streamed_documents_become_chunks_and_replace_their_source(spark, tmp_path):
    inbox, store = tmp_path / "in", TableStore(spark, str(tmp_path / "store"))
    inbox.mkdir()
    schema = "source string, text string"
    for source, text in [("a.pdf", BODY), ("b.pdf", "Một đoạn văn tự do đủ dài để được giữ lại."), ("a.pdf", "Bản mới của văn bản, ngắn hơn hẳn.")]:
        spark.createDataFrame([(source, text)], schema).coalesce(1).write.mode("append").json(str(inbox))
        ingest.ingest(spark.readStream.schema(schema).json(str(inbox)), store, str(tmp_path / "check")).awaitTermination()
    got = {r.source: r.n for r in store.read_parts("chunks").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got == {"a.pdf": 1, "b.pdf": 1}
    assert store.read_parts("postings").select("source").distinct().count() == 2
    ingest.remove_sources(store, spark.createDataFrame([("a.pdf",)], "source string"))
    assert {r.source for r in store.read_parts("postings").collect()} == {r.source for r in store.read_parts("chunks").collect()} == {"b.pdf"}


def test_a_batch_takes_the_latest_version_and_leaves_bad_documents_out(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "store"))
    schema = "source string, text string, modified int"
    ingest.apply_batch(spark.createDataFrame([("a", "Bản cũ của văn bản này.", 1), ("a", "Bản mới của văn bản này.", 2), ("b", None, 1), ("c", "Văn bản thứ ba ở đây.", 1)], schema), store)
    assert {r.source: r.text for r in store.read_parts("chunks").collect()} == {"a": "Bản mới của văn bản này.", "c": "Văn bản thứ ba ở đây."}
    assert [r.source for r in store.read("failed").collect()] == ["b"]
    state = store.parts()
    update = spark.createDataFrame([("c", "Một bản khác hẳn của c.", 2)], schema)
    with monkeypatch.context() as m:  # the driver ends between writing and publishing
        m.setattr(TableStore, "_replace_file", lambda self, target, content: (_ for _ in ()).throw(OSError("killed")) if target.getName() == "STATE" else None)
        with pytest.raises(OSError):
            ingest.apply_batch(update, store)
    assert store.parts() == state and {r.text for r in store.read_parts("chunks").where("source = 'c'").collect()} == {"Văn bản thứ ba ở đây."}
    after = ingest.apply_batch(update, store)
    assert {r.source: r.text for r in store.read_parts("chunks").collect()} == {"a": "Bản mới của văn bản này.", "c": "Một bản khác hẳn của c."}
    same = [p for p in state["chunks"] if after["chunks"].get(p) == state["chunks"][p]]
    assert len(state["chunks"]) - 1 == len(same) or len(state["chunks"]) == 1  # the part of a lies where it did


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 6}:10:00", "a", 1.0) for i in range(12)]
    events = spark.createDataFrame(rows, "user_id int, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = ingest.run_to_memory(spark, ingest.windowed_counts(stream), "w", "complete")
    want = ingest.windowed_counts(events, stream=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_jobs(spark):
    log = spark.createDataFrame([(1, "queued", 1.0), (1, "running", 2.0), (2, "running", 1.0), (2, "done", 2.0), (3, "running", 1.0), (3, "running", 2.0), (3, "running", 3.0)], "job_id int, state string, ts double")
    assert {r.job_id: r.state for r in ingest.queue_state(log).collect()} == {1: "queued", 2: "done", 3: "failed"}


def test_running_values_cross_partitions(spark):
    rows = [(f"c{i:03d}", "hot", i, "Điều %d." % i if i % 7 in (0, 1) else f"Nội dung đoạn {i}", i // 10 if i % 13 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "chunk_id string, source string, chunk_index int, text string, page int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        merged = {r.chunk_index: r.text for r in clauses.merge_headings(df).collect()}
        filled = {r.chunk_id: r.page_filled for r in clauses.page_fallback(df).collect()}
        assert clauses.ranged(df, "source", clauses.PLACE)[0].select("__p").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, lead, page = {}, [], None
    for cid, _, i, text, p in rows:
        page = p if p is not None else page
        assert filled[cid] == (1 if page is None else page)
        if text.startswith("Điều"):
            lead.append(text)
        else:
            want[i] = "\n".join([*lead, text])
            lead = []
    assert merged == want


def test_outline_levels_reset_and_number_themselves():
    blocks = [(None, "Lời nói đầu của tài liệu."), (1, "I. Quy định chung"), (2, "Phạm vi"), (None, "Nội dung của phạm vi áp dụng."), (2, "5. Đối tượng"), (None, "Nội dung về đối tượng."), (1, "Thi hành"), (None, "Nội dung thi hành.")]
    got = [(c["section_type"], c["chapter"], c["article"], c["article_title"]) for c in chunking.split_outline(blocks)]
    assert got == [("text", "", "", ""), ("muc", "I", "", ""), ("article", "I", "1", "Phạm vi"), ("article", "I", "5", "Đối tượng"), ("muc", "2", "", "")]
