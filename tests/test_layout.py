import os

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import layout
from docloom.plans import tables


def test_blocks_in_tables_go(spark):
    blocks = spark.createDataFrame([("s", 1, 1, 0.0, 0.0, 10.0, 10.0), ("s", 1, 2, 50.0, 50.0, 60.0, 60.0), ("s", 2, 1, 0.0, 0.0, 10.0, 10.0)], "source string, page int, block_no int, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([("s", 1, 0.0, 0.0, 10.0, 6.0)], "source string, page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.page, r.block_no) for r in layout.outside_tables(blocks, boxes).collect()) == [(1, 2), (2, 1)]


def test_page_of_is_an_as_of_join(spark):
    starts = spark.createDataFrame([("s", 1, 5), ("s", 2, 100)], "source string, page int, start int")
    places = spark.createDataFrame([("s", 0), ("s", 5), ("s", 99), ("s", 100), ("t", 1)], "source string, pos int")
    assert {(r.source, r.pos): r.page for r in layout.page_of(places, starts).collect()} == {("s", 0): None, ("s", 5): 1, ("s", 99): 1, ("s", 100): 2, ("t", 1): None}


def test_text_helpers(spark):
    row = spark.createDataFrame([("Dieu 5   a\n\n\n\nb Khoan 2", "theo 3/2019/TT-BGDĐT\nSố: 12 /QĐ-ĐHQT\n", "BẢNG ĐIỂM HỌC KỲ", "của hiệu trưởng trường", ["a", None])], "a string, b string, c string, d string, e array<string>")
    got = row.select(layout.clean_recognised(F.col("a")), layout.document_number(F.col("b")), layout.usable_caption(F.col("c")), layout.usable_caption(F.col("d")), layout.header_candidate(F.col("e"))).first()
    assert tuple(got) == ("Điều 5 a\n\nb Khoản 2", "12 /QĐ-ĐHQT", True, False, True)


def test_replicas_stay_near_and_unit(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0]) for i in range(20)], "vec_id bigint, embedding array<float>")
    got = layout.replicate(v, 3).collect()
    assert len(got) == 60 and {r.id for r in got if "__" not in r.id} == {str(i) for i in range(20)}
    m = np.array([r.embedding for r in got])
    assert np.allclose(np.linalg.norm(m, axis=1), 1, atol=1e-5) and (m[:, 0] > 0.99).all() and m[:, 1].std() > 0.003


def test_even_sample(spark):
    assert [r.id for r in layout.evenly_spaced(spark.range(10), 3, ["id"]).collect()] == [0, 3, 6]


def test_captions_stand_just_above_their_table(spark):
    blocks = [("s", 1, 0.0, 10.0, 50.0, 20.0, "BẢNG ĐIỂM HỌC KỲ MỘT"), ("s", 1, 0.0, 30.0, 50.0, 40.0, "của hiệu trưởng trường đại học"), ("s", 1, 0.0, 42.0, 50.0, 48.0, "CỘNG HÒA XÃ HỘI CHỦ NGHĨA"), ("s", 1, 0.0, 300.0, 50.0, 310.0, "Danh mục các môn học")]
    b = spark.createDataFrame(blocks, "source string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    boxes = spark.createDataFrame([("s", 1, 1, 60.0), ("s", 1, 2, 500.0), ("s", 2, 1, 9.0)], "source string, page int, table_no int, y0 double")
    assert {(r.page, r.table_no): r.caption for r in layout.table_captions(b, boxes).collect()} == {(1, 1): "BẢNG ĐIỂM HỌC KỲ MỘT", (1, 2): "", (2, 1): ""}


def test_steps_are_released(spark):
    path = tables.materialize(spark.range(3)).inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    wide = tables.bucketed(spark.range(5).union(spark.range(5)), ["id"])
    assert wide.count() == 5 and os.path.exists(path)
    assert tables.release(spark) >= 2 and not os.path.exists(path) and tables.release(spark) == 0
