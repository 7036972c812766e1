"""Rules of the audit, the catalogue, the paired tests and the clause windows, each from its own words."""

import random

import numpy as np
import pytest
from docloom.operators import clauses, collection, metrics


def flags(spark, text, article="", khoan=""):
    df = spark.createDataFrame([(text, article, khoan)], "text string, article string, khoan string")
    return set(collection.with_defects(df).first().defects)


def test_defects_follow_the_audit(spark):
    plain = "Sinh viên nộp đơn xin học bổng trước ngày mười lăm hằng tháng tại phòng đào tạo của trường đại học."
    assert flags(spark, plain) == flags(spark, plain, "5", "1") == set()
    assert flags(spark, None) == flags(spark, " \n ") == {"empty"}
    corrupt = "Nha tru6ng c6ng bo quy dinh v3e h0c phi cua sinh vien he chinh quy theo n6m hoc moi va cac quy dinh khac"
    assert flags(spark, corrupt) == {"ocr_corrupt"}
    assert "ocr_corrupt" not in flags(spark, corrupt[:70]) | flags(spark, plain + " c6ng s6ch h0a n6m")
    form = "Kính gửi: phòng đào tạo. Đơn đề nghị của sinh viên về việc hoãn thi học phần trong học kỳ này của năm học."
    assert flags(spark, form) == {"form_blank"} and flags(spark, form, "3") == {"form_blank", "mislabelled"}
    assert flags(spark, "Phụ lục các biểu phí của học kỳ này áp dụng cho mọi sinh viên hệ chính quy của trường từ năm nay.", "", "2") == {"mislabelled"}
    assert flags(spark, "Ngắn quá.") == {"stub"} and flags(spark, "từ " * 170) == {"over_budget"}


def test_catalogue_fields_are_dropped_one_by_one(spark):
    schema = "source string, title string, title_en string, doc_number string, issued string, issuing_body string, note string, year int, size bigint"
    rows = [("a", "  Quy chế ", None, "", "2022-12-26", "B" * 121, "n", 2022, 10), ("b", "x" * 301, None, None, "5/4/2016", "Bộ", None, 1899, None), ("c", None, None, None, "nay", None, "n", 3000, 1), ("d", "Old", None, None, None, None, None, None, 7)]
    catalogue = spark.createDataFrame(rows, schema)
    got = {r.source: r.asDict() for r in collection.checked_catalogue(catalogue).collect()}
    assert set(got) == {"a", "b", "d"}
    assert (got["a"]["title"], got["a"]["doc_number"], got["a"]["issued"], got["a"]["issuing_body"], got["a"]["year"]) == ("Quy chế", "", "2022-12-26", None, 2022)
    assert (got["b"]["title"], got["b"]["issued"], got["b"]["issuing_body"], got["b"]["year"]) == (None, None, "Bộ", None)
    files = spark.createDataFrame([("a", 10), ("b", 5), ("d", 8), ("e", 1)], "source string, size bigint")
    joined = {r.source: (r.title, r.issuing_body) for r in collection.with_catalogue(files, catalogue).collect()}
    assert joined == {"a": ("Quy chế", None), "b": (None, "Bộ"), "d": (None, None), "e": (None, None)}


@pytest.mark.parametrize("n", [1, 7, 64, 100])
def test_draws_are_those_of_the_generator(n):
    rng = random.Random(42)
    assert metrics.draws(n, 50, 42).tolist() == [[rng.randrange(n) for _ in range(n)] for _ in range(50)]


def test_intervals_equal_the_plain_loop(spark):
    rng = random.Random(1)
    a, b = [rng.random() < 0.5 for _ in range(40)], [rng.random() < 0.7 for _ in range(40)]
    frame = lambda xs: spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "query_id int, hit double")
    draw, means = random.Random(42), []
    for _ in range(2000):
        means.append(sum(a[draw.randrange(40)] for _ in range(40)) / 40)
    means.sort()
    got = metrics.bootstrap(frame(a), "hit", rounds=2000).first()
    assert (got.low, got.high) == pytest.approx((means[50], means[1950]))
    draw, diffs, far = random.Random(42), [], 0
    for _ in range(2000):
        at = [draw.randrange(40) for _ in range(40)]
        diffs.append(sum(b[i] for i in at) / 40 - sum(a[i] for i in at) / 40)
    diffs.sort()
    seen, draw = sum(b) / 40 - sum(a) / 40, random.Random(42)
    for _ in range(2000):
        far += abs(sum(b[i] - a[i] - seen for i in (draw.randrange(40) for _ in range(40))) / 40) >= abs(seen) - 1e-12
    got = metrics.paired_test(frame(a), frame(b), rounds=2000).first()
    assert (got.n, got.diff, got.low, got.high, got.p_value) == pytest.approx((40, seen, diffs[50], diffs[1949], far / 2000), abs=2e-3)
    assert metrics.bootstrap(frame([]), "hit").count() == 0


def test_percentiles_of_hot_groups(spark):
    rows = [("a", float(v)) for v in random.Random(3).sample(range(5000), 2000)] + [("b", 1.0)]
    got = {r.g: r for r in metrics.latency_stats(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    own = sorted(v for g, v in rows if g == "a")
    assert (got["a"].n, got["a"].p50, got["a"].p95, got["a"].p99, got["b"].p99) == (2000, own[999], own[1899], own[1979], 1.0)


def test_clause_windows_pay_for_the_joints_afterwards(spark):
    parts = [("c", i, f"p{i}", "x" * n) for i, n in enumerate((40, 60, 38, 30))]
    chunks = spark.createDataFrame([(k, s, "1", "1", 1, i, t) for s, i, k, t in parts], "chunk_id string, source string, article string, khoan string, page int, chunk_index int, text string")
    hits = spark.createDataFrame([(1, 1, "p1")], "query_id int, rank int, chunk_id string")
    used = lambda most: (lambda r: (r.parts_used, r.partial, len(r.text)))(clauses.assemble(hits, chunks, most).first())
    assert used(174) == (4, False, 174)
    assert used(100) == (2, True, 102)  # the part before fits the 40 that are left
    assert used(140) == (3, True, 142)  # 40 go in front, the 38 left take the part behind
    assert used(61) == (1, True, 60)


def test_resampling_holds_a_block_of_draws():
    """10 million draws: their places and values together would be 120 MB."""
    import tracemalloc

    d = np.arange(5_000.0)
    tracemalloc.start()
    means, centred = metrics._resampled(2_000, 42, d, d - d.mean())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    places = np.concatenate(list(metrics.draw_blocks(5_000, 60, 42, 13_000)))
    assert np.array_equal(places, metrics.draws(5_000, 60, 42))
    assert np.array_equal(means[:60], d[places].mean(axis=1)) and np.array_equal(centred[:60], (d - d.mean())[places].mean(axis=1))
