import random

import pytest

from docloom.operators import ranking


def run_df(spark, rows):
    return spark.createDataFrame(rows, "query_id int, rank int, id string, score double, source string, article string, text string, page int")


def fold_diversify(rows, k, cap):
    taken, skipped, per = [], [], {}
    for r in rows:
        if per.get(r[1], 0) < cap and len(taken) < k:
            per[r[1]] = per.get(r[1], 0) + 1
            taken.append(r[0])
        else:
            skipped.append(r[0])
    return taken + skipped[: k - len(taken)]


def test_diversify_equals_two_passes_and_keeps_its_invariants(spark):
    rng = random.Random(4)
    rows, cases = [], {}
    for q in range(40):
        own = [(f"d{i}", f"s{rng.randrange(5)}") for i in range(rng.randrange(1, 25))]
        cases[q] = own
        rows += [(q, i + 1, d, 1.0, s, "", "", 1) for i, (d, s) in enumerate(own)]
    got = ranking.diversify(run_df(spark, rows), 6, 2).collect()
    for q, own in cases.items():
        mine = [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert mine == fold_diversify(own, 6, 2)
        assert len(mine) == min(6, len(own)) == len(set(mine))


def test_dedup_doesnt_register_the_id_of_a_row_dropped_for_its_prefix(spark):
    rows = [(1, 1, "a", 1.0, "s", "", "same", 1), (1, 2, "b", 1.0, "s", "", "same", 1), (1, 3, "b", 1.0, "s", "", "other", 1), (1, 4, "a", 1.0, "s", "", "new", 1)]
    got = ranking.dedup(run_df(spark, rows)).orderBy("rank").collect()
    assert [(r.id, r.text, r.rank) for r in got] == [("a", "same", 1), ("b", "other", 2)]


def test_fuse_sums_and_keeps_the_order_of_first_appearance(spark):
    runs = spark.createDataFrame([(1, 1, 1, "x"), (1, 1, 2, "y"), (1, 2, 1, "y"), (1, 2, 2, "x"), (1, 2, 3, "z")], "query_id int, list_no int, rank int, id string")
    got = ranking.fuse(runs).orderBy("rank").collect()
    assert [r.id for r in got] == ["x", "y", "z"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)


def test_payload_of_the_last_list_wins(spark):
    runs = spark.createDataFrame([(1, 1, 1, "x", "old"), (1, 2, 5, "x", "new")], "query_id int, list_no int, rank int, id string, note string")
    assert ranking.fuse_with_payload(runs, ["note"]).first().note == "new"


def test_tiers(spark):
    rows = [(1, 1, "a", 0.9, "s", "5", "", 1), (1, 2, "b", 0.2, "s", "5", "", 1), (2, 1, "a", 0.9, "s", "5", "", 1), (2, 2, "b", 0.8, "s", "5", "", 1), (3, 1, "a", 0.9, "s", "5", "", 1), (3, 2, "b", 0.8, "t", "5", "", 1), (4, 1, "a", 0.01, "s", "5", "", 1)]
    got = {r.query_id: r.tier for r in ranking.classify_tiers(run_df(spark, rows)).collect()}
    assert got == {1: "tier1", 2: "tier2", 3: "tier3", 4: "tier4"}


def test_footnotes_skip_unknown_sources(spark):
    rows = [(1, 1, "a", 1.0, "unknown", "", "", 9), (1, 2, "b", 1.0, "t", "", "", 3), (1, 3, "c", 1.0, "s", "", "", 4), (1, 4, "d", 1.0, "t", "", "", 7)]
    got = {r.source: (r.footnote, r.page) for r in ranking.footnotes(run_df(spark, rows)).collect()}
    assert got == {"t": (1, 3), "s": (2, 4)}
