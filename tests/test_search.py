import math
import re
from collections import Counter

import numpy as np
import pytest

from docloom.operators import bm25, dense, metrics

DOCS = [("a", "Điều một quy định học phí"), ("b", "học phí học kỳ phụ"), ("c", ""), ("d", "thư viện mở cửa"), ("b", "học phí học kỳ phụ"), ("e", None)]


def brute(query, docs, k1=1.5, b=0.75):
    toks = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    out = {}
    for i, t in toks.items():
        c = Counter(t)
        s = sum(idf[w] * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * len(t) / avg)) for w in re.findall(r"\w+", query.lower()) if c[w])
        if round(s, 6):
            out[i] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], [-ord(c) for c in x[0]]))


@pytest.mark.parametrize("query", ["học phí", "học học thư viện", "không có"])
def test_bm25_equals_the_formula(spark, query):
    docs = spark.createDataFrame(DOCS, "chunk_id string, text string")
    got = bm25.search(bm25.build(docs), spark.createDataFrame([(1, query)], "query_id int, text string"), 10).orderBy("rank").collect()
    want = brute(query, dict(DOCS).items())
    assert [(r.id, r.score) for r in got] == [(i, pytest.approx(s, abs=2e-6)) for i, s in want]


def test_incremental_statistics_equal_a_rebuild(spark):
    docs = spark.createDataFrame(DOCS, "chunk_id string, text string")
    one, two = docs.where("chunk_id <> 'a'"), docs.where("chunk_id = 'a'")
    parts = bm25.postings(one).unionByName(bm25.postings(two))
    a, b = (sorted(map(tuple, x.terms.collect())) for x in (bm25.from_postings(parts), bm25.build(docs)))
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert [r[3] for r in a] == pytest.approx([r[3] for r in b])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 16))
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<float>"), v / np.linalg.norm(v, axis=1, keepdims=True)


def test_dense_topk_equals_brute_force(vectors):
    df, v = vectors
    got = dense.dense_topk(df, df.where("vec_id % 20 = 0"), 5).collect()
    for q in range(0, 300, 20):
        s = np.round(v @ v[q], 5)
        s[q] = -9
        mine = [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert mine == sorted(range(300), key=lambda i: (-s[i], i))[:5]


def test_quantised_and_inverted_file_recall(vectors):
    df, _ = vectors
    q = df.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.id) for r in dense.dense_topk(df, q, 10).collect()}
    for found in (dense.rescored_topk(df, q, dense.int8(dense.int8_scale(df)), 10), dense.rescored_topk(df, q, dense.signs, 10, dense.tuned_oversampling(df, dense.signs)), dense.ivf_topk(df, q, 10, cells=8)):
        assert len(exact & {(r.query_id, r.id) for r in found.collect()}) / len(exact) >= 0.9


def test_binary_recall_beyond_five_thousand_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20_000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id bigint, embedding array<float>").repartition(4).cache()
    q = df.where("vec_id % 400 = 0")
    exact = {(r.query_id, r.id) for r in dense.dense_topk(df, q, 10).collect()}
    found = dense.rescored_topk(df, q, dense.signs, 10, dense.tuned_oversampling(df, dense.signs))
    assert len(exact & {(r.query_id, r.id) for r in found.collect()}) / len(exact) >= 0.92


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "b"), (2, 1, "y")], "query_id int, rank int, id string")
    rel = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "z")], "query_id int, id string")
    got = {r.query_id: r for r in metrics.per_query_metrics(run, rel, 5).collect()}
    assert (got[1].precision, got[1].hit, got[1].mrr) == (0.4, 1.0, 0.5)
    assert got[1].recall == pytest.approx(2 / 3)
    assert got[1].map == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert got[1].ndcg == pytest.approx((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3) + 1 / 2))
    assert (got[2].hit, got[2].ndcg) == (0.0, 0.0)


def test_paired_tests(spark):
    assert metrics.binomial_tail(0, 0) == 1.0
    assert metrics.binomial_tail(13, 1) == pytest.approx(0.00183, abs=1e-4)
    a = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 0.0)], "query_id int, hit double")
    b = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.0)], "query_id int, hit double")
    r = metrics.mcnemar(a, b).first()
    assert (r.both, r.only_a, r.only_b, r.neither, r.p_value) == (1, 1, 0, 1, 1.0)
    ci = metrics.bootstrap(a, "hit", rounds=200).first()
    assert ci.low <= ci.mean <= ci.high


def test_withdrawn_and_late_judgments(spark):
    log = spark.createDataFrame([(1, "c", 1, 2, None, 1.0), (1, "c", 1, None, True, 2.0), (1, "d", 1, 0, None, 5.0), (1, "d", 1, 2, None, 3.0)], "topic_id int, chunk_id string, pass_no int, grade int, undo boolean, ts double")
    assert [tuple(r) for r in metrics.latest_judgments(log).collect()] == [(1, "d", 1, 0)]


def test_rouge_and_fuzzy(spark):
    pairs = spark.createDataFrame([("a b c d", "a c d x"), ("", "a"), (None, None)], "reference string, answer string")
    got = metrics.rouge(pairs).collect()
    assert got[0].rouge1 == got[0].rouge_l == pytest.approx(0.75)
    assert got[1].rouge1 == 0.0
    long = spark.createDataFrame([("Sinh viên nộp đơn đúng hạn.", "Theo quy định, sinh viên nộp đơn đúng hạn. Hết.")], "reference string, answer string")
    assert metrics.fuzzy_recall(long).first().fuzzy_recall == 1.0


@pytest.mark.parametrize("k, larger_first, block, least", [(1, False, 20_000, 0.1), (3, True, 7, 0.1), (40, False, 20_000, -0.5)])
def test_ranked_equals_brute_force(spark, k, larger_first, block, least):
    """Common and rare terms, ties, repeated queries and (in the last case) weights below zero."""
    rng = np.random.default_rng(3)
    posts = sorted({(f"t{t}", f"d{d:03}") for d in range(300) for t in [*rng.choice(12, 6), *rng.integers(12, 400, 2)]})
    posts = [(t, d, int(rng.integers(1, 4)), 1 + int(d[1:]) % 3) for t, d in posts]
    weights = {f"t{t}": round(float(w), 1) for t, w in enumerate(rng.uniform(least, 2, 400))}
    asked = {q: {f"t{t}" for t in [*np.random.default_rng(q % 20).choice(12, 5), *rng.integers(12, 400, 2)]} for q in range(40)}
    got = bm25.ranked(
        spark.createDataFrame(posts, "term string, id string, tf int, dl int").repartition(3),
        spark.createDataFrame([(q, t, weights[t]) for q, ts in asked.items() for t in ts], "query_id int, term string, weight double"),
        lambda tf, dl: tf / dl, k, 3, larger_first, block,
    )
    want = set()
    for q, ts in asked.items():
        score = Counter()
        for t, d, tf, dl in posts:
            if t in ts:
                score[d] += weights[t] * tf / dl
        found = [(round(s, 3), d) for d, s in score.items() if round(s, 3)]
        found = sorted(sorted(found, key=lambda x: x[1], reverse=larger_first), key=lambda x: -x[0])[:k]
        want |= {(q, i + 1, d, s) for i, (s, d) in enumerate(found)}
    assert {tuple(r) for r in got.collect()} == want


def test_common_words_are_not_met_pair_by_pair():
    """A word of all queries and half of the records is a column; a rare word stays by index."""
    n, begin = 1_000, np.array([0, 1_000, 1_001])
    queries = bm25.QueryBlock(n, begin, np.r_[np.arange(n), 7], np.r_[np.full(n, 2.0), 9.0], np.array([0.5, 0.001]))
    assert queries.column.tolist() == [0, -1] and queries.size.tolist() == [n]
    key, more = queries.pairs(np.array([4]), np.array([1]), np.array([1.5]))
    assert (key.tolist(), more.tolist()) == ([4 * n + 7], [13.5])
    low, group_low = queries.least(np.full(n, 3.0))
    rough = np.array([[2.0]] * 4 + [[0.0]] + [[4.0]], np.float32)
    assert queries.candidates(rough, low, group_low, key, more).tolist() == [4 * n + 7, *(5 * n + i for i in range(n))]
    assert not queries.fits(np.array([0.5, 9.0])) and queries.fits(np.array([1.0, 0.002]))
