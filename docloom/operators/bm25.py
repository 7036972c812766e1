"""BM25 index tables and batch search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.plans.tables import broadcast_if_small, column_type, map_arrow, materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries scored together, results that a task keeps for them, and distinct query terms that are broadcast to the postings; more terms meet them by a shuffle.
QUERY_BLOCK, KEPT_ROWS, BROADCAST_ROWS = 60_000, 2_000_000, 500_000
#: (record, query) pairs that are scored at once.
CELLS = 2_000_000
#: Terms that are columns of the matrix of weights, at most, and the share of all (record, query) pairs from which a term is one: meeting
#: a pair by index costs some hundred times what a term adds to a cell of the product.
WIDE_TERMS, WIDE_SHARE = 256, 1 / 500


@dataclass
class Bm25Index:
    """postings(term, id, tf, dl), terms(term, df, cf, idf) and stats(n_docs, avgdl, avg_idf)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def distinct_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text), identical repeats once. Distributed by id, which later groupings by id keep; equality is checked by hashing, so texts are never sorted."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("id").distinct()


def postings(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl), with a row of the empty term for every document, which keeps documents without words in the counts.

    Documents are distributed by id once; counting by (id, term) keeps that distribution, so no token is shuffled again.
    """
    words = distinct_documents(docs, id_col, text_col).select("id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    exploded = words.select("id", F.size("words").alias("dl"), F.explode(F.array_append("words", F.lit(""))).alias("term"))
    return exploded.groupBy("id", "term", "dl").agg(F.count("*").cast("int").alias("tf")).select("term", "id", "tf", "dl")


def build(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> Bm25Index:
    """Index of all documents; those without any word count in n_docs and avgdl. Negative idf becomes EPSILON times the mean idf of all terms. The postings are written once, as every statistic and search reads them."""
    return from_postings(materialize(postings(docs, id_col, text_col), "postings"))


def from_postings(rows: DataFrame) -> Bm25Index:
    """Global statistics of postings, wherever they come from; an incremental change of postings gives what a rebuild gives."""
    lengths = rows.where("term = ''").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    posts = rows.where("term <> ''")
    counts = posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    raw = counts.crossJoin(F.broadcast(lengths)).withColumn("raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw = materialize(raw, "terms")
    stats = materialize(lengths.crossJoin(raw.agg(F.avg("raw_idf").alias("avg_idf"))), "stats")
    terms = raw.crossJoin(F.broadcast(stats.select("avg_idf"))).select("term", "df", "cf", F.when(F.col("raw_idf") < 0, EPSILON * F.col("avg_idf")).otherwise(F.col("raw_idf")).alias("idf"))
    return Bm25Index(posts, terms, stats)


def save(index: Bm25Index, path: str) -> None:
    """Write the three tables of an index under ``path``."""
    for name in ("postings", "terms", "stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Bm25Index:
    """An index written by :func:`save`; searching it reads the postings of the asked terms' files only, and nothing is tokenised again."""
    return Bm25Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats")))


def search(index: Bm25Index, queries: DataFrame, k: int = 20, query_id: str = "query_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` best documents of every query.

    A repeated query word counts as often as it occurs. Scores are rounded to ``digits`` before ranking, ties go to the larger id,
    documents of score zero are dropped. Negative scores stay and rank last.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("times"))
    wanted = asked.join(index.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    avgdl = index.stats.first()["avgdl"] or 1.0

    def saturate(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

    return ranked(index.postings, wanted, saturate, k, digits)


def ranked(posts: DataFrame, wanted: DataFrame, saturate, k: int, digits: int = 6, larger_id_first: bool = True, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` documents of greatest sum of weight times saturate(tf, dl) over a query's terms, for (query_id, term, weight) and postings.

    The postings of the asked terms are gathered by document once. The stated queries come in blocks of at most ``block``, and of at most
    KEPT_ROWS results, and are broadcast; each task keeps the best ``k`` of every query over all its documents. So (query, document) pairs are never rows: what
    is shuffled is the postings of the queried terms and at most tasks x queries x k results, however many batches a task has.
    """
    wanted = materialize(wanted, "wanted")
    n = wanted.select("query_id").distinct().count()
    parts = max(1, -(-n // max(1, min(block, KEPT_ROWS // k))))
    known = materialize(wanted.select("term").distinct().withColumn("no", F.monotonically_increasing_id()), "vocabulary")
    small = broadcast_if_small(known, known.count(), BROADCAST_ROWS)
    docs = posts.join(small, "term").groupBy("id").agg(F.first("dl").alias("dl"), F.collect_list(F.struct("no", "tf")).alias("terms"))
    docs = docs if parts == 1 else materialize(docs, "gathered")
    numbered = wanted.join(small, "term").select("query_id", "no", "weight")
    order = F.desc("id") if larger_id_first else F.asc("id")
    out = None
    for p in range(parts):
        some = numbered if parts == 1 else numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)
        found = _ranked_block(docs.sortWithinPartitions(order), some, saturate, k, digits)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), order))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


class TopK:
    """The best ``k`` (score, id) of each of ``n`` queries over the batches of a task, whose records come with the ids that win ties first."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.new = n, k, 0
        self.query, self.score, self.ids = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, object)]
        self.floor = np.full(n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take candidates in; those that don't exceed a query's k-th best score at the last cut are left out at once."""
        good = score > self.floor[query]
        for old, more in ((self.query, query), (self.score, score), (self.ids, ids)):
            old.append(more[good])
        self.new += len(self.query[-1])

    def cut(self) -> None:
        query, score, ids = (np.concatenate(x) for x in (self.query, self.score, self.ids))
        order = np.lexsort((-score, query))  # stable: of equal scores the earlier record is first
        query = query[order]
        place = np.arange(len(order)) - np.searchsorted(query, query)
        kept = order[place < self.k]
        last = place == self.k - 1
        self.floor[query[last]] = score[order[last]]
        self.query, self.score, self.ids, self.new = [query[place < self.k]], [score[kept]], [ids[kept]], 0


class QueryBlock:
    """A block's queries as two kinds of terms: ``wide`` ones as columns of a matrix of weights, the others by index.

    A term is wide if it makes so many (record, query) pairs that multiplying all records with all queries is cheaper than meeting
    the pairs one by one; ``share`` is the share of the records with each term, as seen in a task's batches. Queries with equal
    weights of the wide terms are a group and share a column of the product. Neither changes a result.
    """

    def __init__(self, n: int, begin: np.ndarray, asks: np.ndarray, weights: np.ndarray, share: np.ndarray):
        self.n, self.begin, self.asks, self.weights, self.share = n, begin, asks, weights, share
        reach = np.diff(begin)
        load = share * reach / n
        wide = np.argsort(-load, kind="stable")[:WIDE_TERMS]
        wide = wide[load[wide] > WIDE_SHARE]
        self.column = np.full(len(reach), -1)
        self.column[wide] = np.arange(len(wide))
        term = np.repeat(np.arange(len(reach)), reach)
        held = self.column[term] >= 0
        matrix = np.zeros((n, len(wide)))
        np.add.at(matrix, (asks[held], self.column[term[held]]), weights[held])
        mark = np.einsum("ij,j->i", matrix, np.random.default_rng(0).random(len(wide)))
        _, first, group = np.unique(mark, return_index=True, return_inverse=True)
        if any(not np.array_equal(matrix[first[group[i : i + 4096]]], matrix[i : i + 4096]) for i in range(0, n, 4096)):  # two kinds of queries with one mark
            first = group = np.arange(n)
        self.group, self.matrix = group, matrix[first]
        self.flat = np.ascontiguousarray(self.matrix.T, np.float32)
        self.members = np.argsort(group, kind="stable")
        self.size = np.bincount(group, minlength=len(first))
        self.start = np.cumsum(self.size) - self.size
        # what a sum in single precision may be off by, for values of at most one, with room to spare
        self.off = (np.bincount(asks[held], minlength=n) + 8) * 2.0**-23 * np.bincount(asks[held], np.abs(weights[held]), n)
        self.positive = not len(weights) or weights.min() >= 0

    def fits(self, share: np.ndarray) -> bool:
        """Whether no term that isn't wide is far more frequent than its records so far let expect."""
        load = (share * np.diff(self.begin) / self.n)[self.column < 0]
        return not len(load) or load.max() <= 4 * WIDE_SHARE or self.matrix.shape[1] == WIDE_TERMS

    def least(self, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score in single precision from which a query, and a group, can have a candidate whose score is ``bound`` or more."""
        low = (bound - np.abs(np.where(np.isfinite(bound), bound, 0.0)) * 2.0**-22).astype(np.float32)
        return low, np.minimum.reduceat(low[self.members], self.start)

    def pairs(self, doc: np.ndarray, no: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (record times queries plus query) and sums of the terms that aren't wide."""
        many = self.begin[no + 1] - self.begin[no]
        source = np.repeat(np.arange(len(no)), many)
        pair = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + self.begin[no[source]]
        key, back = np.unique(doc[source] * self.n + self.asks[pair], return_inverse=True)
        return key, np.bincount(back, self.weights[pair] * value[source], len(key))

    def candidates(self, rough: np.ndarray, low: np.ndarray, group_low: np.ndarray, key: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Keys whose rough score, with what the other terms add, reaches the query's bound."""
        d, g = np.divmod(np.flatnonzero(rough >= group_low), rough.shape[1])
        many = self.size[g]
        d, g = np.repeat(d, many), np.repeat(g, many)
        q = self.members[self.start[g] + np.arange(len(g)) - np.repeat(np.cumsum(many) - many, many)]
        good = rough[d, g] >= low[q]
        kd, kq = np.divmod(key, self.n)
        return np.union1d(d[good] * self.n + q[good], key[rough[kd, self.group[kq]] + more >= low[kq]])

    def exact(self, values: np.ndarray, d: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Sums of the wide terms in double precision."""
        out = np.zeros(len(d))
        for i in range(0, len(d), 2048):
            some = slice(i, i + 2048)
            out[some] = np.einsum("ij,ij->i", values[d[some]], self.matrix[self.group[q[some]]])
        return out


def _ranked_block(docs: DataFrame, wanted: DataFrame, saturate, k: int, digits: int) -> DataFrame:
    """(query_id, id, score): the best ``k`` of each query in each task. Only records that can still be among them are scored exactly."""
    own: dict[object, int] = {}
    rows = wanted.select("query_id", "no", F.col("weight").cast("double").alias("weight")).toArrow()
    nos, place = np.unique(rows["no"].to_numpy(), return_inverse=True)
    by_term = np.argsort(place, kind="stable")
    asks, weights = np.array([own.setdefault(q, len(own)) for q in rows["query_id"].to_pylist()], np.int64)[by_term], rows["weight"].to_numpy()[by_term]
    begin = np.searchsorted(place[by_term], np.arange(len(nos) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((list(own), nos, begin, asks, weights))
    kind, step = column_type(docs, "id"), 10.0**-digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        names, nos, begin, asks, weights = shared.value
        n = len(names)
        if not n:
            return
        top, queries = TopK(n, k), None
        seen = cut_at = 0
        most, positive = 0.0, True
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            no, tf = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("no", "tf"))
            value = saturate(tf.astype(np.float64), np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), sizes))
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(nos, no), len(nos) - 1)
            asked = nos[at] == no  # other blocks' terms are in the lists, too
            no, value, doc = at[asked], value[asked], doc[asked]
            if not len(no):
                continue
            ids = np.array([*batch.column(0).to_pylist(), None], dtype=object)[:-1]
            share = np.bincount(no, minlength=len(nos)) / batch.num_rows
            if queries is None or not queries.fits(share):
                queries = QueryBlock(n, begin, asks, weights, share if queries is None else np.maximum(share, queries.share))
            most, positive = max(most, float(np.abs(value).max())), positive and queries.positive and float(value.min()) >= 0
            bound = lambda b: np.maximum(b, 1e-30) if positive else b  # noqa: E731  without negative parts, a score of zero is a record without the terms
            low, group_low = queries.least(bound(top.floor + step / 2 - queries.off * most))
            column, n_wide = queries.column[no], queries.matrix.shape[1]
            rare = np.where(column < 0, begin[no + 1] - begin[no], 0)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            work = np.r_[0, np.cumsum(rare)][first]
            height = min(4096, max(1, CELLS // len(queries.size)))
            here = 0
            while here < batch.num_rows:  # records are scored in slices of bounded work
                end = min(batch.num_rows, here + height, max(here + 1, int(np.searchsorted(work, work[here] + CELLS, "right")) - 1))
                some = slice(first[here], first[end])
                d, c, v = doc[some] - here, column[some], value[some]
                wide = c >= 0
                values = np.bincount(d[wide] * n_wide + c[wide], v[wide], (end - here) * n_wide).reshape(end - here, n_wide)
                rough = values.astype(np.float32) @ queries.flat
                if not cut_at and positive and end - here >= k:  # as many records as are kept give a first bound
                    kth = np.partition(rough, end - here - k, axis=0)[end - here - k][queries.group] - 2 * queries.off * most - step
                    low, group_low = queries.least(bound(np.where(kth > step, kth, -np.inf)))
                key, more = queries.pairs(d[~wide], no[some][~wide], v[~wide])
                found = queries.candidates(rough, low, group_low, key, more)
                fd, fq = np.divmod(found, n)
                score = queries.exact(values, fd, fq)
                if len(key):
                    near = np.minimum(np.searchsorted(key, found), len(key) - 1)
                    score += np.where(key[near] == found, more[near], 0.0)
                score = np.round(score, digits)
                good = score != 0
                top.add(fq[good], score[good], ids[here + fd[good]])
                seen += end - here
                if seen >= 2 * cut_at or top.new > n * k:
                    top.cut()
                    cut_at = seen
                    low, group_low = queries.least(bound(top.floor + step / 2 - queries.off * most))
                here = end
        top.cut()
        if len(top.query[0]):
            yield [[names[q] for q in top.query[0]], top.ids[0].tolist(), top.score[0]]

    return map_arrow(docs, run, f"query_id {column_type(wanted, 'query_id')}, id {kind}, score double")
