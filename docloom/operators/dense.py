"""Exact and approximate vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.tables import column_type, map_arrow

#: Query vectors that are broadcast together; more are handled in blocks.
QUERY_BLOCK = 20_000
#: Vectors scored at once, and scores (queries x vectors) held at once.
VECTORS, CELLS = 2_000, 4_000_000
#: Vectors of a cell of the inverted file, about, and the most cells; centroids are fitted on a bounded sample.
CELL_VECTORS, MAX_CELLS = 1_000, 4_096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def query_blocks(queries: DataFrame, id_col: str, vector_col: str, block: int = QUERY_BLOCK):
    """Blocks of (ids, unit vectors) on the driver, each of bounded size."""
    n = queries.count()
    parts = max(1, -(-n // block))
    for b in range(parts):
        rows = queries.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == b).select(id_col, vector_col).orderBy(id_col).collect()
        if rows:
            yield [r[0] for r in rows], _unit(np.array([r[1] for r in rows], np.float64))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = True, digits: int = 6, transform=None) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest vectors by cosine, ties by the smaller id.

    The stated queries are broadcast in blocks of bounded size and multiplied with slices of the vectors, so that at most CELLS scores
    are held; a task keeps its best ``k`` per query over all batches, so the shuffle carries tasks x queries x k rows whatever the
    number of vectors. Ids are whole numbers. ``transform`` maps a matrix of
    unit vectors to what is compared (quantised search); it is applied to both sides.
    """
    return _union([_topk_block(vectors, ids, q, k, id_col, vector_col, exclude_self, digits, transform) for ids, q in query_blocks(queries, id_col, vector_col)], vectors, id_col)


def _topk_block(vectors, ids, q, k, id_col, vector_col, exclude_self, digits, transform) -> DataFrame:
    if transform:
        q = transform(q)
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        own, m = shared.value
        best_score, best_id = np.full((len(own), k), -np.inf), np.zeros((len(own), k), np.int64)
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = _unit(_matrix(batch.column(1)))
            if transform and len(v):
                v = transform(v)
            for at in range(0, len(v), VECTORS):
                for low in range(0, len(own), max(1, CELLS // VECTORS)):
                    q = slice(low, low + max(1, CELLS // VECTORS))
                    keep_best(best_score, best_id, q, own[q], m[q], names[at : at + VECTORS], v[at : at + VECTORS], digits, exclude_self)
        row, col = np.nonzero(np.isfinite(best_score))
        if len(row):
            yield [own[row], best_id[row, col], best_score[row, col]]

    kind = column_type(vectors, id_col)
    best = map_arrow(vectors.select(id_col, vector_col), run, f"query_id {kind}, id {kind}, score double")
    return rank_top(best, k)


def keep_best(best_score: np.ndarray, best_id: np.ndarray, q: slice, own: np.ndarray, m: np.ndarray, names: np.ndarray, v: np.ndarray, digits: int, exclude_self: bool) -> None:
    """Merge the scores of some vectors into the best of each query; of equal scores the smaller ids stay."""
    k = best_score.shape[1]
    score = np.round(m @ v.T, digits) + 0.0
    if exclude_self:
        score[own[:, None] == names[None, :]] = -np.inf
    floor = best_score[q].min(1, initial=np.inf)
    rows = np.flatnonzero((score >= floor[:, None]).any(1))
    if not len(rows):
        return
    both = np.concatenate([best_score[q][rows], score[rows]], axis=1)
    ids = np.concatenate([best_id[q][rows], np.broadcast_to(names, (len(rows), len(names)))], axis=1)
    if both.shape[1] > 4 * k:
        # what is below the k-th score can't stay; ties at the border are kept for the order by id
        border = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k]
        width = int((both >= border[:, None]).sum(1).max())
        some = np.argpartition(-both, min(width, both.shape[1] - 1), axis=1)[:, :width]
        both, ids = np.take_along_axis(both, some, 1), np.take_along_axis(ids, some, 1)
    order = np.lexsort((ids, -both), axis=1)[:, :k]
    at = np.arange(q.start, q.start + len(own))[rows]
    best_score[at], best_id[at] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)


def rank_top(scored: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    order = F.asc("score") if ascending else F.desc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, F.asc("id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _union(parts: list[DataFrame], vectors: DataFrame, id_col: str) -> DataFrame:
    if not parts:
        kind = column_type(vectors, id_col)
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def signs(m: np.ndarray) -> np.ndarray:
    """Binary quantisation: cosine of sign vectors is an affine map of the Hamming distance."""
    return np.where(m > 0, 1.0, -1.0) / np.sqrt(max(1, m.shape[1]))


def int8_scale(vectors: DataFrame, vector_col: str = "embedding", quantile: float = 0.99) -> float:
    """The absolute value below which ``quantile`` of all components of the unit vectors lie, from an approximate percentile over all of them."""
    norm = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    parts = vectors.select(F.explode(F.transform(vector_col, lambda x: F.abs(x.cast("double")))).alias("x"), norm.alias("n")).select((F.col("x") / F.col("n")).alias("x"))
    return float(parts.agg(F.percentile_approx("x", quantile, 10_000)).first()[0] or 1.0)


def int8(scale: float):
    """Scalar quantisation to 127 steps each way, clipped at ``scale``."""

    def quantize(m: np.ndarray) -> np.ndarray:
        return np.rint(np.clip(m / scale, -1, 1) * 127) / 127 * scale

    return quantize


def rescored_topk(vectors: DataFrame, queries: DataFrame, transform, k: int = 10, oversampling: float = 2.0, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """Two stages: ``oversampling * k`` by the quantised score, then the ``k`` best of these by the exact cosine."""
    first = dense_topk(vectors, queries, int(k * oversampling), id_col, vector_col, True, digits, transform).select("query_id", "id")
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q"))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = F.round(dot("q", "v") / F.sqrt(dot("q", "q") * dot("v", "v")), digits)
    return rank_top(first.join(q, "query_id").join(v, "id").select("query_id", "id", cosine.alias("score")), k)


def _sample(vectors: DataFrame, id_col: str, vector_col: str, rows: int) -> np.ndarray:
    """Unit vectors of at most ``rows`` rows, those of the smallest id hashes."""
    got = vectors.select(vector_col, F.xxhash64(id_col).alias("h")).orderBy("h").limit(rows).select(vector_col).collect()
    return _unit(np.array([r[0] for r in got], np.float64)) if got else np.zeros((0, 1))


def tuned_oversampling(vectors: DataFrame, transform, k: int = 10, target: float = 0.95, queries: int = 200, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> float:
    """The oversampling at which quantised candidates hold ``target`` of the true neighbours of at most ``queries`` sampled vectors.

    The sampled vectors are those of the smallest id hashes. Their true neighbours and the places of these by the quantised score are
    taken over all of ``vectors``, in two passes that each hand on queries x k rows a task, as the depth grows with the collection.
    """
    got = vectors.select(id_col, vector_col, F.xxhash64(id_col).alias("h")).orderBy("h").limit(queries).collect()
    if not got:
        return 1.0
    ids, q = [r[0] for r in got], _unit(np.array([r[1] for r in got], np.float64))
    true: dict = {}
    for r in _topk_block(vectors, ids, q, k, id_col, vector_col, True, digits, None).select("query_id", "rank", "id").collect():
        true[r[0], r[1] - 1] = r[2]
    if not true:
        return 1.0
    rows = dict(vectors.where(F.col(id_col).isin(sorted(set(true.values())))).select(id_col, vector_col).collect())
    at = [(i, true[name, rank]) for i, name in enumerate(ids) for rank in range(k) if (name, rank) in true]
    owner, near = np.array([i for i, _ in at]), np.array([n for _, n in at])
    cheap = transform(q)
    bound = np.round(np.einsum("ij,ij->i", cheap[owner], transform(_unit(np.array([rows[n] for _, n in at], np.float64)))), digits) + 0.0
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids), cheap, owner, near, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        own, m, owner, near, bound = shared.value
        ahead = np.zeros(len(owner), np.int64)
        for batch in batches:
            v = _unit(_matrix(batch.column(1)))
            if not len(v):
                continue
            names = batch.column(0).to_numpy(zero_copy_only=False)
            score = np.round(m @ transform(v).T, digits) + 0.0
            score[own[:, None] == names[None, :]] = -np.inf
            for n, (i, name, least) in enumerate(zip(owner, near, bound)):
                ahead[n] += np.count_nonzero(score[i] > least) + np.count_nonzero(names[score[i] == least] < name)
        yield [np.arange(len(owner)), ahead]

    counted = map_arrow(vectors.select(id_col, vector_col), run, "place int, ahead bigint").groupBy("place").agg(F.sum("ahead").alias("ahead"))
    depth = [r["ahead"] + 1 for r in counted.collect()]
    return float(max(1.0, (np.ceil(np.quantile(depth, target)) + 1) / k))


def ivf_cells(vectors: DataFrame, sample: int = 20_000, seed: int = 7, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Centroids of the inverted file, fitted on a bounded sample; their number grows with the root of the table's rows where none is given."""
    data = _sample(vectors, id_col, vector_col, sample)
    if cells is None:
        rows = vectors.count()
        cells = int(min(MAX_CELLS, max(16, rows**0.5 / 2), max(1, len(data) // 8)))
    rng = np.random.default_rng(seed)
    centers = data[rng.permutation(len(data))[:cells]]
    for _ in range(12 if len(data) else 0):
        near = (data @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, data)
        full = np.bincount(near, minlength=len(centers)) > 0
        centers = np.where(full[:, None], _unit(sums), centers)
    return centers


def ivf_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, cells: int | None = None, probes: int | None = None, target: float = 0.97, sample: int = 20_000, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """Approximate search over an inverted file: every vector is indexed in its nearest cell, a query looks into ``probes`` cells.

    Without ``probes`` the fewest cells are taken that hold ``target`` of the true neighbours of up to 200 sampled vectors, measured over
    the whole table. The stated queries are broadcast in blocks; a slice of vectors is scored only against the queries that probe
    its cell, in NumPy, and a task hands on its best ``k`` per query. So neither vectors nor (query, vector) rows are shuffled, and a hot
    cell is spread like the table.
    """
    centers = ivf_cells(vectors, sample, seed, cells, id_col, vector_col)
    if not len(centers):
        return _union([], vectors, id_col)
    if probes is None:
        probes = tuned_probes(vectors, centers, k, target, id_col=id_col, vector_col=vector_col)
    probes = max(1, min(probes, len(centers)))
    return _union([_ivf_block(vectors, centers, ids, q, k, probes, id_col, vector_col, digits) for ids, q in query_blocks(queries, id_col, vector_col)], vectors, id_col)


def _ivf_block(vectors, centers, ids, q, k, probes, id_col, vector_col, digits) -> DataFrame:
    asked = np.argsort(-(q @ centers.T), axis=1, kind="stable")[:, :probes]
    by_cell: dict[int, np.ndarray] = {int(c): np.flatnonzero((asked == c).any(1)) for c in np.unique(asked)}
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), q, centers, by_cell))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        own, m, centers, by_cell = shared.value
        best_score, best_id = np.full((len(own), k), -np.inf), np.zeros((len(own), k), np.int64)
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = _unit(_matrix(batch.column(1)))
            if not len(v):
                continue
            cell = np.concatenate([(v[at : at + VECTORS] @ centers.T).argmax(1) for at in range(0, len(v), VECTORS)])
            for c in np.unique(cell):
                rows, who = np.flatnonzero(cell == c), by_cell.get(int(c))
                if who is None:
                    continue
                for at in range(0, len(rows), VECTORS):
                    some = rows[at : at + VECTORS]
                    for low in range(0, len(who), max(1, CELLS // VECTORS)):
                        part = who[low : low + max(1, CELLS // VECTORS)]
                        score, name = best_score[part], best_id[part]
                        keep_best(score, name, slice(0, len(part)), own[part], m[part], names[some], v[some], digits, True)
                        best_score[part], best_id[part] = score, name
        row, col = np.nonzero(np.isfinite(best_score))
        if len(row):
            yield [own[row], best_id[row, col], best_score[row, col]]

    kind = column_type(vectors, id_col)
    return rank_top(map_arrow(vectors.select(id_col, vector_col), run, f"query_id {kind}, id {kind}, score double"), k)


def tuned_probes(vectors: DataFrame, centers: np.ndarray, k: int, target: float, queries: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """The probes at which a ``target`` share of the true neighbours, over the whole table, of up to ``queries`` sampled vectors lie in a probed cell."""
    got = vectors.select(id_col, vector_col, F.xxhash64(id_col).alias("h")).orderBy("h").limit(queries).collect()
    if not got:
        return len(centers)
    ids, q = [r[0] for r in got], _unit(np.array([r[1] for r in got], np.float64))
    true = [(r[0], r[1]) for r in _topk_block(vectors, ids, q, k, id_col, vector_col, True, 6, None).select("query_id", "id").collect()]
    if not true:
        return len(centers)
    near = dict(vectors.where(F.col(id_col).isin(sorted({n for _, n in true}))).select(id_col, vector_col).collect())
    place = np.argsort(np.argsort(-(q @ centers.T), axis=1, kind="stable"), axis=1)
    at = {name: i for i, name in enumerate(ids)}
    home = {name: int((_unit(np.array([x], np.float64)) @ centers.T).argmax()) for name, x in near.items()}
    return int(np.quantile([place[at[a], home[b]] for a, b in true], target, method="higher")) + 1
