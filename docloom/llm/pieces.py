"""Problem 4: splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_type, map_arrow, table

#: Unicode code points of a piece and of the overlap of two, at most.
MAX_CHARS, OVERLAP = 512, 64
#: Price of a cut behind each kind of boundary, the best first; a cut inside a word costs INSIDE.
BOUNDARIES = ((re.compile(r"\n\s*\n\s*"), 0.0), (re.compile(r"\n"), 1.0), (re.compile(r"[.!?…][\"”’)»]*\s+"), 2.0), (re.compile(r"[;:]\s+"), 4.0), (re.compile(r",\s+"), 6.0), (re.compile(r"\s+"), 9.0))
INSIDE = 40.0
#: Price of a cut between a letter and its combining marks, where a run of marks leaves no other place.
IN_MARKS = 400.0
#: Distance of the places offered for cuts inside words where a text has no boundary.
HARD_STEP = 32
#: Weight of the squared relative deviation of a piece from the even size.
BALANCE = 6.0


def cut_places(text: str, max_chars: int, overlap: int) -> tuple[list[int], list[float]]:
    """All places a piece may end at, with their prices. Stretches without a boundary get places inside words, and before a combining mark only where marks alone follow for a step."""
    price: dict[int, float] = {}
    for pattern, cost in BOUNDARIES:
        for m in pattern.finditer(text):
            price.setdefault(m.end(), cost)
    n = len(text)
    price.pop(0, None)
    price[n] = 0.0
    reach = max(1, max_chars - overlap)
    places, last = [], 0
    for p in sorted(price):
        if p - last > min(HARD_STEP * 2, reach):
            step = max(1, min(HARD_STEP, reach // 2))
            for at in range(last + step, p, step):
                q = at
                while q < min(p, at + step) and unicodedata.combining(text[q]):
                    q += 1
                if q < p and q not in price:
                    places.append((q, IN_MARKS if unicodedata.combining(text[q]) else INSIDE))
        places.append((p, price[p]))
        last = p
    places = sorted(dict(places).items())
    return [p for p, _ in places], [c for _, c in places]


def split_text(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``, in order; each at most ``max_chars`` long, neighbours sharing at most ``overlap``.

    Dynamic programming over the cut places: least sum of cut prices and squared deviations from the even size, among all ways to
    cut. A piece begins at the best boundary not more than ``overlap`` before the end of the one before it, of equal ones at the
    earliest; where there is none it begins at that end. A text within the limit is one piece, an empty one none.
    """
    n = len(text)
    if n <= max_chars:
        return [(0, n)] if n else []
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the piece")
    ends, prices = cut_places(text, max_chars, overlap)
    soft = [p for p, c in zip(ends, prices) if c < INSIDE]
    cost_of = dict(zip(ends, prices))
    starts = [0]
    for p in ends[:-1]:
        starts.append(min(soft[bisect_left(soft, max(1, p - overlap)) : bisect_left(soft, p)], key=cost_of.__getitem__, default=p))
    first = np.array(starts)  # first[i]: where a piece begins that follows cut i (cut 0: the start of the text)
    even = n / -(-n // max_chars)
    best = np.full(len(ends) + 1, np.inf)
    best[0] = 0.0
    back = [0] * (len(ends) + 1)
    low = 0
    for j, (p, cost) in enumerate(zip(ends, prices), 1):
        while p - starts[low] > max_chars:
            low += 1
        size = p - first[low:j]
        total = best[low:j] + BALANCE * (size / even - 1.0) ** 2
        k = int(total.argmin())
        best[j] = total[k] + cost
        back[j] = low + k
    out, j = [], len(ends)
    while j:
        i = back[j]
        out.append((starts[i], ends[j - 1]))
        j = i
    return out[::-1]


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = ("article", "khoan", "chunk_index"), max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(id, *keep, piece_no, n_pieces, start, end, text) of every row, pieces counted from 1 in text order.

    Texts within the limit become one piece in the JVM; only longer ones go through Python. No shuffle. ``text`` is the stored text
    from ``start`` to ``end``, so the pieces without their overlaps give it back exactly. Null and empty texts become one piece
    that is the value itself with length 0. Equal rows give equal pieces.
    """
    size = F.length(F.col(text_col))
    kept = [F.col(c).alias(c) for c in keep]
    columns = ", ".join(f"`{c}` {column_type(df, c)}" for c in (id_col, *keep))
    schema = f"{columns}, piece_no int, n_pieces int, start int, `end` int, `{text_col}` string"
    short = df.where(F.coalesce(size, F.lit(0)) <= max_chars).select(id_col, *kept, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.coalesce(size, F.lit(0)).alias("end"), F.col(text_col))
    width = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            rows = [(i, no, len(cuts), a, b, text[a:b]) for i, text in enumerate(batch.column(width).to_pylist()) for cuts in (split_text(text, max_chars, overlap),) for no, (a, b) in enumerate(cuts, 1)]
            if rows:
                at, *cols = zip(*rows)
                at = pa.array(at, pa.int64())
                yield [*(batch.column(k).take(at) for k in range(width)), *cols]

    long = map_arrow(df.where(size > max_chars).select(id_col, *kept, text_col), run, schema)
    return short.unionByName(long)


def oversized_chunks(spark, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks")).where("n_pieces > 1").select("chunk_id").distinct()


def chunk_pieces(spark, sf_dir: str) -> DataFrame:
    """The pieces of the oversized chunks."""
    return split_oversized(table(spark, sf_dir, "chunks")).where("n_pieces > 1").drop("text").distinct()


def rebuilt_chunks(spark, sf_dir: str) -> DataFrame:
    """Round trip of the oversized chunks: the digest of the text their pieces without the overlaps make, and whether all pieces and overlaps keep the limits."""
    p = split_oversized(table(spark, sf_dir, "chunks")).where("n_pieces > 1").distinct()
    w = Window.partitionBy("chunk_id").orderBy("piece_no")
    p = p.withColumn("shared", F.coalesce(F.lag("end").over(w) - F.col("start"), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(text, shared + 1)").alias("t"))))
    good = (F.length("text") <= MAX_CHARS) & F.col("shared").between(0, OVERLAP) & (F.length("text") == F.col("end") - F.col("start"))
    return p.groupBy("chunk_id").agg(F.md5(F.array_join(F.transform(parts, lambda x: x["t"]), "")).alias("digest"), F.bool_and(good).alias("within"))
