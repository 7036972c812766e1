"""Problem 8: filling fixed-capacity containers with documents."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, column_type, map_arrow, materialize, table

CAPACITY = 2048
#: Items packed together in one task, about; partitions beyond it only add tasks.
PART_ITEMS = 20_000
#: Times partitions with a gap exchange what lies in their open containers.
ROUNDS = 2
#: Vocabulary file of a public byte-level BPE tokenizer, and how it cuts text before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def merge_ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """The tokenizer's merges, read once on the driver; of fixed size, so they go to the tasks in a broadcast and no executor needs the file."""
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(ranks: dict[bytes, int] | None = None, pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks or merge_ranks(), special_tokens={})


class TokenCounter:
    """Token counts of whole texts, exactly those of the tokenizer.

    The tokenizer never merges across a single space between two other characters, so the counts of the words with their leading
    spaces add up; they are looked up by word. Texts with other blanks are cut only at such spaces.
    """

    def __init__(self, ranks: dict[bytes, int] | None = None, pattern: str = PATTERN):
        self.encode = encoder(ranks, pattern).encode_ordinary
        self.words = WordCache(lambda raw: len(self.encode(raw)))

    def count(self, text: str) -> int:
        if "  " in text or " \n" in text or "\n " in text or " \t" in text or text[:1] == " " or text[-1:] == " ":
            return len(self.encode(text))
        first, *rest = text.split(" ")
        look = self.words
        return look[first] + sum([look[" " + w] for w in rest])


def token_items(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece_no, first_token, n_tokens): one item per text, or, of texts longer than ``capacity``, pieces of full capacity and a rest.

    Null and empty texts have no tokens and no item. Repeated rows count once.
    """

    shared = documents.sparkSession.sparkContext.broadcast(merge_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        counter = TokenCounter(shared.value)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                n = counter.count(text) if text else 0
                rows += [(i, k // capacity + 1, k, min(capacity, n - k)) for k in range(0, n, capacity)]
            if rows:
                at, *cols = zip(*rows)
                yield [batch.column(0).take(pa.array(at, pa.int64())), *cols]

    items = map_arrow(documents.select(id_col, text_col), run, f"`{id_col}` {column_type(documents, id_col)}, piece_no int, first_token int, n_tokens int")
    return items.distinct()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container of each item and their number. The containers' free space is a bit mask, so each item finds the tightest fit at once."""
    order = np.argsort(-sizes, kind="stable")
    where = np.zeros(len(sizes), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for i in order.tolist():
        size = int(sizes[i])
        fit = mask >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask ^= 1 << space
        else:
            space, b = capacity, n
            n += 1
        where[i] = b
        left = space - size
        if left:
            by_space[left].append(b)
            mask |= 1 << left
    return where, n


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers no packing can do without: the largest bound of a family of dual-feasible functions.

    f_t keeps items up to capacity - t, drops those below t and counts those above as full (t up to half the capacity); u_k rounds
    (k + 1) x / capacity down unless it is whole. Integer arithmetic throughout.
    """
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    total = counts * x
    upto, number = np.cumsum(total), np.cumsum(counts)
    t = np.arange(0, capacity // 2 + 1)
    large = number[capacity] - number[capacity - t]
    middle = upto[capacity - t] - np.where(t > 0, upto[np.maximum(t - 1, 0)], 0)
    best = int((-(-(large * capacity + middle) // capacity)).max())
    for k in range(1, 41):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)  # times k
        best = max(best, int(-(-(counts * value).sum() // (capacity * k))))
    return best


def _pack(items: DataFrame, id_col: str, capacity: int, round_no: int) -> DataFrame:
    """Best-fit decreasing in each part; adds container, the part's number of containers and its lower bound."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([id_col, "piece_no"], kind="stable", ignore_index=True)
        sizes = frame["n_tokens"].to_numpy(np.int64)
        where, n = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(where, weights=sizes, minlength=n).astype(np.int32)
        return frame.assign(container=[f"{round_no}-{p}-{b}" for p, b in zip(frame["part"], where)], fill=fill[where], n_containers=n, bound=lower_bound(sizes, capacity))

    schema = f"`{id_col}` {column_type(items, id_col)}, piece_no int, first_token int, n_tokens int, part bigint, container string, fill int, n_containers int, bound int"
    return items.groupBy("part").applyInPandas(run, schema)


def pack_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, part_items: int = PART_ITEMS, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, id, piece_no, first_token, n_tokens, part, part_containers, part_bound): every token of every document in exactly one container of ``capacity`` tokens.

    The last three are the certificate: the part a container was packed in, how many containers that part took, and how many no
    packing of the part's items can do without. A container that a single piece fills is a part of its own.

    Method: bound-certified repacking. Items are dealt by hash into parts of about ``part_items`` and packed best-fit decreasing;
    dual-feasible-function lower bounds certify the number of containers of a part. Parts that reach their bound are final. The others
    keep their full containers and give what lies in the open ones to an exchange, which deals it anew and packs again, up to ``rounds``
    times; the new packing is taken where it needs fewer containers. Only texts longer than ``capacity`` are split, into full
    containers and one rest. A part's size does not grow with the data, so no task does.

    Null and empty texts take no place; an empty table gives no rows; ids that repeat with other texts are told apart by nothing, so
    ids should be unique.
    """
    items = materialize(token_items(documents, id_col, text_col, capacity, vocabulary), "items")
    key = [id_col, "piece_no"]
    full = items.where(F.col("n_tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), F.col(id_col).cast("string"), "piece_no"))
    columns = ["container", id_col, "piece_no", "first_token", "n_tokens", "part", "part_containers", "part_bound"]
    done = [full.withColumn("part", F.lit("full")).withColumn("part_containers", F.lit(1)).withColumn("part_bound", F.lit(1)).select(columns)]
    loose = items.where(F.col("n_tokens") < capacity)
    for r in range(rounds + 1):
        n = loose.count()
        if not n:
            break
        parts = max(1, round(n / part_items))
        dealt = loose.select(id_col, "piece_no", "first_token", "n_tokens", F.pmod(F.xxhash64(F.lit(r), *key), F.lit(parts)).alias("part"))
        packed = materialize(_pack(dealt, id_col, capacity, r), "packed").withColumn("part", F.concat_ws("-", F.lit(r), F.col("part"))).withColumnsRenamed({"n_containers": "part_containers", "bound": "part_bound"})
        if r:
            was = previous.select("container").distinct().count()
            if packed.select("container").distinct().count() >= was:
                packed = previous
                done.append(packed.select(columns))
                break
        if r == rounds:
            done.append(packed.select(columns))
            break
        settled = (F.col("part_containers") <= F.col("part_bound")) | (F.col("fill") == capacity)
        done.append(packed.where(settled).select(columns))
        loose = previous = packed.where(~settled)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def packing_report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the lower bound of all tokens together, the share of space used, and the fullest container."""
    c = containers.groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return c.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.ceil(F.sum("t") / capacity).alias("least_containers"), F.round(F.sum("t") / (F.count("*") * capacity), 6).alias("used"), F.max("t").alias("fullest"))


def whole_documents(containers: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(id, whole): of every packed document whether its pieces follow each other from the first token on, none but the last short of the capacity, and whether all their containers keep it."""
    filled = containers.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    rows = containers.join(filled, "container")
    w = Window.partitionBy(id_col).orderBy("piece_no")
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("last", F.lead("piece_no").over(w).isNull())
    good = (F.col("before") == F.col("first_token")) & (F.col("last") | (F.col("n_tokens") == capacity)) & (F.col("fill") <= capacity)
    return rows.groupBy(id_col).agg(F.bool_and(good).alias("whole"))


def document_containers(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def packed_documents(spark, sf_dir: str) -> DataFrame:
    return whole_documents(document_containers(spark, sf_dir))


def packing_totals(spark, sf_dir: str) -> DataFrame:
    return packing_report(document_containers(spark, sf_dir))
