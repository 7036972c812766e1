"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.tables import broadcast_if_small, bucketed, column_type, map_arrow, materialize, read

__all__ = ["CACHE_WORDS", "WordCache", "broadcast_if_small", "bucketed", "column_type", "fold_tokens", "fold_word", "hash_sample", "map_arrow", "matching", "materialize", "table", "word_hash"]

#: Upper bound of one worker's word cache; a full cache is emptied, never consulted less.
CACHE_WORDS = 400_000

_STRIP = re.compile(r"[^\W_]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name)


def fold_word(raw: str) -> str:
    """Lower case without accents; đ becomes d."""
    plain = unicodedata.normalize("NFD", raw.lower()).replace("đ", "d")
    return "".join(ch for ch in plain if not unicodedata.combining(ch))


def fold_tokens(raw: str) -> list[str]:
    """Words of ``raw`` without case, accents and punctuation."""
    return _STRIP.findall(fold_word(raw))


def matching(column: pa.Array, pattern: str) -> pa.Array:
    """Places of the values that have a match of an RE2 pattern; the column stays in Arrow's memory."""
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, pattern), False)).cast(pa.int64())


class WordCache(dict):
    """Raw whitespace-separated word -> value of ``make``; bounded by CACHE_WORDS."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, raw):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self.make(raw)
        if len(raw) <= 64:
            self[raw] = value
        return value


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def hash_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The rows of the ``rows`` smallest id hashes (a few more where ids repeat): the same sample on every run, for fitting models only."""
    h = F.xxhash64(F.col(id_col).cast("string"))
    bound = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(bound)) if bound is not None else df.limit(0)
