"""Versioned tables: a new version is written whole, then one pointer file makes it current."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of tables that several sources share, by hash of the source.
PARTS = 64


class TableStore:
    """Tables of one folder as versions ``<table>/v-<id>`` with a pointer ``<table>/CURRENT``; readers keep the version they opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def current(self, table: str) -> str | None:
        return self._content(self._path(table, "CURRENT"))

    def _content(self, path) -> str | None:
        fs = self._fs(path)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame | None:
        version = self.current(table)
        return None if version is None else self.spark.read.parquet(f"{self.root}/{table}/{version}")

    def write(self, table: str, df: DataFrame) -> str:
        """Write a version; it isn't current yet."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{table}/{version}")
        return version

    def publish(self, table: str, version: str) -> str | None:
        """Make ``version`` current; returns the version before, for a rollback. The pointer file is replaced in one rename, so readers see the old or the new version and a crash leaves one of them."""
        before = self.current(table)
        self._replace_file(self._path(table, "CURRENT"), version)
        return before

    def _replace_file(self, target, content: str) -> None:
        new = self._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
        out = self._fs(target).create(new)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(new, target, options)

    def replace(self, table: str, df: DataFrame) -> str:
        version = self.write(table, df)
        self.publish(table, version)
        return version

    def upsert(self, table: str, rows: DataFrame, key: list[str]) -> str:
        """Rows of equal key are replaced, others added."""
        old = self.read(table)
        return self.replace(table, rows if old is None else old.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def delete(self, table: str, keys: DataFrame, key: list[str]) -> str | None:
        old = self.read(table)
        return None if old is None else self.replace(table, old.join(keys.select(*key).distinct(), key, "left_anti"))

    def parts(self) -> dict[str, dict[str, str]]:
        """Of each table kept in parts the folder of each part, as the one pointer STATE names them."""
        text = self._content(self._path("STATE"))
        return json.loads(text) if text else {}

    def read_parts(self, table: str) -> DataFrame | None:
        """A table kept in parts, as it is now."""
        folders = sorted(self.parts().get(table, {}).values())
        return self.spark.read.parquet(*(f"{self.root}/{table}/{f}" for f in folders)) if folders else None

    def update_parts(self, new: dict[str, DataFrame | None], sources: DataFrame) -> dict[str, dict[str, str]]:
        """Replace the rows of ``sources`` (source, part) in several tables by ``new`` rows (None: by nothing) and make all current with one pointer; the parts of other sources aren't read."""
        before = self.parts()
        touched = [str(r[0]) for r in sources.select("part").distinct().collect()]
        after = {t: dict(before.get(t, {})) for t in {*before, *new}}
        version = uuid.uuid4().hex
        for table, rows in new.items():
            old = [f"{self.root}/{table}/{before[table][p]}" for p in touched if p in before.get(table, {})]
            kept = self.spark.read.parquet(*old).join(sources.select("source"), "source", "left_anti") if old else None
            whole = kept if rows is None else rows if kept is None else kept.unionByName(rows, allowMissingColumns=True)
            if whole is None:
                continue
            parted = whole.withColumn("__part", F.pmod(F.xxhash64("source"), F.lit(PARTS)).cast("int"))
            parted.repartition("__part", F.pmod(F.xxhash64(*whole.columns[:1]), F.lit(8))).write.partitionBy("__part").parquet(f"{self.root}/{table}/v-{version}")
            folder = self._path(table, f"v-{version}")
            there = {s.getPath().getName() for s in self._fs(folder).listStatus(folder)}
            for p in touched:
                name = f"__part={p}"
                after[table].pop(p, None)
                if name in there:
                    after[table][p] = f"v-{version}/{name}"
        self._replace_file(self._path("STATE"), json.dumps(after))
        return after

    def rollback(self, table: str, version: str | None) -> None:
        """Make an earlier version current again; None takes the table away for readers."""
        target = self._path(table, "CURRENT")
        if version is None:
            self._fs(target).delete(target, False)
        else:
            self._replace_file(target, version)

    def ensure_vectors(self, table: str, dimension: int, vector_col: str = "embedding", fresh: bool = False) -> bool:
        """Whether the table's vectors have that dimension; one that is to be made anew or has another is emptied first and gives False."""
        old = self.read(table)
        if old is None:
            return False
        if fresh or not old.where(F.size(vector_col) != dimension).isEmpty():
            self.replace(table, old.limit(0))
            return False
        return True


def export_seed(vectors: DataFrame, path: str, model: str, id_col: str = "chunk_id", vector_col: str = "embedding") -> None:
    """Write vectors with what an import must check: model, dimension, rows and a digest over all rows that doesn't depend on their order."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    _manifest(vectors, id_col, vector_col).withColumn("model", F.lit(model)).write.mode("overwrite").json(f"{path}/manifest")


def _manifest(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    row = F.xxhash64(id_col, vector_col).cast("decimal(38,0)")
    return vectors.agg(F.count("*").alias("n"), F.max(F.size(vector_col)).alias("dimension"), F.min(F.size(vector_col)).alias("least"), F.sum(row).cast("string").alias("digest"))


def import_seed(spark: SparkSession, path: str, model: str, dimension: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame | None:
    """The vectors of a seed; None if it is of another model or dimension, an error if its rows aren't those that were written."""
    told = spark.read.json(f"{path}/manifest").first()
    if told["model"] != model or told["dimension"] != dimension:
        return None
    vectors = spark.read.parquet(f"{path}/vectors")
    found = _manifest(vectors, id_col, vector_col).first()
    if (found["n"], found["digest"], found["least"]) != (told["n"], told["digest"], dimension):
        raise ValueError(f"{path} doesn't hold what was exported")
    return vectors


def split_by_seed(produced: DataFrame, seed: DataFrame, id_col: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(rows the seed has vectors for, rows that must be embedded)."""
    have = seed.select(id_col).distinct()
    return produced.join(have, id_col, "left_semi"), produced.join(have, id_col, "left_anti")
