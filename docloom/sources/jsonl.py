"""JSON-lines chunk files, truth files and JSON maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = (
    "chunk_id string, source string, source_path string, page int, chunk_index int, text string, doc_group string, doc_type string, doc_number string, issuing_body string, section_type string, "
    "chapter string, chapter_title string, article string, article_title string, khoan string, file_type string, language string, ingest_version int, level_labels struct<chapter: string, article: string, khoan: string>"
)
TRUTH = "id int, question string, answer string, relevant_ids array<string>, sources array<struct<source: string, page: int>>"


def read_chunks(spark: SparkSession, path: str, only_files: list[str] | None = None, tolerant: bool = False) -> DataFrame:
    """Chunk records under ``path`` with their file name; ``only_files`` prunes files before they are read. Bad lines fail, or are left out if ``tolerant``."""
    reader = spark.read.schema(CHUNK).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    rows = reader.json(path).withColumn("file_name", F.col("_metadata.file_name"))
    return rows.where(F.col("file_name").isin(only_files)) if only_files is not None else rows


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder per source; only the sources at hand are replaced. Rows are ranged by source and place, so a large source is written by several tasks."""
    chunks.repartitionByRange("source", "chunk_index").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").json(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Test questions from JSON lines or, by the extension .json, from one JSON array."""
    return spark.read.schema(TRUTH).option("multiLine", str(path.endswith(".json")).lower()).json(path)


def read_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Rows of a JSON object whose values are records: ``key`` and the fields of ``value`` (a DDL struct body). A missing or invalid file gives no rows."""
    schema = T._parse_datatype_string(f"{key} string, {value}")
    try:
        text = spark.read.option("wholetext", "true").text(path)
    except Exception:
        return spark.createDataFrame([], schema)
    parsed = text.select(F.explode(F.from_json("value", f"map<string, struct<{value}>>")).alias(key, "v"))
    return parsed.select(key, "v.*")


def read_catalogue(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Entries of a catalogue file ``{"documents": {source: entry}}``: source and the fields of ``value`` (a DDL struct body). A missing or invalid file gives no rows."""
    schema = T._parse_datatype_string(f"source string, {value}")
    try:
        text = spark.read.option("wholetext", "true").text(path)
    except Exception:
        return spark.createDataFrame([], schema)
    parsed = text.select(F.explode(F.from_json("value", f"struct<documents: map<string, struct<{value}>>>")["documents"]).alias("source", "v"))
    return parsed.select("source", "v.*")


def read_sidecars(spark: SparkSession, root: str, fields: str) -> DataFrame:
    """(source, fields...) of the files ``<source>.meta.json`` under ``root``, one JSON object each; one that is no object has null fields."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").text(root).select(F.col("_metadata.file_name").alias("name"), F.from_json("value", f"struct<{fields}>").alias("v"))
    return rows.select(F.regexp_replace(F.url_decode("name"), r"\.meta\.json$", "").alias("source"), "v.*")


def latest_result(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, value) of the newest ``summary_*.json`` under ``root``; no row where there is none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "summary_*.json").load(root)
    return found.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).select("path", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("value"))


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """Results as JSON lines or as CSV with a header."""
    (df.write.mode("overwrite").json(path) if kind == "json" else df.write.mode("overwrite").option("header", "true").csv(path))


def latex_table(df: DataFrame, columns: list[str], limit: int = 200) -> str:
    """A LaTeX tabular of a report table of at most ``limit`` rows."""
    escape = lambda v: "" if v is None else "".join("\\" + c if c in "&%$#_{}" else c for c in (f"{v:.3f}" if isinstance(v, float) else str(v)))
    rows = df.select(*columns).limit(limit).collect()
    body = " \\\\\n".join(" & ".join(escape(v) for v in r) for r in [columns, *rows])
    return f"\\begin{{tabular}}{{{'l' * len(columns)}}}\n{body} \\\\\n\\end{{tabular}}"
