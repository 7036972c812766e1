"""Raw document files: listing, validation and text extraction."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.tables import map_arrow
from docloom.sources.docx import read_docx

# The largest upload, the largest unpacked office file, and its pages.
MAX_BYTES, MAX_UNPACKED, MAX_PAGES = 50 * 1024 * 1024, 400 * 1024 * 1024, 1000


def list_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, source, doc_group, size, modified, content) of the PDF and DOCX files under ``root``; folders that begin with '.', '_' or 'processed' and lock files are left out. Reading no ``content`` reads no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,docx,PDF,DOCX}").load(root)
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    parts = F.split(F.replace(plain(F.col("path")), plain(F.lit(root.rstrip("/") + "/")), F.lit("")), "/")
    source = F.element_at(parts, -1)
    hidden = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike(r"^(\.|_|processed)"))
    group = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("ungrouped")
    return files.where(~hidden & ~source.startswith("~$")).select("path", source.alias("source"), group.alias("doc_group"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def find_document(files: DataFrame, name: str) -> DataFrame:
    """The file of that name, exactly or else without case; at most one row."""
    return files.where(F.lower("source") == name.lower()).orderBy(F.desc(F.col("source") == name), "source").limit(1)


def sniff(content) -> F.Column:
    """'pdf', 'zip', 'ole' or 'unknown' by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0"), "ole").otherwise("unknown")


def validate(files: DataFrame) -> DataFrame:
    """(source, sha256, code): the first rule a file breaks: bad_extension, empty, too_large, encrypted, wrong_type, zip_bomb, macro, broken, too_many_pages, no_text; null for a good file. The inside of PDF files is left to their reader."""
    ext = F.lower(F.regexp_extract("source", r"\.([^.]+)$", 1))
    kind = sniff(F.col("content"))
    simple = F.coalesce(
        F.when(~ext.isin("pdf", "docx"), F.lit("bad_extension")),
        F.when(F.col("size") == 0, F.lit("empty")),
        F.when(F.col("size") > MAX_BYTES, F.lit("too_large")),
        F.when((ext == "docx") & (kind == "ole"), F.lit("encrypted")),
        F.when(((ext == "pdf") & (kind != "pdf")) | ((ext == "docx") & (kind != "zip")), F.lit("wrong_type")),
    )
    checked = files.select("source", "content", F.sha2("content", 256).alias("sha256"), simple.alias("simple"), ext.alias("ext"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            source, content, sha, code, ext_ = (batch.column(k) for k in range(5))
            codes = [c if c or e != "docx" else inspect_docx(b) for c, e, b in zip(code.to_pylist(), ext_.to_pylist(), content.to_pylist())]
            yield [source, sha, codes]

    return map_arrow(checked, run, "source string, sha256 string, code string")


def inspect_docx(content: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if sum(i.file_size for i in z.infolist()) > MAX_UNPACKED:
                return "zip_bomb"
            if any(n.endswith("vbaProject.bin") for n in names):
                return "macro"
            if "word/document.xml" not in names:
                return "wrong_type"
        blocks = read_docx(content)
    except Exception:  # no archive, or parts that can't be parsed
        return "broken"
    if max((b[0] for b in blocks), default=1) > MAX_PAGES:
        return "too_many_pages"
    return None if any(b[1] != "warning" for b in blocks) else "no_text"


def extract_documents(files: DataFrame, pdf_reader=None) -> DataFrame:
    """(source, page, text) of every page. DOCX is read here; ``pdf_reader(bytes) -> list[str]`` is a plug-in, as no PDF library is assumed. A file that fails has one row with page 0 and the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            rows = []
            for i, (name, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                try:
                    if name.lower().endswith(".docx"):
                        pages: dict[int, list[str]] = {}
                        for page, kind, _, line, *_ in read_docx(content):
                            if kind != "warning":
                                pages.setdefault(page, []).append(line)
                        rows += [(i, p, "\n".join(lines)) for p, lines in sorted(pages.items())]
                    elif pdf_reader:
                        rows += [(i, p, t) for p, t in enumerate(pdf_reader(content), 1)]
                    else:
                        rows.append((i, 0, "no PDF reader"))
                except Exception as e:
                    rows.append((i, 0, f"{type(e).__name__}: {e}"))
            if rows:
                at, page, text = zip(*rows)
                yield [batch.column(0).take(pa.array(at, pa.int64())), page, text]

    return map_arrow(files.select("source", "content"), run, "source string, page int, text string")
