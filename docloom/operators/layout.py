"""Page layout and small helpers of parsing: tables on pages, places of text, cleaning of recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import restore_section_words, squash
from docloom.plans.tables import fill_forward, materialize

# How reference numbers of documents read, the first that matches.
DOC_NUMBERS = (
    r"(?i)\b([0-9]+/[0-9]{4}/QH[0-9]+)\b",
    r"(?im)^s[o?ố].{0,3}:\s*([0-9]+/[0-9]{4}/TT-BGD.{1,2}T)\b",
    r"(?im)^s[o?ố].{0,3}:\s*([0-9]+\s*/\s*Q.{1,2}-.{0,3}HQG)\b",
    r"(?im)^s[o?ố].{0,3}:\s*([0-9]+\s*/\s*Q.{1,2}-.{0,3}HQT)\b",
    r"(?im)^s[o?ố].{0,3}:\s*([0-9]+[-\s]TB/DHQ.{0,2}-CTSV)\b",
)
# How a line above a table begins that describes the document, and one that is the table's title.
CAPTION_SKIP = r"^\s*(?:cộng hòa|độc lập|trường đại học|đại học quốc gia|số\s*:|kính gửi)"
CAPTION_TITLE = r"^\s*(?:bảng|biểu|phụ\s*lục|mẫu|khung|tiêu\s*chí|danh\s*mục|mức|điều\s+[0-9]+|chương\s+[ivxlcdm0-9]+)"
# Letters and their share a caption needs, its longest, and the share of capitals that makes a title.
CAPTION_LETTERS, CAPTION_SHARE, CAPTION_CHARS, CAPTION_CAPITALS = 8, 0.4, 160, 0.7


def outside_tables(blocks: DataFrame, boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Text blocks (source, page, block_no, x0, y0, x1, y1) that lie in no table box of their page by more than ``share`` of their area.

    An equi-join on (source, page) with the overlap as a condition; pages are small, so no block meets another page's boxes.
    """
    b = boxes.select("source", "page", *(F.col(c).alias("t" + c) for c in ("x0", "y0", "x1", "y1")))
    wide = F.greatest(F.lit(0.0), F.least("x1", "tx1") - F.greatest("x0", "tx0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "ty1") - F.greatest("y0", "ty0"))
    inside = blocks.join(b, ["source", "page"]).where(wide * high > share * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return blocks.join(inside.select("source", "page", "block_no").distinct(), ["source", "page", "block_no"], "left_anti")


def page_of(places: DataFrame, starts: DataFrame) -> DataFrame:
    """As-of join: (source, pos) gets the last page of (source, page, start) that starts at or before it, null before the first.

    One pass over the union of both, ranged over partitions, so a long file is no single task; no range join.
    """
    kind = starts.schema["page"].dataType
    marks = starts.select("source", F.col("start").alias("pos"), F.lit(0).alias("kind"), F.col("page").alias("nth"), "page")
    asked = places.select("source", "pos", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("nth"), F.lit(None).cast(kind).alias("page"))
    return fill_forward(marks.unionByName(asked), "source", ["pos", "kind", "nth"], "page", "last").where("kind = 1").select("source", "pos", F.col("last").alias("page"))


def clean_recognised(text: Column) -> Column:
    """Recognised text with its section words restored, runs of blanks as one and of empty lines as one, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(restore_section_words(text), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def document_number(text: Column) -> Column:
    """The document's own reference number in its first 2,000 characters, else ''."""
    head = F.substring(text, 1, 2000)
    found = [F.nullif(F.trim(F.regexp_extract(head, p, 1)), F.lit("")) for p in DOC_NUMBERS]
    return F.coalesce(*found, F.lit(""))


def usable_caption(line: Column) -> Column:
    """A heading-like line above a table: letters enough, not a paragraph nor the document's head, and a title word or mostly capitals."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    low = F.lower(line)
    fits = (letters >= CAPTION_LETTERS) & (letters / F.length(line) >= CAPTION_SHARE) & (F.length(line) <= CAPTION_CHARS) & ~low.rlike(CAPTION_SKIP)
    return F.coalesce(fits & (low.rlike(CAPTION_TITLE) | (upper / letters > CAPTION_CAPITALS)), F.lit(False))


def table_captions(blocks: DataFrame, boxes: DataFrame, window: float = 90.0) -> DataFrame:
    """(source, page, table_no, caption) of (source, page, x0, y0, x1, y1, text) blocks and (source, page, table_no, y0) boxes: the usable line that ends nearest above each table, within ``window`` points; '' where there is none."""
    lines = blocks.select("source", "page", F.col("y1").alias("__y"), squash(F.col("text")).alias("line")).where(usable_caption(F.col("line")))
    above = boxes.join(lines, ["source", "page"]).where((F.col("__y") <= F.col("y0")) & (F.col("y0") - F.col("__y") <= window))
    best = above.groupBy("source", "page", "table_no").agg(F.max_by("line", F.struct("__y", "line")).alias("caption"))
    return boxes.select("source", "page", "table_no").join(best, ["source", "page", "table_no"], "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def header_candidate(cells: Column) -> Column:
    """Whether a table line can be a header: no filled cell is longer than 100 characters."""
    return F.forall(cells, lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) <= 100)


def replicate(vectors: DataFrame, factor: int, noise: float = 0.01, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, embedding): every vector ``factor`` times, copies after the first with normal noise and unit length, ids '<id>__rep<n>'. The noise depends on id, copy and place alone."""
    copies = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("r"))

    def normal(i: Column) -> Column:
        u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id"), F.col("r"), i), F.lit(1_000_003)) + 0.5) / 1_000_003.0
        return F.sqrt(-2.0 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))

    moved = F.transform("v", lambda x, i: x.cast("double") + F.when(F.col("r") > 0, normal(i) * noise).otherwise(0.0))
    rows = copies.withColumn("m", moved).withColumn("n", F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.select(F.when(F.col("r") > 0, F.concat_ws("__rep", "id", F.col("r").cast("string"))).otherwise(F.col("id")).alias("id"), F.transform("m", lambda x: (x / F.col("n")).cast("float")).alias("embedding"))


def evenly_spaced(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Every (rows // n)th row in ``order``, at most ``n``; a sampling operator.

    Rows are ranged over partitions and written once; each partition numbers its own rows and adds the counts of those before it, so
    no task sorts the whole table.
    """
    from pyspark.sql import Window

    ranged = materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("__p").count().collect())
    total = sum(c for _, c in counts)
    step = max(1, total // max(1, n))
    before, at = {}, 0
    for p, c in counts:
        before[p] = at
        at += c
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("__p")] if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1 + offset
    return ranged.withColumn("__n", place).where((F.col("__n") % step == 0) & (F.col("__n") < step * n)).select(df.columns)
