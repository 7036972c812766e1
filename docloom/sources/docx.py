"""DOCX files as tables of blocks: numbering and styles rebuilt, pages counted, merged cells resolved."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.tables import map_arrow

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: What an accepted document doesn't show in its place: deletions, moved text, text boxes, fallbacks of drawings.
HIDDEN = {f"{W}del", f"{W}moveFrom", f"{W}txbxContent", "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"}
SCHEMA = "source string, block_no int, page int, kind string, level int, text string, table_no int, line_no int, cells array<string>, header boolean, above string"


def _val(el, name: str, attr: str = "val") -> str | None:
    """Attribute of a child property; None where either is missing."""
    child = el.find(W + name) if el is not None else None
    return None if child is None else child.get(W + attr)


def _on(el, name: str) -> bool:
    child = el.find(W + name) if el is not None else None
    return child is not None and (child.get(f"{W}val") or "true").lower() not in ("0", "false", "off")


def _number(properties) -> tuple[str | None, int | None]:
    found = properties.find(f"{W}numPr") if properties is not None else None
    depth = _val(found, "ilvl")
    return _val(found, "numId"), None if depth is None else int(depth)


def in_letters(n: int) -> str:
    """a to z, then aa to zz and so on."""
    rounds, at = divmod(max(n, 1) - 1, 26)
    return "abcdefghijklmnopqrstuvwxyz"[at] * (rounds + 1)


def in_roman(n: int) -> str:
    """Place by place from the symbols of one, five and ten of that place; '0' for nothing."""
    out = "m" * (n // 1000)
    for place, (one, five, ten) in ((100, "cdm"), (10, "xlc"), (1, "ivx")):
        digit = n // place % 10
        out += one + ten if digit == 9 else one + five if digit == 4 else five * (digit > 4) + one * (digit % 5)
    return out or "0"


#: Number formats other than plain digits.
FORMATS = {"lowerLetter": in_letters, "upperLetter": lambda n: in_letters(n).upper(), "lowerRoman": in_roman, "upperRoman": lambda n: in_roman(n).upper(), "decimalZero": lambda n: f"{n:02d}"}


def formatted(n: int, kind: str) -> str:
    return FORMATS.get(kind, str)(n)


def style_table(root) -> dict[str, tuple[tuple[str, int] | None, int | None]]:
    """Style -> (list and depth, heading level from 0) with what it inherits worked in.

    A heading level comes from the built-in English name, which doesn't depend on the interface language, or from the outline level.
    """
    own: dict[str, tuple] = {}
    for style in root.iter(f"{W}style") if root is not None else ():
        properties = style.find(f"{W}pPr")
        num, depth = _number(properties)
        name, outline = (_val(style, "name") or "").lower(), int(_val(properties, "outlineLvl") or 9)
        level = 0 if name == "title" else int(name[8:]) - 1 if re.fullmatch(r"heading \d", name) else outline if outline < 9 else None
        own[style.get(f"{W}styleId")] = ((num, depth or 0) if num else None, level, _val(style, "basedOn"))
    whole: dict[str, tuple] = {}

    def resolve(key: str, below: frozenset) -> tuple:
        if key not in whole:
            number, level, parent = own.get(key, (None, None, None))
            up = resolve(parent, below | {key}) if parent and parent not in below | {key} else (None, None)
            whole[key] = (number or up[0], up[1] if level is None else level)
        return whole[key]

    return {key: resolve(key, frozenset()) for key in own}


class Lists:
    """Counters of the document's lists, which store no numbers in their text.

    ``plan`` has for each list number the list it counts in, the (format, pattern, start) of its levels and the starts it sets at its
    first use. ``counts`` has of each list a counter per level; one that moves empties those below it.
    """

    def __init__(self, root, styles: dict[str, tuple]):
        levels, links, uses = {}, {}, {}
        for el in root if root is not None else ():
            if el.tag == f"{W}abstractNum":
                key = el.get(f"{W}abstractNumId")
                levels[key] = {int(v.get(f"{W}ilvl") or 0): (_val(v, "numFmt") or "decimal", _val(v, "lvlText") or "", int(_val(v, "start") or 1)) for v in el.findall(f"{W}lvl")}
                links[key] = _val(el, "numStyleLink")
            elif el.tag == f"{W}num":
                starts = {int(o.get(f"{W}ilvl") or 0): _val(o, "startOverride") for o in el.findall(f"{W}lvlOverride")}
                uses[el.get(f"{W}numId")] = (_val(el, "abstractNumId"), {d: int(v) for d, v in sorted(starts.items()) if v})

        def behind(key: str, seen: frozenset) -> str:
            """The list that has the levels, where one only points to a style."""
            number = styles.get(links.get(key), (None, None))[0]
            target = uses.get(number[0], (None,))[0] if number else None
            return behind(target, seen | {key}) if target and target not in seen else key

        self.plan = {num: (at := behind(key, frozenset()), levels.get(at, {}), starts) for num, (key, starts) in uses.items() if key}
        self.counts: dict[str, list[int | None]] = {}

    def marker(self, num: str | None, depth: int) -> str:
        """The next number of a list, as it is drawn before the text, with a blank; '' for a level without one."""
        key, levels, starts = self.plan.get(num, ("", {}, {}))
        if depth not in levels or num == "0":
            return ""
        kind, pattern, start = levels[depth]
        counts = self.counts.setdefault(key, [None] * 10)
        for d, first in starts.items():
            counts[d:] = [first - 1] + [None] * (9 - d)
        self.plan[num] = (key, levels, {})
        counts[depth:] = [(start - 1 if counts[depth] is None else counts[depth]) + 1] + [None] * (9 - depth)
        if kind in ("bullet", "none"):
            return "- " if kind == "bullet" else ""

        def shown(m: re.Match) -> str:
            how, _, begins = levels.get(int(m[1]) - 1, ("decimal", "", 1))
            n = counts[int(m[1]) - 1]
            return formatted(begins if n is None else n, how)

        drawn = re.sub("%([1-9])", shown, pattern).strip()
        return drawn and drawn + " "


@dataclass
class Reader:
    """Reads paragraphs and tables in order and counts pages: by the breaks of the last rendering where there are any, else by explicit ones."""

    styles: dict[str, tuple]
    lists: Lists
    rendered: bool
    page: int = 1
    owed: int = 0  # pages that begin with the next content
    tables: int = 0
    said: dict = field(default_factory=dict)

    def runs(self, el) -> Iterator:
        for child in el:
            if child.tag == f"{W}r":
                yield child
            elif child.tag not in HIDDEN:
                yield from self.runs(child)

    def paragraph(self, p) -> tuple[str, int | None, int]:
        """(text with its list number, heading level or None, page it begins on)."""
        properties = p.find(f"{W}pPr")
        by_style, level = self.styles.get(_val(properties, "pStyle"), (None, None))
        if (outline := int(_val(properties, "outlineLvl") or 9)) < 9:
            level = outline
        num, depth = _number(properties)
        number = by_style if num is None else (num, depth or 0)
        self.page, self.owed = self.page + self.owed, 0
        if not self.rendered and _on(properties, "pageBreakBefore"):
            self.page += 1
        text, later = "", 0
        for run in self.runs(p):
            for child in run:
                tag = child.tag.removeprefix(W)
                broken = tag == "lastRenderedPageBreak" if self.rendered else tag == "br" and child.get(f"{W}type") == "page"
                if broken and text.strip():
                    later += 1  # a break behind text begins the page of what follows
                elif broken:
                    self.page += 1
                elif tag == "t":
                    text += child.text or ""
                else:
                    text += {"tab": " ", "cr": "\n", "noBreakHyphen": "-", "br": "" if child.get(f"{W}type") == "page" else "\n"}.get(tag, "")
        begins = self.page
        self.page += later
        section = properties.find(f"{W}sectPr") if properties is not None else None
        if not self.rendered and section is not None and (_val(section, "type") or "nextPage") != "continuous":
            self.owed += 1
        lead = self.lists.marker(*number) if number else ""
        text = "\n".join(" ".join(line.split()) for line in text.split("\n")).strip()
        return (lead + text if text else ""), level, begins

    def cell(self, tc) -> str:
        """Text of a cell, read once however many rows it spans; a table inside gives a line a row."""
        if tc not in self.said:
            lines = []
            for child in blocks_of(tc):
                if child.tag == f"{W}p":
                    lines.append(self.paragraph(child)[0])
                else:
                    for row in child.iter(f"{W}tr"):
                        inner = (" ".join(self.paragraph(p)[0] for p in c.findall(f"{W}p")).strip() for c in row.findall(f"{W}tc"))
                        lines.append(" | ".join(filter(None, inner)))
            self.said[tc] = "\n".join(filter(None, lines)).strip()
        return self.said[tc]

    def table(self, tbl) -> tuple[list[list[str]], list[int], int]:
        """(rows of values, page of each row, leading rows marked as header). A vertically merged cell has its text in every row, a horizontally merged one once."""
        rows, pages, header, above = [], [], 0, []
        for tr in tbl.findall(f"{W}tr"):
            properties = tr.find(f"{W}trPr")
            grid = [None] * int(_val(properties, "gridBefore") or 0)
            for tc in tr.iter(f"{W}tc") if tr.find(f"{W}sdt") is not None else tr.findall(f"{W}tc"):
                shape = tc.find(f"{W}tcPr")
                merge = shape.find(f"{W}vMerge") if shape is not None else None
                goes_on = merge is not None and (merge.get(f"{W}val") or "continue") == "continue"
                shown = above[len(grid)] if goes_on and len(grid) < len(above) else tc
                grid += [shown] * int(_val(shape, "gridSpan") or 1)
            pages.append(self.page)
            rows.append(["" if c is None or i and c is grid[i - 1] else self.cell(c) for i, c in enumerate(grid)])
            header += header == len(rows) - 1 and _on(properties, "tblHeader")
            above = grid
        return rows, pages, header

    def blocks(self, body) -> Iterator[tuple]:
        """(page, kind, level, text, table_no, line_no, cells, header, above) of the body in reading order.

        A table of one row or one column is layout and read as text. ``above`` is the text right before a table.
        """
        before = ""
        for el in blocks_of(body):
            if el.tag == f"{W}p":
                text, level, page = self.paragraph(el)
                if text:
                    yield page, "para" if level is None else "heading", level, text, None, None, None, None, None
                    before = " ".join(text.split())
                continue
            rows, pages, header = self.table(el)
            wide = max(map(len, rows), default=0)
            if len(rows) < 2 or wide < 2:
                values = [v for row in rows for v in row if v]
                for v in values:
                    yield pages[0], "para", None, v, None, None, None, None, None
                before = " ".join(values[-1].split()) if values else ""
                continue
            self.tables += 1
            for n, (row, page) in enumerate(zip(rows, pages), 1):
                cells = [" ".join(v.split()) for v in row] + [""] * (wide - len(row))
                yield page, "row", None, " | ".join(filter(None, cells)), self.tables, n, cells, n <= header, before
            before = ""


def blocks_of(parent) -> Iterator:
    """Paragraphs and tables in order, also those inside content controls and custom XML."""
    for el in parent:
        if el.tag in (f"{W}p", f"{W}tbl"):
            yield el
        elif el.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}customXml"):
            yield from blocks_of(el)


def read_docx(content: bytes) -> list[tuple]:
    """All blocks of a file, then a block of kind 'warning' for each part that isn't read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        part = lambda name: ET.fromstring(z.read(name)) if name in names else None
        body = part("word/document.xml").find(f"{W}body")
        beside = [part(n) for n in sorted(names) if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n)]
        styles = style_table(part("word/styles.xml"))
        reader = Reader(styles, Lists(part("word/numbering.xml"), styles), body.find(f".//{W}lastRenderedPageBreak") is not None)
    out = list(reader.blocks(body))
    unread = {
        "header_footer_skipped": any((t.text or "").strip() for root in beside for t in root.iter(f"{W}t")),
        "text_boxes_skipped": body.find(f".//{W}txbxContent") is not None,
        "footnotes_skipped": body.find(f".//{W}footnoteReference") is not None,
    }
    return out + [(reader.page, "warning", None, name, None, None, None, None, None) for name, there in unread.items() if there]


def docx_blocks(files: DataFrame) -> DataFrame:
    """The blocks of DOCX files (source, content), numbered from 1; a file that can't be read has one block of kind 'error' with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            rows = []
            for i, content in enumerate(batch.column(1).to_pylist()):
                try:
                    found = read_docx(content)
                except Exception as e:
                    found = [(0, "error", None, f"{type(e).__name__}: {e}", None, None, None, None, None)]
                rows += [(i, n, *block) for n, block in enumerate(found, 1)]
            if rows:
                at, *columns = zip(*rows)
                yield [batch.column(0).take(pa.array(at, pa.int64())), *columns]

    return map_arrow(files.select("source", "content"), run, SCHEMA)


def docx_pages(blocks: DataFrame) -> DataFrame:
    """(source, page, text): paragraphs and headings of each page, one a line; table rows are left to the table chunks."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    return blocks.where(F.col("kind").isin("para", "heading")).groupBy("source", "page").agg(F.array_join(lines, "\n").alias("text"))


def docx_text(blocks: DataFrame) -> DataFrame:
    """(source, text): everything in reading order, rows with ' | ' between their cells."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    return blocks.where(F.col("kind").isin("para", "heading", "row")).groupBy("source").agg(F.array_join(lines, "\n").alias("text"))
