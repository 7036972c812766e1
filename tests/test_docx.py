"""DOCX files made by hand: numbering, styles, pages, tables, and the chunks they give."""

import io
import zipfile

from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.sources import docx, files

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def run(text):
    return f'<w:r><w:t xml:space="preserve">{text}</w:t></w:r>'


def p(text="", style=None, num=None, extra="", inner=None):
    properties = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "") + extra
    return f"<w:p><w:pPr>{properties}</w:pPr>{run(text) if inner is None else inner}</w:p>"


def tc(content, span=1, merge=None):
    shape = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + {None: "", "restart": '<w:vMerge w:val="restart"/>', "continue": "<w:vMerge/>"}[merge]
    return f"<w:tc><w:tcPr>{shape}</w:tcPr>{content if content.startswith('<') else p(content)}</w:tc>"


def table(*rows, header=0):
    return "<w:tbl>" + "".join(f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if n < header else ''}{''.join(c if c.startswith('<w:tc') else tc(c) for c in row)}</w:tr>" for n, row in enumerate(rows)) + "</w:tbl>"


BREAK = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
LEVELS = [("decimal", "%1.", 1), ("lowerLetter", "%2)", 1), ("upperRoman", "%1.%3", 4)]
LISTS = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="{s}"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for i, (f, t, s) in enumerate(LEVELS))
NUMBERING = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7">{LISTS}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>'
STYLES = f"""<w:styles {NS}><w:style w:styleId="Tiude1"><w:name w:val="Heading 1"/></w:style><w:style w:styleId="Own"><w:name w:val="own"/><w:basedOn w:val="Tiude1"/></w:style>
<w:style w:styleId="Part"><w:name w:val="part"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:styleId="List"><w:name w:val="list number"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style></w:styles>"""


def made(*body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {NS}><w:body>{"".join(body)}</w:body></w:document>')
        z.writestr("word/numbering.xml", NUMBERING)
        z.writestr("word/styles.xml", STYLES)
        for name, content in parts.items():
            z.writestr(f"word/{name}.xml", content)
    return out.getvalue()


def texts(*body):
    return [b[3] for b in docx.read_docx(made(*body))]


def test_lists_are_numbered_by_level_and_restart():
    assert texts(p("Một", num=(1, 0)), p("ý", num=(1, 1)), p("hai", num=(1, 1)), p("Hai", num=(1, 0)), p("mới", num=(1, 1)), p("sâu", num=(1, 2))) == ["1. Một", "a) ý", "b) hai", "2. Hai", "a) mới", "2.IV sâu"]
    assert texts(p("a", style="List"), p("b", num=(2, 0)), p("c", num=(2, 0)), p("d", num=(0, 0)), p("e", num=(9, 0))) == ["1. a", "5. b", "6. c", "d", "e"]


def test_number_formats():
    assert [docx.in_roman(n) for n in (1, 4, 9, 14, 40, 90, 400, 1994, 0)] == ["i", "iv", "ix", "xiv", "xl", "xc", "cd", "mcmxciv", "0"]
    assert [docx.in_letters(n) for n in (0, 1, 26, 27, 53)] == ["a", "a", "z", "aa", "aaa"] and docx.formatted(7, "decimalZero") == "07"


def test_changes_are_accepted_and_headings_inherit():
    inner = run("Giữ ") + f"<w:ins>{run('CHÈN ')}</w:ins><w:del><w:r><w:delText>XOÁ</w:delText></w:r></w:del><w:moveFrom>{run('cũ')}</w:moveFrom>" + run("cuối.")
    assert texts(p(inner=inner)) == ["Giữ CHÈN cuối."]
    blocks = docx.read_docx(made(p("Giới thiệu", style="Own"), p("Nội dung."), p("Phạm vi", style="Part"), p("Sâu", extra='<w:outlineLvl w:val="4"/>')))
    assert [(b[1], b[2]) for b in blocks] == [("heading", 0), ("para", None), ("heading", 1), ("heading", 4)]


def test_pages_follow_breaks_and_the_rendering_goes_first():
    pages = lambda *body: [(b[3], b[0]) for b in docx.read_docx(made(*body))]
    assert pages(p("Một"), BREAK, p("Hai"), p("Ba", extra="<w:pageBreakBefore/>"), p("Bốn", extra="<w:sectPr/>"), p("Năm")) == [("Một", 1), ("Hai", 2), ("Ba", 3), ("Bốn", 3), ("Năm", 4)]
    rendered = "<w:r><w:lastRenderedPageBreak/><w:t>Hai</w:t></w:r>"
    assert pages(p("Một"), BREAK, p(inner=rendered), p(inner=run("Ba") + "<w:r><w:lastRenderedPageBreak/><w:t> sau</w:t></w:r>"), p("Bốn")) == [("Một", 1), ("Hai", 2), ("Ba sau", 2), ("Bốn", 3)]


def test_merged_cells_and_layout_tables():
    t = table(["Nhóm", "Nội dung"], [tc(p("Nhóm A", num=(1, 0)), merge="restart"), "x"], [tc("", merge="continue"), "y"], [tc("chung", span=2)])
    blocks = docx.read_docx(made(t, p("sau bảng", num=(1, 0))))
    assert [b[6] for b in blocks[:4]] == [["Nhóm", "Nội dung"], ["1. Nhóm A", "x"], ["1. Nhóm A", "y"], ["chung", ""]]
    assert blocks[4][3] == "2. sau bảng"
    layout = docx.read_docx(made(table(["BỘ GIÁO DỤC", tc(p("Số: 12") + table(["a", "b"]))]), p("Điều 1. Nội dung")))
    assert [(b[1], b[3]) for b in layout] == [("para", "BỘ GIÁO DỤC"), ("para", "Số: 12\na | b"), ("para", "Điều 1. Nội dung")]


def test_unread_parts_and_broken_files_are_told(spark):
    good = made(p("Nội dung"), header1=f"<w:hdr {NS}>{p('Tiêu đề trang')}</w:hdr>")
    found = spark.createDataFrame([("a.docx", good), ("b.docx", b"PK no"), ("c.docx", None)], "source string, content binary")
    got = {(r.source, r.kind): r.text for r in docx.docx_blocks(found).collect()}
    assert got["a.docx", "warning"] == "header_footer_skipped" and got["a.docx", "para"] == "Nội dung"
    assert ("b.docx", "error") in got and ("c.docx", "error") in got
    assert docx.docx_blocks(found.limit(0)).count() == 0


def test_files_are_validated_inside(spark):
    good, empty, long = made(p("Nội dung")), made(p("")), made(*[p("Trang") + BREAK] * 1001)
    rows = [("a.docx", good), ("b.docx", empty), ("c.docx", long), ("d.docx", good[:200]), ("e.txt", good), ("f.docx", b"")]
    checked = files.validate(spark.createDataFrame([(n, len(c), c) for n, c in rows], "source string, size bigint, content binary"))
    assert {r.source: r.code for r in checked.collect()} == {"a.docx": None, "b.docx": "no_text", "c.docx": "too_many_pages", "d.docx": "broken", "e.txt": "bad_extension", "f.docx": "empty"}


def test_blocks_become_chunks_with_pages_and_labels(spark):
    prose = "Sinh viên nộp đơn xin học bổng trước ngày mười lăm hằng tháng tại phòng đào tạo của trường."
    a = made(p("Giới thiệu", style="Own"), p(prose), BREAK, p("Phạm vi", style="Part"), p(prose), p("Kết luận", style="Own"), p(prose), p("Bảng 1. Mức hỗ trợ công tác"),
             table(["Hạng mục", "Mức"], ["Vé máy bay", "Theo thực tế"], ["Hạng mục", "Mức"], ["", ""], ["Lưu trú", "800.000"]))
    b = made(*(p(f"Điều {i}. Tên {i}") + p(prose + " " + prose) for i in range(1, 5)))
    c = made(table(["STT", "Mức", "Mức"], ["", "thấp", "cao"], ["1", "x", "y"], header=2))
    raw = spark.createDataFrame([("a.docx", a), ("b.docx", b), ("c.docx", c)], "source string, content binary")
    chunks = chunking.chunk_blocks(docx.docx_blocks(raw))
    got = {}
    for r in chunks.orderBy("source", "chunk_index").collect():
        got.setdefault(r.source, []).append(r)
    own = got["a.docx"]
    assert [r.chunk_index for r in own] == list(range(5)) and [r.chunker for r in own] == ["heading"] * 3 + ["table"] * 2
    assert [(r.chapter_title, r.article_title, r.page) for r in own[:3]] == [("Giới thiệu", "", 1), ("Giới thiệu", "Phạm vi", 2), ("Kết luận", "", 2)]
    assert own[0].level_labels.chapter == "HEADING_1" and own[0].level_labels.article == "HEADING_2"
    assert own[3].text == "Bảng 1. Mức hỗ trợ công tác\n[Bảng 1 · trang 2 · dòng 1]\nHạng mục: Vé máy bay\nMức: Theo thực tế" and own[4].text.endswith("dòng 2]\nHạng mục: Lưu trú\nMức: 800.000")
    assert {r.chunker for r in got["b.docx"]} == {"structure"} and got["b.docx"][0].level_labels.article == "DIEU_VN"
    assert [r.text for r in got["c.docx"]] == ["[Bảng 1 · trang 1 · dòng 1]\nSTT: 1\nMức — thấp: x\nMức — cao: y"]
    summary = {(r.chunker, r.labels): (r.documents, r.chunks) for r in chunking.parse_summary(chunks).collect()}
    assert summary["heading", "HEADING_1+HEADING_2"] == (1, 3) and summary["table", ""] == (2, 3)
    pages = {(r.source, r.page): r.text for r in docx.docx_pages(docx.docx_blocks(raw)).collect()}
    assert "Vé máy bay" not in pages["a.docx", 2] and pages["a.docx", 1].startswith("Giới thiệu\nSinh viên")
    assert "Vé máy bay | Theo thực tế" in docx.docx_text(docx.docx_blocks(raw)).where(F.col("source") == "a.docx").first().text
