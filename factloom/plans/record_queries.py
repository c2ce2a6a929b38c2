"""Queries of documents, sheets, replies, reports and the generic relational forms."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import paths, records, replies
from factloom.functions import text as tx
from factloom.operators import artefacts, council, evidence, index, ledger, petals
from factloom.sources import documents as docs
from factloom.sources import legacy, store

from .council_queries import _verified
from .registry import RELATIONS, Tables, query

RELATIONS["benchmark_lines"] = "select item_id, cast(generate_subscripts(string_split(text, chr(10)), 1) as integer) n, unnest(string_split(text, chr(10))) line from benchmark"


def _packed(t: Tables, make, rows=None):
    """The benchmark's items, or rows (item_id, lines), as files (item_id, content)."""
    import pyarrow as pa

    rows = t("benchmark").select("item_id", F.split("text", "\n").alias("lines")) if rows is None else rows
    out = pa.schema([("item_id", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([make(x) for x in batch.column(1).to_pylist()], pa.binary())], schema=out)

    return rows.mapInArrow(run, "item_id long, content binary")


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _esc(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _docx(lines) -> bytes:
    """A heading, a list item and paragraphs, with the style ids of a French Word."""
    ids = {0: "Titre1", 1: "Puces"}
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("Titre1", "heading 1"), ("Puces", "Bulleted List")))
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{ids[i]}\"/></w:pPr>" if i in ids else ""}<w:r><w:t xml:space="preserve">{_esc(x)}</w:t></w:r></w:p>' for i, x in enumerate(lines))
    return _zip({"word/document.xml": f'<w:document xmlns:w="{docs.W[1:-1]}"><w:body>{body}</w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="{docs.W[1:-1]}">{styles}</w:styles>'})


def _pptx(lines) -> bytes:
    shape = '<p:sld xmlns:p="p" xmlns:a="%s"><a:p><a:r><a:t>%s</a:t></a:r></a:p></p:sld>'
    return _zip({f"ppt/slides/slide{i}.xml": shape % (docs.A[1:-1], _esc(x)) for i, x in enumerate(lines, 1)})


def _xlsx(lines, further=()) -> bytes:
    """A sheet `lines` with numbered lines, and further sheets (name, text) of one cell."""
    sheet = lambda rows: f'<worksheet xmlns="{docs.S[1:-1]}"><sheetData>{rows}</sheetData></worksheet>'
    cell = lambda at, x: f'<c r="{at}" t="inlineStr"><is><t>{_esc(x)}</t></is></c>'
    rows = "".join(f'<row><c r="A{i}"><v>{i}.0</v></c>{cell(f"B{i}", x)}</row>' for i, x in enumerate(lines, 1))
    parts = {"xl/worksheets/sheet1.xml": sheet(rows)} | {f"xl/worksheets/sheet{n}.xml": sheet(f"<row>{cell('A1', x)}</row>") for n, (_, x) in enumerate(further, 2)}
    names = "".join(f'<sheet name="{n}"/>' for n in ("lines", *(n for n, _ in further)))
    return _zip({"xl/workbook.xml": f'<workbook xmlns="{docs.S[1:-1]}"><sheets>{names}</sheets></workbook>'} | parts)


def _pdf(lines, per: int = 5, broken: int = 0) -> bytes:
    """Pages of five lines each, drawn from the last to the first, in compressed streams and a font with a character map; each line ends in
    a second run, its number, and the stream of page `broken` is no stream."""
    cmap = b"begincmap 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", 4: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)}
    pages = []
    code = lambda x: x.encode("utf-16-be").hex().encode()
    for begin in range(0, len(lines), per):
        n = 5 + 2 * len(pages)
        drawn = [b"1 0 0 1 400 %d Tm <%s> Tj 1 0 0 1 72 %d Tm <%s> Tj" % (700 - 20 * i, code(f" #{begin + i + 1}"), 700 - 20 * i, code(x)) for i, x in enumerate(lines[begin : begin + per])]
        body = zlib.compress(b"\n".join([b"BT /F1 12 Tf", *reversed(drawn), b"ET"]))
        if len(pages) + 1 == broken:
            body = b"no stream"
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (n + 1)
        objects[n + 1] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body)
        pages.append(b"%d 0 R" % n)
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(pages), len(pages))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


def _rtf(lines) -> bytes:
    body = "\\par ".join("".join(c if ord(c) < 128 else f"\\u{ord(c)}?" for c in x) for x in lines)
    return ("{\\rtf1{\\fonttbl{\\f0 Arial;}}" + body + "}").encode("ascii")


@query("scan_docx", "select item_id, cast(row_number() over (partition by item_id order by n) as integer) block, case when n = 1 then 'heading' when n = 2 then 'list' else 'para' end kind, trim(line) text from benchmark_lines where trim(line) <> ''")
def _(t: Tables):
    numbered = lambda data: [(i, k, x) for i, (k, _, x) in enumerate(docs.docx_blocks(data), 1)]
    return docs.parsed(_packed(t, _docx), numbered, "block int, kind string, text string", "item_id").drop("error")


def _open(body: str) -> bytes:
    names = " ".join(f'xmlns:{k}="{v[1:-1]}"' for k, v in docs.O.items())
    return _zip({"content.xml": f"<office:document-content {names}><office:body>{body}</office:body></office:document-content>"})


def _odt(lines) -> bytes:
    """A heading, a list item and paragraphs."""
    kinds = ['<text:h text:outline-level="2">%s</text:h>', "<text:list><text:list-item><text:p>%s</text:p></text:list-item></text:list>", "<text:p>%s</text:p>"]
    return _open("<office:text>" + "".join(kinds[min(i, 2)] % _esc(x) for i, x in enumerate(lines)) + "</office:text>")


def _ods(lines) -> bytes:
    """Numbered lines, a blank row that is repeated, and very many blank rows at the end."""
    cell = lambda x: f"<table:table-cell><text:p>{x}</text:p></table:table-cell>"
    rows = "".join(f"<table:table-row>{cell(f'{i}.0')}{cell(_esc(x))}</table:table-row>" for i, x in enumerate(lines, 1))
    blank = '<table:table-row table:number-rows-repeated="%d"><table:table-cell table:number-columns-repeated="1024"/></table:table-row>'
    return _open(f'<office:spreadsheet><table:table table:name="lines">{rows}{blank % 2}<table:table-row>{cell("end")}</table:table-row>{blank % 1_000_000}</table:table></office:spreadsheet>')


@query("scan_odt", "select item_id, cast(row_number() over (partition by item_id order by n) as integer) block, case when n = 1 then 'heading' when n = 2 then 'list' else 'para' end kind, trim(line) text from benchmark_lines where trim(line) <> ''")
def _(t: Tables):
    numbered = lambda data: [(i, k, x) for i, (k, _, x) in enumerate(docs.odt_blocks(data), 1)]
    return docs.parsed(_packed(t, _odt), numbered, "block int, kind string, text string", "item_id").drop("error")


@query("scan_ods", """select item_id, n "row", n::varchar || chr(9) || line cells from benchmark_lines union all select item_id, unnest([m + 1, m + 2, m + 3]), unnest(['', '', 'end']) from (select item_id, max(n) m from benchmark_lines group by 1)""")
def _(t: Tables):
    rows = docs.parsed(_packed(t, _ods), docs.ods_rows, "sheet string, row int, cells array<string>", "item_id")
    return rows.select("item_id", "row", F.array_join("cells", "\t").alias("cells"))


@query("scan_pptx", "select item_id, n slide, trim(line) text from benchmark_lines")
def _(t: Tables):
    return docs.parsed(_packed(t, _pptx), docs.pptx_slides, "slide int, text string, notes string", "item_id").select("item_id", "slide", "text")


@query("scan_xlsx", "select item_id, n \"row\", n::varchar || chr(9) || line cells from benchmark_lines")
def _(t: Tables):
    rows = docs.parsed(_packed(t, _xlsx), docs.xlsx_rows, "sheet string, row int, cells array<string>", "item_id")
    return rows.select("item_id", "row", F.array_join("cells", "\t").alias("cells"))


def _compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of sectors of 512 bytes; streams under 4,096 bytes lie in the stream of short sectors."""
    end, sectors, table = 0xFFFFFFFE, [], []

    def chained(body: bytes, size: int, table: list[int]) -> tuple[int, list[bytes]]:
        parts = [body[i : i + size].ljust(size, b"\0") for i in range(0, len(body), size)]
        first = len(table)
        table += [*range(first + 1, first + len(parts)), end][: len(parts)]
        return first if parts else end, parts

    def add(body: bytes) -> int:
        first, parts = chained(body, 512, table)
        sectors.extend(parts)
        return first

    short, shorts, entries = b"", [], []
    for name, body in streams.items():
        if len(body) < 4096:
            first, parts = chained(body, 64, shorts)
            short += b"".join(parts)
        else:
            first = add(body)
        entries.append((name, 2, first, len(body)))
    packed = lambda xs: struct.pack(f"<{len(xs)}I", *xs)
    entries.insert(0, ("Root Entry", 5, add(short), len(short)))
    wide = lambda name: name.encode("utf-16-le")
    directory = add(b"".join(struct.pack("<64sHBB12s20s16sIII", wide(n), len(wide(n)) + 2, kind, 1, b"\xff" * 12, b"", b"", first, size, 0) for n, kind, first, size in entries))
    short_table = add(packed(shorts).ljust(-len(shorts) % 128 * 4 + 4 * len(shorts), b"\xff"))
    own = next(n for n in range(1, 110) if 128 * n >= len(sectors) + n)
    at = len(sectors)
    table += [0xFFFFFFFD] * own
    sectors.append(packed(table + [0xFFFFFFFF] * (128 * own - len(table))))
    head = struct.pack("<8s16sHHHHH6s10I", legacy.SIGNATURE, b"", 0x3E, 3, 0xFFFE, 9, 6, b"", 0, own, directory, 0, 4096, short_table, -(-len(shorts) // 128), end, 0, 0)
    return head[:76] + packed([*range(at, at + own)] + [0xFFFFFFFF] * (109 - own)) + b"".join(sectors)


def _xls(lines) -> bytes:
    """A sheet `lines` like that of _xlsx, its strings shared and cut at 200 bytes into continued records, wide where they need to be."""
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    parts = [struct.pack("<II", len(lines), len(lines))]
    for x in lines:
        wide = any(ord(c) > 255 for c in x)
        body, width = x.encode("utf-16-le" if wide else "latin-1"), 1 + wide
        if len(parts[-1]) > 190:
            parts.append(b"")
        parts[-1] += struct.pack("<HB", len(body) // width, wide)
        while body:
            room = (200 - len(parts[-1])) // width * width
            if room <= 0:
                parts.append(bytes([wide]))
                continue
            parts[-1] += body[:room]
            body = body[room:]
    strings = record(legacy.SHARED_STRINGS, parts[0]) + b"".join(record(legacy.CONTINUE, p) for p in parts[1:])
    begin, end = record(legacy.BOF, bytes(16)), record(legacy.EOF, b"")
    sheet = lambda at: record(legacy.BOUND_SHEET, struct.pack("<IBBBB", at, 0, 0, 5, 0) + b"lines")
    book = begin + sheet(len(begin + sheet(0) + strings + end)) + strings + end
    cells = [record(legacy.RK, struct.pack("<HHHI", i, 0, 0, i + 1 << 2 | 2)) + record(legacy.LABEL_SHARED, struct.pack("<HHHI", i, 1, 0, i)) for i in range(len(lines))]
    return _compound({"Workbook": book + begin + b"".join(cells) + end})


def _doc(lines) -> bytes:
    """A piece for each line, of one byte a character where that can hold it, and a page number's field, which shows nothing."""
    pieces = [x + "\r" for x in lines] + ["\x13 PAGE \x14\x15"]
    word, bounds, places = bytearray(1472), [0], b""
    for x in pieces:
        one = x.isascii()
        places += struct.pack("<HIH", 0, len(word) * 2 | 0x40000000 if one else len(word), 0)
        bounds.append(bounds[-1] + len(x.encode("utf-16-le")) // 2)
        word += x.encode("ascii" if one else "utf-16-le")
    plan = struct.pack(f"<{len(bounds)}I", *bounds) + places
    table = b"\x01\x02\x00\x00\x00\x02" + struct.pack("<I", len(plan)) + plan
    struct.pack_into("<H", word, 0, 0xA5EC)
    struct.pack_into("<H", word, 10, 0x200)
    struct.pack_into("<I", word, 76, bounds[-1])
    struct.pack_into("<II", word, 418, 0, len(table))
    return _compound({"WordDocument": bytes(word), "1Table": table})


def _some_broken(files):
    """Every fifth file is none of its kind."""
    return files.select("item_id", F.when(F.col("item_id") % 5 == 4, F.encode(F.lit("{no such file}"), "UTF-8")).otherwise(F.col("content")).alias("content"))


@query("scan_xls", "select item_id, n \"row\", n::varchar || chr(9) || line cells, null error from benchmark_lines where item_id % 5 <> 4 union all select item_id, null, null, 'ValueError' from benchmark where item_id % 5 = 4")
def _(t: Tables):
    rows = docs.parsed(_some_broken(_packed(t, _xls)), legacy.xls_rows, "sheet string, row int, cells array<string>", "item_id")
    return rows.select("item_id", "row", F.array_join("cells", "\t").alias("cells"), "error")


@query("scan_doc", "select item_id, case when item_id % 5 <> 4 then trim(text) end text, case when item_id % 5 = 4 then 'ValueError' end error from benchmark")
def _(t: Tables):
    return docs.parsed(_some_broken(_packed(t, _doc)), lambda data: [(legacy.doc_text(data),)], "text string", "item_id")


@query("scan_rtf", "select item_id, trim(text) text from benchmark")
def _(t: Tables):
    return docs.parsed(_packed(t, _rtf), lambda data: [(docs.rtf_text(data),)], "text string", "item_id").drop("error")


_pdf_lines = "(select item_id, n, line, cast((n - 1) // 2 + 1 as integer) page, (max(n) over (partition by item_id) - 1) // 2 + 1 pages from (select item_id, unnest(range(1, 8)) n, 'line ' || item_id || ' é' line from benchmark) where item_id % 7 <> 3)"


def _pdfs(t: Tables):
    """Seven lines of each item on pages of two lines; some files are no PDF, and the second page of each is broken."""
    line = F.concat(F.lit("line "), F.col("item_id").cast("string"), F.lit(" é"))
    files = _packed(t, lambda lines: _pdf(lines, 2, 2), t("benchmark").select("item_id", F.array_repeat(line, 7).alias("lines")))
    return files.select("item_id", F.when(F.col("item_id") % 7 == 3, F.encode(F.lit("{not a pdf}"), "UTF-8")).otherwise(F.col("content")).alias("content"))


@query("scan_pdf", f"""select item_id, page, case when page = 2 then null else string_agg(line || ' #' || n, chr(10) order by n) end text, case when page = 2 then 'error' end problem, null error from {_pdf_lines} where page in (1, 2, 4) group by item_id, page
 union all select item_id, null, null, null, 'ValueError' from benchmark where item_id % 7 = 3""")
def _(t: Tables):
    # Pages 1, 2 and from 4 on: a file, and a page, that cannot be read is reported, and none sinks the others.
    return docs.parsed(_pdfs(t), lambda data: docs.pdf_pages(data, True, "-2,4-"), "page int, text string, problem string", "item_id")


@query("scan_pdf_text", "select item_id, cast((n - 1) // 5 + 1 as integer) page, string_agg(line || ' #' || n, chr(10) order by n) text from benchmark_lines group by all")
def _(t: Tables):
    return docs.parsed(_packed(t, _pdf), lambda data: docs.pdf_pages(data, layout=True), "page int, text string, problem string", "item_id").select("item_id", "page", "text")


@query("scan_pdf_tables", f"select item_id, page, cast((n - 1) % 2 + 1 as integer) \"row\", line || '|' || ' #' || n cells from {_pdf_lines} where page in (1, 3, 4)")
def _(t: Tables):
    rows = docs.parsed(_pdfs(t).where("item_id % 7 <> 3"), lambda data: docs.pdf_tables(data, "1,3-"), "page int, row int, cells array<string>", "item_id")
    return rows.select("item_id", "page", "row", F.array_join("cells", "|").alias("cells"))


@query("scan_delimited", "select c_custkey, c_custkey::varchar c1, c_name c2, c_mktsegment c3 from customer")
def _(t: Tables):
    line = F.to_csv(F.struct("c_custkey", "c_name", "c_mktsegment"))
    return docs.delimited(t("customer").select("c_custkey", line.alias("line")), 3)


@query("scan_latex", "select item_id, 'T' || item_id || chr(10) || 'Intro' || chr(10) || '  Detail ' || item_id outline from benchmark")
def _(t: Tables):
    i = F.col("item_id").cast("string")
    tex = F.concat(F.lit("\\documentclass{a}\\title{T"), i, F.lit("}\\begin{document}\n\\section{Intro}\n"), F.col("text"), F.lit("\n\\subsection{Detail "), i, F.lit("}\n\\end{document}"))
    return t("benchmark").select("item_id", docs.latex_outline(docs.latex_body(tex)).alias("outline"))


@query("fn_title_outline", "select doc_id, lang || chr(10) || '    ' || source || case when doc_id % 2 = 0 then chr(10) || '  ' || doc_id else '' end outline from documents")
def _(t: Tables):
    tex = F.concat(F.lit("\\chapter{"), "lang", F.lit("} \\subsection{"), "source", F.lit("}"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\\section*{"), F.col("doc_id").cast("string"), F.lit("}"))).otherwise(""))
    return t("documents").select("doc_id", docs.latex_outline(tex).alias("outline"))


@query("prj_page_spec", "select p_partkey, unnest(case when p_size % 2 = 0 then [0,1,2,3,4,7,10,11] else [p_size::int % 12] end) page from part")
def _(t: Tables):
    spec = F.when(F.col("p_size") % 2 == 0, "1-5,8,11-").otherwise((F.col("p_size") % 12 + 1).cast("string"))
    return t("part").select("p_partkey", F.explode(docs.page_spec(spec, 12)).alias("page"))


@query("prj_sheet_select", """select item_id, 'lines' sheet, n "row", n::varchar || chr(9) || line cells, null error from benchmark_lines where item_id % 3 = 0 union all select item_id, 'notes', 1, 'a note', null from benchmark where item_id % 3 = 1
 union all select item_id, null, null, null, 'LookupError' from benchmark where item_id % 3 = 2""")
def _(t: Tables):
    # A sheet by its name, one by its place, and one that is not there.
    files = _packed(t, lambda lines: _xlsx(lines, [("notes", "a note")]))
    parts = [docs.parsed(files.where(F.col("item_id") % 3 == i), lambda data, spec=spec: docs.sheet_rows(data, spec), "sheet string, row int, cells array<string>", "item_id") for i, spec in enumerate(("lines", "2", "9"))]
    return artefacts.union(*parts).select("item_id", "sheet", "row", F.array_join("cells", "\t").alias("cells"), "error")


@query("prj_trim_table", "select doc_id, cast(max(line_no) as integer) last from lines where trim(line) <> '' group by 1")
def _(t: Tables):
    lines = F.split("text", "\n")
    at = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i + 1)), lambda x: x.isNotNull())
    return t("documents").select("doc_id", F.array_max(at).alias("last")).where("last is not null")


@query("fn_xls_fmt", "select l_orderkey, l_linenumber, case when l_quantity = floor(l_quantity) then cast(cast(l_quantity as bigint) as varchar) else cast(l_quantity as varchar) end q from lineitem")
def _(t: Tables):
    q = F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.when(q == F.floor(q), q.cast("long").cast("string")).otherwise(q.cast("string")).alias("q"))


_sheet = "(select n_regionkey sheet, row_number() over (partition by n_regionkey order by n_nationkey) n, n_nationkey::varchar k, n_name || case when n_nationkey % 3 = 0 then ' | \"x\", y' else '' end v from nation)"


@query("sink_sheet_text", f"""select how, sheet, cast(n as integer) n, pos, line from (
 select 'txt' how, sheet, n, 0 pos, k || chr(9) || v line from {_sheet} union all select 'md', sheet, n, 0, '| ' || k || ' | ' || replace(v, '|', '\\|') || ' |' from {_sheet} union all select 'md', sheet, n, 1, '|---|---|' from {_sheet} where n = 1
 union all select 'csv', sheet, n, 0, k || ',' || case when v like '%,%' then '"' || replace(v, '"', '""') || '"' else v end from {_sheet} union all select 'json', sheet, n, 0, '["' || k || '","' || replace(v, '"', '\\"') || '"]' from {_sheet})""")
def _(t: Tables):
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    name = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit(' | "x", y'))).otherwise(F.col("n_name"))
    rows = t("nation").select("n_regionkey", place.alias("n"), F.array(F.col("n_nationkey").cast("string"), name).alias("cells"))
    return artefacts.union(*(records.sheet_lines(rows, "n_regionkey", "n", "cells", how).select(F.lit(how).alias("how"), "*") for how in ("txt", "md", "csv", "json")))


_kinds = "case line_no % 5 when 1 then 'heading' || (line_no % 6 + 1) when 2 then 'item' when 3 then 'cell' when 4 then 'code' else 'paragraph' end"
_blocks = f"(select doc_id, line_no, {_kinds} kind, trim(line) body from lines where trim(line) <> '')"


@query("sink_doc_text", f"""select doc_id, line_no, case when kind = 'item' then '- ' || body else body end txt,
 case when starts_with(kind, 'heading') then repeat('#', line_no % 6 + 1) || ' ' || body when kind = 'item' then '- ' || body when kind = 'cell' then '| ' || replace(body, '|', '\\|') || ' |' when kind = 'code' then '```' || chr(10) || body || chr(10) || '```' else body end md from {_blocks}""")
def _(t: Tables):
    n = F.col("line_no") % 5
    kind = F.when(n == 1, F.concat(F.lit("heading"), (F.col("line_no") % 6 + 1).cast("string"))).when(n == 2, "item").when(n == 3, "cell").when(n == 4, "code").otherwise("paragraph")
    return t.lines.select("doc_id", "line_no", records.block_text(kind, "line", "txt").alias("txt"), records.block_text(kind, "line", "md").alias("md")).where("txt is not null")


_memos = """(select source, min(lang) || ' texts' topic, count(*) filter (status in ('CONFIRMED', 'DRIFTED')) good, count(*) total, count(*) filter (status in ('NEEDS_AGENT', 'PENDING')) pending, cast(sum(len(string_split(text, chr(10)))) as bigint) n_lines,
 source || '.memo.md' memo, cast(sum(greatest(1, floor(length(text) / 4))) as bigint) raw, cast(sum(60 + len(string_split(text, chr(10)))) as bigint) tokens from claims join (select doc_id claim_id, lang from documents) using (claim_id) group by 1)"""
_steps = "".join(f", s{i + 1} as (select greatest(1, (length + length(format('{{:,}}', own))) // 4) own, length from s{i})" for i in range(5))


@query("sink_index_md", f"""with m as {_memos}, t as (select cast(sum(raw) as bigint) raw, cast(sum(tokens) as bigint) tokens from m),
 body as (select unnest(['# Memo index', '', '| source | topic | trust | lines | memo |', '|---|---|---|---|---|']) line union all
  select '| `' || source || '` | ' || replace(left(topic, 60), '|', '\\|') || ' | ' || good || '/' || total || case when pending > 0 then ' (+' || pending || ' unchecked)' else '' end || ' | ' || n_lines || ' | `' || memo || '` |' from m),
 tail as (select unnest(['', '## Ledger', '', '- raw material: ~' || format('{{:,}}', raw) || ' tokens', '- all memos: ~' || format('{{:,}}', tokens) || ' tokens', '- this index: ~@ tokens', '- saved: ~' || format('{{:,}}', raw - tokens) || ' tokens (' || cast(floor(100 * (raw - tokens) / raw) as bigint) || '%)', '']) line from t),
 l as (select cast(sum(length(line) + 1) - 1 as bigint) length from (select line from body union all select line from tail)),
 s0 as (select greatest(1, length // 4) own, length from l){_steps}
select line from body union all select replace(line, '@', format('{{:,}}', own)) from tail, s5""")
def _(t: Tables):
    status = lambda *s: F.count_if(F.col("status").isin(*s))
    lines = F.size(F.split("text", "\n"))
    memos = t.claims.join(t("documents").select(F.col("doc_id").alias("claim_id"), "lang"), "claim_id").groupBy("source").agg(
        F.concat(F.min("lang"), F.lit(" texts")).alias("topic"), status("CONFIRMED", "DRIFTED").alias("good"), F.count("*").alias("total"), status("NEEDS_AGENT", "PENDING").alias("pending"), F.sum(lines).alias("n_lines"),
        F.concat(F.first("source"), F.lit(".memo.md")).alias("memo"), F.sum(tx.est_tokens("text")).alias("raw"), F.sum(lines + 60).alias("tokens"))
    return _written(t, artefacts.memo_index(memos))


def _written(t: Tables, rows):
    """The lines of an artefact that was written, read back."""
    path = store.scratch(t.spark, "artefact")
    artefacts.write_text(rows, path)
    return artefacts.read_text(t.spark, path).select("line")


_two = lambda c: f"printf('%.2f', round({c}, 2))"
_score = "printf('%+.2f', round(score, 2))"


@query("sink_report_md", f"""select unnest(['# Session report', '', '## Claims', '', '| Status | Score | +/-/? | Check | Citations | Claim |', '|---|---:|---|---|---|---|']) line
 union all select '| **' || upper(status) || '** | ' || {_score} || ' | +' || n_support || '/-' || n_refute || '/?' || n_uncertain || ' | ' || case when passed is null then '—' when passed then 'pass' else '**FAIL**' end || ' | '
  || case when citations_total = 0 then '—' else coalesce(citations_verified::varchar, '?') || '/' || citations_total end || ' | claim ' || claim_id || ' |' from scored
 union all select unnest(['', '### [' || upper(status) || '] claim ' || claim_id, '', 'Consensus ' || {_score}, '', '| Panelist | Round | Verdict | Conf. |', '|---|---|---|---:|']) from scored
 union all select '| ' || panelist || ' | ' || round || ' | ' || coalesce(verdict, 'discarded') || ' | ' || coalesce({_two('confidence')}, '?') || ' |' from votes""")
def _(t: Tables):
    return _written(t, artefacts.report(t.scored, t.votes))


@query("sink_ledger_md", f"""with f as (select 'claim ' || claim_id fact, 'claims' source, case status when 'validated' then 'verified' when 'refuted' then 'refuted' else 'asserted' end status from scored
 union all select 'citation ' || citation, 'evidence', case when verified then 'verified' else 'refuted' end from citations
 union all select 'on topic ' || citation, 'relevance', case when relevant then 'verified' when not relevant then 'refuted' else 'not_run' end from citations where verified
 union all select 'check ' || claim_id, 'checks', case when passed then 'verified' when not passed then 'refuted' else 'inconclusive' end from checks), n as (select status, count(*) n from f group by 1)
select unnest(['# Verifiable facts', '', '| | count |', '|---|---:|']) line union all select '| **' || status || '** | ' || n || ' |' from n union all select unnest(['', '## ' || status || ' (' || n || ')', '']) from n union all select unnest(['**' || fact || '**', '- *From:* `' || source || '`']) from f""")
def _(t: Tables):
    return _written(t, artefacts.ledger(ledger.facts(t.scored, t.citations, t.checks), ledger.place("status")))


@query("sink_petals_md", f"""with v as {_verified} select unnest(['# Passages', '', '## Not used', '']) line union all select unnest(['## ' || section, '']) from (select distinct section from v where coalesce(verified, true))
 union all select unnest(['**' || kind || '**' || case when verified is null then '  **[needs author confirmation]**' else '' end, '> ' || regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '*Anchor (' || anchor_kind || '):* ' || regexp_replace(anchor, '[\\r\\n]+', ' ', 'g'), '']) from v where coalesce(verified, true)
 union all select '- ~~' || regexp_replace(left(text, 110), '[\\r\\n]+', ' ', 'g') || '~~ (' || kind || ')' from v where not coalesce(verified, true)""")
def _(t: Tables):
    claims = t.petals.select("set_id", F.col("text").alias("claim"))
    return _written(t, artefacts.petals(petals.verify(t.petals, claims)))


_findings = "(select case when p_size % 2 = 0 then 'reviewer' else 'statistician' end role, case when p_size > 45 then 'blocking' when p_size > 25 then 'major' else 'minor' end severity, p_type location, p_name finding from part)"


@query("sink_review_md", f"""with f as {_findings} select unnest(['# Independent review', '', '## Where they agree', '']) line union all select unnest(['## ' || role || ': ' || severity || ' (' || count(*) || ')', '']) from f group by role, severity
 union all select unnest(['**' || location || '**', '> ' || finding]) from f union all select '- `' || left(lower(location), 40) || '`' from f where location <> '' group by left(lower(location), 40) having count(distinct role) > 1""")
def _(t: Tables):
    size = F.col("p_size")
    findings = t("part").select(F.when(size % 2 == 0, "reviewer").otherwise("statistician").alias("role"), F.when(size > 45, "blocking").when(size > 25, "major").otherwise("minor").alias("severity"), F.col("p_type").alias("location"), F.col("p_name").alias("finding"))
    return _written(t, artefacts.review(findings))


@query("sink_petals", f"select petal_id, set_id, kind, verified, verified is null needs_author, 's' || set_id % 2 as \"session\" from {_verified}")
def _(t: Tables):
    # Two sessions propose passages; the first is saved twice, as after a failure.
    path = store.scratch(t.spark, "petals")
    verified = evidence.kept(petals.verify(t.petals, t.petals.select("set_id", F.col("text").alias("claim"))).select("petal_id", "set_id", "kind", "verified"), "verified")
    for k in (0, 1, 0):
        petals.save(verified.where(F.col("set_id") % 2 == k), path, f"s{k}")
    return petals.saved(t.spark, path)


@query("sink_council", """select 'arguments' tab, stance "key", count(*) n, round(sum(strength), 3) total from (select 'pro' stance, k / 1000 strength from reviews union all select 'contra', (105 - k) / 1000 from reviews) group by 2
 union all select 'claims', status, count(*), round(sum(score), 3) from scored group by 2 union all select 'calibration', panelist, 1, round(weight, 3) from weights""")
def _(t: Tables):
    # A session is stored twice, the second time with its claims settled: claims are upserted, arguments kept with the discarded ones.
    spoken = t.reviews.withColumn("pro", F.expr("repeat('p', k)")).withColumn("contra", F.expr("concat(repeat(' ', 5), repeat('c', 100 - k))"))
    path = store.scratch(t.spark, "council")
    store.write_index(path, claims=t.scored.select("claim_id", F.lit("open").alias("status"), F.lit(0.0).alias("score")))
    settled = council.upserted(store.read_index(t.spark, path)["claims"], t.scored.select("claim_id", "status", "score"), "claim_id")
    store.write_index(path, claims=settled, arguments=council.arguments(spoken), calibration=t.weights)
    kept = store.read_index(t.spark, path)
    total = lambda c: F.round(F.sum(c), 3).alias("total")
    return artefacts.union(
        kept["arguments"].groupBy(F.col("stance").alias("key")).agg(F.count("*").alias("n"), total("strength")).select(F.lit("arguments").alias("tab"), "key", "n", "total"),
        kept["claims"].groupBy(F.col("status").alias("key")).agg(F.count("*").alias("n"), total("score")).select(F.lit("claims").alias("tab"), "key", "n", "total"),
        kept["calibration"].groupBy(F.col("panelist").alias("key")).agg(F.count("*").alias("n"), total("weight")).select(F.lit("calibration").alias("tab"), "key", "n", "total"),
    )


@query("fmt_assembly_record", """select source || ':' || doc_id seat, source || ':' || doc_id || ' — ' || upper(lang) || printf(' (confidence %.2f)', 0.5) || chr(10) || '  PRO: ' || left(text, 400) || chr(10) || '  CONTRA: ' || left(reverse(text), 400)
 || case when doc_id % 3 = 0 then chr(10) || '  EMPHASIS: none declared' else chr(10) || '  EMPHASIS:' || chr(10) || '    foregrounds: ' || lang || chr(10) || '    sets aside: ' || case when doc_id % 3 = 1 then '(not declared)' else source end || chr(10) || '    reading: ' || left(text, 400) end
 || chr(10) || '  LENSES:' || chr(10) || '    [literal] ' || left(text, 300) || chr(10) || '    [?] (empty)' record from documents""")
def _(t: Tables):
    turn = F.col("doc_id") % 3
    lenses = F.array(F.struct(F.lit("literal").alias("kind"), F.col("text").alias("text")), F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text")))
    entries = t("documents").select(
        F.concat_ws(":", "source", "doc_id").alias("seat"), F.col("lang").alias("verdict"), F.lit(0.5).alias("confidence"), F.col("text").alias("pro"), F.reverse("text").alias("contra"), F.when(turn != 0, F.col("lang")).alias("foregrounds"),
        F.when(turn == 2, F.col("source")).alias("sets_aside"), F.col("text").alias("reading"), lenses.alias("lenses"))
    return artefacts.assembly_record(entries)


@query("fn_md_escape", "select page_id, replace(url, '|', '\\|') cell from pages")
def _(t: Tables):
    return t("pages").select("page_id", records.md_escape("url").alias("cell"))


@query("flt_not_null_blank", "select distinct l_shipdate is not null dated, trim(l_returnflag) flag from lineitem where trim(l_returnflag) <> ''")
def _(t: Tables):
    return t("lineitem").where(F.trim("l_returnflag") != "").select(F.col("l_shipdate").isNotNull().alias("dated"), F.trim("l_returnflag").alias("flag")).distinct()


_code = "(select item_id, case item_id % 4 when 0 then 'x <- system(1)' when 1 then 'result <- mean(x)' when 2 then 'quit(1); unlink(f)' else text end code from benchmark)"


def _codes(t: Tables):
    i = F.col("item_id") % 4
    return t("benchmark").select("item_id", F.when(i == 0, "x <- system(1)").when(i == 1, "result <- mean(x)").when(i == 2, "quit(1); unlink(f)").otherwise(F.col("text")).alias("code"))


@query("flt_code_screen", f"select item_id, item_id % 4 in (0, 2) denied from {_code}")
def _(t: Tables):
    return _codes(t).select("item_id", (replies.screen("code") != "").alias("denied"))


@query("fn_code_block", f"select item_id, case when item_id % 4 = 1 then code when item_id % 4 = 2 then 'x = 1' || chr(10) end block from {_code}")
def _(t: Tables):
    reply = F.when(F.col("item_id") % 4 == 2, F.lit("Here:\n```r\nx = 1\n```\ndone")).otherwise(F.col("code"))
    return _codes(t).select("item_id", replies.code_block(reply).alias("block"))


@query("fn_json_lenient", """select item_id, case item_id % 4 when 0 then '{"n":' || item_id || ',"status":"ok"}' when 1 then '{"note":"a\\nb' || item_id || '"}' when 3 then '{"a":[1,2],"b":' || item_id || '}' end json from benchmark""")
def _(t: Tables):
    # Valid JSON, a fenced block, a raw line break in a string within prose, and a reply without any.
    i, n = F.col("item_id") % 4, F.col("item_id").cast("string")
    text = F.when(i == 0, F.concat(F.lit('```json\n{"status": "ok", "n": '), n, F.lit("}\n```"))).when(i == 1, F.concat(F.lit('Sure: {"note": "a\nb'), n, F.lit('"} there'))).when(i == 3, F.concat(F.lit('{"b": '), n, F.lit(', "a": [1, 2]}'))).otherwise(F.lit("no json at all"))
    return replies.parse_replies(t("benchmark").select("item_id", text.alias("reply")), "item_id", "reply")


@query("fn_split_seat", "select p_partkey, split_part(p_brand || '/' || p_name, '/', 1) provider, p_name model from part")
def _(t: Tables):
    provider, model = replies.split_seat(F.concat_ws("/", "p_brand", "p_name"))
    return t("part").select("p_partkey", provider.alias("provider"), model.alias("model"))


def _answer(prompt: str) -> str:
    """A provider that runs on the workers: it counts words, has no answer for some prompts and fails on others."""
    if len(prompt) % 5 == 0:
        raise ConnectionError(prompt[:20])
    return "" if len(prompt) % 5 == 1 else f'{{"words": {len(prompt.split())}}}'


@query("scan_llm", """select item_id, length(text) % 5 > 1 ok, case when length(text) % 5 > 1 then '{"words":' || len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) || '}' end json, case length(text) % 5 when 0 then 'ConnectionError' when 1 then 'empty completion' end error from benchmark""")
def _(t: Tables):
    rows = replies.called(t("benchmark").select("item_id", F.col("text").alias("prompt")), _answer, "item_id")
    return rows.join(replies.parse_replies(rows, "item_id", "text"), "item_id").select("item_id", "ok", "json", "error")


@query("adp_providers", "select item_id, item_id % 2 = 0 ok, case when item_id % 2 = 0 then 'reply to ' || text end reply from benchmark")
def _(t: Tables):
    # Replies that a provider has left as a table.
    prompts = t("benchmark").select("item_id", F.col("text").alias("prompt"))
    known = prompts.where("item_id % 2 = 0").select("item_id", F.concat(F.lit("reply to "), "prompt").alias("reply"))
    return replies.table_backed(prompts, known, "item_id").select("item_id", "ok", "reply")


@query("prm_prompts", "select doc_id, 'Question from ' || source || ' (' || lang || '):' || chr(10) || coalesce(text, '') || chr(10) || 'Answer in JSON.' prompt from documents")
def _(t: Tables):
    return t("documents").select("doc_id", replies.prompt("Question from {source} ({lang}):\n{text}\nAnswer in JSON.", source="source", lang="lang", text="text").alias("prompt"))


_replied = "(select claim_id, claim_id % 5 k, status from claims)"


@query("adp_local_verdict", f"select claim_id, case when k in (0, 1) and status in ('CONFIRMED', 'REFUTED', 'UNSUPPORTED') then status else 'UNSUPPORTED' end verdict, case k when 2 then 'no answer' when 3 then 'no JSON' when 4 then 'no such verdict' else case when status in ('CONFIRMED', 'REFUTED', 'UNSUPPORTED') then case k when 1 then 'claim ' || claim_id end else 'no such verdict' end end note from {_replied}")
def _(t: Tables):
    # A judge that answers in JSON, in JSON within prose, not at all, in words, and with a verdict of its own.
    k, n = F.col("claim_id") % 5, F.col("claim_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit('{"verdict": "'), F.lower("status"), F.lit('"}'))).when(k == 1, F.concat(F.lit('I say {"verdict": "'), "status", F.lit('", "note": "claim '), n, F.lit('"} of it'))).when(k == 3, "it is confirmed").when(k == 4, '{"verdict": "MAYBE"}')
    return replies.judged(t.claims.select("claim_id", (k != 2).alias("ok"), text.alias("text")), "claim_id", "text")


@query("adp_image_claims", """select item_id, 'part ' || item_id topic, cast(row_number() over (partition by item_id order by n) - 1 as integer) pos, l text from (select item_id, n, regexp_replace(trim(line), '^`+|`+$', '', 'g') l from benchmark_lines where trim(line) <> '') where length(l) >= 8 and not regexp_matches(l, '(?i)^(?:imports?\\b|includes?\\s+the\\b|this\\s+(?:line|statement)\\s+)')""")
def _(t: Tables):
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("- "), x))
    reply = F.concat(F.lit("TOPIC: part "), F.col("item_id").cast("string"), F.lit("\ntopic: another\n- imports a module of its own\n- short\n"), F.array_join(lines, "\n"))
    rows = replies.image_claims(t("benchmark").select(F.col("item_id").alias("key"), reply.alias("reply")))
    return rows.select(F.col("key").alias("item_id"), "topic", "pos", "text")


_first_pairs = "(select set_id, a, b from (select a.set_id, a.petal_id a, b.petal_id b, row_number() over (partition by a.set_id order by a.petal_id, b.petal_id) rn from petals a join petals b on a.set_id = b.set_id and a.petal_id < b.petal_id) where rn <= 12)"


@query("adp_tension", f"select set_id, a, b from {_first_pairs}")
def _(t: Tables):
    # Twelve pairs of each set are judged: that limit is the feature. Sets hold eight passages.
    return petals.first_pairs(t.petals)


@query("adp_tension_judged", f"select set_id, count(*) filter ((a + b) % 5 < 3) judged, count(*) filter ((a + b) % 5 >= 3) failed, count(*) filter ((a + b) % 5 = 1) \"found\", round(sum(case when (a + b) % 5 = 1 then a % 10 / 10.0 end), 6) severity, min(case when (a + b) % 5 = 1 then 'repetition' end) relation from {_first_pairs} group by 1")
def _(t: Tables):
    # A judge that finds nothing, a repetition, says nothing of a relation, answers in words, or doesn't answer.
    pairs, k = petals.first_pairs(t.petals), (F.col("a") + F.col("b")) % 5
    reply = F.when(k == 0, '{"relation": "none"}').when(k == 1, F.concat(F.lit('```json\n{"relation": "Repetition", "severity": '), (F.col("a") % 10 / 10).cast("string"), F.lit(', "why": "the same"}\n```'))).when(k == 2, "{}").when(k == 3, "they repeat")
    found, counts = petals.tension(pairs, pairs.select("a", "b", reply.alias("reply")).where(k != 4))
    by = found.groupBy("set_id").agg(F.count("*").alias("found"), F.round(F.sum("severity"), 6).alias("severity"), F.min("relation").alias("relation"))
    return counts.join(by, "set_id", "left").select("set_id", "judged", "failed", F.coalesce("found", F.lit(0)).alias("found"), "severity", "relation")


_needs = {"algeria": None, "brazil": "BRAZIL", "canada": "CANADA", "egypt": "EGYPT", "france": "FRANCE"}


@query("adp_seats", """select pos, seat, provider, model from (values (0, 'brazil', 'brazil', null, 'BRAZIL'), (1, 'canada/big-2', 'canada', 'big-2', 'CANADA'), (3, 'egypt/small', 'egypt', 'small', 'EGYPT'), (4, 'algeria', 'algeria', null, null), (5, 'france', 'france', null, 'FRANCE')) s(pos, seat, provider, model, need)
 where need is null or need in (select n_name from nation where n_regionkey <> 3)""")
def _(t: Tables):
    # Nations as settings: those of one region are blank.
    settings = t("nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 3, "set").otherwise(" ").alias("value"))
    return replies.available_seats("brazil, canada/big-2, nobody, egypt/small, algeria, france", settings, _needs)


@query("src_find_transcript", "select user_id, arg_max(event_id, ts) latest from (select user_id, event_id, (ts, event_id) ts from events) group by 1")
def _(t: Tables):
    return t("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("fn_is_image", "select page_id, regexp_matches(lower(path), '\\.(png|jpg|jpeg|webp|gif|bmp|tiff)$') image from files")
def _(t: Tables):
    return t.files.select("page_id", paths.is_image("path").alias("image"))


@query("null_coalesce", "select doc_id, case when quality is null then 'none' else quality::varchar end quality, case when trim(split_part(text, chr(10), 2)) = '' then 'blank' else trim(split_part(text, chr(10), 2)) end line2 from documents left join labels using (doc_id)")
def _(t: Tables):
    rows = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    second = F.trim(F.get(F.split("text", "\n"), F.lit(1)))
    return rows.select("doc_id", records.or_default(F.col("quality").cast("string"), "none").alias("quality"), records.or_default(second, "blank").alias("line2"))


@query("agg_review", """select location, count(*) n, bool_or(blocking) blocking from (select distinct left(lower(p_type), 40) location, p_size % 2 role, p_size > 45 blocking from part) group by 1 having count(distinct role) = 2""")
def _(t: Tables):
    f = t("part").select(F.substring(F.lower("p_type"), 1, 40).alias("location"), (F.col("p_size") % 2).alias("role"), (F.col("p_size") > 45).alias("blocking")).distinct()
    return f.groupBy("location").agg(F.count("*").alias("n"), F.bool_or("blocking").alias("blocking"), F.countDistinct("role").alias("r")).where("r = 2").drop("r")


_have = "(select user_id, list_sort(list_intersect(['purchase', 'error', 'refund', 'click'], list(event_type))) have from events where user_id % 3 = 0 or event_type <> 'click' group by 1)"


def _installed(t: Tables):
    """What each user's environment has of the packages that are wanted."""
    wanted = F.array(*map(F.lit, ("purchase", "error", "refund", "click")))
    have = t("events").where("user_id % 3 = 0 or event_type <> 'click'").groupBy("user_id").agg(F.collect_set("event_type").alias("all"))
    return have.select("user_id", F.array_sort(F.array_intersect(wanted, "all")).alias("have"))


@query("set_zip_check", f"select user_id, array_to_string(have, ',') have from {_have}")
def _(t: Tables):
    return _installed(t).select("user_id", F.array_join("have", ",").alias("have"))


@query("adp_check_env", f"select user_id, case when len(have) = 0 then 'Base only; no further packages are installed.' else 'Base, and these packages: ' || array_to_string(have, ', ') || '.' end env from {_have}")
def _(t: Tables):
    return _installed(t).select("user_id", replies.environment("have").alias("env"))


@query("scan_env_file", "select r_regionkey, upper(replace(n_name, ' ', '_')) \"key\", n_nationkey::varchar \"value\" from nation join region on n_regionkey = r_regionkey union all select r_regionkey, 'KEPT', 'old' from region")
def _(t: Tables):
    # A settings file for each region: comments, quotes, and a key that is set already.
    line = F.concat(F.upper(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit(" = '"), F.col("n_nationkey").cast("string"), F.lit("'"))
    files = t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("l"))
    files = files.select(F.col("r_regionkey").cast("long").alias("r_regionkey"), F.encode(F.concat(F.lit("# settings\n\nKEPT=new\n"), "l"), "UTF-8").alias("content"))
    return docs.parsed(files, lambda data: list(docs.env_settings(data.decode(), {"KEPT": "old"}).items()), "key string, value string", "r_regionkey").drop("error")


@query("sink_atomic", "select count(*) n, cast(sum(r_regionkey) as bigint) total from region")
def _(t: Tables):
    # A rebuild that broke off before it was published is never read.
    path = store.scratch(t.spark, "atomic")
    store.write_index(path, rows=t("region").select("r_regionkey"))
    store.put(store.new_version(path), "rows", t("region").select("r_regionkey").limit(0))
    return store.read_index(t.spark, path)["rows"].agg(F.count("*").alias("n"), F.sum("r_regionkey").alias("total"))


@query("chart_consensus", "select claim_id, round(score, 6) score, status from scored order by score, claim_id")
def _(t: Tables):
    return t.scored.select("claim_id", F.round("score", 6).alias("score"), "status").orderBy("score", "claim_id")


@query("chart_calibration", "select panelist, weight, round(100.0 * n_correct / greatest(n_votes, 1), 6) acc from weights join prior using (panelist) order by weight, panelist")
def _(t: Tables):
    rows = t.weights.join(t.prior, "panelist")
    return rows.select("panelist", "weight", F.round(100.0 * F.col("n_correct") / F.greatest("n_votes", F.lit(1)), 6).alias("acc")).orderBy("weight", "panelist")


@query("scan_html", """select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) text from pages""")
def _(t: Tables):
    return t("pages").select("page_id", records.html_text("html").alias("text"))


@query("sink_index", "select 'claims' name, count(*) n from claims union all select 'keywords', count(*) from keywords union all select 'memos', count(distinct source) from claims")
def _(t: Tables):
    path = store.scratch(t.spark, "index")
    for _ in range(2):  # a rebuild replaces the index as a whole
        store.write_index(path, claims=t.claims, keywords=t.stored, memos=t.claims.select("source").distinct())
    out = None
    for name, df in store.read_index(t.spark, path).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_sqlite_index", "select claim_id, status from claims where status = 'CONFIRMED'")
def _(t: Tables):
    return t.index["claims"].where("status = 'CONFIRMED'").select("claim_id", "status")


@query("scan_council_store", "select claim_id, panelist, verdict from votes")
def _(t: Tables):
    path = store.scratch(t.spark, "council")
    store.write_index(path, verdicts=t.votes.select("claim_id", "panelist", "verdict"))
    return store.read_index(t.spark, path)["verdicts"]


@query("sink_handoff", """with u as (select max(event_id) tokens from events), c as (select count(*) n, count(*) filter (status in ('NEEDS_AGENT', 'PENDING')) p, count(distinct source) s from claims)
select unnest(['# Handoff', '']) line union all select '- context: ' || tokens || ' of 200000 tokens (' || printf('%.1f', round(100.0 * tokens / 200000, 1)) || '%)' from u
 union all select unnest(['- claims: ' || n || ' from ' || s || ' source(s)', case when p > 0 then '- still to check: ' || p else '- nothing left to check' end]) from c union all select '- ' || status || ': ' || count(*) from claims group by status""")
def _(t: Tables):
    usage = t("events").agg(F.max("event_id").alias("context_tokens")).withColumn("window", F.lit(200_000))
    return _written(t, artefacts.handoff(t.claims, usage))


_results = """(select page_id endpoint, page_id % 3 <> 0 passed, case when page_id % 3 = 0 then 'REFUTED' else 'CONFIRMED' end verdict, est_tokens without_, cast(length(path) // 4 + 12 as bigint) with_ from files)"""
_saved = f"(select count(*) total, count(*) filter (passed) passed, cast(sum(case when passed then without_ else 0 end) as bigint) without_, cast(sum(case when passed then with_ else 0 end) as bigint) with_ from {_results})"


@query("sink_bench", f"""with s as (select *, round(100.0 * (without_ - with_) / without_, 1) pct from {_saved})
select 'results.json' name, '{{"endpoint":' || endpoint || ',"verdict":"' || verdict || '","passed":' || passed || ',"without":' || without_ || ',"with_":' || with_ || '}}' line from {_results}
 union all select 'results.json', '{{"total":' || total || ',"passed":' || passed || ',"without":' || without_ || ',"with_":' || with_ || ',"pct":' || pct || '}}' from s
 union all select 'RESULTS.md', unnest(['# Benchmark', '', '| endpoint | verdict | without | with |', '|---|---|---:|---:|']) union all select 'RESULTS.md', '| ' || endpoint || ' | ' || verdict || ' | ' || without_ || ' | ' || with_ || ' |' from {_results}
 union all select 'RESULTS.md', unnest(['', 'passed: ' || passed || ' of ' || total || '; saved: ' || printf('%.1f', pct) || '%']) from s""")
def _(t: Tables):
    # Files as endpoints: a third of them fail; a hit costs what its path does, without the index it is the file.
    passed = F.col("page_id") % 3 != 0
    cost = (F.floor(F.length("path") / 4) + 12).cast("long")
    results = t.files.select(F.col("page_id").alias("endpoint"), F.when(passed, "CONFIRMED").otherwise("REFUTED").alias("verdict"), passed.alias("passed"), F.col("est_tokens").alias("without"), cost.alias("with_"))
    path = store.scratch(t.spark, "bench")
    artefacts.write_text(artefacts.bench(results), path)
    return artefacts.read_text(t.spark, path)


_colours = {"validated": "#1a9850", "refuted": "#d73027", "contested": "#f0a202", "unresolved": "#9e9e9e"}
_colour_sql = "case status " + " ".join(f"when '{k}' then '{v}'" for k, v in _colours.items()) + " end"
_open_svg, _close_svg = '<svg xmlns="http://www.w3.org/2000/svg" width="760" font-size="12">', "</svg>"


def _bars_sql(source: str, label: str, size: str, order: str, colour: str) -> str:
    """The lines of a chart of bars, with their place."""
    short = "case when length(label) > 46 then left(label, 43) || '...' else label end"
    return f"""(select -1 y, '{_open_svg}' line union all select y, '<rect x="300" y="' || y || '" width="' || width || '" height="16" fill="' || colour || '"/><text x="0" y="' || (y + 13) || '">' || replace(replace({short}, '&', '&amp;'), '<', '&lt;') || '</text>'
 from (select *, (row_number() over (order by ord, label) - 1) * 20 y from (select {label} label, cast(round(abs({size}) * 400) as bigint) width, {order} ord, {colour} colour from {source})) union all select 1000000000, '{_close_svg}')"""


_chart_sql = {
    "consensus": _bars_sql("scored", "'claim ' || claim_id", "score", "round(score, 9)", _colour_sql),
    "votes": _bars_sql("(select claim_id, verdict, count(*) n from votes group by all)", "'claim ' || claim_id || ' ' || verdict", "n / 20", "cast(n as double)", "'#3b78b0'"),
    "calibration": _bars_sql("weights", "panelist", "weight / 2", "round(weight, 9)", "'#3b78b0'"),
    "citations": _bars_sql("(select case when not verified then 'does not resolve' when relevant is null then 'resolves, not judged' when relevant then 'resolves, on topic' else 'resolves, off topic' end class, count(*) / (select count(*) from citations) share from citations group by 1)", "class", "share", "share", "'#3b78b0'"),
}


def _charts(t: Tables) -> dict:
    """The four charts by name, as functions of the name, so that one that fails doesn't sink the others."""
    claim = F.concat(F.lit("claim "), F.col("claim_id").cast("string"))
    total = lambda: t.citations.count()
    return {
        "consensus": lambda n: artefacts.bars(t.scored, claim, F.col("score"), F.round("score", 9), paths.lookup("status", _colours, "#000000"), n),
        "votes": lambda n: artefacts.bars(t.votes.groupBy("claim_id", "verdict").agg(F.count("*").alias("n")), F.concat(claim, F.lit(" "), "verdict"), F.col("n") / 20, F.col("n").cast("double"), "#3b78b0", n),
        "calibration": lambda n: artefacts.bars(t.weights, F.col("panelist"), F.col("weight") / 2, F.round("weight", 9), "#3b78b0", n),
        "citations": lambda n: artefacts.bars(t.citations.groupBy(evidence.citation_class("verified", "relevant").alias("class")).agg((F.count("*") / total()).alias("share")), F.col("class"), F.col("share"), F.col("share"), "#3b78b0", n),
    }


@query("sink_charts", " union all ".join(f"select '{n}' chart, line from {q}" for n, q in _chart_sql.items()) + " union all select 'broken', 'AnalysisException'")
def _(t: Tables):
    path = store.scratch(t.spark, "charts")
    makers = _charts(t) | {"broken": lambda n: artefacts.bars(t.weights, F.col("no_such_column"), F.lit(1), F.lit(1.0), "#000000", n)}
    made = artefacts.charts(makers, path)
    drawn = [artefacts.read_text(t.spark, f"{path}/{n}").select(F.col("name").alias("chart"), "line") for n, error in made.items() if not error]
    failed = t.spark.createDataFrame([(n, e) for n, e in made.items() if e], "chart string, line string")
    return artefacts.union(*drawn, failed)


@query("sink_html", f"""with k as (select count(*) n, count(*) filter (status = 'validated') v, avg(score) m from scored),
 svg as (select string_agg(line, chr(10) order by y) s from {_chart_sql['calibration']})
select unnest(['<!doctype html><html><head><meta charset=''utf-8''><title>Statistical report</title></head><body>', '<h1>Statistical report</h1>', '<table><tr><th>status</th><th>n</th><th>mean</th></tr>', '</table>', '</body></html>']) line
 union all select unnest(['<div class=''kpi''><b>' || n || '</b> claims</div>', '<div class=''kpi''><b>' || v || '</b> validated</div>', '<div class=''kpi''><b>' || printf('%.2f', round(m, 2)) || '</b> mean consensus</div>']) from k
 union all select '<tr><td>' || status || '</td><td>' || count(*) || '</td><td>' || printf('%.2f', round(avg(score), 2)) || '</td></tr>' from scored group by status
 union all select '<img alt=''calibration'' src=''data:image/svg+xml;base64,' || to_base64(encode(s)) || chr(39) || '/>' from svg""")
def _(t: Tables):
    mean = records.two_places(F.avg("score"))
    totals = t.scored.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "validated").alias("v"), mean.alias("m"))
    rows = t.scored.groupBy("status").agg(F.count("*").alias("n"), mean.alias("mean"))
    figure = _charts(t)["calibration"]("calibration")
    return _written(t, artefacts.page("Statistical report", {"claims": F.col("n"), "validated": F.col("v"), "mean consensus": F.col("m")}, totals, rows, {"calibration": figure}))


@query("fn_norm_slug", "select doc_id, 'q' || left(sha1(source || '|' || lang || '|' || doc_id), 10) id from documents")
def _(t: Tables):
    return t("documents").select("doc_id", records.short_id("q", "source", "lang", F.col("doc_id").cast("string")).alias("id"))


@query("adp_review_role", "select claim_id, arg_min(panelist, case panelist when 'p3' then 0 when 'p1' then 1 else 9 end) seat from (select claim_id, panelist from votes where panelist in ('p1', 'p3')) group by 1")
def _(t: Tables):
    rank = F.when(F.col("panelist") == "p3", 0).when(F.col("panelist") == "p1", 1)
    return t.votes.where(rank.isNotNull()).groupBy("claim_id").agg(F.min_by("panelist", rank).alias("seat"))


@query("adp_specialist", """select case when length(label) > 58 then left(label, 55) || '...' else label end "label", status, case when status in ('CONFIRMED', 'validated') then 'green' when status in ('REFUTED', 'refuted') then 'red' else 'grey' end colour, score
 from (select source || ' ' || text "label", status, cast(case when claim_id % 4 in (0, 1) then claim_id % 100 / 100.0 end as double) score from claims union all select 'claim ' || claim_id, status, round(score, 6) from scored)""")
def _(t: Tables):
    # Programs that compute a score each: the last line of JSON counts; some print none. The claims of the votes have their consensus.
    k, n = F.col("claim_id") % 4, (F.col("claim_id") % 100 / 100).cast("string")
    stdout = F.when(k == 0, F.concat(F.lit('loading\n{"score": '), n, F.lit("}"))).when(k == 1, F.concat(F.lit('{"score": 5}\n {"score": '), n, F.lit("}\n{broken\nbye"))).when(k == 2, "no result")
    computed = t.claims.select(F.concat_ws(" ", "source", "text").alias("label"), "status", F.get_json_object(replies.last_json(stdout), "$.score").cast("double").alias("score"))
    voted = t.scored.select(F.concat(F.lit("claim "), F.col("claim_id").cast("string")).alias("label"), "status", F.round("score", 6).alias("score"))
    return artefacts.consensus_bars(computed.unionByName(voted), "label", {"CONFIRMED": "green", "validated": "green", "REFUTED": "red", "refuted": "red"}, "grey")


@query("adp_env_lookup", """select c_custkey, case c_mktsegment when 'BUILDING' then 'r-stats' when 'MACHINERY' then 'figures' else 'r-stats' end env from customer""")
def _(t: Tables):
    # One environment is there without the execute bit, so that its role falls back to the default's.
    installed = t.spark.createDataFrame([("r-stats", True), ("figures", True), ("half-made", False)], "env string, executable boolean")
    roles = t("customer").select("c_custkey", F.col("c_mktsegment").alias("role"))
    return paths.environments(roles, {"BUILDING": "r-stats", "MACHINERY": "figures", "AUTOMOBILE": "half-made", "default": "r-stats"}, installed, "Rscript").select("c_custkey", "env")


RELATIONS["bench_claims"] = "select item_id claim_id, text from benchmark"
RELATIONS["bench_words"] = RELATIONS["kw_words"].replace("from claims", "from bench_claims")
RELATIONS["bench_kw"] = RELATIONS["keywords"].replace("kw_words", "bench_words")


@query("run_bench_pipeline", """with s as (select b.claim_id item_id, k.claim_id, round(sum(round(k.weight * (0.4 + idf), 3)), 6) s from bench_kw b join keywords k using (keyword) join idf using (keyword) group by all),
 top as (select item_id, claim_id from (select *, row_number() over (partition by item_id order by s desc, claim_id) rn from s) where rn <= 3),
 g as (select item_id, bool_or(contains(lower(c.text), lower(b.text))) ok, cast(sum(length(c.text) // 4 + 12) as bigint) cost from top join claims c using (claim_id) join benchmark b using (item_id) group by 1)
select item_id, case when ok then 'CONFIRMED' when ok is null then 'no claim returned' else 'REFUTED' end verdict, coalesce(cost, 0) cost from benchmark left join g using (item_id)""")
def _(t: Tables):
    # Each endpoint asks the stored index for three claims, which are graded against what it expects, and cost their tokens.
    items = t("benchmark").select("item_id", "text")
    top = index.best_by_keywords(t.index, items.select(F.col("item_id").alias("claim_id"), "text"), 3).withColumnRenamed("question_id", "item_id")
    met = top.join(t.claims.select("claim_id", F.col("text").alias("found")), "claim_id").join(items, "item_id")
    graded = met.groupBy("item_id").agg(F.bool_or(F.lower("found").contains(F.lower("text"))).alias("ok"), F.sum(F.floor(F.length("found") / 4).cast("long") + 12).alias("cost"))
    verdict = F.when(F.col("ok"), "CONFIRMED").when(F.col("ok").isNull(), "no claim returned").otherwise("REFUTED")
    return items.join(graded, "item_id", "left").select("item_id", verdict.alias("verdict"), F.coalesce("cost", F.lit(0)).alias("cost"))


@query("fn_lenses", "select claim_id, cast(case when utility >= 0.7 then 3 when utility >= 0.4 then 2 else 1 end as integer) n from indexed where status = 'NEEDS_AGENT'")
def _(t: Tables):
    u = F.col("utility")
    return t.indexed.where("status = 'NEEDS_AGENT'").select("claim_id", F.when(u >= 0.7, 3).when(u >= 0.4, 2).otherwise(1).alias("n"))


# Generic relational forms.
@query("rel_pricing", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) disc, min(l_tax) low, max(l_tax) high, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def _(t: Tables):
    li = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high"), F.count("*").alias("n"))


@query("rel_having", "select c_nationkey, count(*) n from customer group by 1 having count(*) > 50")
def _(t: Tables):
    return t("customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n > 50")


@query("rel_inner_join", "select c_mktsegment, count(*) n, round(sum(o_totalprice), 2) total from orders join customer on o_custkey = c_custkey group by 1")
def _(t: Tables):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("rel_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def _(t: Tables):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("rel_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def _(t: Tables):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("rel_correlated_max", "select o_custkey, o_orderkey from orders o where o_totalprice = (select max(o_totalprice) from orders i where i.o_custkey = o.o_custkey)")
def _(t: Tables):
    o = t("orders")
    best = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    return o.join(best, ["o_custkey", "o_totalprice"]).select("o_custkey", "o_orderkey")


@query("rel_left_default", "select s_suppkey, coalesce(n_name, 'nowhere') nation from supplier left join (select * from nation where n_nationkey > 5) on s_nationkey = n_nationkey")
def _(t: Tables):
    n = t("nation").where("n_nationkey > 5")
    return t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("nowhere")).alias("nation"))


@query("rel_order_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def _(t: Tables):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("rel_like", "select p_partkey from part where p_name like '%a%'")
def _(t: Tables):
    return t("part").where(F.col("p_name").like("%a%")).select("p_partkey")


@query("rel_upsert", "select c_custkey, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end bal from customer")
def _(t: Tables):
    old = t("customer").select("c_custkey", F.col("c_acctbal").alias("bal"), F.lit(0).alias("seq"))
    new = old.where("c_custkey % 3 = 0").select("c_custkey", (F.col("bal") + 1).alias("bal"), F.lit(1).alias("seq"))
    return old.unionByName(new).groupBy("c_custkey").agg(F.max_by("bal", "seq").alias("bal"))
