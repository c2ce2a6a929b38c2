"""Document readers: bytes to records, with the standard library. Each takes a table of (path, content) and returns rows of records.

Word, PowerPoint and Excel files are zip archives of XML, which the standard library parses; PDF files have a reader of their own (pdf).
OpenDocument texts and sheets are zip archives, too; binary Office files have readers of their own (legacy). OCR and rasterising are outside of Spark's reach; their adapters take the converted text as a table.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def binary_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files under root whose names match."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


def _number(name: str) -> int:
    return int(re.sub(r"\D", "", name) or 0)


def _style_names(z: zipfile.ZipFile) -> dict[str, str]:
    """Style names by id: ids differ between languages, names don't."""
    if "word/styles.xml" not in z.namelist():
        return {}
    out = {}
    for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
        name = style.find(f"{W}name")
        if name is not None:
            out[style.get(f"{W}styleId")] = name.get(f"{W}val") or ""
    return out


def docx_blocks(data: bytes) -> list[tuple[str, int | None, str]]:
    """(kind, level, text): headings, list items and paragraphs in order, blank ones dropped, then tables row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = _style_names(z)
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out: list[tuple[str, int | None, str]] = []
    for p in body.findall(f"{W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{W}t")).strip()
        if not text:
            continue
        style = p.find(f"{W}pPr/{W}pStyle")
        own = (style.get(f"{W}val") if style is not None else "") or ""
        name = names.get(own, own).lower()
        heading = re.match(r"heading\s*(\d+)", name)
        out.append(("heading", int(heading[1]), text) if heading else ("list" if "list" in name else "para", None, text))
    for table in body.findall(f"{W}tbl"):
        for row in table.findall(f"{W}tr"):
            out.append(("row", None, "\t".join("".join(t.text or "" for t in c.iter(f"{W}t")).strip() for c in row.findall(f"{W}tc"))))
    return out


def docx_comments(data: bytes) -> list[tuple[str, str, str]]:
    """(author, date, text)"""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "word/comments.xml" not in z.namelist():
            return []
        root = ElementTree.fromstring(z.read("word/comments.xml"))
    return [(c.get(f"{W}author") or "", c.get(f"{W}date") or "", "".join(t.text or "" for t in c.iter(f"{W}t"))) for c in root.findall(f"{W}comment")]


def pptx_slides(data: bytes) -> list[tuple[int, str, str]]:
    """(slide, text, notes): joined text of a slide's paragraphs that are not blank."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
        for n in slides:
            parts = []
            for name in (n, f"ppt/notesSlides/notesSlide{_number(n)}.xml"):
                texts = []
                if name in names:
                    for p in ElementTree.fromstring(z.read(name)).iter(f"{A}p"):
                        text = "".join(t.text or "" for t in p.iter(f"{A}t")).strip()
                        if text:
                            texts.append(text)
                parts.append("\n".join(texts))
            out.append((_number(n), parts[0], parts[1]))
    return out


def _cell_place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def cell_text(value: str) -> str:
    """A number without a fraction as an integer."""
    try:
        number = float(value)
    except ValueError:
        return value
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else value


def trimmed(rows: list[list[str]]) -> list[list[str]]:
    """Without blank rows at the end, cut to the last column with text."""
    while rows and not any(c.strip() for c in rows[-1]):
        rows.pop()
    width = max((i + 1 for r in rows for i, c in enumerate(r) if c.strip()), default=0)
    return [r[:width] for r in rows]


def xlsx_rows(data: bytes, formulas: bool = False) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of all sheets as text; blank rows at the end are cut."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for i, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"), 1):
            target = targets.get(sheet.get(f"{R}id"), f"worksheets/sheet{i}.xml")
            grid: dict[int, dict[int, str]] = {}
            for c in ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter(f"{S}c"):
                row, column = _cell_place(c.get("r"))
                value, formula = c.find(f"{S}v"), c.find(f"{S}f")
                if formulas and formula is not None:
                    text = "=" + (formula.text or "")
                elif c.get("t") == "s":
                    text = shared[int(value.text)]
                elif c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{S}t"))
                else:
                    text = cell_text(value.text or "") if value is not None else ""
                grid.setdefault(row, {})[column] = text
            last = max(grid, default=-1)
            rows = trimmed([[grid.get(r, {}).get(k, "") for k in range(max(grid.get(r, {}), default=-1) + 1)] for r in range(last + 1)])
            out += [(sheet.get("name"), n, cells) for n, cells in enumerate(rows, 1)]
    return out


def rtf_text(data: bytes) -> str:
    """Text of an RTF file: groups of tables and pictures dropped, control words taken as white space where they break lines."""
    s = data.decode("latin-1")
    out: list[str] = []
    skip, stack = False, []
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", s):
        code, uni, word, _, sign, brace, text = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "generator") or sign == "*":
            skip = True
        elif skip:
            continue
        elif word in ("par", "line", "sect", "page"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif code:
            out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif uni:
            out.append(chr(int(uni) % 65536))
        elif sign in ("{", "}", "\\"):
            out.append(sign)
        elif sign == "~":
            out.append(" ")
        elif text:
            out.append(text)
    return "".join(out).strip()


def pdf_pages(data: bytes, layout: bool = False, spec: str | None = None) -> list[tuple[int, str | None, str | None]]:
    """(page, text, problem) of the pages that a specification chooses, or of all."""
    from . import pdf

    return pdf.pages(data, layout, spec)


def pdf_tables(data: bytes, spec: str | None = None) -> list[tuple[int, int, list[str]]]:
    """(page, row, cells)"""
    from . import pdf

    return pdf.tables(data, spec)


O = {k: f"{{urn:oasis:names:tc:opendocument:xmlns:{k}:1.0}}" for k in ("office", "text", "table")}


def _open_text(node) -> str:
    """Text of an OpenDocument paragraph: spaces, tabs and line breaks are elements there."""
    out = [node.text or ""]
    for child in node:
        if child.tag == f"{O['text']}s":
            out.append(" " * int(child.get(f"{O['text']}c") or 1))
        elif child.tag in (f"{O['text']}tab", f"{O['text']}line-break"):
            out.append("\t" if child.tag.endswith("tab") else "\n")
        else:
            out.append(_open_text(child))
        out.append(child.tail or "")
    return "".join(out)


def odt_blocks(data: bytes) -> list[tuple[str, int | None, str]]:
    """(kind, level, text) of an OpenDocument text, as docx_blocks gives them, in order of the document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("content.xml")).find(f"{O['office']}body/{O['office']}text")
    out: list[tuple[str, int | None, str]] = []

    def walk(node, kind: str) -> None:
        for child in node:
            if child.tag == f"{O['text']}h":
                block = ("heading", int(child.get(f"{O['text']}outline-level") or 1), _open_text(child).strip())
            elif child.tag == f"{O['text']}p":
                block = (kind, None, _open_text(child).strip())
            elif child.tag == f"{O['table']}table-row":
                block = ("row", None, "\t".join("\n".join(_open_text(p) for p in c.iter(f"{O['text']}p")).strip() for c in child))
            else:
                walk(child, "list" if child.tag == f"{O['text']}list" else kind)
                continue
            if block[2].strip():
                out.append(block)

    walk(body, "para")
    return out


def ods_rows(data: bytes, most: int = 1 << 20) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of an OpenDocument spreadsheet as text; repeated rows and cells are written out, blank ones at the ends cut.
    A repeat count above `most` that is not blank raises."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    out = []
    for sheet in root.iter(f"{O['table']}table"):
        rows: list[list[str]] = []
        blank = 0
        for row in sheet.iter(f"{O['table']}table-row"):
            cells: list[str] = []
            blanks = 0
            for cell in row:
                text = cell_text("\n".join(_open_text(p) for p in cell.iter(f"{O['text']}p")))
                times = int(cell.get(f"{O['table']}number-columns-repeated") or 1)
                if text:
                    if blanks + times > most:
                        raise ValueError("too many repeated cells")
                    cells += [""] * blanks + [text] * times
                    blanks = 0
                else:
                    blanks += times  # a row ends in very many of these
            times = int(row.get(f"{O['table']}number-rows-repeated") or 1)
            if not any(c.strip() for c in cells):
                blank += times  # a sheet ends in very many of these
                continue
            if times > most or blank > most:
                raise ValueError("too many repeated rows")
            rows += [[]] * blank + [cells] * times
            blank = 0
        out += [(sheet.get(f"{O['table']}name"), n, cells) for n, cells in enumerate(trimmed(rows), 1)]
    return out


def sheet_rows(data: bytes, spec: str) -> list[tuple[str, int, list[str]]]:
    """The rows of one sheet, by its place from 1 on or by its exact name; raises where there is none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")]
    if spec.isdigit():
        if not 1 <= int(spec) <= len(names):
            raise LookupError(f"no sheet {spec}")
        spec = names[int(spec) - 1]
    elif spec not in names:
        raise LookupError(f"no sheet {spec}")
    return [r for r in xlsx_rows(data) if r[0] == spec]


def parsed(files: DataFrame, reader: Callable[[bytes], list[tuple]], columns: str, key: str = "path") -> DataFrame:
    """(key, error, and the reader's columns): a row for each record, and one with an error for a file that cannot be read, so that one
    bad file does not sink the others."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"{key} {dict(files.dtypes)[key]}, error string, {columns}")
    out = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(k, None, *r) for r in reader(data)]
                except Exception as e:
                    rows.append((k, type(e).__name__, *[None] * (len(out) - 2)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return files.select(key, "content").mapInArrow(run, schema)


def delimited(lines: DataFrame, columns: int, separator: str = ",") -> DataFrame:
    """Cells c1..cn of lines (line), all strings, a byte order mark at the start stripped, ragged rows kept."""
    shape = ", ".join(f"c{i} string" for i in range(1, columns + 1))
    line = F.regexp_replace("line", "^\ufeff", "")
    rest = [c for c in lines.columns if c != "line"]
    return lines.withColumn("r", F.from_csv(line, F.lit(shape), {"sep": separator, "mode": "PERMISSIVE"})).select(*rest, "r.*")


def latex_body(s) -> Column:
    """The document's body, its title kept as a section."""
    s = F.col(s) if isinstance(s, str) else s
    title = F.regexp_extract(s, r"(?s)\\title\{([^}]*)\}", 1)
    body = F.regexp_extract(s, r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|$)", 1)
    kept = F.when(body != "", body).otherwise(s)
    return F.when((title != "") & (body != ""), F.concat(F.lit("\\section*{"), title, F.lit("}\n"), kept)).otherwise(kept)


def latex_outline(s) -> Column:
    """Section titles, indented by two for each level below the highest there is."""
    s = F.col(s) if isinstance(s, str) else s
    names = F.array(*map(F.lit, ("part", "chapter", "section", "subsection", "subsubsection", "paragraph")))
    pattern = r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^}]*)\}"
    pairs = F.arrays_zip(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(s, F.lit(pattern), F.lit(2)).alias("t"))
    levels = F.transform(pairs, lambda p: F.struct(F.array_position(names, p["k"]).cast("int").alias("l"), p["t"].alias("t")))
    least = F.array_min(F.transform(levels, lambda p: p["l"]))
    return F.array_join(F.transform(levels, lambda p: F.concat(F.repeat(F.lit("  "), p["l"] - least), p["t"])), "\n")


def env_settings(text: str, existing: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines, comments and blank lines skipped; settings that exist are kept."""
    out = dict(existing)
    for line in text.splitlines():
        key, sep, value = line.strip().partition("=")
        if sep and not key.startswith("#") and key.strip() not in out:
            out[key.strip()] = value.strip().strip("\"'")
    return out


def page_spec(spec, total: int) -> Column:
    """Sorted distinct 0-based pages of a specification such as 1-5,8,11- within a document of `total` pages."""
    spec = F.col(spec) if isinstance(spec, str) else spec
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d*-?\d*$") & (p != ""))

    def pages(p):
        lo = F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(1))
        hi = F.when(p.contains("-"), F.coalesce(F.regexp_extract(p, r"-(\d+)$", 1).try_cast("int"), F.lit(total))).otherwise(lo)
        lo, hi = F.greatest(lo, F.lit(1)), F.least(hi, F.lit(total))
        return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(parts, pages)), lambda x: x - 1)))
