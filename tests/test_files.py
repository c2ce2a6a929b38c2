"""Real files, lines in reach, tables anywhere in a document."""

import fnmatch
import os

import pytest
from pyspark.sql import functions as F

from factloom.functions import paths, records
from factloom.operators import anchors
from factloom.sources import files


def tree(tmp_path):
    root = tmp_path / "tree"
    for rel in ("a.md", "build/x.md", "src/a.py", "src/builder.py", "src/build/y.md", "src/deep/er/z.md", "docs/b c.md", "docs/[1].md", "gitx/.keep/q.md", "x.git/a.md"):
        at = root / rel
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(rel * 3)
    return root


def test_listing_and_patterns_are_those_of_the_file_system(spark, tmp_path):
    root = tree(tmp_path)
    listed = {r["rel"]: r["size"] for r in files.listing(spark, str(root)).collect()}
    want = {str(p.relative_to(root)): p.stat().st_size for p in root.rglob("*") if p.is_file() and not any(x.startswith(".") for x in p.relative_to(root).parts)}
    assert listed == want
    patterns = ["src/*.py", "**/*.md", "*.md", "docs/?[1]*", "docs/*", "src/**"]
    got = [(r["pattern"], r["rel"]) for r in files.included(files.listing(spark, str(root)), patterns).orderBy("pattern", "rel").collect()]
    seen, order = set(), []
    for n, p in enumerate(patterns):
        for at in sorted(str(x.relative_to(root)) for x in root.glob(p) if x.is_file()):
            if at in want and at not in seen:
                seen.add(at)
                order.append((n, at))
    assert got == sorted(order)


def excluded_plainly(rel, patterns):
    parts, name = rel.split("/"), rel.split("/")[-1]
    for p in filter(None, map(str.strip, patterns)):
        if fnmatch.fnmatchcase(rel, p) or fnmatch.fnmatchcase(name, p):
            return True
        top = next((p[: -len(s)] for s in ("/**", "/*", "/") if p.endswith(s)), p)
        if top and ("/" in top or set(top) & set("*?[")):
            if rel == top or rel.startswith(top + "/") or fnmatch.fnmatchcase(rel, top + "/*"):
                return True
        elif top and top in parts[:-1]:
            return True
    return False


def test_exclusions_hold_whole_segments(spark, tmp_path):
    found = files.listing(spark, str(tree(tmp_path)))
    for patterns in ([], ["build/*"], ["build"], ["src/build/**"], ["*.git/*"], ["src/d*"], ["b c.md", " ", "/"], ["*/deep"], ["docs/", "*.py"]):
        table = files.exclusions(spark, patterns)
        got = {r["rel"]: r["excluded"] for r in files.tagged(found, table).collect()}
        assert got == {rel: excluded_plainly(rel, patterns) for rel in got} and len(got) == 9, patterns
        columns = {r["rel"]: r["x"] for r in found.select("rel", paths.excluded("rel", patterns).alias("x")).collect()}
        assert columns == got


def test_newest_and_hinted(spark, tmp_path):
    root = tree(tmp_path)
    for n, rel in enumerate(("a.md", "src/a.py", "build/x.md")):
        os.utime(root / rel, (2_000_000_000 + n, 2_000_000_000 + n))
    listed = files.listing(spark, str(root))
    assert [r["rel"] for r in files.newest(listed, 3).collect()] == ["build/x.md", "src/a.py", "a.md"]
    assert files.find(listed).first()["rel"] == "build/x.md"
    assert files.find(listed, F.lit("er")).first()["rel"] == "src/deep/er/z.md" and files.find(listed, F.lit("z")).first()["rel"] == "src/deep/er/z.md"
    assert files.find(listed, F.lit("nothing")).first()["rel"] == "build/x.md"


def test_tails_read_the_ends_only(spark, tmp_path, monkeypatch):
    root = tmp_path / "t"
    root.mkdir()
    (root / "long.jsonl").write_bytes(b"x" * 5_000_000 + b"\nlast line\n")
    (root / "short.jsonl").write_bytes(b"one\n")
    (root / "none.jsonl").write_bytes(b"")  # empty files are not listed
    listed = files.listing(spark, str(root))
    ends = {r["rel"]: (bytes(r["content"]), r["cut"], r["read"]) for r in files.tails(str(root), listed, 100).collect()}
    assert ends == {"long.jsonl": (b"x" * 89 + b"\nlast line\n", True, 100), "short.jsonl": (b"one\n", False, 4)}
    monkeypatch.setattr(files, "_reads", lambda path: False)
    whole = {r["rel"]: (bytes(r["content"]), r["cut"], r["read"]) for r in files.tails(str(root), listed, 100).collect()}
    assert {k: v[:2] for k, v in whole.items()} == {k: v[:2] for k, v in ends.items()} and whole["long.jsonl"][2] == 5_000_011


def test_anchors_of_a_long_document(spark):
    """200,000 lines and as many anchors of one document: what meets is what is in reach, block by block."""
    n = 200_000
    lines = spark.range(1, n + 1).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("line_no"), F.concat(F.lit("this is the line of number "), F.col("id").cast("string"), F.lit(" .")).alias("line"))
    a = lines.select(F.col("line_no").alias("anchor_id"), "doc_id", F.col("line").alias("snippet"), (F.col("line_no") + F.when(F.col("line_no") % 2 == 0, 0).otherwise(50)).alias("cited"))
    got = {r["verdict"]: r["n"] for r in anchors.verdicts(a, lines).groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    assert got == {"CONFIRMED": n // 2, "DRIFTED": n // 2 - 25, "REFUTED": 25}
    plan = anchors.in_reach(a.withColumnRenamed("doc_id", "_doc"), F.col("cited") - 3, F.col("cited") + 3, lines)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "_block" in plan


def test_reach_is_the_range_join(spark):
    rows = spark.createDataFrame([(1, 1, -5, 3), (2, 1, 126, 130), (3, 1, 1, 400), (4, 2, 1, 9), (5, 1, 10, 9), (6, 3, 1, 9)], "k int, _doc int, lo int, hi int")
    lines = spark.range(1, 301).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("doc_id"), F.col("id").cast("int").alias("line_no"))
    got = {r["k"]: (r["n"], r["a"], r["b"]) for r in anchors.in_reach(rows, F.col("lo"), F.col("hi"), lines).groupBy("k").agg(F.count("*").alias("n"), F.min("line_no").alias("a"), F.max("line_no").alias("b")).collect()}
    assert got == {1: (3, 1, 3), 2: (5, 126, 130), 3: (300, 1, 300), 4: (9, 1, 9)}


def test_table_claims_anywhere(spark):
    body = ["text", "| a | b |", "|---|---|", "| 1 | `x` |", "| a | b |", "", "|--|", "| p | q |", "no table", "| lone | row |", "", "| k |  |", "|:-:|---|", "| 3 | 4 | 5 |", "| c | d |", "|---|---|", "| 6 | 7 |"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(body, 1)], "doc_id int, line_no int, line string")
    assert [tuple(r)[1:] for r in records.table_claims(lines).orderBy("line_no").collect()] == [(4, "a=1; b=x"), (8, "col1=p; col2=q"), (14, "k=3; col2=4; col3=5"), (17, "c=6; d=7")]


@pytest.mark.parametrize("lines", [[], ["one"], ["a" * 500, "wide \u0416\U0001f600" * 90, "caf\u00e9", ""], [f"line {i} " + "\u4e2d" * (i % 7) for i in range(900)]])
def test_old_sheets_and_texts_come_back(lines):
    """Short and long streams, strings that go on in a further record in either width, pieces of either width."""
    from factloom.plans.record_queries import _doc, _xls
    from factloom.sources import legacy

    assert [(s, n, [*c, ""][:2]) for s, n, c in legacy.xls_rows(_xls(lines))] == [("lines", i, [str(i), x]) for i, x in enumerate(lines, 1)]
    assert legacy.doc_text(_doc(lines)) == "\n".join(lines).strip()


def test_cells_of_old_sheets():
    import struct

    from factloom.plans.record_queries import _compound
    from factloom.sources import legacy as old

    record = lambda kind, fmt, *x: struct.pack("<HH", kind, struct.calcsize("<" + fmt)) + struct.pack("<" + fmt, *x)
    begin, end = record(old.BOF, "16s", b""), record(old.EOF, "")
    upper = struct.unpack("<Q", struct.pack("<d", 0.25))[0] >> 32
    sheet = b"".join([
        record(old.NUMBER, "HHHd", 0, 0, 0, 2.5), record(old.RK, "HHHI", 0, 1, 0, (-7 & 0x3FFFFFFF) << 2 | 2), record(old.RK, "HHHI", 0, 2, 0, 1234 << 2 | 3), record(old.RK, "HHHI", 0, 3, 0, upper),
        record(old.MULTIPLE_RK, "HHHIHIH", 1, 1, 0, 5 << 2 | 2, 0, 6 << 2 | 2, 2), record(old.BOOL_ERROR, "HHHBB", 1, 3, 0, 1, 0),
        # A chart of its own within the sheet, then formulas: a number, a string that follows, a truth value, an empty string.
        begin, record(old.NUMBER, "HHHd", 0, 0, 0, 99.0), end,
        record(old.FORMULA, "HHHdHI", 2, 0, 0, 3.0, 0, 0), record(old.FORMULA, "HHHB5sHHI", 2, 1, 0, 0, b"", 0xFFFF, 0, 0), record(old.STRING, "HB2s", 2, 0, b"ok"),
        record(old.FORMULA, "HHHBBB3sHHI", 2, 2, 0, 1, 0, 1, b"", 0xFFFF, 0, 0), record(old.LABEL, "HHHHB3s", 2, 3, 0, 3, 0, b"abc"),
    ])
    bound = lambda at: record(old.BOUND_SHEET, "IBBBB1s", at, 0, 0, 1, 0, b"S")
    book = begin + bound(len(begin + bound(0) + end)) + end + begin + sheet + end
    assert old.xls_rows(_compound({"Workbook": book})) == [("S", 1, ["2.5", "-7", "12.34", "0.25"]), ("S", 2, ["", "5", "6", "1"]), ("S", 3, ["3", "ok", "1", "abc"])]
    with pytest.raises(PermissionError):
        old.xls_rows(_compound({"Workbook": begin + record(old.FILE_PASS, "H", 1) + end}))
    for broken in (b"", b"PK", _compound({"Book": book}), _compound({"Workbook": book * 60})[:2000]):
        with pytest.raises(ValueError):
            old.xls_rows(broken)


def test_fields_of_old_texts():
    """Codes of fields go, their results stay; cells end in tabs; what follows the main text is no part of it."""
    from factloom.plans.record_queries import _doc
    from factloom.sources import legacy

    assert legacy.doc_text(_doc(['see \x13 HYPERLINK "x" \x14the \x13 REF y \x14link\x15\x15 here', "a\x07b\x07\x07", "caf\u00e9 \u2019"])) == "see the link here\na\tb\t\t\ncaf\u00e9 \u2019"
