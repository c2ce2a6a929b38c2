"""Anchors and chunks: line-anchored claims against their sources."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.text import col

NEAR, FAR, LEAST = 3, 60, 24
MOST_LINES, OVERLAP, TINY = 160, 15, 25
# Patterns of declarations, headings, tables, claims.
DECLARATION = r"^(?:export\s+)?(?:async\s+)?(?:def |class |function |const \w+\s*=\s*(?:async\s*)?\(|func |fn |type |interface |impl |struct |var |public |private |protected )"
HEADING = r"^#{1,6}\s+\S"
TABLE_ROW = r"^\s*\|.*\|\s*$"
TABLE_SEPARATOR = r"^\s*\|[\s:|-]+\|\s*$"
CLAIM = r"^- \[C(\d+)\] \[(\w+)\] (.*?) (?:@L(\d+) `([^`]*)`|@semantic L(\d+)-(\d+))\s*(?:<!--(.*)-->)?\s*$"
CLAIMISH = r"^- \[C\d+\]"


def verdicts(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """(anchor_id, verdict, found_line) for anchors (anchor_id, doc_id, snippet, cited) against lines (doc_id, line_no, line).

    Each anchor meets the lines of its own document within FAR lines of the cited one, by blocks of lines; the rest are
    conditional minima and counts over those. Far hits count only if the snippet is long and they are unique.
    """
    want = tx.norm_anchor("snippet")
    a = anchors.select("anchor_id", F.col("doc_id").alias("_doc"), "cited", want.alias("want"))
    size = lines.groupBy(F.col("doc_id").alias("_doc")).agg(F.max("line_no").alias("last"))
    normed = lines.select("doc_id", "line_no", tx.norm_anchor("line").alias("norm"))  # once a line, before lines meet anchors
    near = in_reach(a, F.col("cited") - FAR, F.col("cited") + FAR, normed).where(F.col("norm").contains(F.col("want")))
    away = F.abs(F.col("line_no") - F.col("cited"))
    hits = near.groupBy("anchor_id").agg(
        F.bool_or(away == 0).alias("exact"), F.min(F.when(away <= NEAR, F.col("line_no"))).alias("close"), F.count("*").alias("n"), F.min("line_no").alias("first")
    )
    rows = a.join(size, "_doc", "left").join(hits, "anchor_id", "left")
    inside = (F.col("cited") >= 1) & (F.col("cited") <= F.col("last"))
    unique = (F.length("want") >= LEAST) & (F.col("n") == 1)
    verdict = (
        F.when(F.col("want") == "", "REFUTED").when(F.col("last").isNull() | ~inside, "REFUTED").when(F.col("exact"), "CONFIRMED")
        .when(F.col("close").isNotNull(), "DRIFTED").when(unique, "DRIFTED").otherwise("REFUTED")
    )
    found = F.when(F.col("exact"), F.col("cited")).when(F.col("close").isNotNull(), F.col("close")).when(unique, F.col("first"))
    out = rows.select("anchor_id", verdict.alias("verdict"), found.cast("int").alias("found_line"))
    return out.withColumn("found_line", F.when(F.col("verdict") != "REFUTED", F.col("found_line")))


def sticky(verdict, marked) -> Column:
    """A claim that was marked as drifted stays so."""
    return F.when(col(marked) & col(verdict).isin("CONFIRMED", "DRIFTED"), "DRIFTED").otherwise(col(verdict))


def region(line, lo, hi, before: int = 8, after: int = 12) -> tuple[Column, Column]:
    """The lines to show for a claim: around its anchor, else its own region."""
    line = col(line)
    return F.when(line.isNotNull(), F.greatest(F.lit(1), line - before)).otherwise(col(lo)), F.when(line.isNotNull(), line + after).otherwise(col(hi))


def chunk_ranges(starts, n) -> Column:
    """Chunks (lo, hi) of n lines from sorted boundary lines: long runs are cut at MOST_LINES, then small neighbours are joined left to
    right while the whole stays within MOST_LINES. One fold over a document's boundaries."""
    starts, n = col(starts), col(n)
    first = F.when((F.size(starts) == 0) | (F.get(starts, F.lit(0)) != 1), F.concat(F.array(F.lit(1)), starts)).otherwise(starts)
    nexts = F.concat(F.transform(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), lambda x: x - 1), F.array(n))
    runs = F.arrays_zip(first.alias("s"), nexts.alias("e"))

    def cut(r):
        s, e = r["s"], r["e"]
        return F.transform(F.sequence(s, F.greatest(e, s), F.lit(MOST_LINES)), lambda x: F.struct(x.alias("lo"), F.least(e, x + MOST_LINES - 1).alias("hi")))

    pieces = F.filter(F.flatten(F.transform(runs, cut)), lambda p: p["hi"] >= p["lo"])
    shape = "array<struct<lo:int,hi:int>>"

    def step(acc, p):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (p["hi"] - last["lo"] + 1 <= MOST_LINES) & (p["hi"] - p["lo"] < TINY)
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(rest, F.array(F.struct(last["lo"].alias("lo"), p["hi"].alias("hi"))))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(F.transform(pieces, lambda p: F.struct(p["lo"].cast("int").alias("lo"), p["hi"].cast("int").alias("hi"))), F.array().cast(shape), step)


def boundaries(documents: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, lo, hi): runs of lines from each line that matches, and from the first one, to the line before the next."""
    lines = F.split("text", "\n")
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda x: x.isNotNull())
    first = F.array_distinct(F.concat(F.array(F.lit(1)), at))
    nexts = F.concat(F.transform(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), lambda x: x - 1), F.array(F.size(lines)))
    return documents.select("doc_id", F.inline(F.arrays_zip(first.alias("lo"), nexts.alias("hi"))))


def chunks(documents: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, lo, hi) of each document split at the lines that match."""
    lines = F.split("text", "\n")
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda x: x.isNotNull())
    return documents.select("doc_id", F.inline(chunk_ranges(at, F.size(lines))))


def generic_chunks(documents: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): windows of MOST_LINES lines that overlap."""
    n = F.size(F.split("text", "\n"))
    lo = F.explode(F.sequence(F.lit(1), n, F.lit(MOST_LINES - OVERLAP)))
    return documents.select("doc_id", n.alias("n"), lo.alias("lo")).select("doc_id", "lo", F.least(F.col("lo") + MOST_LINES - 1, "n").alias("hi"))


def table_cells(row) -> Column:
    inner = F.regexp_replace(F.trim(col(row)), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def table_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, sep, island, table, headless, header): the rows of the markdown tables among lines (doc_id, line_no, line), with
    each table's header row, null where it is headless. Tables are islands of piped lines, split at each separator.

    Everything is found by windows over one document's piped lines, which are one shuffle."""
    from pyspark.sql import Window

    rows = lines.where(F.col("line").rlike(TABLE_ROW)).select("doc_id", "line_no", "line", F.col("line").rlike(TABLE_SEPARATOR).alias("sep"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("island", F.col("line_no") - F.row_number().over(w))
    own = Window.partitionBy("doc_id", "island").orderBy("line_no")
    # A table starts at the row above its separator, or at a separator that opens the island; separators in a row are one table.
    first = F.row_number().over(own) == 1
    starts = F.coalesce(F.lead("sep").over(own), F.lit(False)) & ~F.col("sep") | F.col("sep") & first
    rows = rows.withColumn("table", F.sum(starts.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))).where("table > 0")
    whole = Window.partitionBy("doc_id", "island", "table")
    head = whole.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("headless", F.first("sep").over(head)).withColumn("header", F.when(~F.col("headless"), F.first("line").over(head)))
    kept = (F.count_if("sep").over(whole) > 0) & (F.count_if(~F.col("sep")).over(whole) >= F.when(F.col("headless"), 1).otherwise(2))
    return rows.withColumn("_kept", kept).where("_kept").drop("_kept")


def tables(lines: DataFrame) -> DataFrame:
    """(doc_id, lo, hi) of the markdown tables among lines (doc_id, line_no, line)."""
    return table_rows(lines).groupBy("doc_id", "island", "table").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi")).select("doc_id", "lo", "hi")


#: Lines in a block: what looks for lines near a place meets the one to three blocks that it can reach.
BLOCK = 128


def in_reach(rows: DataFrame, lo: Column, hi: Column, lines: DataFrame, doc: str = "_doc") -> DataFrame:
    """Rows with the lines (doc_id, line_no) of their document between lo and hi: an equi-join on document and block of lines, so that the
    work is that of what is in reach and a long document is dealt over many keys."""
    block = lambda c: F.floor(c / BLOCK).cast("long")
    low, high = F.greatest(lo, F.lit(0)), F.greatest(hi, F.lit(0))
    dealt = rows.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("_block", F.explode(F.sequence(block(low), block(high))))
    own = lines.withColumn("_at", block(F.col("line_no")))
    met = dealt.join(own, (F.col(doc) == F.col("doc_id")) & (F.col("_block") == F.col("_at")) & F.col("line_no").between(F.col("_lo"), F.col("_hi")))
    return met.drop("_lo", "_hi", "_block", "_at")


def semantic_hint(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(claim_id, hint): the line that a claim's quoted identifiers point at: the first identifier with a unique definition line in the
    claim's region, else a unique mention. rows: (claim_id, doc_id, text, lo, hi)."""
    ident = F.regexp_extract_all("text", F.lit("`([A-Za-z_][A-Za-z0-9_]{2,})`"), F.lit(1))
    idents = rows.select("claim_id", F.col("doc_id").alias("_doc"), "lo", "hi", F.posexplode(ident).alias("pos", "ident"))
    mention = F.expr(r"line rlike concat('\\b', ident, '\\b')")
    definition = F.expr(r"line rlike concat('^\\s*(?:(?:def|class|function|const|let|var)\\s+', ident, '\\b|', ident, '\\s*(?::[^=]*)?=(?!=))')")
    met = in_reach(idents, F.col("lo"), F.col("hi"), lines).where(mention)
    per = met.groupBy("claim_id", "pos").agg(F.count("*").alias("n"), F.count_if(definition).alias("d"), F.min("line_no").alias("one"), F.min(F.when(definition, F.col("line_no"))).alias("at"))
    hint = F.when(F.col("d") == 1, F.col("at")).when(F.col("n") == 1, F.col("one"))
    return per.withColumn("hint", hint).where("hint is not null").groupBy("claim_id").agg(F.min_by("hint", "pos").alias("hint"))


def dedup_claims(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, line, key): memo-wide dedup of (doc_id, pos, line, text), in order of pos: a row goes if its line or its normalised
    text was kept before. A row that goes for its line does not register its text, so that this is one pass over a memo's claims in
    order; it holds the lines and a digest of each text that the memo has kept so far."""
    import pyarrow as pa

    keyed = rows.select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("line").cast("int").alias("line"), tx.norm_text_key("text").alias("key"))
    out = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("line", pa.int32()), ("key", pa.string())])

    def run(batches):
        memo, lines, keys = None, set(), set()
        for batch in batches:
            kept = []
            for doc, line, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "line", "key"))):
                if doc != memo:
                    memo, lines, keys = doc, set(), set()
                mark = hashlib.blake2b(key.encode(), digest_size=16).digest()
                stays = line not in lines and mark not in keys
                if stays:
                    lines.add(line)
                    keys.add(mark)
                kept.append(stays)
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in out], schema=out).filter(pa.array(kept, pa.bool_()))

    return keyed.repartition("doc_id").sortWithinPartitions("doc_id", "pos", "line", "key").mapInArrow(run, "doc_id long, pos int, line int, key string")


def render_memo(rows: DataFrame) -> DataFrame:
    """(doc_id, memo): frontmatter and numbered claim lines of each document's claims (doc_id, source, sha, n_lines, claim_id, status, text,
    line_no, snippet)."""
    line = F.concat(F.lit("- [C"), F.col("claim_id").cast("string"), F.lit("] ["), F.col("status"), F.lit("] "), F.col("text"), F.lit(" @L"), F.col("line_no").cast("string"), F.lit(" `"), F.col("snippet"), F.lit("`"))
    g = rows.groupBy("doc_id").agg(F.any_value("source").alias("source"), F.any_value("sha").alias("sha"), F.any_value("n_lines").alias("n_lines"), F.array_sort(F.collect_list(F.struct("claim_id", line.alias("line")))).alias("c"))
    head = F.concat(F.lit("---\nsource: "), F.col("source"), F.lit("\nsha256: "), F.col("sha"), F.lit("\nlines: "), F.col("n_lines").cast("string"), F.lit("\n---\n"))
    return g.select("doc_id", F.concat(head, F.array_join(F.transform("c", lambda x: x["line"]), "\n")).alias("memo"))


def parse_memo(memos: DataFrame) -> DataFrame:
    """(doc_id, claim_id, status, text, line_no, snippet, parsed) of a memo's claim lines; a line that only looks like a claim is kept
    with parsed = false."""
    line = F.explode(F.filter(F.split("memo", "\n"), lambda x: x.rlike(CLAIMISH)))
    part = lambda i: F.regexp_extract("l", CLAIM, i)
    rows = memos.select("doc_id", line.alias("l"))
    return rows.select("doc_id", F.expr("try_cast(regexp_extract(l, '^- .C([0-9]+)', 1) as int)").alias("claim_id"), part(2).alias("status"), part(3).alias("text"), F.expr("try_cast(nullif(regexp_extract(l, '@L([0-9]+) `[^`]*`\\\\s*(?:<!--.*-->)?\\\\s*$', 1), '') as int)").alias("line_no"), part(5).alias("snippet"), F.col("l").rlike(CLAIM).alias("parsed"))


def frontmatter(memos: DataFrame, last_wins: bool = False) -> DataFrame:
    """(doc_id, key, value) of the header between the first two lines of ---; the first value of a key wins, or the last."""
    lines = F.split("memo", "\n")
    stop = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "---")
    head = F.when((lines[0] == "---") & (stop > 0), F.slice(lines, 2, (stop - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    rows = memos.select("doc_id", F.posexplode(head).alias("pos", "l")).where(F.col("l").rlike(r"^\w+: "))
    pick = F.max_by if last_wins else F.min_by
    return rows.groupBy("doc_id", F.regexp_extract("l", r"^(\w+): (.*)$", 1).alias("key")).agg(pick(F.regexp_extract("l", r"^(\w+): (.*)$", 2), "pos").alias("value"))
