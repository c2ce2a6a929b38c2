"""Records of text: snippets, transcripts, tables, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col


def safe_snip(s) -> Column:
    """Backticks, which delimit snippets, as a letter that looks alike."""
    return F.replace(col(s), F.lit("`"), F.lit("ˋ"))


def safe_note(s) -> Column:
    return F.substring(F.replace(F.regexp_replace(col(s), r"\s+", " "), F.lit("-->"), F.lit("-- >")), 1, 160)


def md_escape(s) -> Column:
    return F.replace(F.coalesce(col(s), F.lit("")), F.lit("|"), F.lit("\\|"))


def two_places(c, plus: bool = False) -> Column:
    """A number to two places, with the sign that it had before it was rounded; plus: also that of numbers that are not negative."""
    c = col(c)
    sign = F.when(c < 0, "-").otherwise("+" if plus else "")
    return F.when(c.isNotNull(), F.concat(sign, F.format_string("%.2f", F.abs(F.round(c, 2)))))


def row_text(cells, how: str) -> Column:
    """A row of a sheet as a line: txt (tabs), md (a table row), csv (quoted where needed) or json."""
    cells = F.transform(col(cells), lambda c: F.coalesce(c, F.lit("")))
    if how == "txt":
        return F.array_join(cells, "\t")
    if how == "md":
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, md_escape), " | "), F.lit(" |"))
    if how == "csv":
        quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        return F.array_join(F.transform(cells, quoted), ",")
    if how == "json":
        return F.to_json(cells)
    raise ValueError(f"no such format: {how}")


def sheet_lines(rows: DataFrame, sheet: str, number: str, cells: str, how: str) -> DataFrame:
    """(sheet, n, pos, line): the rows of sheets as lines; a Markdown sheet has a separator under its first row, number 1."""
    line = row_text(cells, how)
    below = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(cells)))
    lines = F.array(line, F.when(F.col(number) == 1, below)) if how == "md" else F.array(line)
    return rows.select(F.col(sheet).alias("sheet"), F.col(number).alias("n"), F.posexplode(lines).alias("pos", "line")).where("line is not null")


def block_text(kind, text, how: str) -> Column:
    """A block of a document (heading1 to heading6, item, cell, code or any other kind) as text: txt, md or json. Blank blocks are null."""
    kind, text = F.coalesce(col(kind), F.lit("")), F.trim(F.coalesce(col(text), F.lit("")))
    if how == "txt":
        made = F.when(kind == "item", F.concat(F.lit("- "), text)).otherwise(text)
    elif how == "md":
        level = F.regexp_extract(kind, "^heading([1-6])$", 1)
        marks = F.repeat(F.lit("#"), F.coalesce(level.try_cast("int"), F.lit(0)))
        made = F.when(level != "", F.concat(marks, F.lit(" "), text)).when(kind == "item", F.concat(F.lit("- "), text)).when(kind == "cell", F.concat(F.lit("| "), md_escape(text), F.lit(" |"))).when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).otherwise(text)
    elif how == "json":
        made = F.to_json(F.struct(kind.alias("kind"), text.alias("text")))
    else:
        raise ValueError(f"no such format: {how}")
    return F.when(text != "", made)


def too_thin(s) -> Column:
    return F.length(F.trim(col(s))) < 32


def lenient(raw) -> tuple[Column, Column]:
    """(whether bytes are valid UTF-8, their text with replacement characters where they are not)"""
    return F.is_valid_utf8(col(raw).cast("string")), F.make_valid_utf8(col(raw).cast("string"))


def html_text(s) -> Column:
    """Plain text of markup by patterns: scripts, styles and comments dropped, tags and white space as one space, common references
    decoded. For articles without their surroundings see the extraction operator."""
    s = F.regexp_replace(F.coalesce(col(s), F.lit("")), r"(?s)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def short_id(prefix: str, *parts) -> Column:
    """A deterministic id: a prefix and ten letters of a hash."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *map(col, parts))), 1, 10))


def truncated(s, most: int = 3000, head: int = 1500, tail: int = 1200) -> Column:
    s = col(s)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, head), F.lit(" [...] "), F.right(s, F.lit(tail)))).otherwise(s)


def session_turn(role, text) -> Column:
    return col(role).isin("user", "assistant") & (F.length(F.trim(col(text))) >= 15) & ~col(text).startswith("<system")


def transcript(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body) of JSON lines: invalid ones go, text blocks are joined, reminders are cut out, short ones go."""
    shape = "type string, message struct<model: string, content: array<struct<type: string, text: string>>>"
    parsed = lines.withColumn("j", F.from_json("line", shape)).where("j.message is not null")
    blocks = F.transform(F.filter("j.message.content", lambda b: b["type"] == "text"), lambda b: b["text"])
    body = F.trim(F.regexp_replace(F.array_join(blocks, "\n"), r"(?s)<system-reminder>.*?</system-reminder>", ""))
    rows = parsed.select("conv_id", "turn", F.col("j.type").alias("role"), body.alias("body"))
    return rows.where(session_turn("role", "body"))


def connectors(rows: DataFrame) -> DataFrame:
    """Authorised connectors of a JSON list (name, auth)."""
    listed = rows.withColumn("c", F.explode(F.from_json("json", "array<struct<name: string, auth: string>>")))
    return listed.where(F.col("c.auth").eqNullSafe(F.lit("authorized"))).select(*(c for c in rows.columns if c != "json"), F.col("c.name").alias("name"))


def table_claims(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, claim): header=value pairs of each data row of the tables anywhere in a document. The header is the row above a
    table's separator, carried down the table; a table that opens with its separator has none. A header row that is repeated is no data;
    cells beyond the header, or under an empty one, get a name by their place; rows without cells give no claim."""
    from factloom.operators.anchors import table_cells, table_rows

    rows = table_rows(lines).where(~F.col("sep")).withColumn("cells", table_cells("line")).withColumn("header", table_cells("header"))
    name = lambda i: F.coalesce(F.nullif(F.get("header", i), F.lit("")), F.concat(F.lit("col"), (i + 1).cast("string")))
    named = F.transform("cells", lambda c, i: F.when(c != "", F.concat(name(i), F.lit("="), c)))
    claim = F.replace(F.array_join(F.filter(named, lambda x: x.isNotNull()), "; "), F.lit("`"), F.lit(""))
    data = F.col("header").isNull() | (F.col("cells") != F.col("header"))
    return rows.where(data).select("doc_id", "line_no", claim.alias("claim")).where("claim <> ''")


#: Bytes at the end of a transcript that are read for its last usage record.
TAIL_BYTES = 512 * 1024


def tail_usage(files: DataFrame, key: str, tail_bytes: int | None = TAIL_BYTES) -> DataFrame:
    """(key, context_tokens, model) of transcripts (key, content): the last record with usage among the last bytes, and the last model that
    one of those names. Where the file is longer, the line that the cut falls in is left out; files without a record give no row.
    Without tail_bytes the content is an end already, and the column `cut` says whether something stood before it."""
    cut = F.col("cut") if tail_bytes is None else F.octet_length("content") > tail_bytes
    end = F.col("content") if tail_bytes is None else F.when(cut, F.substring("content", -tail_bytes, tail_bytes)).otherwise(F.col("content"))
    text = F.make_valid_utf8(end.cast("string"))
    lines = F.split(text, "\n")
    whole = F.when(cut, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    shape = "message struct<model:string,usage:struct<input_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>>"
    held = F.filter(F.transform(whole, lambda x: F.from_json(x, shape)["message"]), lambda m: m["usage"]["input_tokens"].isNotNull())
    rows = files.select(key, held.alias("m")).where(F.size("m") > 0)
    last = F.element_at("m", -1)["usage"]
    models = F.filter(F.transform("m", lambda m: m["model"]), lambda x: x.isNotNull())
    tokens = last["input_tokens"] + F.coalesce(last["cache_creation_input_tokens"], F.lit(0)) + F.coalesce(last["cache_read_input_tokens"], F.lit(0))
    return rows.select(key, tokens.alias("context_tokens"), F.try_element_at(models, F.lit(-1)).alias("model"))


def or_default(c, default) -> Column:
    """The value, or the default where it is null or of length 0."""
    c = col(c)
    return F.when(c.isNull() | (F.length(c) == 0), default).otherwise(c)


def retired(memos: DataFrame, made: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, state) of memos (key, sha) after a run that made (key, sha, n_claims) of their sources: a memo whose source has changed is
    replaced if the run gave claims, and retired (stale) if it gave none; stale ones are invisible to readers."""
    now = made.select(F.col(key).alias("_k"), F.col("sha").alias("_sha"), "n_claims")
    state = F.when(F.col("_sha").isNull() | (F.col("sha") == F.col("_sha")), "kept").when(F.col("n_claims") > 0, "replaced").otherwise("stale")
    return memos.join(now, F.col(key) == F.col("_k"), "left").select(key, state.alias("state"))


def freshness(was: DataFrame, now: DataFrame, key: str, sha: str) -> DataFrame:
    """(key, state): removed, added or changed between two listings."""
    a, b = was.select(key, F.col(sha).alias("_a")), now.select(key, F.col(sha).alias("_b"))
    state = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").withColumn("state", state).where("state is not null").select(key, "state")
