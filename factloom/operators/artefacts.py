"""Written artefacts: Markdown and HTML reports, charts, the memo index, session files.

An artefact is made as rows (name, section, key, id, pos, line), that is, in parallel, and written as text files for each name, dealt by
range of the order: the parts, one after the other by their names, are the artefact. What reads it back reads lines. The headings and
the forms of lines are fixed values of the formats.
"""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import records
from factloom.sources.ordered import numbered

ORDER = ("name", "section", "key", "id", "pos")


def block(rows: DataFrame, name: str, section: int, lines: list, key: Column | None = None, id_: Column | None = None) -> DataFrame:
    """The lines that each row gives, in order."""
    text = F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    key, id_ = F.lit(0.0) if key is None else key.cast("double"), F.lit("") if id_ is None else id_.cast("string")
    made = rows.select(F.lit(name).alias("name"), F.lit(section).alias("section"), key.alias("key"), id_.alias("id"), F.posexplode(text).alias("pos", "line"))
    return made.where("line is not null").withColumn("line", F.regexp_replace("line", r"[\r\n]+", " "))


def text_block(spark: SparkSession, name: str, section: int, lines: list[str]) -> DataFrame:
    return block(spark.range(1), name, section, lines)


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_text(rows: DataFrame, path: str) -> None:
    """Text files in numbered parts for each name; a large artefact is written by many tasks."""
    rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("name", F.col("line").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(name, line)"""
    return spark.read.schema("value string, name string").option("basePath", path).text(path).select("name", F.col("value").alias("line"))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(name, part, text): the parts of each artefact in their order, each whole; joined, they are the artefact."""
    files = spark.read.schema("value string, name string").option("basePath", path).text(path, wholetext=True)
    return files.select("name", F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("int").alias("part"), F.col("value").alias("text"))


def signed(c: Column) -> Column:
    return records.two_places(c, plus=True)


def report(scored: DataFrame, votes: DataFrame, name: str = "report") -> DataFrame:
    """A session's report: the table of claims by falling score, then each claim with its votes."""
    spark = scored.sparkSession
    claim = F.concat(F.lit("claim "), F.col("claim_id").cast("string"))
    check = F.when(F.col("passed").isNull(), "—").when(F.col("passed"), "pass").otherwise("**FAIL**")
    cites = F.when(F.col("citations_total") == 0, "—").otherwise(F.concat(F.coalesce(F.col("citations_verified").cast("string"), F.lit("?")), F.lit("/"), F.col("citations_total").cast("string")))
    row = F.concat(F.lit("| **"), F.upper("status"), F.lit("** | "), signed(F.col("score")), F.format_string(" | +%d/-%d/?%d | ", "n_support", "n_refute", "n_uncertain"), check, F.lit(" | "), cites, F.lit(" | "), claim, F.lit(" |"))
    head = F.concat(F.lit("### ["), F.upper("status"), F.lit("] "), claim)
    vote = F.concat(F.lit("| "), "panelist", F.lit(" | "), F.col("round").cast("string"), F.lit(" | "), F.coalesce("verdict", F.lit("discarded")), F.lit(" | "), F.coalesce(records.two_places("confidence"), F.lit("?")), F.lit(" |"))
    order = -F.col("score")
    held = votes.join(scored.select("claim_id", "score"), "claim_id")
    padded = F.lpad(F.col("claim_id").cast("string"), 20, "0")
    return union(
        text_block(spark, name, 0, ["# Session report", "", "## Claims", "", "| Status | Score | +/-/? | Check | Citations | Claim |", "|---|---:|---|---|---|---|"]),
        block(scored, name, 1, [row], order, padded),
        block(scored, name, 2, [F.lit(""), head, F.lit(""), F.concat(F.lit("Consensus "), signed(F.col("score"))), F.lit(""), F.lit("| Panelist | Round | Verdict | Conf. |"), F.lit("|---|---|---|---:|")], order, F.concat(padded, F.lit(" "))),
        block(held, name, 2, [vote], order, F.concat(padded, F.lit(" 1"), F.col("panelist"))),
    )


def ledger(facts: DataFrame, place: Column, name: str = "ledger") -> DataFrame:
    """Facts by status, what failed first, each status under its count."""
    counted = facts.groupBy("status").agg(F.count("*").alias("n"))
    rest = text_block(facts.sparkSession, name, 0, ["# Verifiable facts", "", "| | count |", "|---|---:|"])
    return union(
        rest,
        block(counted, name, 1, [F.format_string("| **%s** | %d |", "status", "n")], place),
        block(counted, name, 2, [F.lit(""), F.format_string("## %s (%d)", "status", "n"), F.lit("")], place),
        block(facts, name, 2, [F.concat(F.lit("**"), "fact", F.lit("**")), F.concat(F.lit("- *From:* `"), "source", F.lit("`"))], place, F.concat(F.lit("1"), "fact")),
    )


def petals(verified: DataFrame, name: str = "petals") -> DataFrame:
    """Passages that hold, by section, with their anchors; those whose anchor did not hold are listed at the end."""
    spark, kept = verified.sparkSession, F.coalesce("verified", F.lit(True))
    ok, bad = verified.where(kept), verified.where(~kept)
    id_ = F.concat("section", F.lit("1"), F.lpad(F.col("petal_id").cast("string"), 20, "0"))
    flag = F.when(F.col("verified").isNull(), "  **[needs author confirmation]**").otherwise("")
    return union(
        text_block(spark, name, 0, ["# Passages", ""]),
        block(ok.select("section").distinct(), name, 1, [F.concat(F.lit("## "), "section"), F.lit("")], id_=F.concat("section", F.lit("0"))),
        block(ok, name, 1, [F.concat(F.lit("**"), "kind", F.lit("**"), flag), F.concat(F.lit("> "), "text"), F.concat(F.lit("*Anchor ("), "anchor_kind", F.lit("):* "), "anchor"), F.lit("")], id_=id_),
        text_block(spark, name, 2, ["## Not used", ""]),
        block(bad, name, 3, [F.concat(F.lit("- ~~"), F.substring("text", 1, 110), F.lit("~~ ("), "kind", F.lit(")"))], id_=F.lpad(F.col("petal_id").cast("string"), 20, "0")),
    )


def review(findings: DataFrame, name: str = "review") -> DataFrame:
    """Findings (role, severity, location, finding) by role and severity, then the locations that more than one role has found."""
    rank = F.when(F.col("severity") == "blocking", 0).when(F.col("severity") == "major", 1).otherwise(2)
    counted = findings.groupBy("role", "severity").agg(F.count("*").alias("n"))
    at = lambda x: F.concat("role", rank.cast("string"), F.lit(x))
    both = findings.select(F.substring(F.lower("location"), 1, 40).alias("spot"), "role").where("spot <> ''").groupBy("spot").agg(F.countDistinct("role").alias("n")).where("n > 1")
    return union(
        text_block(findings.sparkSession, name, 0, ["# Independent review", ""]),
        block(counted, name, 1, [F.format_string("## %s: %s (%d)", "role", "severity", "n"), F.lit("")], id_=at("0")),
        block(findings, name, 1, [F.concat(F.lit("**"), "location", F.lit("**")), F.concat(F.lit("> "), "finding")], id_=F.concat(at("1"), "location", "finding")),
        text_block(findings.sparkSession, name, 2, ["## Where they agree", ""]),
        block(both, name, 3, [F.concat(F.lit("- `"), "spot", F.lit("`"))], id_=F.col("spot")),
    )


def memo_index(memos: DataFrame, name: str = "INDEX") -> DataFrame:
    """One line for each memo (source, topic, good, total, pending, n_lines, memo, raw, tokens), then the ledger of tokens, which holds the
    size of this very file: its count is solved to a fixed point over one scalar, since only the number of its digits matters."""
    spark = memos.sparkSession
    trust = F.concat(F.format_string("%d/%d", "good", "total"), F.when(F.col("pending") > 0, F.format_string(" (+%d unchecked)", "pending")).otherwise(""))
    line = F.concat(F.lit("| `"), "source", F.lit("` | "), records.md_escape(F.substring("topic", 1, 60)), F.lit(" | "), trust, F.lit(" | "), F.col("n_lines").cast("string"), F.lit(" | `"), "memo", F.lit("` |"))
    body = union(text_block(spark, name, 0, ["# Memo index", "", "| source | topic | trust | lines | memo |", "|---|---|---|---|---|"]), block(memos, name, 1, [line], id_=F.col("source")))
    s = memos.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    saved = s["raw"] - s["tokens"]
    share = 100 * saved // s["raw"] if s["raw"] else 0

    def tail(own: str) -> list[str]:
        return ["", "## Ledger", "", f"- raw material: ~{s['raw']:,} tokens", f"- all memos: ~{s['tokens']:,} tokens", f"- this index: ~{own} tokens", f"- saved: ~{saved:,} tokens ({share}%)", ""]

    length = body.agg(F.sum(F.length("line") + 1)).first()[0] + sum(len(x) + 1 for x in tail(""))
    own = max(1, (length - 1 + len("0")) // 4)
    for _ in range(5):
        now = max(1, (length + len(f"{own:,}")) // 4)
        if now == own:
            break
        own = now
    return union(body, text_block(spark, name, 2, tail(f"{own:,}")))


def handoff(claims: DataFrame, usage: DataFrame, name: str = "handoff") -> DataFrame:
    """A note for who resumes a session: the state of its claims (source, status), and one row of usage (context_tokens, window)."""
    pending = F.col("status").isin("NEEDS_AGENT", "PENDING")
    counts = claims.agg(F.count("*").alias("n"), F.count_if(pending).alias("p"), F.countDistinct("source").alias("s"))
    by = claims.groupBy("status").agg(F.count("*").alias("n"))
    share = F.format_string("%.1f", F.round(100.0 * F.col("context_tokens") / F.col("window"), 1))
    return union(
        text_block(claims.sparkSession, name, 0, ["# Handoff", ""]),
        block(usage, name, 1, [F.concat(F.lit("- context: "), F.col("context_tokens").cast("string"), F.lit(" of "), F.col("window").cast("string"), F.lit(" tokens ("), share, F.lit("%)"))]),
        block(counts, name, 2, [F.format_string("- claims: %d from %d source(s)", "n", "s"), F.when(F.col("p") > 0, F.format_string("- still to check: %d", "p")).otherwise("- nothing left to check")]),
        block(by, name, 3, [F.format_string("- %s: %d", "status", "n")], id_=F.col("status")),
    )


def bench_totals(results: DataFrame) -> DataFrame:
    """(total, passed, without, with_, pct) of results (passed, without, with_): tokens of endpoints that passed only, and the share saved,
    null where nothing passed."""
    ok = lambda c: F.sum(F.when(F.col("passed"), F.col(c)).otherwise(0))
    sums = results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.coalesce(ok("without"), F.lit(0)).alias("without"), F.coalesce(ok("with_"), F.lit(0)).alias("with_"))
    return sums.withColumn("pct", F.round(F.try_divide(100.0 * (F.col("without") - F.col("with_")), F.col("without")), 1))


def bench(results: DataFrame) -> DataFrame:
    """A benchmark as two artefacts: results.json, a line for each endpoint and one for all, and RESULTS.md, of results (endpoint, verdict,
    passed, without, with_)."""
    spark, totals = results.sparkSession, bench_totals(results)
    key = F.lpad(F.col("endpoint").cast("string"), 20, "0")
    line = F.concat(F.lit("| "), F.col("endpoint").cast("string"), F.lit(" | "), "verdict", F.lit(" | "), F.col("without").cast("string"), F.lit(" | "), F.col("with_").cast("string"), F.lit(" |"))
    saved = F.when(F.col("pct").isNull(), "saved: n/a").otherwise(F.concat(F.lit("saved: "), F.format_string("%.1f", "pct"), F.lit("%")))
    return union(
        block(results, "results.json", 0, [F.to_json(F.struct("endpoint", "verdict", "passed", "without", "with_"))], id_=key),
        block(totals, "results.json", 1, [F.to_json(F.struct("total", "passed", "without", "with_", "pct"), {"ignoreNullFields": "false"})]),
        text_block(spark, "RESULTS.md", 0, ["# Benchmark", "", "| endpoint | verdict | without | with |", "|---|---|---:|---:|"]),
        block(results, "RESULTS.md", 1, [line], id_=key),
        block(totals, "RESULTS.md", 2, [F.lit(""), F.concat(F.format_string("passed: %d of %d; ", "passed", "total"), saved)]),
    )


def consensus_bars(scored: DataFrame, label: str, colours: dict[str, str], other: str) -> DataFrame:
    """(label, status, colour, score): the data of a chart of consensus, in order of the score; labels of 58 characters at most."""
    colour = F.lit(other)
    for status, c in colours.items():
        colour = F.when(F.col("status") == status, c).otherwise(colour)
    short = F.when(F.length(label) > 58, F.concat(F.substring(label, 1, 55), F.lit("..."))).otherwise(F.col(label))
    return scored.select(short.alias("label"), "status", colour.alias("colour"), "score").orderBy("score", "label")


def bars(rows: DataFrame, label: Column, size: Column, order: Column, colour: Column | str, name: str, most: int | None = None) -> DataFrame:
    """A chart of horizontal bars as SVG: a row is a bar of the given size, 0 to 1, in rising order. most: only so many, the last of these."""
    colour = F.lit(colour) if isinstance(colour, str) else colour
    drawn = rows.select(label.alias("label"), F.round(F.abs(size) * 400).cast("long").alias("width"), order.alias("order"), colour.alias("colour"))
    if most is not None:
        drawn = drawn.orderBy(F.desc("order"), F.desc("label")).limit(most)
    placed = numbered(drawn, "order", "label").withColumn("y", F.col("place") * 20)
    short = F.when(F.length("label") > 46, F.concat(F.substring("label", 1, 43), F.lit("..."))).otherwise(F.col("label"))
    text = F.replace(F.replace(short, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    bar = F.concat(F.lit('<rect x="300" y="'), F.col("y").cast("string"), F.lit('" width="'), F.col("width").cast("string"), F.lit('" height="16" fill="'), "colour", F.lit('"/><text x="0" y="'), (F.col("y") + 13).cast("string"), F.lit('">'), text, F.lit("</text>"))
    spark = rows.sparkSession
    return union(text_block(spark, name, 0, ['<svg xmlns="http://www.w3.org/2000/svg" width="760" font-size="12">']), block(placed, name, 1, [bar], F.col("y")), text_block(spark, name, 2, ["</svg>"]))


def charts(makers: dict, path: str) -> dict[str, str | None]:
    """Write each chart that its maker gives; one that fails doesn't sink the others. By name the error, or None."""
    out: dict[str, str | None] = {}
    for name, make in makers.items():
        try:
            write_text(make(name), f"{path}/{name}")
            out[name] = None
        except Exception as e:  # noqa: BLE001 the failure is the chart's result
            out[name] = type(e).__name__
    return out


def page(title: str, tiles: dict[str, Column], totals: DataFrame, rows: DataFrame, figures: dict[str, DataFrame], name: str = "page") -> DataFrame:
    """An HTML report without other files: tiles of totals (one row), a table of rows, and charts as base64 images. A chart in a
    page is one line of it, so that it should show a bounded number of bars."""
    spark = rows.sparkSession
    tile = [F.concat(F.lit("<div class='kpi'><b>"), F.coalesce(c.cast("string"), F.lit("n/a")), F.lit(f"</b> {html.escape(k)}</div>")) for k, c in tiles.items()]
    cells = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in rows.columns), F.lit("</tr>"))
    images = []
    for n, (label, svg) in enumerate(figures.items()):
        whole = svg.groupBy().agg(F.array_sort(F.collect_list(F.struct(*ORDER[1:], "line"))).alias("l")).select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("svg"))
        images.append(block(whole, name, 4, [F.concat(F.lit(f"<img alt='{html.escape(label)}' src='data:image/svg+xml;base64,"), F.regexp_replace(F.base64(F.encode("svg", "UTF-8")), r"\s", ""), F.lit("'/>"))], F.lit(float(n))))
    return union(
        text_block(spark, name, 0, [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>", f"<h1>{html.escape(title)}</h1>"]),
        block(totals, name, 1, tile),
        text_block(spark, name, 2, ["<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns) + "</tr>"]),
        block(rows, name, 3, [cells], id_=F.col(rows.columns[0])),
        block(spark.range(1), name, 3, ["</table>"], F.lit(1.0)),
        *images,
        text_block(spark, name, 5, ["</body></html>"]),
    )


def write_session(path: str, frames: dict[str, DataFrame]) -> None:
    """Sessions as JSON lines: a file for each session (qid) and frame, dealt by range so that a large frame has several."""
    rows = None
    for name, df in frames.items():
        one = df.select("qid", F.lit(name).alias("frame"), F.to_json(F.struct(*(c for c in df.columns if c != "qid")), {"ignoreNullFields": "false"}).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    rows.repartitionByRange("qid", "frame", "value").write.mode("overwrite").partitionBy("qid", "frame").text(path)


def read_session(spark: SparkSession, path: str, frame: str, columns: str) -> DataFrame:
    """One frame of all sessions: (qid, columns); a frame without rows has the columns all the same."""
    lines = spark.read.schema("value string, qid long, frame string").text(path).where(F.col("frame") == frame)
    return lines.select("qid", F.from_json("value", columns).alias("r")).select("qid", "r.*")


def assembly_record(entries: DataFrame) -> DataFrame:
    """(seat, record): what goes to the other seats in the second round, of entries (seat, verdict, confidence, pro, contra, foregrounds,
    sets_aside, reading, lenses array of (kind, text)); a seat that declares no emphasis is said to have none."""
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    lens = F.array_join(F.transform("lenses", lambda x: F.concat(F.lit("    ["), F.coalesce(x["kind"], F.lit("?")), F.lit("] "), F.substring(F.coalesce(x["text"], F.lit("(empty)")), 1, 300))), "\n")
    declared = F.concat(F.lit("\n  EMPHASIS:\n    foregrounds: "), "foregrounds", F.lit("\n    sets aside: "), F.coalesce("sets_aside", F.lit("(not declared)")), F.lit("\n    reading: "), cut("reading", 400))
    emphasis = F.when(F.trim(F.coalesce("foregrounds", F.lit(""))) != "", declared).otherwise("\n  EMPHASIS: none declared")
    head = F.concat("seat", F.lit(" — "), F.upper(F.coalesce("verdict", F.lit("?"))), F.format_string(" (confidence %.2f)", F.round(F.coalesce("confidence", F.lit(0.0)), 2)))
    return entries.select("seat", F.concat(head, F.lit("\n  PRO: "), cut("pro", 400), F.lit("\n  CONTRA: "), cut("contra", 400), emphasis, F.lit("\n  LENSES:\n"), lens).alias("record"))
