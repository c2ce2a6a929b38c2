"""Queries of anchors, chunks, memos, transcripts, routing, paths."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import duck, paths, records
from factloom.functions import text as tx
from factloom.operators import anchors, artefacts
from factloom.sources import files, store

from .registry import RELATIONS, Tables, query

# Anchors: each line of a document is cited, some of them at the wrong place, some with a foreign snippet.
RELATIONS["anchors"] = """select doc_id || ':' || line_no anchor_id, doc_id, case when line_no % 7 = 0 then 'nowhere to be found at all' when line_no % 5 = 0 then '' else left(line, 40) end snippet,
  cast(line_no + case (doc_id + line_no) % 4 when 0 then 0 when 1 then 2 when 2 then 40 else 500 end as integer) cited from lines"""
_norm = lambda c: f"trim(regexp_replace(replace({c}, '`', ''), '\\s+', ' ', 'g'))"
_verdict = f"""(select a.anchor_id, case when want = '' then 'REFUTED' when last is null or cited < 1 or cited > last then 'REFUTED' when exact then 'CONFIRMED' when near_ is not null then 'DRIFTED' when length(want) >= 24 and n = 1 then 'DRIFTED' else 'REFUTED' end verdict,
 case when exact then cited when near_ is not null then near_ when length(want) >= 24 and n = 1 then first_ end f from (select *, {_norm('snippet')} want from anchors) a
 left join (select doc_id, max(line_no) last from lines group by 1) z using (doc_id)
 left join (select anchor_id, bool_or(line_no = cited) exact, min(case when abs(line_no - cited) <= 3 then line_no end) near_, count(*) n, min(line_no) first_ from (select *, {_norm('snippet')} want from anchors) a join lines l on a.doc_id = l.doc_id and abs(line_no - cited) <= 60 and contains({_norm('line')}, want) group by 1) h on h.anchor_id = a.anchor_id)"""


def _anchors(t: Tables):
    n = F.col("line_no")
    snippet = F.when(n % 7 == 0, "nowhere to be found at all").when(n % 5 == 0, "").otherwise(F.substring("line", 1, 40))
    turn = (F.col("doc_id") + n) % 4
    cited = n + F.when(turn == 0, 0).when(turn == 1, 2).when(turn == 2, 40).otherwise(500)
    return t.lines.select(F.concat_ws(":", "doc_id", "line_no").alias("anchor_id"), "doc_id", snippet.alias("snippet"), cited.cast("int").alias("cited"))


@query("fn_anchor_verdict", f"select anchor_id, verdict, cast(case when verdict <> 'REFUTED' then f end as integer) found_line from {_verdict}")
def _(t: Tables):
    return anchors.verdicts(_anchors(t), t.lines)


@query("join_anchor_line", f"select verdict, count(*) n from {_verdict} group by 1")
def _(t: Tables):
    return anchors.verdicts(_anchors(t), t.lines).groupBy("verdict").agg(F.count("*").alias("n"))


@query("fn_anchor_sticky", f"select anchor_id, case when anchor_id[-1:] in ('0', '2', '4', '6', '8') and verdict in ('CONFIRMED', 'DRIFTED') then 'DRIFTED' else verdict end verdict from {_verdict}")
def _(t: Tables):
    return anchors.verdicts(_anchors(t), t.lines).select("anchor_id", anchors.sticky("verdict", F.right("anchor_id", F.lit(1)).isin("0", "2", "4", "6", "8")).alias("verdict"))


@query("fn_norm_anchor", f"select doc_id, line_no, {_norm('line')} norm from lines")
def _(t: Tables):
    return t.lines.select("doc_id", "line_no", tx.norm_anchor("line").alias("norm"))


@query("fn_norm_text_key", "select doc_id, line_no, lower(trim(regexp_replace(line, '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+', ' ', 'g'))) key from lines")
def _(t: Tables):
    return t.lines.select("doc_id", "line_no", tx.norm_text_key("line").alias("key"))


@query("fn_safe_snip", "select doc_id, line_no, replace(line, '`', 'ˋ') snip, left(replace(regexp_replace(line, '\\s+', ' ', 'g'), '-->', '-- >'), 160) note from lines")
def _(t: Tables):
    return t.lines.select("doc_id", "line_no", records.safe_snip("line").alias("snip"), records.safe_note("line").alias("note"))


@query("fn_region", "select anchor_id, greatest(1, cited - 8) lo, cited + 12 hi from anchors")
def _(t: Tables):
    lo, hi = anchors.region("cited", F.lit(None).cast("int"), F.lit(None).cast("int"))
    return _anchors(t).select("anchor_id", lo.alias("lo"), hi.alias("hi"))


@query("join_region_lines", "select anchor_id, count(*) n, sum(length(line))::bigint chars from anchors a join lines l on a.doc_id = l.doc_id and line_no between cited - 12 and cited + 15 group by 1")
def _(t: Tables):
    a = _anchors(t).select("anchor_id", F.col("doc_id").alias("_doc"), "cited")
    met = anchors.in_reach(a, F.col("cited") - 12, F.col("cited") + 15, t.lines)
    return met.groupBy("anchor_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("fn_semantic_hint")
def _(t: Tables):
    # A claim for each line, which quotes the line's first identifier, and looks for it twenty lines up and down.
    ident = F.regexp_extract("line", "([A-Za-z_][A-Za-z0-9_]{2,})", 1)
    n = F.col("line_no")
    rows = t.lines.select(F.concat_ws(":", "doc_id", "line_no").alias("claim_id"), "doc_id", F.concat(F.lit("`"), ident, F.lit("` is there")).alias("text"), F.greatest(F.lit(1), n - 20).alias("lo"), (n + 20).alias("hi"))
    return anchors.semantic_hint(rows, t.lines)


@query("fn_chunk_prose")
def _(t: Tables):
    return anchors.chunks(t("documents"), anchors.HEADING)


def _code(t: Tables):
    """Documents as code: each fourth line declares a function."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("def "), x)).otherwise(x))
    return t("documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


@query("fn_chunk_code")
def _(t: Tables):
    return anchors.chunks(_code(t), anchors.DECLARATION)


@query("fn_chunk_generic", "select doc_id, cast(lo as integer) lo, cast(least(lo + 159, n) as integer) hi from (select doc_id, n, unnest(range(1, n + 1, 145)) lo from (select doc_id, len(string_split(text, chr(10))) n from documents))")
def _(t: Tables):
    return anchors.generic_chunks(t("documents"))


@query("win_chunk_boundaries", f"""select doc_id, line_no lo, cast(coalesce(lead(line_no) over (partition by doc_id order by line_no) - 1, n) as integer) hi
 from (select doc_id, line_no, case when line_no % 4 = 1 then 'def ' || line else line end line, max(line_no) over (partition by doc_id) n from lines) where line_no = 1 or regexp_matches(line, {duck.quoted(anchors.DECLARATION)})""")
def _(t: Tables):
    return anchors.boundaries(_code(t), anchors.DECLARATION)


@query("flt_chunk_bounds", "select doc_id, line_no from (select doc_id, cited line_no, row_number() over (partition by doc_id, cited order by anchor_id) rn from anchors where cited between 1 and 160) where rn = 1")
def _(t: Tables):
    return _anchors(t).where("cited between 1 and 160").groupBy("doc_id", F.col("cited").alias("line_no")).agg(F.min("anchor_id").alias("a")).select("doc_id", "line_no")


@query("win_first_dupe", "select min(doc_id) doc_id, count(*) - 1 dropped from documents group by text")
def _(t: Tables):
    return t("documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("dropped")).select("doc_id", "dropped")


@query("win_memo_dedup")
def _(t: Tables):
    rows = t.lines.select("doc_id", F.col("line_no").alias("pos"), F.floor(F.col("line_no") / 2).cast("int").alias("line"), F.col("line").alias("text"))
    return anchors.dedup_claims(rows)


@query("flt_trivial", "select doc_id, line_no from lines where not (regexp_matches(line, '(?i)^(?:imports?\\b|includes?\\s+the\\b|this\\s+(?:line|statement)\\s+)') or regexp_matches(line, '^\\s*(?:import\\s|#include\\b|package\\s)'))")
def _(t: Tables):
    return t.lines.where(~(F.col("line").rlike(tx.TRIVIAL_TEXT) | F.col("line").rlike(tx.TRIVIAL_ANCHOR))).select("doc_id", "line_no")


# Markdown tables: the parts as rows of one table for each brand, with a header and a separator.
RELATIONS["md"] = """select p_brand, 1 line_no, '| part | size |' line from (select distinct p_brand from part) union all select p_brand, 2, '|---|---|' from (select distinct p_brand from part)
 union all select p_brand, cast(row_number() over (partition by p_brand order by p_partkey) + 2 as integer), '| ' || p_partkey || ' | ' || p_size || ' |' from part"""


def _md(t: Tables):
    line = F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    body = t("part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("r"))
    rows = F.concat(F.array(F.lit("| part | size |"), F.lit("|---|---|")), F.transform("r", lambda x: x["line"]))
    return body.select(F.col("p_brand").alias("doc_id"), F.posexplode(rows).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


@query("win_table_islands", "select p_brand doc_id, cast(min(line_no) as integer) lo, cast(max(line_no) as integer) hi from md group by 1")
def _(t: Tables):
    return anchors.tables(_md(t))


@query("fn_table_cells", "select p_brand doc_id, line_no, 'part=' || trim(string_split(line, '|')[2]) || '; size=' || trim(string_split(line, '|')[3]) claim from md where line_no > 2")
def _(t: Tables):
    return records.table_claims(_md(t))


# Documents of several tables: one with a header, text, one that opens with its separator, and a last one that follows it at once.
RELATIONS["md_many"] = """with b as (select distinct p_brand from part), r as (select p_brand, '| ' || p_partkey || ' | ' || p_size || ' |' line, case when p_size < 20 then 1 when p_size < 40 then 4 else 6 end part_, p_partkey from part),
 x as (select p_brand, part_, p_partkey o, line from r union all select p_brand, 0, 0, '| part | size |' from b union all select p_brand, 0, 1, '|---|---|' from b union all select p_brand, 2, 0, 'some text' from b union all select p_brand, 3, 0, '| --- | --- |' from b
  union all select p_brand, 5, 0, '| key |  |' from b union all select p_brand, 5, 1, '|:--|--:|' from b)
 select p_brand, part_, cast(row_number() over (partition by p_brand order by part_, o) as integer) line_no, line from x"""


def _md_many(t: Tables):
    p = t("part")
    size = F.col("p_size")
    line = F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), size.cast("string"), F.lit(" |"))
    rows = p.select("p_brand", F.when(size < 20, 1).when(size < 40, 4).otherwise(6).alias("part"), F.col("p_partkey").alias("o"), line.alias("line"))
    fixed = [(0, 0, "| part | size |"), (0, 1, "|---|---|"), (2, 0, "some text"), (3, 0, "| --- | --- |"), (5, 0, "| key |  |"), (5, 1, "|:--|--:|")]
    more = p.select("p_brand").distinct().select("p_brand", F.inline(F.array(*(F.struct(F.lit(a).alias("part"), F.lit(o).alias("o"), F.lit(x).alias("line")) for a, o, x in fixed))))
    body = rows.unionByName(more).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("part", "o", "line"))).alias("r"))
    return body.select(F.col("p_brand").alias("doc_id"), F.posexplode("r").alias("pos", "r")).select("doc_id", (F.col("pos") + 1).alias("line_no"), F.col("r.line").alias("line"))


_names = {1: ("part", "size"), 4: ("col1", "col2"), 6: ("key", "col2")}
_name = lambda i: "case part_ " + " ".join(f"when {k} then '{v[i]}'" for k, v in _names.items()) + " end"


@query("fn_table_claims", f"select p_brand doc_id, line_no, {_name(0)} || '=' || trim(string_split(line, '|')[2]) || '; ' || {_name(1)} || '=' || trim(string_split(line, '|')[3]) claim from md_many where part_ in (1, 4, 6)")
def _(t: Tables):
    return records.table_claims(_md_many(t))


# Memos: a claim for each line of a document.
RELATIONS["memo_claims"] = """select l.doc_id, l.source, sha256(d.text) sha, cast(len(string_split(d.text, chr(10))) as integer) n_lines, l.line_no claim_id, status, replace(line, '`', '') text, l.line_no, replace(line, '`', 'ˋ') snippet
 from lines l join documents d on d.doc_id = l.doc_id join claims c on c.claim_id = l.doc_id"""
_line = "'- [C' || claim_id || '] [' || status || '] ' || text || ' @L' || line_no || ' `' || snippet || '`'"


def _memo_claims(t: Tables):
    d = t.claims.select(F.col("claim_id").alias("doc_id"), "source", F.sha2("text", 256).alias("sha"), F.size(F.split("text", "\n")).alias("n_lines"), "status", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = F.col("pos") + 1
    return d.select("doc_id", "source", "sha", "n_lines", n.alias("claim_id"), "status", F.replace("line", F.lit("`"), F.lit("")).alias("text"), n.alias("line_no"), records.safe_snip("line").alias("snippet"))


@query("sink_memo", f"select doc_id, '---' || chr(10) || 'source: ' || any_value(source) || chr(10) || 'sha256: ' || any_value(sha) || chr(10) || 'lines: ' || any_value(n_lines) || chr(10) || '---' || chr(10) || string_agg({_line}, chr(10) order by claim_id) memo from memo_claims group by 1")
def _(t: Tables):
    return anchors.render_memo(_memo_claims(t))


@query("scan_memo", "select doc_id, claim_id, status, text, line_no, snippet, true parsed from memo_claims")
def _(t: Tables):
    return anchors.parse_memo(anchors.render_memo(_memo_claims(t)))


@query("scan_frontmatter", "select distinct doc_id, unnest(['source', 'sha256', 'lines']) key, unnest([source, sha, n_lines::varchar]) value from memo_claims")
def _(t: Tables):
    return anchors.frontmatter(anchors.render_memo(_memo_claims(t)))


@query("src_parse_memo_lines", "select distinct doc_id, 'sha256' key, sha value from memo_claims")
def _(t: Tables):
    return anchors.frontmatter(anchors.render_memo(_memo_claims(t)), last_wins=True).where("key = 'sha256'")


@query("join_anti_diff", """select coalesce(a.doc_id, b.doc_id) doc_id, case when b.doc_id is null then 'removed' when a.doc_id is null then 'added' else 'changed' end state
from (select doc_id, sha256(text) sha from documents where doc_id % 13 <> 0) a full join (select doc_id, sha256(case when doc_id % 10 = 1 then text || '!' else text end) sha from documents where doc_id % 10 <> 0) b using (doc_id)
where a.doc_id is null or b.doc_id is null or a.sha <> b.sha""")
def _(t: Tables):
    d = t("documents")
    was = d.where("doc_id % 13 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    now = d.where("doc_id % 10 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return records.freshness(was, now, "doc_id", "sha")


@query("fn_sha", "select doc_id, sha256(text) sha, left(sha256(source || '|' || lang), 16) cache_key from documents")
def _(t: Tables):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha2(F.concat_ws("|", "source", "lang"), 256), 1, 16).alias("cache_key"))


_turn = "role in ('user', 'assistant') and length(trim(text)) >= 15 and not starts_with(text, '<system')"


@query("flt_session_turn", f"select conv_id, turn, role from conversations where {_turn}")
def _(t: Tables):
    return t("conversations").where(records.session_turn("role", "text")).select("conv_id", "turn", "role")


@query("scan_jsonl_transcript", f"select conv_id, turn, role, trim(text) body from conversations where {_turn}")
def _(t: Tables):
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("message")))
    return records.transcript(t("conversations").select("conv_id", "turn", line.alias("line")))


@query("prj_session_truncate", "select conv_id, turn, case when length(text) > 300 then left(text, 150) || ' [...] ' || right(text, 120) else text end body from conversations")
def _(t: Tables):
    return t("conversations").select("conv_id", "turn", records.truncated("text", 300, 150, 120).alias("body"))


@query("win_utf_last", "select user_id, arg_max(value, event_id) last_value, arg_max(event_type, event_id) filter (event_type <> 'view') model from events group by 1")
def _(t: Tables):
    kind = F.col("event_type")
    return t("events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value"), F.max_by(F.when(kind != "view", kind), F.when(kind != "view", F.col("event_id"))).alias("model"))


_usage_line = """case when event_type = 'error' then '{"message": broken' else '{"message":{"model":' || case when event_type = 'view' then 'null' else '"' || event_type || '"' end || ',"usage":{"input_tokens":' || event_id || ',"cache_read_input_tokens":' || (event_id % 7) || '}}}' end"""


@query("scan_tail_last", f"""with f as (select user_id, string_agg({_usage_line}, chr(10) order by event_id) c from events group by 1),
 l as (select user_id, list_filter(case when length(c) > 400 then string_split(right(c, 400), chr(10))[2:] else string_split(c, chr(10)) end, lambda x: ends_with(x, '}}}}}}')) ls from f)
select user_id, cast(regexp_extract(ls[-1], 'input_tokens":([0-9]+)', 1) as bigint) + cast(regexp_extract(ls[-1], 'cache_read_input_tokens":([0-9]+)', 1) as bigint) context_tokens,
 nullif(regexp_extract(list_filter(ls, lambda x: contains(x, '"model":"'))[-1], '"model":"([a-z]+)"', 1), '') model from l where len(ls) > 0""")
def _(t: Tables):
    # Transcripts of events by user, some of their lines broken; the last 400 bytes are read.
    rows = t("events").select("user_id", "event_id", _usage_line_of().alias("line"))
    files_ = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("l")).select("user_id", F.encode(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), "UTF-8").alias("content"))
    return records.tail_usage(files_, "user_id", 400)


def _usage_line_of():
    kind = F.col("event_type")
    usage = F.concat(F.lit('{"message":{"model":'), F.when(kind == "view", "null").otherwise(F.concat(F.lit('"'), kind, F.lit('"'))), F.lit(',"usage":{"input_tokens":'), F.col("event_id").cast("string"), F.lit(',"cache_read_input_tokens":'), (F.col("event_id") % 7).cast("string"), F.lit("}}}"))
    return F.when(kind == "error", '{"message": broken').otherwise(usage)


@query("scan_connectors", "select event_id, event_type name from events where cast(regexp_extract(props, '([0-9]+)', 1) as integer) % 2 = 0")
def _(t: Tables):
    auth = F.when(F.from_json("props", "k int")["k"] % 2 == 0, "authorized").otherwise("needed")
    return records.connectors(t("events").select("event_id", F.to_json(F.array(F.struct(F.col("event_type").alias("name"), auth.alias("auth")))).alias("json"))).select("event_id", "name")


def _session(t: Tables) -> str:
    """Twenty sessions as files: six frames, the calibration once, since it belongs to all."""
    qid = lambda df: df.withColumn("qid", F.col("claim_id") % 20)
    frames = {
        "question": t.scored.select((F.col("claim_id") % 20).alias("qid")).distinct().withColumn("question", F.concat(F.lit("question "), F.col("qid").cast("string"))),
        "claims": qid(t.scored), "verdicts": qid(t.votes.select("claim_id", "panelist", "round", "verdict", "confidence")), "evidence": qid(t.citations), "r_checks": qid(t.checks), "calibration": t.weights.withColumn("qid", F.lit(-1)),
    }
    path = store.scratch(t.spark, "session")
    artefacts.write_session(path, frames)
    return path


@query("sink_json_session", """select claim_id % 20 qid, 'claims' frame, count(*) n from scored group by 1 union all select claim_id % 20, 'verdicts', count(*) from votes group by 1 union all select claim_id % 20, 'evidence', count(*) from citations group by 1
 union all select claim_id % 20, 'r_checks', count(*) from checks group by 1 union all select distinct claim_id % 20, 'question', 1 from scored union all select -1, 'calibration', count(*) from weights""")
def _(t: Tables):
    lines = t.spark.read.schema("value string, qid long, frame string").text(_session(t))
    return lines.groupBy("qid", "frame").agg(F.count("*").alias("n"))


@query("scan_session_json", "select claim_id % 20 qid, claim_id, status, n_valid, round(score, 9) score, passed, citations_verified from scored")
def _(t: Tables):
    rows = artefacts.read_session(t.spark, _session(t), "claims", "claim_id long, status string, n_valid long, score double, passed boolean, citations_verified long")
    return rows.withColumn("score", F.round("score", 9))


@query("sink_worklist", "select claim_id, '{\"claim_id\":' || claim_id || ',\"source\":\"' || source || '\"}' job from claims where status = 'NEEDS_AGENT'")
def _(t: Tables):
    return t.claims.where("status = 'NEEDS_AGENT'").select("claim_id", F.to_json(F.struct("claim_id", "source")).alias("job"))


@query("scan_text_lenient", "select doc_id, doc_id % 7 <> 0 valid, cast(length(text) + case when doc_id % 7 = 0 then 1 else 0 end as bigint) n from documents")
def _(t: Tables):
    raw = F.when(F.col("doc_id") % 7 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("text", "UTF-8"))
    valid, text = records.lenient(raw)
    return t("documents").select("doc_id", valid.alias("valid"), F.length(text).cast("long").alias("n"))


@query("flt_doc_too_thin", "select doc_id, length(trim(text)) < 32 thin from documents")
def _(t: Tables):
    return t("documents").select("doc_id", records.too_thin("text").alias("thin"))


_ext = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))"


@query("fn_profile", f"select page_id, case when {_ext} in ('py', 'js') then 'code' when {_ext} in ('md', 'txt', 'html') then 'prose' else 'generic' end profile from files")
def _(t: Tables):
    return t.files.select("page_id", paths.profile("path", prose=(*paths.PROSE, "html")).alias("profile"))


_role = f"(select *, case when {_ext} = 'png' then 'vision' when est_tokens > 600 then 'long' when {_ext} = 'html' then 'prose' else 'generic' end role from files)"


@query("fn_classify_role", f"select page_id, role from {_role}")
def _(t: Tables):
    return t.files.select("page_id", paths.role("path", paths.profile("path", prose=(*paths.PROSE, "html")), "est_tokens", 600).alias("role"))


@query("join_route_fallback", f"select page_id, case role when 'long' then 'big' when 'prose' then 'small' else 'small' end model from {_role}")
def _(t: Tables):
    roles = t.files.select("page_id", paths.role("path", paths.profile("path", prose=(*paths.PROSE, "html")), "est_tokens", 600).alias("role"))
    return paths.route(roles, {"long": "big", "prose": "small"}, "small").select("page_id", "model")


@query("agg_route_batches", f"select case role when 'long' then 'big' else 'small' end model, count(*) files, cast(sum(est_tokens) as bigint) tokens from {_role} group by 1")
def _(t: Tables):
    roles = t.files.select("est_tokens", paths.role("path", paths.profile("path", prose=(*paths.PROSE, "html")), "est_tokens", 600).alias("role"))
    return paths.route(roles, {"long": "big", "prose": "small"}, "small").groupBy("model").agg(F.count("*").alias("files"), F.sum("est_tokens").alias("tokens"))


@query("ord_batches", f"""select model, cast(case when contains(model, '7b') then 0 when contains(model, '8b') then 1 else 2 end as integer) rank, count(*) files, cast(sum(est_tokens) as bigint) tokens
 from (select case role when 'long' then 'big:32b' when 'prose' then 'writer:8b' when 'vision' then 'seer' else 'coder:7b' end model, est_tokens from {_role}) group by 1 order by rank, model""")
def _(t: Tables):
    roles = t.files.select("est_tokens", paths.role("path", paths.profile("path", prose=(*paths.PROSE, "html")), "est_tokens", 600).alias("role"))
    return paths.batches(paths.route(roles, {"long": "big:32b", "prose": "writer:8b", "vision": "seer"}, "coder:7b"))


@query("ord_files", "select user_id, max(ts) modified from events group by 1 order by modified desc, user_id limit 12")
def _(t: Tables):
    return t("events").groupBy("user_id").agg(F.max("ts").alias("modified")).orderBy(F.desc("modified"), "user_id").limit(12)


@query("adp_model_lookup", f"select page_id, case when {_ext} in ('py', 'js') then 'coder' when {_ext} in ('md', 'txt', 'html') then 'writer' else 'small' end model, case when {_ext} in ('py', 'js') then 32768 when {_ext} in ('md', 'txt', 'html') then 131072 else 8192 end ctx from files")
def _(t: Tables):
    model = paths.lookup(paths.profile("path", prose=(*paths.PROSE, "html")), {"code": "coder", "prose": "writer"}, "small")
    return t.files.select("page_id", model.alias("model"), paths.lookup(model, {"coder": 32768, "writer": 131072}, 8192).alias("ctx"))


@query("agg_corpus_tokens", "select count(*) files, cast(sum(est_tokens) as bigint) tokens from files")
def _(t: Tables):
    return t.files.agg(F.count("*").alias("files"), F.sum("est_tokens").alias("tokens"))


@query("agg_dryrun", "select sum(est_tokens)::bigint raw, count(*) * 450 memo, sum(est_tokens)::bigint - count(*) * 450 saved, sum(est_tokens) - count(*) * 450 > 5000 worth from files")
def _(t: Tables):
    g = t.files.agg(F.sum("est_tokens").alias("raw"), (F.count("*") * 450).alias("memo"))
    return g.select("raw", "memo", (F.col("raw") - F.col("memo")).alias("saved"), (F.col("raw") - F.col("memo") > 5000).alias("worth"))


@query("agg_bench", "select sum(est_tokens)::bigint without_, sum(page_id % 90)::bigint with_, case when sum(est_tokens) > 0 then round(100.0 * (sum(est_tokens) - sum(page_id % 90)) / sum(est_tokens), 1) end pct from files where page_id % 3 <> 0")
def _(t: Tables):
    passed = t.files.where("page_id % 3 <> 0")  # endpoints that failed save nothing
    g = passed.agg(F.sum("est_tokens").alias("without_"), F.sum(F.col("page_id") % 90).alias("with_"))
    return g.select("without_", "with_", F.round(F.try_divide(100.0 * (F.col("without_") - F.col("with_")), F.col("without_")), 1).alias("pct"))


@query("fn_baseline_tokens", "select page_id, case when page_id % 2 = 0 then est_tokens else (select cast(sum(est_tokens) as bigint) from files) end tokens from files")
def _(t: Tables):
    total = t.files.agg(F.sum("est_tokens").alias("total"))
    return t.files.join(F.broadcast(total)).select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("est_tokens")).otherwise(F.col("total")).alias("tokens"))


_tiers = "[200000, 500000, 1000000, 2000000]"
_seen = "(select o_orderkey, cast(floor(o_totalprice * 5) as bigint) seen, case o_orderstatus when 'F' then 'alpha-4-8' when 'O' then 'alpha-4' else 'beta' end model from orders)"
_window = f"(select *, case when starts_with(model, 'alpha-4-8') then 1000000 when starts_with(model, 'alpha-4') then 200000 end known from {_seen})"


@query("join_prefix_lookup", f"select o_orderkey, known from {_window}")
def _(t: Tables):
    return paths.model_window(_usage(t), {"alpha-4": 200_000, "alpha-4-8": 1_000_000}).select("o_orderkey", "known")


@query("join_range_tier", f"select o_orderkey, coalesce(list_min(list_filter({_tiers}, lambda x: x >= seen)), seen) tier from {_seen}")
def _(t: Tables):
    return _usage(t).select("o_orderkey", paths.tier("seen").alias("tier"))


@query("fn_window_tier", f"select o_orderkey, cast(case when seen <= coalesce(known, 200000) then coalesce(known, 200000) else coalesce(list_min(list_filter({_tiers}, lambda x: x >= seen)), seen) end as bigint) win from {_window}")
def _(t: Tables):
    return paths.resolve_window(_usage(t), {"alpha-4": 200_000, "alpha-4-8": 1_000_000}).select("o_orderkey", F.col("window").alias("win"))


@query("fn_pct", f"select o_orderkey, round(100.0 * seen / 1000000, 1) pct, 100.0 * seen / 1000000 >= 70 over_ from {_seen}")
def _(t: Tables):
    pct = 100.0 * F.col("seen") / 1_000_000
    return _usage(t).select("o_orderkey", F.round(pct, 1).alias("pct"), (pct >= 70).alias("over_"))


def _usage(t: Tables):
    status = F.col("o_orderstatus")
    model = F.when(status == "F", "alpha-4-8").when(status == "O", "alpha-4").otherwise("beta")
    return t("orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 5).cast("long").alias("seen"), model.alias("model"))


@query("scan_glob", "select path, min(case when ends_with(path, '.html') then 0 when starts_with(path, 'en/') then 1 end) pattern from files where ends_with(path, '.html') or starts_with(path, 'en/') group by 1")
def _(t: Tables):
    return paths.glob(t.files, ["*.html", "en/*"]).groupBy("path").agg(F.min("pattern").alias("pattern"))


@query("scan_exclude", "select page_id, path from files where not (starts_with(path, 'de/') or ends_with(path, '.html') or starts_with(path, 'fr/1'))")
def _(t: Tables):
    return t.files.where(~paths.excluded("path", ["de/*", "*.html", "fr/1*"])).select("page_id", "path")


# A tree of files: documents by language, source and kind, a file in each folder.
_tree = "(select 'lang=' || lang || '/source=' || source || '/kind=' || (doc_id % 3) dir, count(*) n, cast(sum(strlen(text) + 1) as bigint) size from documents group by 1)"


def _tree_of(t: Tables) -> str:
    root = store.scratch(t.spark, "tree")
    rows = t("documents").select(F.col("text").alias("value"), "lang", "source", (F.col("doc_id") % 3).alias("kind"))
    rows.repartition("lang", "source", "kind").write.partitionBy("lang", "source", "kind").text(root)
    return root


@query("scan_files", f"select dir, size, case when dir like '%/kind=1' then 0 when starts_with(dir, 'lang=en/') then 1 else 2 end pattern, dir like '%/kind=2' or starts_with(dir, 'lang=de/') or starts_with(dir, 'lang=fr/source=src3/') excluded from {_tree}")
def _(t: Tables):
    found = files.included(files.listing(t.spark, _tree_of(t)), ["*/*/kind=1/*.txt", "lang=en/**/*.txt", "**/*.txt", "*.txt"])
    tagged = files.tagged(found, files.exclusions(t.spark, ["kind=2/", "lang=de/*", "lang=fr/source=src3/**", "ource*", ""]))
    return tagged.select(F.regexp_extract("rel", "^(.*)/", 1).alias("dir"), "size", "pattern", "excluded")


def _session_id(k: str) -> str:
    return f"substr(md5('session {k}'), 1, 8) || '-' || substr(md5('session {k}'), 9, 4) || '-4000-8000-' || substr(md5('session {k}'), 13, 12)"


@query("src_find_session", "select 'hinted' how, " + _session_id("1") + " session, count(*) n from conversations where conv_id % 3 = 1 having count(*) > 0 union all select 'newest', " + _session_id("2") + ", count(*) from conversations where conv_id % 3 = 2 having count(*) > 0 union all select 'order ' || k, case k when 1 then " + _session_id("2") + " when 2 then " + _session_id("1") + " else " + _session_id("0") + " end, k from (select unnest([1, 2, 3]) k)")
def _(t: Tables):
    # Three sessions, written one after the other; a hint names the second, and without one the last is found.
    root, ids = store.scratch(t.spark, "sessions"), []
    for k in range(3):
        digest = hashlib.md5(f"session {k}".encode()).hexdigest()  # noqa: S324 a name
        ids.append(f"{digest[:8]}-{digest[8:12]}-4000-8000-{digest[12:24]}")
        line = F.to_json(F.struct("conv_id", "turn", "role"))
        t("conversations").where(F.col("conv_id") % 3 == k).select(line.alias("value"), F.lit(ids[k]).alias("session")).coalesce(1).write.partitionBy("session").mode("append").text(root)
    listed = files.listing(t.spark, root)
    out = []
    for how, one in (("hinted", files.find(listed, F.lit(f"session={ids[1]}"))), ("newest", files.find(listed, F.lit("session=unknown")))):
        at = one.first()
        lines = t.spark.read.text(at["path"]).agg(F.count("*").alias("n"))
        out.append(lines.select(F.lit(how).alias("how"), F.lit(at["rel"].split("/")[0].split("=")[1]).alias("session"), "n"))
    ranked = files.newest(listed, 12).withColumn("n", F.row_number().over(Window.orderBy(F.desc("modified"), "rel")).cast("long"))  # twelve rows
    out.append(ranked.select(F.concat(F.lit("order "), F.col("n").cast("string")).alias("how"), F.regexp_extract("rel", "session=([^/]+)", 1).alias("session"), "n"))
    return artefacts.union(*out)


@query("scan_tail_files", f"""with f as (select user_id % 16 transcript, string_agg({_usage_line}, chr(10) order by event_id) || chr(10) c from events group by 1),
 l as (select transcript, length(c) size, list_filter(case when length(c) > 2000 then string_split(right(c, 2000), chr(10))[2:] else string_split(c, chr(10)) end, lambda x: ends_with(x, '}}}}}}')) ls from f)
select transcript, least(2000, size) "read", cast(regexp_extract(ls[-1], 'input_tokens":([0-9]+)', 1) as bigint) + cast(regexp_extract(ls[-1], 'cache_read_input_tokens":([0-9]+)', 1) as bigint) context_tokens,
 nullif(regexp_extract(list_filter(ls, lambda x: contains(x, '"model":"'))[-1], '"model":"([a-z]+)"', 1), '') model from l where len(ls) > 0""")
def _(t: Tables):
    # Transcripts as files, of which the last 2,000 bytes are read.
    root = store.scratch(t.spark, "transcripts")
    rows = t("events").select((F.col("user_id") % 16).alias("transcript"), "event_id", _usage_line_of().alias("value"))
    rows.repartition("transcript").sortWithinPartitions("transcript", "event_id").select("transcript", "value").write.partitionBy("transcript").text(root)
    ends = files.tails(root, files.listing(t.spark, root), 2000).withColumn("transcript", F.regexp_extract("rel", "transcript=([0-9]+)", 1).cast("long"))
    return records.tail_usage(ends, "transcript", None).join(ends.select("transcript", "read"), "transcript")


@query("scan_route_doc", f"select page_id, case when {_ext} = 'html' then 'doctotext' else 'copy' end tool, case when length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) < 32 then 'too little text' end error from pages join files using (page_id)")
def _(t: Tables):
    joined = t.files.join(t("pages").select("page_id", "html"), "page_id")
    return joined.select("page_id", paths.tool_for("path").alias("tool"), F.when(records.too_thin(F.regexp_replace("html", "<[^>]*>", "")), "too little text").alias("error"))


@query("win_top_topic", "select doc_id, line topic from (select doc_id, line, row_number() over (partition by doc_id order by length(line) desc, line_no) rn from lines where not regexp_matches(line, '(?i)^(?:imports?|setup)\\b')) where rn = 1")
def _(t: Tables):
    rows = t.lines.where(~F.col("line").rlike(r"(?i)^(?:imports?|setup)\b"))
    return rows.groupBy("doc_id").agg(F.max_by("line", F.struct(F.length("line"), -F.col("line_no"))).alias("topic"))


@query("retire_stale", "select doc_id, case when doc_id % 10 <> 1 then 'kept' when doc_id % 20 = 1 then 'stale' else 'replaced' end state from documents")
def _(t: Tables):
    # A tenth of the sources has changed; half of those give no claims any more.
    d = t("documents")
    memos = d.select("doc_id", F.sha2("text", 256).alias("sha"))
    made = d.where("doc_id % 10 = 1").select("doc_id", F.sha2(F.concat("text", F.lit("!")), 256).alias("sha"), F.when(F.col("doc_id") % 20 == 1, 0).otherwise(3).alias("n_claims"))
    return records.retired(memos, made)


@query("incremental_work", "select doc_id from documents where doc_id % 13 = 0 or doc_id % 10 = 1")
def _(t: Tables):
    d = t("documents")
    seen = d.where("doc_id % 13 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    now = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return now.join(seen, ["doc_id", "sha"], "left_anti").select("doc_id")
