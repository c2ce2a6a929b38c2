"""Queries of the claim index and of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import duck
from factloom.functions import text as tx
from factloom.operators import artefacts, index, segments
from factloom.sources import store
from factloom.streaming import feedback

from .registry import Tables, query

#: The question that the retrieval queries ask.
QUESTION = "That and onesen erblest it hein ti inenan eranenes whou therouou thon the"


def _terms_sql(source: str) -> str:
    """(question_id, term, tokens) of a source (question_id, text)."""
    split = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2 and not list_contains(" + duck.STOPS + ", w))"
    return f"(select * from (select distinct question_id, stem term, {duck.words('stem')} tokens from {duck.stem_steps(f'(select question_id, unnest({split}) w from {source})')}) where len(tokens) > 0)"


def _bm_sql(source: str) -> str:
    """(question_id, claim_id, bm25): words with their positions, a term's occurrences as stretches of them that begin with its tokens."""
    return f"""(with ws as (select claim_id, list_concat({duck.words('text')}, coalesce(flatten(list_transform(k, lambda x: list_concat([null], {duck.words('x')}))), [])) ws
   from claims left join (select claim_id, list(keyword order by keyword) k from keywords group by 1) using (claim_id)),
 words as (select claim_id, ws, len(list_filter(ws, lambda x: x is not null)) dl from ws), st as (select count(*) n, avg(dl) avgdl from words),
 places as (select claim_id, dl, unnest(ws) w, generate_subscripts(ws, 1) i from words), terms as materialized {_terms_sql(source)},
 hit as (select question_id, term, claim_id, dl, i from terms join places on starts_with(w, tokens[1]) and len(tokens) = 1
  union all select question_id, term, a.claim_id, a.dl, a.i from terms join places a on a.w = tokens[1] and len(tokens) > 1 join words b on b.claim_id = a.claim_id
   and b.ws[a.i:a.i + len(tokens) - 2] = tokens[1:len(tokens) - 1] and starts_with(b.ws[a.i + len(tokens) - 1], tokens[len(tokens)])),
 tf as (select question_id, term, claim_id, dl, count(*) tf from hit group by all), df as (select question_id, term, count(*) df from tf group by all)
 select question_id, claim_id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) bm25 from tf join df using (question_id, term), st group by all)"""


_asked = f"(select distinct stem keyword from {duck.stem_steps(f'(select unnest({duck.split_ident(duck.quoted(QUESTION))}) w) where length(w) >= 2 and not list_contains({duck.STOPS}, w)')} where not list_contains({duck.STOPS}, stem))"
_kw = f"""(select claim_id, sum(round(weight * (0.4 + idf), 3)) s from keywords join idf using (keyword) where keyword in (select keyword from {_asked}) group by 1)"""
_bm = f"(select claim_id, bm25 from {_bm_sql(f'(select 0 question_id, {duck.quoted(QUESTION)} as text)')})"
#: Questions of a table: passages whose words stand in pairs, as identifiers do.
_paired = "(select item_id question_id, regexp_replace(text, '([a-z]+) ([a-z]+)', '\\1_\\2', 'g') as text from benchmark)"
#: Whole words, and letters cut from the middle of words, which no stem matches.
_searched = "(select 2 * item_id question_id, array_to_string(string_split(text, ' ')[1:4], ' ') as text from benchmark union all select 2 * item_id + 1, substr(text, 3, 7) from benchmark)"
_search_words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '' and not list_contains(" + duck.array(tx.STOP_SEARCH) + ", w))"
_fts = f"(select claim_id, 0.35 + 0.65 * bm25 / (max(bm25) over ()) fts from (select * from {_bm} order by round(bm25, 9) desc, claim_id limit 64))"
_kw64 = f"(select claim_id, least(1.0, s / 8) kw from (select * from {_kw} order by s desc, claim_id limit 64))"
_both = f"(select coalesce(a.claim_id, b.claim_id) claim_id, cast(coalesce(fts, 0.0) as double) fts, cast(coalesce(kw, 0.0) as double) kw from {_fts} a full join {_kw64} b on a.claim_id = b.claim_id)"
_hits = f"(select claim_id, source, status, utility, 0.6 * greatest(fts, kw) + 0.4 * least(fts, kw) rel from {_both} join indexed using (claim_id))"
_gate = "status not in ('REFUTED', 'STALE', 'NEEDS_AGENT', 'PENDING', 'UNSUPPORTED')"


@query("fn_stopwords", f"select claim_id, cast(len(w) as integer) n, cast(len(list_filter(w, lambda x: not list_contains({duck.STOPS}, x))) as integer) kept from (select claim_id, list_filter({duck.split_ident('text')}, lambda x: x <> '') w from claims)")
def _(t: Tables):
    return t.claims.select("claim_id", tx.split_ident("text").alias("w")).select("claim_id", F.size("w").alias("n"), F.size(F.filter("w", lambda x: ~x.isin(tx.STOP))).alias("kept"))


@query("fn_split_ident", f"select word, count(*) n from (select unnest({duck.split_ident('text')}) word from claims) where word <> '' group by 1")
def _(t: Tables):
    return t.claims.select(F.explode(tx.split_ident("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_vocabulary = f"(select distinct unnest({duck.split_ident('text')}) w from claims)"


@query("fn_depluralize", f"select w word, {duck.depluralise('w')} singular from {_vocabulary} where w <> ''")
def _(t: Tables):
    return t.claims.select(F.explode(tx.split_ident("text")).alias("word")).distinct().select("word", tx.depluralise("word").alias("singular"))


@query("fn_stem", f"select w word, stem from {duck.stem_steps(_vocabulary)} where w <> ''")
def _(t: Tables):
    return t.claims.select(F.explode(tx.split_ident("text")).alias("word")).distinct().select("word", tx.stem("word").alias("stem"))


@query("fn_keywords", "select claim_id, keyword, cast(weight as double) weight from keywords")
def _(t: Tables):
    return t.keywords


@query("fn_numbers", f"select claim_id, unnest(regexp_extract_all(text, {duck.quoted(tx.NUMBER)})) number from claims")
def _(t: Tables):
    return t.claims.select("claim_id", F.explode(F.regexp_extract_all("text", F.lit(tx.NUMBER), F.lit(0))).alias("number"))


@query("fn_specificity", "select claim_id, specificity from indexed")
def _(t: Tables):
    return t.claims.select("claim_id", tx.specificity("text").alias("specificity"))


@query("fn_utility", "select claim_id, utility from indexed")
def _(t: Tables):
    return t.indexed.select("claim_id", "utility")


@query("fn_kw_weight", "select claim_id, keyword, round(cast(weight as double) * (0.4 + idf), 3) weight from keywords join idf using (keyword)")
def _(t: Tables):
    return index.postings(t.stored, t.idf)


@query("agg_df_idf", "select keyword, df, round(idf, 9) idf from idf")
def _(t: Tables):
    return index.idf(t.keywords, t.claims).select("keyword", "df", F.round("idf", 9).alias("idf"))


@query("agg_mean_idf", "select claim_id, round(coalesce(idf, 0.0), 9) idf from claims left join (select claim_id, avg(idf) idf from keywords join idf using (keyword) group by 1) using (claim_id)")
def _(t: Tables):
    return t.claims.select("claim_id").join(index.mean_idf(t.stored, t.idf), "claim_id", "left").select("claim_id", F.round(F.coalesce("idf", F.lit(0.0)), 9).alias("idf"))


@query("agg_distinct", "select (select count(distinct keyword) from keywords) keywords, (select count(distinct source) from claims) sources")
def _(t: Tables):
    return t.keywords.agg(F.countDistinct("keyword").alias("keywords")).join(F.broadcast(t.claims.agg(F.countDistinct("source").alias("sources"))))


@query("agg_prunable", "select count(*) prunable from indexed where utility < 0.15")
def _(t: Tables):
    return t.indexed.where("utility < 0.15").agg(F.count("*").alias("prunable"))


@query("agg_status_stats", "select status, count(*) n, round(avg(utility), 3) utility from indexed group by 1")
def _(t: Tables):
    return t.indexed.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("utility"), 3).alias("utility")).orderBy(F.desc("n"), "status")


@query("agg_hist_utility", """select bucket, count(*) n, cast(round(40.0 * count(*) / sum(count(*)) over ()) as bigint) bar
from (select case when utility < 0.15 then 0 when utility < 0.35 then 1 when utility < 0.55 then 2 else 3 end bucket from indexed) group by 1""")
def _(t: Tables):
    u = F.col("utility")
    counted = t.indexed.groupBy(F.when(u < 0.15, 0).when(u < 0.35, 1).when(u < 0.55, 2).otherwise(3).alias("bucket")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("all"))
    return counted.join(F.broadcast(total)).select("bucket", "n", F.round(40.0 * F.col("n") / F.col("all")).cast("long").alias("bar"))


@query("agg_rare_kw", "select keyword, count(*) n from keywords group by 1 having count(*) <= 2 order by n, keyword limit 8")
def _(t: Tables):
    return t.keywords.groupBy("keyword").agg(F.count("*").alias("n")).where("n <= 2").orderBy("n", "keyword").limit(8)


@query("agg_noise_kw", "select keyword, count(*) n from keywords group by 1 order by n desc, keyword limit 5")
def _(t: Tables):
    return t.keywords.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(5)


@query("agg_kw_score", f"select claim_id, round(least(1.0, s / 8), 6) kw from {_kw}")
def _(t: Tables):
    return index.keyword_scores(t.index, QUESTION).select("claim_id", F.round("kw", 6).alias("kw"))


@query("top_kw", f"select claim_id, round(kw, 6) kw from {_kw64}")
def _(t: Tables):
    return index.keyword_scores(t.index, QUESTION, 64).select("claim_id", F.round("kw", 6).alias("kw"))


def _paired_questions(t: Tables):
    return t("benchmark").select(F.col("item_id").alias("question_id"), F.regexp_replace("text", "([a-z]+) ([a-z]+)", "$1_$2").alias("text"))


@query("fn_fts_query", f"select question_id, term, array_to_string(tokens, ' ') phrase from {_terms_sql(_paired)}")
def _(t: Tables):
    return index.asked(_paired_questions(t)).select("question_id", "term", F.array_join("tokens", " ").alias("phrase"))


@query("bm25_phrases", f"select question_id, claim_id, round(bm25, 6) bm25 from {_bm_sql(_paired)}")
def _(t: Tables):
    return index.bm25_of_many(t.index, _paired_questions(t)).select("question_id", "claim_id", F.round("bm25", 6).alias("bm25"))


@query("bm25", f"select claim_id, round(bm25, 6) bm25 from {_bm}")
def _(t: Tables):
    return index.bm25(t.index, QUESTION).select("claim_id", F.round("bm25", 6).alias("bm25"))


@query("top_fts", f"select claim_id, round(bm25, 6) bm25 from {_bm} order by round(bm25, 9) desc, claim_id limit 64")
def _(t: Tables):
    return index.bm25(t.index, QUESTION).orderBy(F.desc(F.round("bm25", 9)), "claim_id").limit(64).select("claim_id", F.round("bm25", 6).alias("bm25"))


@query("win_fts_norm", f"select claim_id, round(fts, 6) fts from {_fts}")
def _(t: Tables):
    return index.full_text(t.index, QUESTION, 64).select("claim_id", F.round("fts", 6).alias("fts"))


@query("join_full_scores", f"select claim_id, round(fts, 6) fts, round(kw, 6) kw from {_both}")
def _(t: Tables):
    return index.candidates(t.index, QUESTION, 8).select("claim_id", F.round("fts", 6).alias("fts"), F.round("kw", 6).alias("kw"))


@query("join_lookup_claims", f"select claim_id, source, status, utility from {_both} join indexed using (claim_id)")
def _(t: Tables):
    return index.candidates(t.index, QUESTION, 8).join(t.indexed, "claim_id").select("claim_id", "source", "status", "utility")


@query("fn_relevance", f"select claim_id, round(rel, 3) relevance from {_hits}")
def _(t: Tables):
    rel = 0.6 * F.greatest("fts", "kw") + 0.4 * F.least("fts", "kw")
    return index.candidates(t.index, QUESTION, 8).select("claim_id", F.round(rel, 3).alias("relevance"))


@query("fn_score", f"select claim_id, round((0.25 + 0.75 * rel) * (0.5 + 0.5 * utility), 4) score from {_hits}")
def _(t: Tables):
    rel = 0.6 * F.greatest("fts", "kw") + 0.4 * F.least("fts", "kw")
    return index.candidates(t.index, QUESTION, 8).join(t.indexed, "claim_id").select("claim_id", F.round((0.25 + 0.75 * rel) * (0.5 + 0.5 * F.col("utility")), 4).alias("score"))


_top = f"""select claim_id, source, status, utility, round(rel, 3) relevance, round((0.25 + 0.75 * rel) * (0.5 + 0.5 * utility), 4) score from {_hits}
where %s and utility >= 0.15 order by score desc, utility desc, source, 'C' || claim_id limit 8"""


@query("top_query", _top % _gate)
def _(t: Tables):
    return index.search(t.index, QUESTION)


@query("top_query_unproven", _top % "status not in ('REFUTED', 'STALE')")
def _(t: Tables):
    return index.search(t.index, QUESTION, include_unproven=True)


_hits_kept = f"select claim_id, cast(sum(hits) as bigint) hits, cast(sum(helpful) as bigint) helpful, cast(sum(unhelpful) as bigint) unhelpful from (select claim_id, hits, helpful, unhelpful from feedback union all select claim_id, 1, 0, 0 from ({_top % _gate})) group by 1"


@query("agg_hits", _hits_kept)
def _(t: Tables):
    return index.shown(t.feedback, index.search(t.index, QUESTION))


@query("feedback_state", _hits_kept)
def _(t: Tables):
    """Events arrive as files in two lots, which a stream folds; a search's hits are appended, twice under one name; a last run of the
    stream finds nothing new."""
    path = store.scratch(t.spark, "feedback")
    kind = F.expr("case event_type when 'purchase' then 'helpful' when 'error' then 'unhelpful' else 'shown' end")
    events = t("events").select(F.col("user_id").alias("claim_id"), kind.alias("kind"), "event_id")
    early = F.coalesce(F.col("event_id") <= F.lit(t("events").agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]), F.lit(False))
    lots = (events.where(early), events.where(~early), None)
    for lot in lots:
        if lot is not None:
            lot.drop("event_id").write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema("claim_id long, kind string").parquet(f"{path}/in")
        feedback.append_counters(stream, f"{path}/counters", f"{path}/progress").awaitTermination()
    for _ in range(2):
        feedback.append_shown(index.search(t.index, QUESTION), f"{path}/counters", "first")
    return feedback.totals(t.spark, f"{path}/counters")


@query("index_build", f"""select 'claims' name, count(*) n from claims union all select 'keywords', count(*) from keywords union all select 'postings', count(*) from keywords union all select 'idf', count(*) from idf
 union all select 'memos', count(distinct source) from claims union all select 'stats', 1 union all select 'stem_stats', 1
 union all select 'terms', count(*) from (select distinct claim_id, w from (select claim_id, unnest({duck.words('text')}) w from claims union all select claim_id, unnest({duck.words('keyword')}) from keywords))
 union all select 'stems', count(*) from (select distinct claim_id, p from {duck.porter(f"(select claim_id, unnest({_search_words}) w from claims)")})""")
def _(t: Tables):
    out = None
    for name, df in t.index.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _updated(t: Tables):
    """The claims indexed in segments: first as they were, with other texts for one in a hundred, a tenth not there yet and some that go;
    then brought up to date, twice more, the last time after the segments were merged."""
    path = store.scratch(t.spark, "segments")
    now = t.claims.withColumn("sha", F.sha2("text", 256)).select("claim_id", "source", "sha", "status", "text")
    early = F.when(F.col("claim_id") % 100 == 0, F.concat(F.lit("an older text of "), "text")).otherwise(F.col("text"))
    was = now.where("claim_id % 10 <> 3").withColumn("text", early).withColumn("sha", F.sha2("text", 256)).unionByName(now.where("claim_id % 50 = 1").withColumn("claim_id", -F.col("claim_id")))
    half = now.where("claim_id % 20 <> 3")
    for state, merge in ((was, False), (half, True), (now, False)):
        listing = state.drop("text")
        segments.update(path, listing, lambda ids, s=state: s.join(ids, "claim_id", "left_semi").select("claim_id", "text"), t.feedback)
        if merge:
            segments.compact(path, listing, t.feedback)
    return segments.read(t.spark, path)


@query("index_update", "select claim_id, source, status, round(specificity, 6) specificity, round(idf, 6) idf, hits, helpful, unhelpful, utility from indexed")
def _(t: Tables):
    return _updated(t)["claims"].select("claim_id", "source", "status", F.round("specificity", 6).alias("specificity"), F.round("idf", 6).alias("idf"), "hits", "helpful", "unhelpful", "utility")


@query("index_update_search", f"select 'search' how, claim_id, score from ({_top % _gate}) union all select 'bm25', claim_id, round(bm25, 6) from {_bm} union all select 'keywords', claim_id, round(least(1.0, s / 8), 6) from {_kw}")
def _(t: Tables):
    found = _updated(t)
    parts = (("search", index.search(found, QUESTION), F.col("score")), ("bm25", index.bm25(found, QUESTION), F.round("bm25", 6)), ("keywords", index.keyword_scores(found, QUESTION), F.round("kw", 6)))
    return artefacts.union(*(df.select(F.lit(how).alias("how"), "claim_id", score.alias("score")) for how, df, score in parts))


@query("flt_status_gate", f"select claim_id, status from claims where {_gate}")
def _(t: Tables):
    return t.claims.where(tx.status_allowed("status")).select("claim_id", "status")


@query("flt_utility_floor", "select claim_id, utility from indexed where utility >= 0.15")
def _(t: Tables):
    return t.indexed.where("utility >= 0.15").select("claim_id", "utility")


@query("flt_pending", "select claim_id, source, utility from indexed where status in ('NEEDS_AGENT', 'PENDING') and utility >= 0.2 and source = 'src3' order by utility desc, claim_id limit 100")
def _(t: Tables):
    return t.indexed.where("status in ('NEEDS_AGENT', 'PENDING') and utility >= 0.2 and source = 'src3'").orderBy(F.desc("utility"), "claim_id").limit(100).select("claim_id", "source", "utility")


@query("ord_pending", "select claim_id, utility from indexed where status in ('NEEDS_AGENT', 'PENDING') order by utility desc, claim_id limit 25")
def _(t: Tables):
    return t.indexed.where("status in ('NEEDS_AGENT', 'PENDING')").orderBy(F.desc("utility"), "claim_id").limit(25).select("claim_id", "utility")


@query("flt_eager_split", "select case when utility >= 0.25 then 'EAGER' else 'lazy' end label, count(*) n from indexed where status in ('NEEDS_AGENT', 'PENDING') group by 1")
def _(t: Tables):
    return t.indexed.where("status in ('NEEDS_AGENT', 'PENDING')").groupBy(F.when(F.col("utility") >= 0.25, "EAGER").otherwise("lazy").alias("label")).agg(F.count("*").alias("n"))


@query("fn_depth", "select claim_id, depth, unnest(['literal', 'contradiction', 'edges'][1:depth]) lens from (select claim_id, case when utility >= 0.7 then 3 when utility >= 0.4 then 2 else 1 end depth from indexed)")
def _(t: Tables):
    u = F.col("utility")
    depth = F.when(u >= 0.7, 3).when(u >= 0.4, 2).otherwise(1)
    return t.indexed.select("claim_id", depth.alias("depth")).select("claim_id", "depth", F.explode(F.slice(F.array(F.lit("literal"), F.lit("contradiction"), F.lit("edges")), 1, F.col("depth"))).alias("lens"))


@query("join_feedback_carry", "select claim_id, coalesce(hits, 0) hits, coalesce(helpful, 0) helpful, coalesce(unhelpful, 0) unhelpful from claims left join feedback using (claim_id)")
def _(t: Tables):
    return t.claims.select("claim_id").join(t.feedback, "claim_id", "left").fillna(0, ["hits", "helpful", "unhelpful"])


@query("join_anti_orphan", "select count(*) orphans from keywords where claim_id not in (select claim_id from claims where status <> 'REFUTED')")
def _(t: Tables):
    return t.keywords.join(t.claims.where("status <> 'REFUTED'").select("claim_id"), "claim_id", "left_anti").agg(F.count("*").alias("orphans"))


@query("agg_handoff", "select count(*) total, count(*) filter (status in ('NEEDS_AGENT', 'PENDING')) pending, count(distinct source) sources from claims")
def _(t: Tables):
    return t.claims.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("NEEDS_AGENT", "PENDING")).alias("pending"), F.countDistinct("source").alias("sources"))


@query("agg_hook_count", "select count(*) proven from claims where status in ('CONFIRMED', 'DRIFTED')")
def _(t: Tables):
    return t.claims.agg(F.count_if(F.col("status").isin("CONFIRMED", "DRIFTED")).alias("proven"))


@query("agg_trust", "select source, count(*) filter (status in ('CONFIRMED', 'DRIFTED')) good, count(*) total, count(*) filter (status in ('NEEDS_AGENT', 'PENDING')) pending from claims group by 1")
def _(t: Tables):
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return t.claims.groupBy("source").agg(count("CONFIRMED", "DRIFTED").alias("good"), F.count("*").alias("total"), count("NEEDS_AGENT", "PENDING").alias("pending"))


@query("agg_tally", "select source memo, string_agg(n || ' ' || status, ', ' order by status) tally from (select source, status, count(*) n from claims group by all) group by 1")
def _(t: Tables):
    counted = t.claims.groupBy("source", "status").agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["status"]))
    return counted.groupBy(F.col("source").alias("memo")).agg(F.array_join(parts, ", ").alias("tally"))


@query("agg_verify_summary", "select status, count(*) n, cast(floor(100 * count(*) / sum(count(*)) over ()) as bigint) pct from claims group by 1")
def _(t: Tables):
    counted = t.claims.groupBy("status").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(counted.agg(F.sum("n").alias("all")))).select("status", "n", F.floor(100 * F.col("n") / F.col("all")).cast("long").alias("pct"))


@query("agg_ledger_tokens", """select source, raw, memo, raw - memo saved, cast(floor(100 * (raw - memo) / raw) as bigint) pct
from (select source, cast(sum(greatest(1, floor(length(text) / 4))) as bigint) raw, cast(sum(60 + len(string_split(text, chr(10)))) as bigint) memo from claims group by 1)""")
def _(t: Tables):
    g = t.claims.groupBy("source").agg(F.sum(tx.est_tokens("text")).alias("raw"), F.sum(F.size(F.split("text", "\n")) + 60).alias("memo"))
    return g.select("source", "raw", "memo", (F.col("raw") - F.col("memo")).alias("saved"), F.floor(100 * (F.col("raw") - F.col("memo")) / F.col("raw")).cast("long").alias("pct"))


@query("fn_est_tokens", "select claim_id, greatest(1, cast(floor(length(text) / 4) as bigint)) tokens, cast(floor(length(text) / 4) as bigint) + 12 hit_cost from claims")
def _(t: Tables):
    return t.claims.select("claim_id", tx.est_tokens("text").alias("tokens"), (F.floor(F.length("text") / 4).cast("long") + 12).alias("hit_cost"))


@query("fn_hit_cost", "select cast(sum(floor(length(text) / 4) + 12) as bigint) cost from claims where " + _gate)
def _(t: Tables):
    return t.claims.where(tx.status_allowed("status")).agg(F.sum(F.floor(F.length("text") / 4).cast("long") + 12).alias("cost"))


@query("top_search", f"""with toks as (select claim_id, {_search_words} ws from claims), vocabulary as materialized (select w, p from {duck.porter(f'(select distinct unnest(ws) w from (select ws from toks union all select {_search_words} from {_searched}))')}),
 posts as (select claim_id, p, len(ws) dl, count(*) tf from (select claim_id, ws, unnest(ws) w from toks) join vocabulary using (w) group by claim_id, p, len(ws)), st as (select count(*) n, avg(len(ws)) avgdl from toks),
 df as (select p, count(*) df from posts group by 1), wanted as (select distinct question_id, p from (select question_id, unnest({_search_words}) w from {_searched}) join vocabulary using (w)),
 weighed as (select question_id, claim_id, sum(log10((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) score from wanted join posts using (p) join df using (p), st group by all),
 plain as (select question_id, claim_id from {_searched} q join claims c on lower(c.text) like '%' || lower(q.text) || '%' where question_id not in (select question_id from weighed))
select question_id, claim_id, round(score, 6) score from weighed qualify row_number() over (partition by question_id order by round(score, 9) desc, claim_id) <= 20
union all select question_id, claim_id, null from plain qualify row_number() over (partition by question_id order by claim_id) <= 20""")
def _(t: Tables):
    b = t("benchmark")
    questions = b.select((2 * F.col("item_id")).alias("question_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("text")).unionByName(b.select((2 * F.col("item_id") + 1).alias("question_id"), F.substring("text", 3, 7).alias("text")))
    return index.stem_search(t.index, t.claims, questions).select("question_id", "claim_id", F.round("score", 6).alias("score"))


@query("search_like", "select doc_id from short where contains(lower(claim), 'thonon')")
def _(t: Tables):
    return index.like_search(t.short, "thonon").select("doc_id")


@query("fn_grade", """select item_id, found, first_source from (select item_id, count(claim_id) > 0 found, min(source) first_source
from benchmark b left join claims c on contains(lower(c.text), lower(b.text)) and len(string_split(b.text, ' ')) >= 5 group by 1)""")
def _(t: Tables):
    # An endpoint is answered by a claim that contains what it expects.
    items = t("benchmark").select("item_id", F.col("text").alias("expect"))
    hits = index.contained(t.claims, items).join(t.claims.select("claim_id", "source"), "claim_id").groupBy("item_id").agg(F.min("source").alias("first_source"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.col("first_source").isNotNull().alias("found"), "first_source")
