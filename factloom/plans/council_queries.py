"""Queries of votes, evidence, the ledger and the statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import duck
from factloom.functions import text as tx
from factloom.operators import council, evidence, ledger, meta, petals

from .registry import Tables, query

CAT = "(select claim_id, count(*) filter (verdict = 'support') s, count(*) filter (verdict = 'refute') r, count(*) filter (verdict = 'uncertain') u, count(*) m from votes group by 1 having count(*) >= 2)"


@query("win_latest_round", "select claim_id, panelist, round, seq, verdict, confidence, discharged from latest")
def _(t: Tables):
    return council.latest_round(t.reviews).select("claim_id", "panelist", "round", "seq", "verdict", "confidence", "discharged")


@query("win_max_round_rows", "select claim_id, panelist, seq from (select *, max(round) over (partition by claim_id) m from reviews) where round = m")
def _(t: Tables):
    # The maximum is aggregated first, so that a claim's rows never meet in one window.
    best = t.reviews.groupBy("claim_id").agg(F.max("round").alias("round"))
    return t.reviews.join(best, ["claim_id", "round"]).select("claim_id", "panelist", "seq")


@query("flt_duty", "select seq, case when k >= 40 and 100 - k >= 40 then verdict end verdict from reviews")
def _(t: Tables):
    pro, contra = F.expr("repeat('p', k)"), F.expr("concat(repeat(' ', 5), repeat('c', 100 - k))")
    return t.reviews.select("seq", council.duty("verdict", pro, contra).alias("verdict"))


@query("agg_vote_counts", "select claim_id, n_valid, n_support, n_refute, n_uncertain from consensus")
def _(t: Tables):
    return council.consensus(t.votes, t.weights).drop("score")


@query("agg_consensus", "select claim_id, round(score, 9) score from consensus")
def _(t: Tables):
    return council.consensus(t.votes, t.weights).select("claim_id", F.round("score", 9).alias("score"))


@query("join_weight_lookup", "select claim_id, panelist, coalesce(weight, 1.0) weight from votes left join (select * from weights where panelist <> 'p5') using (panelist)")
def _(t: Tables):
    known = t.weights.where("panelist <> 'p5'")  # a panelist without a record weighs 1
    return t.votes.join(known, "panelist", "left").select("claim_id", "panelist", F.coalesce("weight", F.lit(1.0)).alias("weight"))


@query("agg_fleiss", f"select round((p - pe) / (1 - pe), 9) kappa from (select avg((s*s + r*r + u*u - m) / (m * (m - 1))) p, (sum(s) / sum(m)) ** 2 + (sum(r) / sum(m)) ** 2 + (sum(u) / sum(m)) ** 2 pe from {CAT})")
def _(t: Tables):
    return council.fleiss(t.votes).select(F.round("kappa", 9).alias("kappa"))


@query("agg_kripp", f"""select round(1 - (1 - o / n) / (1 - (a*(a-1) + b*(b-1) + c*(c-1)) / (n * (n - 1))), 9) alpha
from (select sum((s*(s-1) + r*(r-1) + u*(u-1)) / (m - 1)) o, cast(sum(m) as double) n, cast(sum(s) as double) a, cast(sum(r) as double) b, cast(sum(u) as double) c from {CAT})""")
def _(t: Tables):
    return council.krippendorff(t.votes).select(F.round("alpha", 9).alias("alpha"))


@query("fn_kappa_label", "select claim_id, case when score < 0 then 'poor' when score < 0.21 then 'slight' when score < 0.41 then 'fair' when score < 0.61 then 'moderate' when score < 0.81 then 'substantial' else 'almost perfect' end label from consensus")
def _(t: Tables):
    return council.consensus(t.votes, t.weights).select("claim_id", council.kappa_label("score").alias("label"))


@query("fn_classify_claim", "select claim_id, status from scored")
def _(t: Tables):
    return t.scored.select("claim_id", "status")


_held = "printf('%.2f', round(score, 2))"


@query("fn_classify_reason", f"""select claim_id, case when n_valid < 2 then 'votes that count: ' || n_valid || ', too few' when passed = false then 'refuted by its check, whatever the vote' when score <= -0.2 then 'the vote is against it: ' || {_held}
 when passed = true and score >= 0.2 then 'its check holds and the vote is ' || {_held} || case when citations_total > 0 and citations_verified = 0 then '; no citation resolves, which the check outweighs' else '' end
 when citations_total > 0 and citations_verified = 0 then 'the vote is ' || {_held} || ', citations that resolve: 0 of ' || citations_total when score >= 0.2 then 'the vote is ' || {_held} || ', at least 0.20'
 when abs(score) < 0.2 and n_refute > 0 then 'the vote is divided: ' || {_held} || ', against: ' || n_refute else 'the vote is ' || {_held} || ', under 0.20' end reason from scored""")
def _(t: Tables):
    return t.scored.select("claim_id", council.reason("score", 0.2, "passed", "n_refute", "n_valid", "citations_verified", "citations_total").alias("reason"))


@query("fn_citation_counts", "select claim_id, citations_total, citations_verified from scored")
def _(t: Tables):
    return t.scored.select("claim_id", "citations_total", "citations_verified")


_brier = """(select v.claim_id, panelist, verdict, status, case when verdict = 'uncertain' then 0.25 when (verdict = 'support') = (status = 'validated') then (1 - coalesce(confidence, 0.5)) ** 2 else coalesce(confidence, 0.5) ** 2 end b
 from votes v join scored using (claim_id) where status in ('validated', 'refuted'))"""


@query("fn_brier", f"select claim_id, panelist, round(b, 9) brier from {_brier}")
def _(t: Tables):
    rows = t.votes.join(t.scored.select("claim_id", "status"), "claim_id").select("claim_id", "panelist", F.round(council.brier("verdict", "confidence", "status"), 9).alias("brier"))
    return rows.where("brier is not null")


@query("agg_calib", f"""select panelist, n_votes, n_correct, round(brier_sum, 6) brier_sum, greatest(0.25, least(2.0, 2 * (n_correct + 5) / (n_votes + 10))) weight from (
 select panelist, coalesce(p.n_votes, 0) + coalesce(v, 0) n_votes, coalesce(p.n_correct, 0) + coalesce(c, 0) n_correct, cast(coalesce(bs, 0) as double) brier_sum
 from prior p full join (select panelist, count(*) v, count(*) filter ((verdict = 'support' and status = 'validated') or (verdict = 'refute' and status = 'refuted')) c, sum(b) bs from {_brier} group by 1) using (panelist))""")
def _(t: Tables):
    return council.calibrate(t.votes, t.scored, t.prior).withColumn("brier_sum", F.round("brier_sum", 6))


@query("fn_cal_weight", "select panelist, weight from weights")
def _(t: Tables):
    return t.weights


@query("ord_calibration", "select panelist, weight from weights order by weight, panelist")
def _(t: Tables):
    return t.weights.orderBy("weight", "panelist")


@query("join_votes_claims", "select claim_id, verdict, count(*) n, any_value(status) status from votes join scored using (claim_id) group by 1, 2")
def _(t: Tables):
    return t.votes.join(t.scored.select("claim_id", "status"), "claim_id").groupBy("claim_id", "verdict").agg(F.count("*").alias("n"), F.any_value("status").alias("status"))


@query("join_semi_in", "select claim_id, count(*) n from citations where claim_id in (select claim_id from scored where status = 'validated') group by 1")
def _(t: Tables):
    return t.citations.join(t.scored.where("status = 'validated'").select("claim_id"), "claim_id", "left_semi").groupBy("claim_id").agg(F.count("*").alias("n"))


@query("join_cite_rows", "select claim_id, citation, verified from (select *, row_number() over (partition by claim_id, citation order by verified, relevant nulls first) rn from citations) where rn = 1")
def _(t: Tables):
    # The first row of each citation, in a total order: a minimum of structs, aggregated before the shuffle.
    first = F.min(F.struct("verified", F.col("relevant").isNotNull().alias("known"), "relevant"))
    return t.citations.groupBy("claim_id", "citation").agg(first.alias("f")).select("claim_id", "citation", "f.verified")


@query("agg_status_cli", "select status, count(*) n, round(avg(score), 9) score from scored group by 1")
def _(t: Tables):
    return t.scored.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("score")).orderBy(F.desc("n"), "status")


@query("agg_table_counts", "select 'claims' name, count(*) n from scored union all select 'votes', count(*) from votes union all select 'reviews', count(*) from events union all select 'checks', count(*) from checks union all select 'evidence', count(*) from lineitem union all select 'calibration', count(*) from prior")
def _(t: Tables):
    out = None
    for name, df in (("claims", t.scored), ("votes", t.votes), ("reviews", t.reviews), ("checks", t.checks), ("evidence", t.citations), ("calibration", t.prior)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("agg_evidence_rate", "select count(*) filter (verified) resolved, count(*) total, round(100.0 * count(*) filter (verified) / count(*), 6) pct from citations")
def _(t: Tables):
    g = t.citations.agg(F.count_if("verified").alias("resolved"), F.count("*").alias("total"))
    return g.select("resolved", "total", F.round(100.0 * F.col("resolved") / F.col("total"), 6).alias("pct"))


@query("agg_cite_class", "select case when not verified then 'does not resolve' when relevant is null then 'resolves, not judged' when relevant then 'resolves, on topic' else 'resolves, off topic' end class, count(*) n from citations group by 1")
def _(t: Tables):
    return t.citations.groupBy(evidence.citation_class("verified", "relevant").alias("class")).agg(F.count("*").alias("n"))


@query("agg_descriptives", """select count(*) n_claims, round(avg(score), 9) mean, round(stddev_samp(score), 9) sd, round(min(score), 9) low, round(max(score), 9) high, round(median(score), 9) median,
 round(100.0 * count(*) filter (status = 'validated') / count(*), 9) pct_validated, count(*) filter (passed) passed, count(*) filter (not passed) failed, count(*) filter (passed is null) inconclusive from scored""")
def _(t: Tables):
    return ledger.descriptives(t.scored)


@query("agg_status_zero_filled", "select status, coalesce(n, 0) n from (select unnest(['validated', 'contested', 'refuted', 'unresolved']) status) left join (select status, count(*) n from scored group by 1) using (status)")
def _(t: Tables):
    return ledger.zero_filled(t.scored)


_ledger = """(select 'claims' source, case status when 'validated' then 'verified' when 'refuted' then 'refuted' else 'asserted' end status from scored
 union all select 'evidence', case when verified then 'verified' else 'refuted' end from citations
 union all select 'relevance', case when relevant then 'verified' when not relevant then 'refuted' else 'not_run' end from citations where verified
 union all select 'checks', case when passed then 'verified' when not passed then 'refuted' else 'inconclusive' end from checks)"""


@query("fn_ledger_status", f"select source, status, count(*) n from {_ledger} group by all")
def _(t: Tables):
    return ledger.facts(t.scored, t.citations, t.checks).groupBy("source", "status").agg(F.count("*").alias("n"))


@query("set_union_frames", f"select source, count(*) n from {_ledger} group by 1")
def _(t: Tables):
    return ledger.facts(t.scored, t.citations, t.checks).groupBy("source").agg(F.count("*").alias("n"))


_levels = "['refuted', 'inconclusive', 'not_run', 'no_method', 'asserted', 'verified']"


@query("agg_ledger_summary", f"select status, n, cast(list_position({_levels}, status) as bigint) place from (select status, count(*) n from {_ledger} group by 1)")
def _(t: Tables):
    return ledger.summary(ledger.facts(t.scored, t.citations, t.checks))


@query("ord_ledger", f"select source, status, cast(list_position({_levels}, status) as bigint) place, count(*) n from {_ledger} group by all order by place, source")
def _(t: Tables):
    f = ledger.facts(t.scored, t.citations, t.checks).groupBy("source", "status").agg(F.count("*").alias("n"))
    return f.withColumn("place", ledger.place("status")).orderBy("place", "source")


@query("ord_claims", "select claim_id, round(score, 9) score from consensus order by score desc, claim_id")
def _(t: Tables):
    return council.consensus(t.votes, t.weights).select("claim_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "claim_id")


@query("ord_sessions", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 20")
def _(t: Tables):
    return t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("set_union_distinct", "select citation from citations where verified union select citation from citations where relevant")
def _(t: Tables):
    # Each side is distinct before they meet, so that a citation of very many claims is a row a task.
    side = lambda c: t.citations.where(c).select("citation").distinct()
    return side("verified").union(side("relevant")).distinct()


@query("set_union_values", "select claim_id, cast(count(distinct citation) as bigint) n from citations group by 1")
def _(t: Tables):
    return t.citations.select("claim_id", "citation").distinct().groupBy("claim_id").agg(F.count("*").alias("n"))


@query("set_intersect_rows", "select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_linestatus = 'O'")
def _(t: Tables):
    li = t("lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").intersect(li.where("l_linestatus = 'O'").select("l_partkey"))


@query("set_except_rows", "select p_partkey from part except select l_partkey from lineitem where l_quantity > 45")
def _(t: Tables):
    return t("part").select("p_partkey").subtract(t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))


_tok = duck.claim_tokens("claim")


@query("fn_norm_claim", f"select doc_id, {duck.norm_claim('claim')} norm, cast(len({_tok}) as integer) n_tokens from short")
def _(t: Tables):
    return t.short.select("doc_id", tx.norm_claim("claim").alias("norm"), F.size(tx.claim_tokens("claim")).alias("n_tokens"))


_classes = f"(select *, min(doc_id) over (partition by question_id, t) rep from (select question_id, doc_id, list_sort({_tok}) t from short) where len(t) > 0)"
_pairs = f"""(select a, b, jaccard from (select a.doc_id a, b.doc_id b, {duck.jaccard('a.t', 'b.t')} jaccard from {_classes} a join {_classes} b on a.question_id = b.question_id and a.doc_id < b.doc_id where a.doc_id = a.rep and b.doc_id = b.rep
 and len(a.t) >= 0.6 * len(b.t) and len(b.t) >= 0.6 * len(a.t)) where jaccard >= 0.6 union all select rep, doc_id, 1.0 from {_classes} where doc_id > rep)"""


@query("join_self_pairs", f"""select a.doc_id a, b.doc_id b, round({duck.jaccard('a.t', 'b.t')}, 9) jaccard from {_classes} a join {_classes} b on a.question_id = b.question_id and a.doc_id < b.doc_id
 and len(a.t) >= 0.6 * len(b.t) and len(b.t) >= 0.6 * len(a.t) where {duck.jaccard('a.t', 'b.t')} >= 0.6""")
def _(t: Tables):
    return evidence.all_pairs(t.short, 0.6).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("fn_jaccard", f"select count(*) n, round(sum(jaccard), 6) total from {_pairs}")
def _(t: Tables):
    return evidence.similar_pairs(t.short, 0.6).agg(F.count("*").alias("n"), F.round(F.sum("jaccard"), 6).alias("total"))


@query("fn_cluster_seed")
def _(t: Tables):
    return evidence.seed_clusters(t.short, 0.6)


@query("agg_claim_merge")
def _(t: Tables):
    # A document is proposed in its language and cites the page of its number; a claim with a figure in it can be tested.
    testable = F.coalesce(F.col("text").rlike(tx.NUMBER), F.lit(False))
    proposals = t("documents").select("doc_id", F.col("text").alias("claim"), F.col("lang").alias("proposer"), (F.col("n_chars") / 1000).alias("confidence"), testable.alias("testable"))
    cited = _citation_texts(t).select(F.col("page_id").alias("doc_id"), F.coalesce(evidence.extract_doi("citation"), evidence.extract_pmid("citation"), "citation").alias("citation"))
    return evidence.merge_claims(evidence.seed_clusters(t.short, 0.6), proposals, cited)


@query("set_array", "select doc_id, cast(len(list_intersect(a, b)) as integer) shared, cast(len(list_distinct(a || b)) as integer) either, cast(len(a) - len(list_intersect(a, b)) as integer) own from (select d.doc_id, %s a, %s b from documents d join documents e on e.doc_id = d.doc_id + 1)" % (duck.claim_tokens("d.text"), duck.claim_tokens("e.text")))
def _(t: Tables):
    # A text's tokens, and those of the next document.
    d = t("documents").select("doc_id", tx.claim_tokens("text").alias("a"))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return d.join(after, "doc_id").select("doc_id", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("own"))


_rel = f"(select doc_id, {duck.plain_tokens('b.text', tx.STOP_RELEVANCE)} c, {duck.plain_tokens('d.text', tx.STOP_RELEVANCE)} s from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))"


@query("fn_lexical_relevance", f"select doc_id, case when len(c) > 0 and len(s) > 0 then len(list_intersect(c, s)) / len(c) >= 0.15 end relevant from {_rel}")
def _(t: Tables):
    # Each document as what is cited for one of the benchmark's items.
    n = t("benchmark").agg(F.count("*").alias("n"))
    cited = t("documents").join(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(t("benchmark").withColumnRenamed("text", "claim"), "item_id")
    return cited.select("doc_id", evidence.lexical_relevance("claim", "text").alias("relevant"))


_cite = "(select page_id, case when page_id % 3 = 0 then 'see 10.' || (1000 + page_id) || '/' || replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '-') || ').' when page_id % 3 = 1 then 'PMID: ' || (100000 + page_id) else url end citation from pages)"
_doi = "nullif(regexp_replace(regexp_extract(citation, '10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+'), '[.,;)\\]]+$', ''), '')"
_pmid = "case when regexp_matches(trim(citation), '^[0-9]{6,8}$') then trim(citation) else nullif(regexp_extract(citation, '(?i)pmid:?\\s*([0-9]{6,8})', 1), '') end"


def _citation_texts(t: Tables):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("see 10."), (F.col("page_id") + 1000).cast("string"), F.lit("/"), F.replace(host, F.lit("."), F.lit("-")), F.lit(").")))
    text = text.when(F.col("page_id") % 3 == 1, F.concat(F.lit("PMID: "), (F.col("page_id") + 100000).cast("string"))).otherwise(F.col("url"))
    return t("pages").select("page_id", text.alias("citation"))


@query("fn_extract_doi", f"select page_id, {_doi} doi from {_cite}")
def _(t: Tables):
    return _citation_texts(t).select("page_id", evidence.extract_doi("citation").alias("doi"))


@query("fn_extract_pmid", f"select page_id, {_pmid} pmid from {_cite}")
def _(t: Tables):
    return _citation_texts(t).select("page_id", evidence.extract_pmid("citation").alias("pmid"))


@query("fn_cite_method", f"""select page_id, case when doi is not null then 'doi' when pmid is not null then 'pmid' else 'text' end "method", case when doi is not null then page_id % 2 = 0 when pmid is not null then page_id % 2 = 0 else false end verified
from (select page_id, {_doi} doi, {_pmid} pmid from {_cite})""")
def _(t: Tables):
    # The reference data that a lookup would give: every second identifier is known.
    known = _citation_texts(t).where("page_id % 2 = 0").select(F.coalesce(evidence.extract_doi("citation"), evidence.extract_pmid("citation")).alias("id")).where("id is not null").distinct()
    return evidence.resolve(_citation_texts(t), known).select("page_id", "method", "verified")


@query("scan_http_crossref", f"select page_id, {_doi} doi from {_cite} where {_doi} is not null and page_id % 2 = 0")
def _(t: Tables):
    known = _citation_texts(t).where("page_id % 2 = 0").select(evidence.extract_doi("citation").alias("doi")).where("doi is not null").distinct()
    return _citation_texts(t).select("page_id", evidence.extract_doi("citation").alias("doi")).join(known, "doi", "left_semi").select("page_id", "doi")


@query("scan_http_epmc", f"""select page_id, case when doi is not null then 'doi' when pmid is not null then 'pmid' else 'text' end "method", case when doi is not null and page_id % 2 = 0 then 'crossref' when (doi is not null or pmid is not null) and page_id % 5 < 3 then 'epmc' end source,
 case when doi is not null and page_id % 2 = 0 then 'C' || page_id when (doi is not null or pmid is not null) and page_id % 5 < 3 then 'E' || page_id end title from (select page_id, {_doi} doi, {_pmid} pmid from {_cite})""")
def _(t: Tables):
    # What two services know: every second DOI, and three of five identifiers of either kind.
    own = _citation_texts(t).select("page_id", F.coalesce(evidence.extract_doi("citation"), evidence.extract_pmid("citation")).alias("id"), evidence.extract_doi("citation").alias("doi")).where("id is not null")
    answer = lambda rows, mark: rows.select("id", F.concat(F.lit(mark), F.col("page_id").cast("string")).alias("title"), F.lit(2020).alias("year"))
    found = evidence.looked_up(_citation_texts(t), answer(own.where("doi is not null and page_id % 2 = 0"), "C"), answer(own.where("page_id % 5 < 3"), "E"))
    return found.select("page_id", "method", "source", "title")


_types = "[['Meta-Analysis'], ['Randomized Controlled Trial', 'Clinical Trial'], ['Clinical Trial, Phase II'], ['Case Reports', 'Letter'], ['Review'], ['Dataset']]"


@query("fn_evidence_level", "select l_orderkey, l_linenumber, case l_linenumber % 6 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 5 when 4 then 6 end level from lineitem")
def _(t: Tables):
    given = F.array(*(F.array(*map(F.lit, x)) for x in (["Meta-Analysis"], ["Randomized Controlled Trial", "Clinical Trial"], ["Clinical Trial, Phase II"], ["Case Reports", "Letter"], ["Review"], ["Dataset"])))
    return t("lineitem").select("l_orderkey", "l_linenumber", evidence.evidence_level(F.element_at(given, F.col("l_linenumber") % 6 + 1)).alias("level"))


_pubtypes = ["Review", "Case Reports", "Observational Study", "Clinical Trial", "Randomized Controlled Trial", "Systematic Review", "Dataset"]


@query("scan_entrez", f"""select pmid, year, title, level evidence_level, case level when 1 then 'systematic review / meta-analysis' when 2 then 'randomised controlled trial' when 3 then 'non-randomised or early-phase trial'
 when 4 then 'observational study' when 5 then 'case report / series' when 6 then 'review or narrative' else 'unclassified' end evidence_label, 'Journal Article; ' || type pubtypes, mesh
from (select *, cast(case type when 'Review' then 6 when 'Case Reports' then 5 when 'Observational Study' then 4 when 'Clinical Trial' then 3 when 'Randomized Controlled Trial' then 2 when 'Systematic Review' then 1 end as integer) level
from (select (page_id + 100000)::varchar pmid, (2010 + page_id % 10)::varchar as year, 'Page ' || page_id || ' at ' || coalesce(url, '') title, [{", ".join(map(duck.quoted, _pubtypes))}][page_id % 7 + 1] type,
 coalesce(array_to_string(list_transform(range(1, least(page_id % 11, 8) + 1), lambda x: 'm' || x), '; '), '') mesh from pages where page_id % 6 = 4))""")
def _(t: Tables):
    # The service knows every second page; each of its answers holds a further record that nobody asked for.
    i = F.col("page_id")
    headings = F.array_join(F.transform(F.sequence(F.lit(0), i % 11), lambda x: F.when(x > 0, F.concat(F.lit("MH  - m"), x.cast("string"))).otherwise("SO  - x")), "\n")
    lines = ["PMID- ", (i + 900000).cast("string"), "\nTI  - Other\n\nPMID- ", (i + 100000).cast("string"), "\nDP  - ", (2010 + i % 10).cast("string"), " Jan\nTI  - Page ", i.cast("string"), "\n      at ", F.coalesce("url", F.lit("")), "\nPT  - Journal Article\nPT  - "]
    text = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines), F.element_at(F.array(*map(F.lit, _pubtypes)), (i % 7 + 1).cast("int")), F.lit("\n"), headings)
    answers = t("pages").where("page_id % 2 = 0").select(text.alias("answer"))
    return evidence.studies(_citation_texts(t).select(evidence.extract_pmid("citation").alias("pmid")).where("pmid is not null"), answers)


@query("win_first_match", f"""with l as (select p_partkey, unnest([{", ".join(map(duck.quoted, _pubtypes))}][p_size % 7 + 1:p_size % 7 + 1] || [{", ".join(map(duck.quoted, _pubtypes))}][p_partkey % 7 + 1:p_partkey % 7 + 1]) t from part)
select p_partkey, cast(min(case t when 'Review' then 6 when 'Case Reports' then 5 when 'Observational Study' then 4 when 'Clinical Trial' then 3 when 'Randomized Controlled Trial' then 2 when 'Systematic Review' then 1 end) as integer) level from l group by 1""")
def _(t: Tables):
    known = F.array(*map(F.lit, _pubtypes))
    own = F.array(F.element_at(known, (F.col("p_size") % 7 + 1).cast("int")), F.element_at(known, (F.col("p_partkey") % 7 + 1).cast("int")))
    return t("part").select("p_partkey", evidence.evidence_level(own).alias("level"))


@query("win_first_seat", "select claim_id, arg_min(panelist, case panelist when 'p4' then 0 when 'p0' then 1 when 'p2' then 2 end) seat from votes where panelist in ('p4', 'p0', 'p2') group by 1")
def _(t: Tables):
    return council.first_seat(t.votes, ["p4", "p0", "p2"])


@query("agg_panel_merge", """select claim_id, case when r then 'REFUTED' when n = c and n > 0 then 'CONFIRMED' else 'UNSUPPORTED' end merged
from (select claim_id, bool_or(verdict = 'refute') r, count(*) n, count(*) filter (verdict = 'support') c from votes group by 1)""")
def _(t: Tables):
    status = F.when(F.col("verdict") == "support", "CONFIRMED").when(F.col("verdict") == "refute", "REFUTED").otherwise("UNSUPPORTED")
    return evidence.merge_panel(t.votes.select("claim_id", status.alias("status"))).select("claim_id", "merged")


@query("join_label_assign", "select doc_id, case when status is null then 'missed' when quality not in (0, 1) then 'invalid' when status = 'NEEDS_AGENT' then 'applied' else 'settled' end outcome from labels left join claims on claim_id = doc_id + 1")
def _(t: Tables):
    verdicts = t("labels").select("doc_id", (F.col("doc_id") + 1).alias("claim_id"), "quality")
    joined = verdicts.join(t.claims.select("claim_id", "status"), "claim_id", "left")
    outcome = F.when(F.col("status").isNull(), "missed").when(~F.col("quality").isin(0, 1), "invalid").when(F.col("status") == "NEEDS_AGENT", "applied").otherwise("settled")
    return joined.select("doc_id", outcome.alias("outcome"))


_allow = "['1','2','3','4','5','6','7','8','9','10']"
_nums = lambda c: f"list_distinct(regexp_extract_all({c}, '[0-9]+(?:\\.[0-9]+)?'))"
_key = "list_filter(list_distinct(string_split_regex(lower(regexp_replace(anchor, '[^a-z0-9 ]', ' ', 'g')), '\\s+')), lambda x: not list_contains(['', 'the', 'a', 'an', 'of', 'in', 'and', 'was', 'were', 'that'], x))"


_verified = f"""(select p.*, case when trim(anchor) = '' then false when length(trim(text)) < 40 then false
 when anchor_kind = 'session' and not hit then false
 when len(list_filter({_nums('text')}, lambda x: not list_contains({_nums('anchor')}, x) and not list_contains({_allow}, x) and not regexp_matches(x, '^(19|20)[0-9]{{2}}$'))) > 0 then false
 when anchor_kind = 'record' then null else true end verified
from (select p.*, exists(select 1 from (select set_id, lower(text) low from petals) c where c.set_id = p.set_id and len(list_filter(k, lambda x: contains(c.low, x))) >= greatest(2, floor(len(k) / 3))) hit from (select *, {_key} k from petals) p) p)"""


@query("fn_petal_verify", f"select petal_id, verified from {_verified}")
def _(t: Tables):
    claims = t.petals.select("set_id", F.col("text").alias("claim"))
    return petals.verify(t.petals, claims).select("petal_id", "verified")


@query("join_exists_overlap", f"select petal_id from (select *, {_key} k from petals) p where exists(select 1 from (select set_id, lower(text) low from petals) c where c.set_id = p.set_id and len(list_filter(k, lambda x: contains(c.low, x))) >= greatest(2, floor(len(k) / 3)))")
def _(t: Tables):
    return petals.in_session(t.petals, t.petals.select("set_id", F.col("text").alias("claim"))).select("petal_id")


@query("flt_kept_petals", f"select petal_id, verified from {_verified} where coalesce(verified, true)")
def _(t: Tables):
    claims = t.petals.select("set_id", F.col("text").alias("claim"))
    return petals.verify(t.petals, claims).where(F.coalesce("verified", F.lit(True))).select("petal_id", "verified")


_costs, _credits = duck.array(petals.COSTS), duck.array(petals.CREDITS)
_valence = f"""(select petal_id, set_id, kind, section, anchor, anchor_kind, greatest(-1, least(1, base + sign(adj) * least(abs(adj), 1))) v from (select *, case when kind in ('surprise', 'uncertainty', 'craft') then -1 when kind in ('clinical_narrative', 'patient_impact') then 1 else 0 end base,
 len(list_filter({_credits}, lambda k: contains(lower(text), k))) - len(list_filter({_costs}, lambda k: contains(lower(text), k))) adj from petals))"""


@query("fn_valence", f"select petal_id, cast(v as integer) valence from {_valence}")
def _(t: Tables):
    return t.petals.select("petal_id", petals.valence("kind", "text").alias("valence"))


@query("fn_tok", f"select petal_id, cast(len({duck.plain_tokens('anchor', tx.STOP_PETAL)}) as integer) n from petals")
def _(t: Tables):
    return t.petals.select("petal_id", F.size(tx.plain_tokens("anchor", tx.STOP_PETAL)).alias("n"))


_pt = f"(select *, {duck.plain_tokens('anchor', tx.STOP_PETAL)} t from petals)"
_ppairs = f"""(select a.set_id, a.petal_id a, b.petal_id b, {duck.jaccard('a.t', 'b.t')} overlap, a.section = b.section and a.kind = b.kind crowd from {_pt} a join {_pt} b on a.set_id = b.set_id and a.petal_id < b.petal_id)"""


@query("fn_pair_relation", f"select a, b, case when overlap >= 0.45 then 'same_event' when overlap >= 0.22 then 'shared_source' else 'crowds' end relation, round(overlap, 2) overlap from {_ppairs} where overlap >= 0.22 or crowd")
def _(t: Tables):
    return petals.pairs(t.petals).select("a", "b", "relation", F.round("overlap", 2).alias("overlap"))


@query("fn_cluster_label", f"""select * from (with recursive near_ as (select b, max(a) a from {_ppairs} where overlap >= 0.45 group by b), up as (select b petal_id, a from near_ union all select petal_id, near_.a from up join near_ on near_.b = up.a)
select p.set_id, p.petal_id, coalesce(min(up.a), p.petal_id) "cluster" from petals p left join up using (petal_id) group by 1, p.petal_id)""")
def _(t: Tables):
    return petals.labels(t.petals)


@query("agg_composition", f"""select set_id, count(*) n, count(*) filter (v < 0) n_costs, count(*) filter (v > 0) n_credits, count(*) filter (v = 0) n_neutral, count(*) filter (anchor_kind = 'record') n_records,
 count(*) filter (v > 0) > 0 and count(*) filter (v < 0) = 0 flattering, count(*) filter (anchor_kind = 'record') > count(*) / 2 uncheckable from {_valence} group by 1""")
def _(t: Tables):
    return petals.composition(t.petals)


_em = f"(select petal_id seat, set_id, {duck.plain_tokens('text', tx.STOP_EMPHASIS)} fore, {duck.plain_tokens('anchor', tx.STOP_EMPHASIS)} aside, trim(anchor) <> '' declared_aside from petals where trim(text) <> '')"


@query("fn_emphasis_map", f"select a.seat a, b.seat b, {duck.jaccard('a.fore', 'b.fore')} >= 0.35 same_fact from {_em} a join {_em} b on a.set_id = b.set_id and a.seat < b.seat")
def _(t: Tables):
    return petals.emphasis(t.petals)


@query("join_cross_unclaimed", f"select seat from {_em} x where declared_aside and not exists(select 1 from {_em} d where d.set_id = x.set_id and {duck.jaccard('x.aside', 'd.fore')} >= 0.35)")
def _(t: Tables):
    return petals.unclaimed(t.petals)


_effects = "(select l_suppkey study, avg(l_discount) yi, var_samp(l_discount) / count(*) vi from lineitem group by 1 having count(*) > 1 and var_samp(l_discount) > 0)"


@query("meta_effects", f"select study, round(yi, 9) yi, round(vi, 12) vi from {_effects}")
def _(t: Tables):
    return meta.group_effects(t("lineitem"), "l_suppkey", "l_discount").select("study", F.round("yi", 9).alias("yi"), F.round("vi", 12).alias("vi"))


@query("meta_fixed", f"select count(*) k, round(sum(yi / vi) / sum(1 / vi), 9) mu from {_effects}")
def _(t: Tables):
    e = meta.group_effects(t("lineitem"), "l_suppkey", "l_discount")
    return e.agg(F.count("*").alias("k"), F.round(F.sum(F.col("yi") / F.col("vi")) / F.sum(1 / F.col("vi")), 9).alias("mu"))


@query("meta_random_effects")
def _(t: Tables):
    return meta.random_effects(meta.group_effects(t("lineitem"), "l_suppkey", "l_discount"))


@query("ancova")
def _(t: Tables):
    return meta.ancova(t("lineitem"), "l_extendedprice", "l_quantity", "l_returnflag")
