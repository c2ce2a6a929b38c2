"""Queries with their SQL: a query is registered once, with the relations its SQL builds on added as needed."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import council, index
from factloom.functions import text as tx
from factloom.sources import store

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


#: The index of a session's sources, as far as it has been asked for.
_BUILT: dict[tuple, index.Stored] = {}


class Tables:
    """The given tables and the relations that stand for the engine's own inputs."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def claims(self) -> DataFrame:
        """Documents as claims; their labels give the status."""
        status = F.when(F.col("quality").isNull(), "NEEDS_AGENT").when(F.col("toxic") == 1, "REFUTED").when(F.col("quality") == 1, "CONFIRMED").otherwise("UNSUPPORTED")
        docs = store.spread(self("documents").select(F.col("doc_id").alias("claim_id"), "source", "text"))
        return docs.join(self("labels").select(F.col("doc_id").alias("claim_id"), "quality", "toxic"), "claim_id", "left").select("claim_id", "source", "text", status.alias("status"))

    @cached_property
    def feedback(self) -> DataFrame:
        e = self("events")
        return e.groupBy(F.col("user_id").alias("claim_id")).agg(F.count("*").alias("hits"), F.count_if(F.col("event_type") == "purchase").alias("helpful"), F.count_if(F.col("event_type") == "error").alias("unhelpful"))

    @cached_property
    def lines(self) -> DataFrame:
        return self("documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "source", (F.col("pos") + 1).alias("line_no"), "line")

    @cached_property
    def keywords(self) -> DataFrame:
        """Distinct keywords of each claim with their weights."""
        return index.keyword_rows(self.claims.select("claim_id", "text"))

    @cached_property
    def index(self) -> index.Stored:
        """The stored index of the claims, each table built when it is first asked for and again when its sources have changed."""
        sources = [f"{self.sf_dir}/{n}.parquet" for n in ("documents", "labels", "events")]
        key = (self.spark.sparkContext.applicationId, self.sf_dir, store.fingerprint(self.spark, sources))
        if key not in _BUILT:
            texts = store.spread(self("documents").select(F.col("doc_id").alias("claim_id"), "text"))
            _BUILT[key] = index.Stored(store.scratch(self.spark, "index"), self.claims, self.feedback, texts)
        return _BUILT[key]

    @property
    def stored(self) -> DataFrame:
        """The keyword rows as the index stores them."""
        return self.index["keywords"]

    @property
    def idf(self) -> DataFrame:
        return self.index["idf"]

    @property
    def indexed(self) -> DataFrame:
        """Claims with specificity, mean idf, feedback and utility."""
        return self.index["claims"]

    @cached_property
    def short(self) -> DataFrame:
        """Documents as the claims that answer a question; a source stands for a question."""
        return store.spread(self("documents").select("doc_id", F.col("source").alias("question_id"), F.col("text").alias("claim")))

    @cached_property
    def reviews(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        verdict = F.when(F.col("event_type").isin("purchase", "click"), "support").when(F.col("event_type") == "error", "refute").otherwise("uncertain")
        return self("events").select(
            (F.col("event_id") % 200).alias("claim_id"), F.concat(F.lit("p"), (F.col("user_id") % 6).cast("string")).alias("panelist"), (k % 2 + 1).alias("round"), F.col("event_id").alias("seq"),
            verdict.alias("verdict"), F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"), (k % 10 != 0).alias("discharged"), k.alias("k"),
        )

    @cached_property
    def votes(self) -> DataFrame:
        """Each panelist's latest review of each claim, those that did their duty."""
        return council.latest_round(self.reviews).where("discharged")

    @cached_property
    def prior(self) -> DataFrame:
        """Calibration totals of earlier sessions."""
        c = self("customer")
        return c.groupBy(F.concat(F.lit("p"), (F.col("c_custkey") % 6).cast("string")).alias("panelist")).agg(F.count("*").alias("n_votes"), F.count_if(F.col("c_acctbal") > 0).alias("n_correct"))

    @cached_property
    def checks(self) -> DataFrame:
        """The latest check of each claim; its result may be unknown."""
        passed = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False)
        o = self("orders").select((F.col("o_orderkey") % 200).alias("claim_id"), F.col("o_orderkey").alias("seq"), passed.alias("passed"))
        return o.groupBy("claim_id").agg(F.max_by(F.struct("passed"), "seq").alias("r")).select("claim_id", F.col("r.passed").alias("passed"))

    @cached_property
    def citations(self) -> DataFrame:
        """Citations of claims: whether they resolve, and whether they are on topic (which may be unknown)."""
        return self("lineitem").select(
            (F.col("l_orderkey") % 200).alias("claim_id"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("citation"), (F.col("l_returnflag") != "R").alias("verified"),
            F.when(F.col("l_tax") != 0, F.col("l_linestatus") == "O").alias("relevant"),
        )

    @cached_property
    def weights(self) -> DataFrame:
        return self.prior.select("panelist", council.calibration_weight("n_votes", "n_correct").alias("weight"))

    @cached_property
    def scored(self) -> DataFrame:
        """Claims with consensus, counts, citation counts, check and status."""
        return council.score_claims(self.votes, self.weights, self.checks, self.citations, 0.2)

    @cached_property
    def files(self) -> DataFrame:
        """Pages as files to route."""
        path = F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1)
        return self("pages").select("page_id", path.alias("path"), tx.est_tokens("html").alias("est_tokens"))

    @cached_property
    def petals(self) -> DataFrame:
        """Passages with an anchor, eight to a set: whole documents, anchored by all that follows their first line, a third of them by what
        follows that of the document before."""
        kinds = F.array(*map(F.lit, ("motivation", "surprise", "clinical_narrative", "uncertainty", "patient_impact", "craft")))
        anchors = F.array(*map(F.lit, ("session", "record", "data", "protocol")))
        after = F.expr("case when contains(text, '\n') then substring(text, locate('\n', text) + 1) else '' end")
        d = self("documents").select("doc_id", "text", (F.col("doc_id") - F.when(F.col("doc_id") % 3 == 1, 1).otherwise(0)).alias("of"))
        rows = d.select("doc_id", "text", "of").join(d.select(F.col("doc_id").alias("of"), after.alias("anchor")), "of", "left")
        return rows.select(
            F.col("doc_id").alias("petal_id"), F.floor(F.col("doc_id") / 8).cast("long").alias("set_id"), F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("kind"),
            F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("section"), "text", F.coalesce("anchor", F.lit("")).alias("anchor"), F.element_at(anchors, (F.col("doc_id") % 4 + 1).cast("int")).alias("anchor_kind"),
        )


#: The relations as SQL.
RELATIONS = {
    "claims": """select d.doc_id claim_id, source, text, case when quality is null then 'NEEDS_AGENT' when toxic = 1 then 'REFUTED' when quality = 1 then 'CONFIRMED' else 'UNSUPPORTED' end status
  from documents d left join labels l on d.doc_id = l.doc_id""",
    "feedback": "select user_id claim_id, count(*) hits, count(*) filter (event_type = 'purchase') helpful, count(*) filter (event_type = 'error') unhelpful from events group by 1",
    "lines": "select doc_id, source, cast(generate_subscripts(string_split(text, chr(10)), 1) as integer) line_no, unnest(string_split(text, chr(10))) line from documents",
    "kw_words": "",  # filled below
    "keywords": "",
    "idf": """select keyword, df, ln((n + 1) / (df + 1)) / ln(n + 1) idf from (select keyword, count(distinct claim_id) df from keywords group by 1), (select greatest(1, count(*)) n from claims)""",
    "indexed": "",
    "short": "select doc_id, source question_id, text claim from documents",
    "reviews": """select event_id % 200 claim_id, 'p' || (user_id % 6) panelist, k % 2 + 1 round, event_id seq,
  case when event_type in ('purchase', 'click') then 'support' when event_type = 'error' then 'refute' else 'uncertain' end verdict, least(1.0, value / 500) confidence, k % 10 <> 0 discharged, k
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as integer) k from events)""",
    "latest": "select * from (select *, row_number() over (partition by claim_id, panelist order by round desc, seq desc) rn from reviews) where rn = 1",
    "votes": "select * from latest where discharged",
    "prior": "select 'p' || (c_custkey % 6) panelist, count(*) n_votes, count(*) filter (c_acctbal > 0) n_correct from customer group by 1",
    "checks": "select claim_id, passed from (select o_orderkey % 200 claim_id, case o_orderstatus when 'O' then true when 'F' then false end passed, row_number() over (partition by o_orderkey % 200 order by o_orderkey desc) rn from orders) where rn = 1",
    "citations": "select l_orderkey % 200 claim_id, 'c' || l_partkey citation, l_returnflag <> 'R' verified, case when l_tax <> 0 then l_linestatus = 'O' end relevant from lineitem",
    "weights": "select panelist, greatest(0.25, least(2.0, 2 * (n_correct + 5) / (n_votes + 10))) weight from prior",
    "consensus": """select claim_id, count(*) n_valid, count(*) filter (verdict = 'support') n_support, count(*) filter (verdict = 'refute') n_refute, count(*) filter (verdict = 'uncertain') n_uncertain,
  coalesce(sum(case verdict when 'support' then 1 when 'refute' then -1 else 0 end * coalesce(weight, 1.0) * coalesce(confidence, 0.5)) / nullif(sum(coalesce(weight, 1.0) * coalesce(confidence, 0.5)), 0), 0) score
  from votes left join weights using (panelist) group by 1""",
    "cited": """select claim_id, count(distinct citation) citations_total, count(distinct case when ok then citation end) citations_verified
  from (select claim_id, citation, bool_or(verified) and bool_or(coalesce(relevant, false)) ok from citations group by 1, 2) group by 1""",
    "scored": "",
    "files": "select page_id, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) path, greatest(1, cast(floor(length(html) / 4) as bigint)) est_tokens from pages",
    "petals": """select d.doc_id petal_id, cast(floor(d.doc_id / 8) as bigint) set_id, ['motivation', 'surprise', 'clinical_narrative', 'uncertainty', 'patient_impact', 'craft'][d.doc_id % 6 + 1] kind, 's' || (d.doc_id % 3) section,
  d.text, coalesce(case when contains(e.text, chr(10)) then substr(e.text, strpos(e.text, chr(10)) + 1) else '' end, '') anchor, ['session', 'record', 'data', 'protocol'][d.doc_id % 4 + 1] anchor_kind
  from documents d left join documents e on e.doc_id = d.doc_id - case when d.doc_id % 3 = 1 then 1 else 0 end""",
}


def _fill() -> None:
    from factloom.functions import duck

    number = duck.quoted(tx.NUMBER)
    RELATIONS["kw_words"] = f"""select distinct claim_id, w, weight from (
  select claim_id, unnest({duck.split_ident("regexp_replace(text, '`[^`]*`', ' ', 'g')")}) w, 1.0 weight from claims
  union all select claim_id, unnest(regexp_extract_all(text, {number})) w, 2.0 weight from claims
) where length(w) >= 2 and not list_contains({duck.STOPS}, w)"""
    RELATIONS["keywords"] = f"select claim_id, stem keyword, max(weight) weight from {duck.stem_steps('kw_words')} where not list_contains({duck.STOPS}, stem) group by 1, 2"
    spec = f"""greatest(0.0, least(1.0, (case when regexp_matches(text, '`[^`]+`') then 0.25 else 0.0 end + case when regexp_matches(text, {number}) then 0.2 else 0.0 end
    + case when len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) between 5 and 28 then 0.15 else 0.0 end - case when regexp_matches(text, {duck.quoted(tx.VAGUE)}) then 0.35 else 0.0 end) + 0.1))"""
    trust = "case status when 'CONFIRMED' then 1.0 when 'DRIFTED' then 0.9 when 'NEEDS_AGENT' then 0.5 when 'PENDING' then 0.4 when 'UNSUPPORTED' then 0.15 when 'REFUTED' then 0.0 when 'STALE' then 0.0 else 0.3 end"
    RELATIONS["indexed"] = f"""select claim_id, source, status, specificity, idf, hits, helpful, unhelpful,
  case when trust = 0 then 0.0 else round(trust * (0.45 * specificity + 0.30 * least(idf, 1.0) + 0.25 * (case when helpful + unhelpful > 0 then helpful / (helpful + unhelpful) when hits > 0 then 0.45 else 0.5 end)), 4) end utility
  from (select c.claim_id, source, status, cast({spec} as double) specificity, coalesce(m.idf, 0.0) idf, coalesce(hits, 0) hits, coalesce(helpful, 0) helpful, coalesce(unhelpful, 0) unhelpful, cast({trust} as double) trust
    from claims c left join (select claim_id, avg(idf) idf from keywords join idf using (keyword) group by 1) m on m.claim_id = c.claim_id left join feedback f on f.claim_id = c.claim_id)"""
    rules = """case when n_valid < 2 then 'unresolved' when passed = false then 'refuted' when score <= -0.2 then 'refuted' when passed = true and score >= 0.2 then 'validated'
  when citations_total > 0 and citations_verified = 0 then 'contested' when score >= 0.2 then 'validated' when abs(score) < 0.2 and n_refute > 0 then 'contested' else 'unresolved' end"""
    RELATIONS["scored"] = f"""select claim_id, n_valid, n_support, n_refute, n_uncertain, score, passed, coalesce(citations_total, 0) citations_total, case when citations_total > 0 then citations_verified end citations_verified, {rules} status
  from consensus left join checks using (claim_id) left join cited using (claim_id)"""


_fill()


def with_relations(sql: str) -> str:
    """The SQL with the relations that it names put before it."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in RELATIONS:
            if name not in needed and re.search(rf"(?:from|join|,)\s*\(?\s*{name}\b", body):
                visit(RELATIONS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} as ({RELATIONS[n]})" for n in needed)
    body = sql.lstrip()
    return f"with {head},\n{body[4:].lstrip()}" if body.lower().startswith("with ") else f"with {head}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a query: a function of Tables, and its SQL where SQL can express it."""

    def add(make: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_relations(sql)
        return make

    return add
