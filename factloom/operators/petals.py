"""Passages with anchors: verification, valence, pairs, composition, emphasis. Sets are small; rows meet within a set only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import replies
from factloom.functions import text as tx
from factloom.functions.text import col

from . import evidence

# Phrases that cost the authors something, and that credit them.
COSTS = ["we were wrong", "the error", "our error", "we had first", "does not hold", "still trouble", "is not enough", "it cost us", "we cannot", "we failed", "mistake", "withdrew", "we did not"]
CREDITS = ["was noticed", "we noticed", "because she was seen", "prompted", "we caught", "the right treatment", "made possible", "we kept", "grew out of"]
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def numbers(s) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(s), F.lit(NUMBER), F.lit(0)))


def stray_numbers(text, anchor) -> Column:
    """Numbers of the text that its anchor lacks, without small ordinals and years."""
    small = F.array(*(F.lit(str(i)) for i in range(1, 11)))
    return F.filter(F.array_except(numbers(text), numbers(anchor)), lambda x: ~F.array_contains(small, x) & ~x.rlike("^(19|20)[0-9]{2}$"))


def session_key(anchor) -> Column:
    """The anchor's words; other than lower-case ASCII is blanked before lowering, so that capitals are lost."""
    words = F.split(F.lower(F.regexp_replace(col(anchor), "[^a-z0-9 ]", " ")), r"\s+")
    return F.array_except(F.array_distinct(words), tx.stop_array(["", "the", "a", "an", "of", "in", "and", "was", "were", "that"]))


def in_session(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """The passages whose anchor shares enough words with a claim (set_id, claim) of their session.

    A claim contains its own words, so that passages which share enough of those are settled by sets of words; the claims' texts are
    searched for each word of the others only."""
    own = ["petal_id", "set_id", "_row"]
    marked = rows.withColumn("_row", F.xxhash64("anchor"))
    asked = marked.select(*own, session_key("anchor").alias("_key")).where(F.size("_key") >= 2)
    hay = claims.select(F.col("set_id").alias("_set"), F.lower("claim").alias("_hay"))
    words = hay.select("_set", F.array_distinct(F.split("_hay", "[^a-z0-9]+")).alias("_words"))
    met, enough = F.col("set_id") == F.col("_set"), F.greatest(F.lit(2), F.floor(F.size("_key") / 3))
    whole = evidence.kept(asked.join(words, met & (F.size(F.array_intersect("_key", "_words")) >= enough), "left_semi").select(own), "whole")
    rest = asked.join(whole, own, "left_anti")
    parts = rest.join(hay, met & (F.size(F.filter("_key", lambda x: F.col("_hay").contains(x))) >= enough), "left_semi").select(own)
    return marked.join(whole.unionByName(parts).distinct(), own, "left_semi").drop("_row")


def verify(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds verified: true, false, or null where only the authors can tell. The session check comes before the numbers."""
    open_ = rows.where((F.col("anchor_kind") == "session") & (F.trim("anchor") != "") & (F.length(F.trim("text")) >= 40))  # no other verdict asks for it
    hits = in_session(open_, claims).select(F.col("petal_id").alias("_hit")).distinct()
    joined = rows.join(hits, F.col("petal_id") == F.col("_hit"), "left")
    verdict = (
        F.when(F.trim("anchor") == "", False).when(F.length(F.trim("text")) < 40, False).when((F.col("anchor_kind") == "session") & F.col("_hit").isNull(), False)
        .when(F.size(stray_numbers("text", "anchor")) > 0, False).when(F.col("anchor_kind") == "record", F.lit(None)).otherwise(True)
    )
    return joined.withColumn("verified", verdict).drop("_hit")


def save(verified: DataFrame, path: str, session: str) -> None:
    """Append the passages that a session has proposed, with the tri-state of their verification. A session that is saved again, as after a
    failure, replaces what it has saved."""
    now = verified.withColumn("needs_author", F.col("verified").isNull())
    now.write.mode("overwrite").parquet(f"{path}/session={session}")


def saved(spark: SparkSession, path: str) -> DataFrame:
    """All sessions' passages, with their session."""
    return spark.read.parquet(path)


#: Pairs of a set that are judged: more of them cost more than they tell.
MOST_PAIRS = 12


def first_pairs(rows: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """(set_id, a, b): the first so many pairs of each set's passages, in order of their ids. Those lie among a set's first most + 1."""
    place = F.row_number().over(Window.partitionBy("set_id").orderBy("petal_id"))
    few = rows.select("set_id", "petal_id", place.alias("place")).where(F.col("place") <= most + 1)  # Spark cuts each task's sets before the shuffle
    ids = few.groupBy("set_id").agg(F.array_sort(F.collect_list("petal_id")).alias("p"))
    both = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return ids.select("set_id", F.inline(F.slice(both, 1, most)))


def tension(pairs: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set_id, a, b, relation, severity, why) of pairs that sit badly together, and (set_id, judged, failed) of all sets with pairs. answers:
    (a, b, reply), a judge's replies; a pair without one, or whose reply has no JSON, has failed. A reply without a relation says none."""
    keyed = answers.select(F.struct("a", "b").alias("pair"), "reply")
    read = replies.parse_replies(keyed.where("reply is not null"), "pair", "reply").select("pair.a", "pair.b", "json")
    met = pairs.join(read, ["a", "b"], "left")
    field = lambda n: F.get_json_object("json", f"$.{n}")
    relation = F.lower(F.coalesce(F.nullif(field("relation"), F.lit("")), F.lit("none")))
    found = met.where(F.col("json").isNotNull() & (relation != "none")).select("set_id", "a", "b", relation.alias("relation"), field("severity").try_cast("double").alias("severity"), F.coalesce(field("why"), F.lit("")).alias("why"))
    return found, met.groupBy("set_id").agg(F.count("json").alias("judged"), F.count_if(F.col("json").isNull()).alias("failed"))


def valence(kind, text) -> Column:
    kind, low = col(kind), F.lower(col(text))
    base = F.when(kind.isin("surprise", "uncertainty", "craft"), -1).when(kind.isin("clinical_narrative", "patient_impact"), 1).otherwise(0)
    has = lambda phrases: F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: low.contains(p)))
    return F.greatest(F.lit(-1), F.least(F.lit(1), base + F.signum(has(CREDITS) - has(COSTS)).cast("int")))


def pairs(rows: DataFrame) -> DataFrame:
    """(set_id, a, b, relation, overlap) of the passages of a set whose anchors overlap, or which are of one kind and section."""
    own = rows.select("set_id", "petal_id", "kind", "section", tx.plain_tokens("anchor", tx.STOP_PETAL).alias("t"))
    a, b = own.alias("a"), own.alias("b")
    met = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.petal_id") < F.col("b.petal_id")))
    crowd = (F.col("a.section") == F.col("b.section")) & (F.col("a.kind") == F.col("b.kind"))
    scored = met.select(F.col("a.set_id"), F.col("a.petal_id").alias("a"), F.col("b.petal_id").alias("b"), tx.jaccard(F.col("a.t"), F.col("b.t")).alias("overlap"), crowd.alias("crowd"))
    relation = F.when(F.col("overlap") >= 0.45, "same_event").when(F.col("overlap") >= 0.22, "shared_source").when(F.col("crowd"), "crowds")
    return scored.withColumn("relation", relation).where("relation is not null").drop("crowd")


def labels(rows: DataFrame) -> DataFrame:
    """(set_id, petal_id, cluster): in order of (i, j), j takes the label of i where their anchors overlap by 0.45.

    Of the pairs that end at j the one with the largest i comes last, and i has its own label by then. So each passage points at the
    largest before it that it overlaps with, and its label is where the pointers end, which they reach by doubling."""
    near = pairs(rows).where("relation = 'same_event'").groupBy(F.col("b").alias("id")).agg(F.max("a").alias("to")).withColumn("odd", F.lit(False))
    ends = evidence.followed(evidence.kept(near, "pointers"))
    return rows.select("set_id", "petal_id").join(ends.select(F.col("id").alias("petal_id"), "to"), "petal_id", "left").select("set_id", "petal_id", F.coalesce("to", "petal_id").alias("cluster"))


def composition(rows: DataFrame) -> DataFrame:
    v = valence("kind", "text")
    record = F.col("anchor_kind") == "record"
    out = rows.groupBy("set_id").agg(F.count("*").alias("n"), F.count_if(v < 0).alias("n_costs"), F.count_if(v > 0).alias("n_credits"), F.count_if(v == 0).alias("n_neutral"), F.count_if(record).alias("n_records"))
    return out.withColumn("flattering", (F.col("n_credits") > 0) & (F.col("n_costs") == 0)).withColumn("uncheckable", F.col("n_records") > F.col("n") / 2)


def _declared(rows: DataFrame) -> DataFrame:
    return rows.where(F.trim("text") != "").select(F.col("petal_id").alias("seat"), "set_id", tx.plain_tokens("text", tx.STOP_EMPHASIS).alias("fore"), tx.plain_tokens("anchor", tx.STOP_EMPHASIS).alias("aside"), (F.trim("anchor") != "").alias("has_aside"))


def emphasis(rows: DataFrame) -> DataFrame:
    """(a, b, same_fact) for each two seats of a set: whether they foreground the same fact."""
    a, b = _declared(rows).alias("a"), _declared(rows).alias("b")
    met = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.seat") < F.col("b.seat")))
    return met.select(F.col("a.seat").alias("a"), F.col("b.seat").alias("b"), (tx.jaccard(F.col("a.fore"), F.col("b.fore")) >= 0.35).alias("same_fact"))


def unclaimed(rows: DataFrame) -> DataFrame:
    """Seats that set a fact aside which no seat of the set foregrounds."""
    x, d = _declared(rows).where("has_aside").alias("x"), _declared(rows).alias("d")
    return x.join(d, (F.col("x.set_id") == F.col("d.set_id")) & (tx.jaccard(F.col("x.aside"), F.col("d.fore")) >= 0.35), "left_anti").select("seat")
