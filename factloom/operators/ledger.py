"""The ledger of checkable facts, and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import col
from factloom.sources.ordered import median

#: Ledger statuses in their order.
LEVELS = ("refuted", "inconclusive", "not_run", "no_method", "asserted", "verified")
STATUSES = ("validated", "contested", "refuted", "unresolved")


def place(status) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), col(status))


def tri_state(value, unknown: str) -> Column:
    v = col(value)
    return F.when(v.isNull(), unknown).when(v, "verified").otherwise("refuted")


def facts(scored: DataFrame, citations: DataFrame, checks: DataFrame) -> DataFrame:
    """(fact, source, status) of every fact of a session; relevance is a fact only where the citation resolves."""
    status = F.when(F.col("status") == "validated", "verified").when(F.col("status") == "refuted", "refuted").otherwise("asserted")
    claims = scored.select(F.concat(F.lit("claim "), F.col("claim_id").cast("string")).alias("fact"), F.lit("claims").alias("source"), status.alias("status"))
    cites = citations.select(F.concat(F.lit("citation "), F.col("citation")).alias("fact"), F.lit("evidence").alias("source"), tri_state(F.coalesce("verified", F.lit(False)), "refuted").alias("status"))
    topics = citations.where("verified").select(F.concat(F.lit("on topic "), F.col("citation")).alias("fact"), F.lit("relevance").alias("source"), tri_state("relevant", "not_run").alias("status"))
    ran = checks.select(F.concat(F.lit("check "), F.col("claim_id").cast("string")).alias("fact"), F.lit("checks").alias("source"), tri_state("passed", "inconclusive").alias("status"))
    return claims.unionByName(cites).unionByName(topics).unionByName(ran)


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n")).withColumn("place", place("status"))


def zero_filled(scored: DataFrame) -> DataFrame:
    levels = scored.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return levels.join(scored.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def descriptives(scored: DataFrame) -> DataFrame:
    """One row of figures; the median is exact, and picked by its place in sorted ranges."""
    s = "score"
    r = lambda c, name: F.round(c, 9).alias(name)
    return scored.agg(
        F.count("*").alias("n_claims"), r(F.avg(s), "mean"), r(F.stddev_samp(s), "sd"), r(F.min(s), "low"), r(F.max(s), "high"),
        r(100.0 * F.count_if(F.col("status") == "validated") / F.count("*"), "pct_validated"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("passed").isNull()).alias("inconclusive"),
    ).join(F.broadcast(median(scored, s).select(r("median", "median"))))
