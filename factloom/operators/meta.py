"""Effect sizes, random-effects meta-analysis by REML, covariance-adjusted group test."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources import store


def group_effects(df: DataFrame, study: str, value: str) -> DataFrame:
    """(study, yi, vi): mean and squared standard error of each group with two rows and some variance."""
    g = df.groupBy(F.col(study).alias("study")).agg(F.avg(value).alias("yi"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    return g.where("n > 1 and v > 0").select("study", "yi", (F.col("v") / F.col("n")).alias("vi"))


def log_risk_ratio(df: DataFrame) -> DataFrame:
    """Adds yi and vi from 2x2 counts (tpos, tneg, cpos, cneg)."""
    t, c = F.col("tpos") + F.col("tneg"), F.col("cpos") + F.col("cneg")
    return df.withColumn("yi", F.log((F.col("tpos") / t) / (F.col("cpos") / c))).withColumn("vi", 1 / F.col("tpos") - 1 / t + 1 / F.col("cpos") - 1 / c)


def random_effects(effects: DataFrame, most_rounds: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """One row (k, mu, ci_low, ci_high, p, tau2, i2). The studies (yi, vi) are written once; each REML step is one aggregation over them
    to one row, of effects around their mean, so that its sums of squares don't cancel. Raises where they don't converge."""
    spark = effects.sparkSession
    out = "k long, mu double, ci_low double, ci_high double, p double, tau2 double, i2 double"
    path = store.scratch(spark, "effects")
    effects.select("yi", "vi").write.parquet(path)
    rows = spark.read.schema("yi double, vi double").parquet(path)
    s = rows.agg(F.count("*").alias("k"), F.avg("yi").alias("mean"), F.sum(1 / F.col("vi")).alias("a"), F.sum(1 / (F.col("vi") * F.col("vi"))).alias("b")).first()
    k = s["k"]
    if not k:
        return spark.createDataFrame([], out)
    y, tau2 = F.col("yi") - s["mean"], 0.0
    for _ in range(most_rounds):
        w = 1 / (F.col("vi") + tau2)
        r = rows.agg(*(F.sum(e).alias(c) for c, e in (("w", w), ("wy", w * y), ("w2", w * w), ("w2y", w * w * y), ("w2yy", w * w * y * y), ("w2v", w * w * F.col("vi"))))).first()
        mu = r["wy"] / r["w"]
        q = r["w2yy"] - 2 * mu * r["w2y"] + mu * mu * r["w2"] - r["w2v"]
        after = max(0.0, q / r["w2"] + 1 / r["w"])
        if abs(after - tau2) < tolerance:
            break
        tau2 = after
    else:
        raise ArithmeticError(f"random effects: no convergence in {most_rounds} rounds")
    store.discard(spark, path)
    mu, se = mu + s["mean"], 1 / math.sqrt(r["w"])
    typical = (k - 1) * s["a"] / (s["a"] ** 2 - s["b"]) if k > 1 else 0.0
    p = math.erfc(abs(mu / se) / math.sqrt(2))
    return spark.createDataFrame([(k, mu, mu - 1.959963984540054 * se, mu + 1.959963984540054 * se, p, tau2, 100 * tau2 / (tau2 + typical) if tau2 + typical > 0 else 0.0)], out)


def ancova(df: DataFrame, dep: str, cov: str, group: str) -> DataFrame:
    """One row (n, groups, f, df1, df2): F of the group in dep ~ cov + group, from one aggregation of sums by group."""
    y, x = F.col(dep), F.col(cov)
    g = df.groupBy(group).agg(F.count("*").alias("n"), *(F.sum(e).alias(a) for a, e in (("x", x), ("y", y), ("xx", x * x), ("xy", x * y), ("yy", y * y))))
    within = g.agg(*(F.sum(F.col(a + b) - F.col(a) * F.col(b) / F.col("n")).alias(f"w{a}{b}") for a, b in ("xx", "xy", "yy")))
    total = g.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), *(F.sum(c).alias(c) for c in ("x", "y", "xx", "xy", "yy")))
    both = total.join(F.broadcast(within))
    t = {a + b: F.col(a + b) - F.col(a) * F.col(b) / F.col("n") for a, b in ("xx", "xy", "yy")}
    rss0 = t["yy"] - t["xy"] * t["xy"] / t["xx"]
    rss1 = F.col("wyy") - F.col("wxy") * F.col("wxy") / F.col("wxx")
    df1, df2 = F.col("groups") - 1, F.col("n") - F.col("groups") - 1
    return both.select("n", "groups", (((rss0 - rss1) / df1) / (rss1 / df2)).alias("f"), df1.alias("df1"), df2.alias("df2"))
