"""URL filter: rules first, then two character language models. DataFrame operations only.

A rule is (verdict, host, path); it fits its host and every subdomain if the url's path starts with the rule's; the longest rule
wins. URLs that a rule decides are also what the models learn from: one variable-order Markov model of the allowed and one of the
blocked ones, over host and path, with contexts of up to ORDER - 1 characters, each order smoothed by the next shorter one. A URL
without a rule is judged by the length-normalised difference of the two log-likelihoods, against a threshold that lies between the
means of the two classes in proportion to their spreads. The threshold is set on addresses that the models haven't counted: those
whose MD5 begins with one of HELD_OUT (on all that rules decide, if that part lacks a class).

Counts cover all rows. URLs are scored once for each distinct host and path. The table of gram weights is broadcast only if its
counted rows are MOST_BROADCAST or fewer; else it is joined by shuffle, its hot grams by broadcast. Addresses with very many rows get
their scores by broadcast, too, so that no task holds all rows of one.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged like any other; of rules
of equal length that fit the last one in order counts; a score at the threshold is allowed; with no allowed or no blocked URL to learn
from, the verdict is `allow`; very long urls are read whole; repeated rows are judged alike; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 4
#: Weight of the shorter context in each smoothing step.
PRIOR = 2.0
#: Characters that the models take to be possible.
ALPHABET = 256.0
#: Rows of the gram table that may be broadcast (some 60 bytes each).
MOST_BROADCAST = 200_000
START, END = "\x02", "\x03"
#: First hex digits of the MD5 of addresses that set the threshold.
HELD_OUT = ("0", "1", "2", "3")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The list of rules is a parameter written into the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def grams(df: DataFrame, text: str) -> DataFrame:
    """One row for each position of each text, its end included: the character with ORDER - 1 before it, as `gram`."""
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col(text), F.lit(END))
    return df.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(ORDER)))))


def weights(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, weight) for the grams asked for: the difference of the models' log probabilities of the last character.

    counts: (gram, allowed, blocked). p(c | context) = (n(context c) + PRIOR * p(c | shorter context)) / (n(context) + PRIOR).
    """
    out = asked.select("gram").distinct()
    for k in range(1, ORDER + 1):
        own, context = F.right("gram", F.lit(k)), F.substr("gram", F.lit(ORDER - k + 1), F.lit(k - 1))
        for kind, key in (("n", own), ("t", context)):
            sums = counts.groupBy(key.alias("key")).agg(F.sum("allowed").alias(f"{kind}a{k}"), F.sum("blocked").alias(f"{kind}b{k}"))
            out = out.withColumn("key", key).join(sums, "key", "left").drop("key")
    pa = pb = F.lit(1 / ALPHABET)
    for k in range(1, ORDER + 1):
        pa, pb = (
            (F.coalesce(f"n{y}{k}", F.lit(0)) + PRIOR * p) / (F.coalesce(f"t{y}{k}", F.lit(0)) + PRIOR) for y, p in (("a", pa), ("b", pb))
        )
    return out.select("gram", (F.log(pa) - F.log(pb)).alias("weight"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages (page_id, url); score: the normalised difference of
    log-likelihoods less the threshold, null where a rule decides or there is nothing to learn from."""
    from .common import discard, skew_join, written

    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    judged = split.select("*", rule.alias("rule"), verdict.alias("ruling"), F.concat("host", "path").alias("s"))
    # Repeated addresses are counted first, so that one address with very many rows is one row with a count from here on.
    # Dealt to as many tasks as the session's shuffles have: a position of an address is a row later.
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = F.substring(F.md5("s"), 1, 1).isin(*HELD_OUT)
    addresses = written(judged.groupBy("s", "ruling").agg(F.count("*").alias("n")).withColumn("held", held).repartition(tasks, "s"), "addresses")
    counts = written(
        grams(addresses.where("ruling is not null and not held"), "s")
        .groupBy("gram")
        .agg(*(F.sum(F.when(F.col("ruling") == v, F.col("n")).otherwise(0)).alias(c) for v, c in (("allow", "allowed"), ("block", "blocked")))),
        "grams",
    )
    asked = written(grams(addresses, "s").groupBy("gram").agg(F.count("*").alias("n")), "asked")
    table = written(weights(counts, asked).join(asked, "gram"), "weights")
    size = table.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    met = grams(addresses, "s").drop("n")
    met = met.join(F.broadcast(table.drop("n")), "gram") if size["rows"] <= MOST_BROADCAST else skew_join(met, table, "gram", size["n"])
    scored = written(met.groupBy("s").agg(F.round(F.avg("weight"), 9).alias("raw")).join(addresses, "s"), "scores")
    discard(counts, asked, table, addresses)
    ours = scored.where("ruling is not null").groupBy("ruling", "held").agg(*(F.sum(e).alias(c) for c, e in (("n", F.col("n")), ("x", F.col("n") * F.col("raw")), ("xx", F.col("n") * F.col("raw") * F.col("raw")))))
    found = ours.collect()  # four rows
    if len({r["ruling"] for r in found}) < 2:
        discard(scored)
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    cut_on = [r for r in found if r["held"]] if len({r["ruling"] for r in found if r["held"]}) == 2 else found

    def spread(kind):
        n, x, xx = (sum(r[c] for r in cut_on if r["ruling"] == kind) for c in ("n", "x", "xx"))
        return x / n, max(xx / n - (x / n) ** 2, 0.0) ** 0.5

    (ma, sa), (mb, sb) = spread("allow"), spread("block")
    threshold = (ma * sb + mb * sa) / (sa + sb) if sa + sb > 0 else (ma + mb) / 2
    open_ = scored.where("ruling is null").select("s", "n", (F.col("raw") - threshold).alias("score"))
    rows = judged.where("ruling is null")
    total = open_.agg(F.sum("n")).first()[0] or 0
    rest = skew_join(rows, open_, "s", total).select("page_id", "host", "path", "rule", F.when(F.col("score") >= 0, "allow").otherwise("block").alias("verdict"), "score")
    return judged.where("ruling is not null").select("page_id", "host", "path", "rule", F.col("ruling").alias("verdict"), F.lit(None).cast("double").alias("score")).unionByName(rest)
