"""Feedback counters and incremental files."""

from factloom.streaming import feedback


def test_counters_are_folded_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, "helpful"), (1, "shown"), (2, "unhelpful")], "claim_id long, kind string").write.parquet(src)
    for rows in (None, [(1, "helpful")]):
        if rows:
            spark.createDataFrame(rows, "claim_id long, kind string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("claim_id long, kind string").parquet(src)
        feedback.append_counters(stream, out, ck).awaitTermination()
    got = {r["claim_id"]: (r["hits"], r["helpful"], r["unhelpful"]) for r in feedback.totals(spark, out).collect()}
    assert got == {1: (3, 2, 0), 2: (1, 0, 1)}
    found = spark.createDataFrame([(2,), (3,)], "claim_id long")
    for _ in range(2):  # a request that is recorded again counts once
        feedback.append_shown(found, out, "a")
    feedback.append_shown(found.where("claim_id = 3"), out, "b")
    got = {r["claim_id"]: (r["hits"], r["helpful"], r["unhelpful"]) for r in feedback.totals(spark, out).collect()}
    assert got == {1: (3, 2, 0), 2: (2, 0, 1), 3: (2, 0, 0)}
    assert feedback.totals(spark, str(tmp_path / "none")).collect() == []


def test_only_new_files_are_processed(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    seen = []
    for n in range(2):
        spark.createDataFrame([(n,)], "x long").write.mode("append").parquet(src)
        stream = spark.readStream.schema("x long").parquet(src)
        feedback.process_new_files(stream, lambda b: seen.append(b.count()) or b, out, ck).awaitTermination()
    assert seen == [1, 1]
