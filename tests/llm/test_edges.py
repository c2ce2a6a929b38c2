"""Nulls, empty and very long texts, repeated rows, empty tables, clashing columns: each with its defined result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bpe, chat, classifier, decontaminate, html_extract, ngram_join, pii, quality_rules, substring, url_filter

LONG = " ".join(f"word{i}" for i in range(60_000)) + " end."
CLASH = ["score", "key", "keys", "class_id", "component", "component_id", "task", "side", "n", "a", "b", "c", "text_a", "place", "_gone", "_of", "_again", "entities", "_cut", "rank", "d1"]


def public():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a first text of quite a few words, which says a thing or two about nothing."), (1, "a first text of quite a few words, which says a thing or two about nothing."), (2, None), (3, ""), (4, " \n\t "), (None, "a text without an id that has words enough to be judged at all, or so."), (5, LONG), (6, LONG + " tail"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30_000, 30_040))), (2, None), (3, ""), (None, "some text of an item without an id"), (4, "tiny")], "item_id long, text string").withColumn("doc_id", F.lit("x"))


def test_bpe(docs, none):
    got = bpe.tokenised(docs, public()).collect()
    assert len(got) == 9 and sum(r["n_tokens"] == 0 for r in got) == 3
    assert all(r["text"] == t for r, t in zip(sorted((x for x in got if x["doc_id"] == 5), key=str), [LONG]))
    ids = bpe.encode(docs, public())
    assert bpe.decode(ids, public()).where(F.col("doc_id") == 5).first()["text"] == LONG
    assert bpe.tokenised(none, public()).count() == bpe.round_trip(none, public()).count() == 0


def test_rules(docs, none):
    got = {(r["doc_id"], r["n_words"]): (r["base_failed"], r["kept"]) for r in quality_rules.apply_rules(docs, with_text=True).collect()}
    assert got[2, 0] == got[3, 0] == got[4, 0] == (True, False)
    assert got[5, 60_001] == (False, True) and got[None, 16] == (False, True)
    assert quality_rules.apply_rules(none).count() == 0


def test_classifier(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (99, 0)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    assert classifier.train(docs, labels) is None and classifier.train(none, labels) is None
    assert [r["score"] for r in classifier.scores(docs, None).collect()] == [0.5] * 9
    good = [(i, f"a clean line of words number {i} that ends as it should, with a full stop.") for i in range(20)]
    junk = [(100 + i, " ".join(["JUNK!!"] * (5 + i))) for i in range(20)]
    own = spark.createDataFrame(good + junk, "doc_id long, text string")
    model = classifier.train(own, own.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality")))
    scored = {r["doc_id"]: r["score"] for r in classifier.scores(own, model).collect()}
    assert all((s > 0.5) == (i < 100) for i, s in scored.items())
    assert all(0 <= r["score"] <= 1 for r in classifier.scores(docs, model).collect())
    kept = classifier.accepted(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 2
    assert classifier.scores(none, model).count() == classifier.accepted(none, model, 0.5).count() == 0


def test_join(docs, none):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.join_components(docs, 3, 90, 100).collect()}
    assert got[1, 14] == 1 and got[2, 0] == 2 and got[3, 0] == 3 and got[4, 0] == 4 and got[5, 59_999] == got[6, 60_000] == 5 and got[None, 0] is None
    kept = ngram_join.one_of_each(docs, 3, 90, 100)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id = 1").count() == 2 and kept.count() == 8
    assert ngram_join.join_components(none).count() == ngram_join.one_of_each(none).count() == 0


def test_substrings(docs, none):
    got = {r["doc_id"]: r for r in substring.repeated_passages(docs).collect()}
    assert got[6]["class_id"] == got[5]["class_id"] == 5 and got[5]["partners"] == [6]
    assert [tuple(p) for p in got[5]["passages"]] == [(0, 60_001)] and got[1]["passages"] == got[2]["passages"] == []
    cut = substring.without_repeats(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 6").first()["text"] == " tail" and cut.where("doc_id = 5").first()["text"] == LONG
    assert substring.repeated_passages(none).count() == substring.without_repeats(none).count() == 0
    # Different texts under one doc_id.
    text = " ".join(f"v{i}" for i in range(120))
    twice = docs.sparkSession.createDataFrame([(1, text), (2, "short"), (2, text + " more of it"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in substring.repeated_passages(twice).collect() if r["passages"]} == {1, 2}
    assert sorted(str(r["text"]) for r in substring.without_repeats(twice).collect()) == sorted([text, "short", " more of it", "None"])
    assert ngram_join.join_components(twice).count() == 4


def test_decontamination(docs, none, items):
    got = decontaminate.matches(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == [(5, 1, 0), (6, 1, 0)]
    assert LONG[got[0]["start"] : got[0]["end"]].startswith("word30000 ")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == 7
    assert decontaminate.matches(none, items).count() == decontaminate.matches(docs, items.where("false")).count() == 0
    assert decontaminate.decontaminate(docs, items.where("false")).count() == 9


def test_pii(spark, docs, none, monkeypatch):
    out = pii.anonymise(docs.withColumn("n_chars", F.length("text")), "k")
    assert out.columns == [*docs.columns, "n_chars"] and out.where("text is null").count() == 2
    assert out.where("doc_id = 5").first()["text"] == LONG
    monkeypatch.setattr(pii, "MOST_BROADCAST", -1)  # so that draws that collide are joined
    assert sorted(map(str, pii.anonymise(docs, "k").collect())) == sorted(map(str, docs.collect()))
    assert pii.anonymise(none, "k").count() == pii.entities(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, "lost"), (2, 0, "sys\ntem<%", "")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("x")).withColumn("rendered", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.digest(chat.render(chat.events_of(conv))).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[None]["n_turns"], got[2]["n_turns"]) == (3, 0, 1, 1)
    assert chat.render(chat.events_of(conv.where("false"))).count() == chat.digest(chat.render(chat.events_of(conv.where("false")))).count() == 0


def test_pages(spark):
    rows = [(1, "http://a.org/x", "<p>Some text here.</p>"), (1, "http://a.org/x", "<p>Some text here.</p>"), (2, None, None), (3, "no scheme", ""), (None, "://", "<<<>&&;<p"), (4, "http://x.com/fr/1?y", "<p>" * 5000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("x").alias(c) for c in ("host", "path", "s", "gram", "text", "ruling", "verdict", "weight", "score")))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages).collect()]
    assert len(got) == 6 and got.count((1, "Some text here.", 15)) == 2 and (2, "", 0) in got and (3, "", 0) in got and (4, "deep", 4) in got
    urls = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect())
    assert urls == [("1", "a.org", "/x", "org/", "allow")] * 2 + [("2", "", "", None, "allow"), ("3", "", "", None, "allow"), ("4", "x.com", "/fr/1", "com/fr/", "allow"), ("None", "", "", None, "allow")]
    assert html_extract.extract_pages(pages.where("false")).count() == url_filter.filter_urls(pages.where("false")).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for given in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, given, sf).columns == given.columns, name
    none.write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
