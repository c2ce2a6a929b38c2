"""Retrieval: phrases by positions, the stemmed search and its fallback, the index in segments."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import index, segments
from factloom.sources import store

# Published pairs of words and their Porter stems.
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated
conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli
differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate
activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil by by is is""".split()


def test_porter_on_published_pairs(spark):
    df = spark.createDataFrame(list(zip(PAIRS[::2], PAIRS[1::2])), "w string, want string").withColumn("got", F.element_at(tx.porter(F.array("w")), 1))
    assert df.where("got <> want").collect() == []


def test_stems_of_single_words_are_those_of_columns(spark):
    from factloom.functions import stems

    from .conftest import SF

    words = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w")).distinct().where("w <> ''")
    extra = spark.createDataFrame([(w,) for w in [*PAIRS, "ies", "bies", "ss", "yes", "agreed", "eed", "ing", "sing", "élèves", "straßes", "12345", "a1s", "ionion", "yyyy", "hopping", "fell", "controlling"]], "w string")
    rows = words.unionByName(extra).select("w", tx.stem("w").alias("s"), F.element_at(tx.porter(F.array("w")), 1).alias("p"), F.col("w").rlike("^[a-z]+$").alias("plain")).collect()
    assert len(rows) > 1000
    assert [r for r in rows if stems.stem(r["w"]) != r["s"] or r["plain"] and stems.porter(r["w"]) != r["p"]] == []


@pytest.mark.parametrize("run", [50, 1 << 19])
def test_index_of_distinct_claims_is_not_shuffled_and_the_same(spark, tmp_path, monkeypatch, run):
    """Claims with distinct ids are worked out where they are read: the same rows as by shuffles, which none of the plans has."""
    from .conftest import SF

    monkeypatch.setattr(index, "RUN", run)
    odd = [(-1, "`Foo bar.Baz` and `été_x` 3.5% of `a` `` `s`"), (-2, None), (-3, ""), (-4, "the of and"), (-5, "x \x01 y `p\x01q` ÀÉ ²½ Ⅷ"), (-6, "Running runs ran 12 12 12.5")]
    texts = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id claim_id", "text").unionByName(spark.createDataFrame(odd, "claim_id long, text string"))
    kws = index.keyword_rows(texts)
    pairs = ((index.keywords_where_read(texts), kws), (index.full_text_where_read(texts), index.full_text_rows(texts, kws)), (index.stems_where_read(texts), index.stem_rows(str(tmp_path), texts)))
    for got, want in pairs:
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.columns == want.columns and rows(got) == rows(want) and got.count() > 1000


def test_parts_of_the_index_are_built_when_asked_for(spark, tmp_path):
    claims = spark.createDataFrame([(1, "s", "one thing", "CONFIRMED"), (2, "s", "two things", "CONFIRMED")], "claim_id long, source string, text string, status string")
    none = spark.createDataFrame([], "claim_id long, hits long, helpful long, unhelpful long")
    idx = index.Stored(str(tmp_path / "i"), claims, none)
    assert index.keyword_scores(idx, "things").count() == 2
    assert sorted(p.name for p in next((tmp_path / "i").iterdir()).iterdir()) == ["idf", "keywords", "postings"]
    # Rows of one claim, which meet: the largest weight of each keyword.
    twice = index.Stored(str(tmp_path / "j"), claims.unionByName(claims.withColumn("text", F.lit("`thing`"))), none)
    assert {(r["claim_id"], r["keyword"]): r["weight"] for r in twice["keywords"].collect()} == {(1, "one"): 1.0, (1, "thing"): 3.0, (2, "two"): 1.0, (2, "thing"): 3.0}


@pytest.mark.parametrize("most", [3, 500_000])
def test_idf_meets_keywords_by_broadcast_and_by_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(index, "VOCABULARY", most)
    kws = spark.createDataFrame([(i, f"w{k}", 1.0) for i in range(12) for k in range(12) if k <= i], "claim_id long, keyword string, weight double").localCheckpoint()
    idfs = index.idf(kws, kws.select("claim_id").distinct())
    assert rows(index.with_idf(kws, idfs)) == rows(kws.join(idfs.select("keyword", "idf"), "keyword"))


def built(spark, texts, path):
    claims = spark.createDataFrame([(i, "s", t, "CONFIRMED") for i, t in texts.items()], "claim_id long, source string, text string, status string")
    index.build(path, claims, spark.createDataFrame([], "claim_id long, hits long, helpful long, unhelpful long"))
    return store.read_index(spark, path), claims


TEXTS = {1: "the read_frames call reads frames", 2: "frames read by hand", 3: "read frame and read framework, then reads", 4: "uses `read_frame`", 5: "nothing of that", 6: None}


def test_phrases(spark, tmp_path):
    idx, _ = built(spark, TEXTS, str(tmp_path / "i"))
    # read_frames is stemmed as one term, read_frame, and is the phrase `read frame*`.
    terms = {r["term"]: list(r["tokens"]) for r in index.asked(spark.createDataFrame([(1, "How read_frames __ frames?")], "question_id long, text string")).collect()}
    assert terms == {"read_fram": ["read", "fram"], "fram": ["fram"]}
    asked = index.asked(spark.createDataFrame([(0, "read_frames")], "question_id long, text string"))
    for hits in (index._hits_of_one(idx, asked), index._hits_of_many(idx, asked)):
        counts = {r["claim_id"]: (r["tf"], r["dl"]) for r in index.term_counts(hits).collect()}
        # 1 has it in the text, 3 twice, 4 in the text and as the keyword's own words; 2 has the words in another order.
        assert {k: v[0] for k, v in counts.items()} == {1: 1, 3: 2, 4: 2}
    one = {r["claim_id"]: r["bm25"] for r in index.bm25(idx, "read_frames nothing").collect()}
    many = {r["claim_id"]: r["bm25"] for r in index.bm25_of_many(idx, spark.createDataFrame([(7, "read_frames nothing"), (8, "absent_words")], "question_id long, text string")).collect()}
    assert one.keys() == many.keys() == {1, 3, 4, 5} and all(one[k] == pytest.approx(many[k]) for k in one)
    assert index.bm25(idx, "the of").collect() == []


def test_terms_counted_in_claims(spark):
    """Terms of one to four words over claims of few frequent words, against a count by hand; a claim's postings span many batches."""
    rng = random.Random(2)
    letters = ["a", "ab", "abc", "b", "ba"]
    claims = {i: [rng.choice([*letters, None]) for _ in range(rng.randrange(60))] for i in range(40)}
    terms = [list(t) for n in (1, 2, 3, 4) for t in sorted({tuple(rng.choice(letters) for _ in range(n)) for _ in range(12)})]
    rows = [(i, sum(w is not None for w in ws), w, [k for k, x in enumerate(ws) if x == w]) for i, ws in claims.items() for w in {*ws} - {None}]
    want = {}
    for i, ws in claims.items():
        for n, (*head, end) in enumerate(terms):
            tf = sum(ws[k : k + len(head)] == head and (ws[k + len(head)] or "").startswith(end) for k in range(len(ws) - len(head)))
            if tf:
                want[n, i] = (sum(w is not None for w in ws), tf)
    postings = spark.createDataFrame(rows, "claim_id long, dl int, word string, positions array<int>").repartition(3, "word")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("2", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = index.counts_in_claims(postings, terms).collect()
            assert len(got) == len(want) and {(r["term"], r["claim_id"]): (r["dl"], r["tf"]) for r in got} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert index.counts_in_claims(postings.where("false"), terms).collect() == index.counts_in_claims(postings, []).collect() == []


def test_stemmed_search_and_its_fallback(spark, tmp_path):
    texts = {1: "connected systems connect", 2: "a connection", 3: "The Unrelated \\ 50% text", 4: "connecting words of unrelated things", 5: None}
    idx, claims = built(spark, texts, str(tmp_path / "i"))
    ask = lambda q, **how: [(r["claim_id"], r["score"]) for r in index.stem_search(idx, claims, spark.createDataFrame([(1, q)], "question_id long, text string"), **how).orderBy(F.desc_nulls_last("score"), "claim_id").collect()]
    got = ask("connections")
    assert [i for i, _ in got] == [1, 2, 4] or [i for i, _ in got] == [2, 1, 4]
    n, avgdl = 5, (3 + 1 + 2 + 4) / 5  # words that are no stop words
    weight = math.log10((n - 3 + 0.5) / 3.5 + 1)
    assert dict(got) == {i: pytest.approx(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) for i, tf, dl in ((1, 2, 3), (2, 1, 1), (4, 1, 4))}
    assert ask("nrelate") == [(3, None), (4, None)]  # no stem: found as a pattern
    assert ask("nrelate", most=1) == [(3, None)] and ask("\\ 5") == [(3, None)] and ask("the") == [(3, None)]
    assert ask("%elated%ngs") == [(4, None)]
    assert ask("connect", status="REFUTED") == []
    assert ask("zzz") == []


def rows(df):
    return sorted(map(str, df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)).select(sorted(df.columns)).collect()))


def test_segments_equal_a_rebuild_and_read_what_changed(spark, tmp_path, monkeypatch):
    path, feedback = str(tmp_path / "s"), spark.createDataFrame([(3, 4, 1, 0)], "claim_id long, hits long, helpful long, unhelpful long")
    say = lambda i, v: f"claim number {i} says `item_{i % 7}` is {i * v} percent of words{i % 5} and more_of it"

    def state(version):
        texts = {i: say(i, 1) for i in range(200)}
        if version:
            texts |= {5: say(5, 2), 300: say(300, 1)}
            del texts[17]
        if version == 2:
            del texts[300]
            texts |= {5: say(5, 1), 6: None}
        return spark.createDataFrame([(i, f"s{i % 3}", t, "REFUTED" if i == 9 and version else "CONFIRMED") for i, t in texts.items()], "claim_id long, source string, text string, status string")

    def updated(version):
        now, asked = state(version), []

        def fetch(ids):
            asked.extend(r["claim_id"] for r in ids.collect())
            return now.join(ids, "claim_id", "left_semi").select("claim_id", "text")

        listing = now.select("claim_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "status")
        n = segments.update(path, listing, fetch, feedback)
        assert n == len(asked)
        return sorted(asked), listing

    def same(version):
        got = segments.read(spark, path)
        at = str(tmp_path / f"whole{version}{store.unique()}")
        index.build(at, state(version), feedback)
        whole = store.read_index(spark, at)
        for name in ("claims", "keywords", "idf", "postings", "terms", "stats"):
            assert rows(got[name].select(whole[name].columns)) == rows(whole[name]), name
        question = "which `item_3` is 40 percent of more_of words2"
        assert rows(index.search(got, question)) == rows(index.search(whole, question)) != []

    assert len(updated(0)[0]) == 200
    assert updated(1)[0] == [5, 300]
    assert updated(1)[0] == []
    # An update that is broken off before it is published changes nothing, and the next one does its work.
    with monkeypatch.context() as m:
        m.setattr(segments, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            updated(2)
    same(1)
    asked, listing = updated(2)
    assert asked == [5, 6]
    segments.compact(path, listing, feedback)
    same(2)
    assert len(segments._segments(spark, path)) == 1 and updated(2)[0] == []
    updated(2)
    assert len(store.folders(spark, path, "s-")) <= 4  # what no version reads is gone
    with pytest.raises(ValueError, match="missing"):
        segments.read(spark, str(tmp_path / "none"))


def test_equal_sums_of_weights_go_by_id(spark):
    # 0.1 + 0.2 + 0.3 is more than 0.6 in doubles, in whatever order the engine happens to add them.
    rows = [(1, "alpha", 0.3), (1, "gamma", 0.3), (2, "alpha", 0.1), (2, "beta", 0.2), (2, "gamma", 0.3)]
    idx = {"postings": spark.createDataFrame(rows, "claim_id long, keyword string, weight double").coalesce(1)}
    assert index.question_keywords(spark, "alpha beta gamma") == ["alpha", "beta", "gamma"]
    assert [tuple(r) for r in index.keyword_scores(idx, "alpha beta gamma", 1).collect()] == [(1, 0.075)]


def test_places_of_words(spark):
    rows = [(1, ["a", "b", "a", "\x01", "c", "\x01", "a"], 2), (2, [], 0), (3, ["\x01", "b"], 1), (4, ["ä", "ä"], 0)]
    df = spark.createDataFrame(rows, "claim_id long, w array<string>, gaps int")
    got = sorted((r["claim_id"], r["dl"], r["word"], r["positions"]) for r in index.places(df, "\x01").collect())
    assert got == [(1, 5, "a", [0, 2, 6]), (1, 5, "b", [1]), (1, 5, "c", [4]), (3, 1, "b", [1]), (4, 2, "ä", [0, 1])]
    assert index.places(df.where("claim_id = 2")).collect() == []


def test_order_of_postings_costs_no_shuffle(spark, tmp_path):
    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    rows, before = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("word"), F.col("id").alias("claim_id")), shuffled()
    out = index.in_order(str(tmp_path), "words", rows, "word", "claim_id")
    assert sum(n for i, n in shuffled().items() if i not in before) == 0
    files = out.select("word", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    assert len(files) == 1000
    for name in {r["file"] for r in files}:
        own = [r["word"] for r in files if r["file"] == name]
        assert own == sorted(own)
