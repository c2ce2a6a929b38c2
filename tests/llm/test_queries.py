"""The subpackage's queries against SQL, and on the smallest tables."""

import pytest

from factloom.llm import oracle, queries

from ..conftest import SF, same

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, duck):
    same(QUERIES[name](spark, SF), duck, SQL[name])


def test_all_are_registered():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in __spark_entry__.queries()}


#: The columns that the contracts name, and the table whose rows a query has.
CONTRACTS = {
    "op2_bpe_encode_decode": ("documents", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"),
    "op3_ngram_jaccard_join": ("documents", "doc_id bigint, n_shingles bigint, component_id bigint"),
    "op4_quality_classifier": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op5_substring_dedup": ("documents", "doc_id bigint, class_id bigint, passages array<struct<start:bigint,end:bigint>>, partners array<bigint>"),
    "op6_html_extraction": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
    "op7_url_filters": ("pages", "page_id bigint, host string, path string, rule string, verdict string"),
    "op9_pii_surrogates": ("documents", "doc_id bigint, text string"),
    "op10_quality_rules": ("documents", "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"),
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(name, spark):
    table, columns = CONTRACTS[name]
    out = QUERIES[name](spark, SF)
    kinds = dict(out.dtypes)
    for column in columns.split(", "):
        at, kind = column.split(" ", 1)
        assert kinds[at] == kind
    key = columns.split(" ", 1)[0]
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    assert sorted(r[0] for r in out.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())


def test_registered_queries_are_their_operators(spark):
    """The thin queries of the operators that SQL can't express, against plain Python over the same tables."""
    import hashlib
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    from .test_operators import brute_components, decontaminate

    corpus = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op2_bpe_encode_decode"](spark, SF).collect():
        ids = theirs.encode(corpus[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(corpus[r["doc_id"]].encode()).hexdigest()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op3_ngram_jaccard_join"](spark, SF).collect()}
    assert got == brute_components(corpus, 3, 90, 100)
    items = decontaminate.Items([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    want = sorted((i, *hit) for i, t in corpus.items() for hit in items.find(t))
    assert sorted(map(tuple, QUERIES["op8_benchmark_decontamination"](spark, SF).collect())) == want
