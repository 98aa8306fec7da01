"""The registered queries against SQL, or against plain versions, on the smallest tables."""

import duckdb
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check_sql import TABLES, compare
from tableprobe.llm import licenses, line_spread
from tableprobe.llm.queries import QUERIES, SQL
from tests.conftest import SMALL, plan
from tests.llm import brute


@pytest.fixture(scope="module")
def rows():
    return pq.read_table(f"{SMALL}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def result(spark, name, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in QUERIES[name](spark, SMALL).collect()}


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(SQL))
def test_query_agrees_with_sql(spark, database, name):
    said, _ = compare(spark, database, QUERIES[name], SQL[name], SMALL)
    assert said.startswith("ok"), said


@pytest.mark.parametrize("name", ["op2_line_spread", "op7_decontaminate"])
def test_native_plans_have_no_python(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert not [x for x in ("Python", "MapInArrow", "Pandas", "CartesianProduct", "NestedLoop") if x in text]


def test_token_files(spark, rows, tokenizer):
    assert result(spark, "op1_token_files", "start", "n_tokens", "ids_crc32") == brute.token_files(rows, tokenizer)


def test_line_spread_with_few_sites(spark, rows):
    done = line_spread.dedup_lines(spark.read.parquet(f"{SMALL}/documents.parquet"), min_sites=2).collect()
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in done} == brute.line_spread(rows, 2)
    assert sum(r["n_removed"] for r in done) > 0


def test_bpe(spark, rows, tokenizer):
    assert result(spark, "op3_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == brute.bpe(rows, tokenizer)


def test_licenses(spark, rows):
    got = result(spark, "op5_licenses", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == brute.licenses(rows)
    labels = result(spark, "op5_licenses", "base_labels", "labels", "score")
    notices = (("MIT License", "mit"), ("Apache License", "apache-2.0"), ("CC BY-NC", "cc-by-nc-4.0"), ("License, version 3", "gpl-3.0"))
    for r in rows:
        base, every, score = labels[r["doc_id"]]
        assert set(base.split(",")) - {""} <= set(every.split(",")) and 0 <= score <= 1
        for phrase, label in notices:
            assert (phrase in r["text"]) == (label in every.split(",")), r["doc_id"]
        more = brute.license_labels(r["text"], licenses.TEMPLATES)
        assert set(every.split(",")) - {""} == set(base.split(",")) - {""} | set(more), r["doc_id"]
        assert score == (1 if base else max(more.values(), default=0))


def test_phrases(spark, rows):
    assert result(spark, "op6_phrases", "n_words", "n_removed", "kept_sha256") == brute.phrases(rows)


def test_similar_documents(spark, rows):
    assert result(spark, "op8_signature_tree", "n_shingles", "component_id") == brute.similar(rows)


def test_strings(spark, rows):
    assert result(spark, "op9_suffix_arrays", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.strings(rows)


def test_personal_data(spark, rows):
    got = result(spark, "op10_personal_data", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    expected = brute.personal(rows)
    for k, (*counts, base) in expected.items():
        assert got[k][:5] == (*counts, brute.sha(base)), k
        assert set(base.split(",")) <= {*got[k][5].split(","), ""}


def test_pipeline(spark, rows, tokenizer):
    items = pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()
    good = brute.good(rows)
    docs = [r | {"text": good[r["doc_id"]]} for r in rows if r["doc_id"] in good]
    changed = brute.line_spread(docs, 10)
    docs = [r | {"text": changed[r["doc_id"]][1]} for r in docs if changed[r["doc_id"]][0] == 0 or changed[r["doc_id"]][1].strip()]
    groups = brute.similar(docs)
    docs = [r for r in docs if groups[r["doc_id"]][1] == r["doc_id"]]
    bad = brute.contaminated(docs, items)
    docs = [r for r in docs if r["doc_id"] not in bad]
    expected = {k: (v[0], v[2]) for k, v in brute.bpe(docs, tokenizer).items()}
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == expected and 0 < len(got) < len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
