"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tableprobe.llm import bpe, decontaminate, licenses, line_frequency, line_spread, personal_data, phrases, signature_tree, suffix_arrays, token_files
from tableprobe.plans.storage import scratch_path
from tests.conftest import SMALL

FILE = public_tokenizers.path("byte_bpe_50k.json")
CLASHES = ("digest", "host", "entity", "line", "lines", "keys", "owner", "label", "ids", "IDS2", "n_lines", "words", "hash", "at", "n", "part", "first", "decoded", "kept", "hit")
COPY = " ".join(f"copy{k}" for k in range(80))
LONG = "\n".join(" ".join(f"w{(k * 7 + j) % 997}" for j in range(20)) for k in range(3000))
ROWS = [
    (None, "no id here " * 10, "s1"),
    (1, None, "s1"),
    (2, "", "s1"),
    (3, " \n\t\n ", None),
    (4, LONG, "s2"),
    (5, COPY, "s1"),
    (5, COPY, "s1"),
    (6, COPY, "s2"),
    (6, COPY + " more", "s2"),
    (7, "É日本 🎉 ... All rights reserved. <|endoftext|> x", "s3"),
    (8, COPY.replace("copy40", "other"), "s3"),
    (9, "a", "s3"),
    (9, "A", "s3"),
]


def schema(extra):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    return T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in extra]])


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, *range(len(CLASHES))) for r in ROWS], schema(CLASHES)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], schema(()))


@pytest.fixture(scope="module")
def tagger(spark, edges):
    return personal_data.train(edges, count=128, epochs=1)


def benchmark(spark):
    items = [(1, " ".join(f"Copy{k}" for k in range(20))), (2, None), (3, ""), (4, "no id"), (None, "copy1 copy2")]
    return spark.createDataFrame(items, "item_id long, text string")


def tokens_of(df):
    path = scratch_path(df.sparkSession, "tokens")
    token_files.write_token_files(df, path, FILE)
    return token_files.document_index(df.sparkSession, path)


def operators(spark, tagger):
    return {
        "token_files": tokens_of,
        "line_spread": lambda d: line_spread.dedup_lines(d, min_sites=2),
        "bpe": lambda d: bpe.decode(bpe.encode(d, FILE), FILE),
        "line_frequency": line_frequency.quality,
        "licenses": licenses.scan_licenses,
        "phrases": phrases.remove_repeated_phrases,
        "decontaminate": lambda d: decontaminate.contamination(d, benchmark(spark)),
        "hit_words": lambda d: decontaminate.drop_hit_words(d, benchmark(spark)),
        "signature_tree": signature_tree.similar_documents,
        "suffix_arrays": suffix_arrays.remove_repeated_strings,
        "personal_data": lambda d: personal_data.find_personal_data(d, tagger=tagger),
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_every_row(spark, edges, empty, tagger, name):
    run = operators(spark, tagger)[name]
    got = run(edges).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert run(empty).collect() == []


def by_text(spark, df, edges):
    return {(r["doc_id"], r["text"]): r for r in df.collect()}


def test_repeats_are_no_phrases_of_their_own_document(spark, edges):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in phrases.remove_repeated_phrases(edges).where("doc_id in (5, 6, 8)").collect())
    assert got == [(5, 80, 0), (5, 80, 0), (6, 80, 80), (6, 81, 80), (8, 80, 79)]


def test_copies_and_versions_are_one_component(edges):
    got = {(r["doc_id"], r["component_id"]) for r in signature_tree.similar_documents(edges).collect()}
    assert {(5, 5), (6, 5), (8, 5), (1, 1), (2, 2), (3, 3), (9, 9), (None, None)} <= got


def test_strings_of_rows_that_are_one_document(edges):
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_arrays.remove_repeated_strings(edges).where("doc_id in (5, 6)").collect()}
    assert got[(5, len(COPY))] == len(COPY)
    assert got[(6, len(COPY) + 5)] == len(COPY)


def test_contaminated_rows(spark, edges):
    bad = decontaminate.contamination(edges, benchmark(spark)).where("contaminated")
    assert {r["doc_id"] for r in bad.collect()} == {None, 5, 6, 8}
    kept = decontaminate.drop_contaminated(edges, benchmark(spark))
    assert kept.columns == edges.columns and kept.count() == len(ROWS) - 6
    spans = decontaminate.drop_hit_words(edges, benchmark(spark)).where("doc_id = 8").first()["kept"]
    assert spans.split()[0] == "copy20" and len(spans.split()) == 60
    assert decontaminate.contamination(edges, benchmark(spark).limit(0)).where("contaminated").count() == 0


def test_special_tokens_and_odd_texts_come_back(edges):
    got = bpe.decode(bpe.encode(edges.select("doc_id", "text", F.col("text").alias("was")), FILE), FILE).collect()
    assert all(r["decoded"] == (r["was"] or "") for r in got)
    assert next(r["ids"] for r in got if r["doc_id"] == 7).count(50256) == 1


def test_find_documents_reads_few_rows(spark, edges):
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(edges, path, FILE)
    found = token_files.find_documents(spark, path, [5, 9])
    assert sorted(r["doc_id"] for r in found.collect()) == [5, 5, 9, 9]
    text = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [5,9])]" in text


@pytest.mark.parametrize("number", range(5))
def test_stages(spark, edges, empty, number):
    stage = corpus_pipeline.STAGES[number][1]
    docs = edges.withColumn("n_chars", F.length("text").cast("long"))
    got = stage(spark, docs, SMALL)
    assert number == 4 or got.columns == docs.columns
    assert got.count() <= len(ROWS)
    assert stage(spark, empty, SMALL).count() == 0


def test_a_line_on_many_sites_stays_once(spark):
    """Also near the limit, where sketches are not trusted, and for null sites."""
    rows = [(n, f"own words {n}\nShared  line \n", f"s{n % 12}" if n % 12 else None) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit, expected in ((12, 39), (13, 0), (2, 39)):
        got = line_spread.dedup_lines(docs, min_sites=limit).collect()
        assert sum(r["n_removed"] for r in got) == expected
        assert all("own words" in r["text"] for r in got)


def test_one_key_with_a_third_of_all_rows(spark):
    """One very common passage, and one large group of near copies, in one table."""
    shared = " ".join(f"shared{k}" for k in range(30))
    base = [f"near{k}" for k in range(120)]
    rows = [(n, f"{shared} " + " ".join(f"d{n}x{k}" for k in range(60))) for n in range(150)]
    rows += [(n, " ".join(base[: n % 100] + [f"edit{n}"] + base[n % 100 :])) for n in range(150, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    classes = {r["doc_id"]: r["component_id"] for r in signature_tree.similar_documents(docs).collect()}
    assert all(classes[n] == n for n in range(150)) and all(classes[n] == 150 for n in range(150, 300))
    gone = {r["doc_id"]: r["n_removed"] for r in phrases.remove_repeated_phrases(docs).collect()}
    assert gone[0] == 0 and all(gone[n] == 30 for n in range(1, 150))
