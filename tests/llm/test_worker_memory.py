"""A Python worker lives through all stages of a pipeline; what one operator keeps between its tasks must not burden the next."""

import gc
import weakref

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tableprobe.llm import alignment, bpe, line_frequency, signature_tree, token_files

FILE = public_tokenizers.path("byte_bpe_50k.json")
ROWS = pa.record_batch({"doc_id": [1, 2], "digest": [1, 2], "text": ["one two three four five six", None]})


def run_bpe() -> weakref.ref:
    assert sum(b.num_rows for b in bpe._encode(iter([ROWS]), FILE, "text", "ids")) == 2
    return weakref.ref(bpe._worker(FILE)[1])


def test_tasks_of_one_operator_share_its_tables():
    table = run_bpe()
    assert run_bpe()() is table()


def test_the_next_operator_drops_them():
    empty = ROWS.slice(0, 0)
    for task in (
        lambda: signature_tree._describe(iter([ROWS]), 5),
        lambda: signature_tree._all_shingles(iter([ROWS]), 5),
        lambda: signature_tree._sets(iter([empty.append_column("entity", pa.array([], pa.int64()))]), 5),
        lambda: signature_tree._link_blocks(iter([]), 80, ["smallest"]),
        lambda: signature_tree._candidates(iter([]), 80),
        lambda: line_frequency._measured(iter([])),
    ):
        table = run_bpe()
        list(task())
        gc.collect()
        assert table() is None


def test_other_tables_of_workers_are_dropped_too():
    piece_file = public_tokenizers.path("piece_bpe_32k.model")
    tables = [weakref.ref(token_files._table(FILE)), weakref.ref(alignment._worker(FILE, piece_file)), run_bpe()]
    list(signature_tree._all_shingles(iter([ROWS]), 5))
    gc.collect()
    assert [t() for t in tables] == [None] * 3


def test_one_worker_encodes_and_decodes(spark):
    texts = ["one two", None, "", "  a\n\nb 日本 🎉", "<|endoftext|> x"] * 300
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    both = bpe.encode_and_decode(docs, FILE)
    apart = bpe.decode(bpe.encode(docs, FILE), FILE)
    assert both.columns == apart.columns and both.orderBy("doc_id").collect() == apart.orderBy("doc_id").collect()
    plan = both.select(F.sha2("decoded", 256))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
