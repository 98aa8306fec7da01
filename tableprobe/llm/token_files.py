"""Token ids in ORC files.

Documents are dealt out by ranges of ``doc_id`` and tokenized in order, so the
files hold ascending ids and each file is one contiguous piece of the corpus.
ORC stores the ids as run-length coded integers in stripes, with a row index and
a Bloom filter on ``doc_id``: readers take stripes in parallel and skip those
that cannot hold a wanted document. ``first`` is a document's place in its file;
the places of the files follow from their totals.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprobe.llm.arrow import chunks, kept, lists, tidy
from tableprobe.llm.bpe import Vocabulary
from tableprobe.llm.pieces import PieceTable

FILE_SCHEMA = "doc_id long, first long, n_tokens long, ids array<int>"


#: New pieces that are encoded as one text.
JOINED = 200


def _joins(piece: str) -> bool:
    """Whether the pre-tokenizer breaks before and after the piece, whatever such piece stands beside it."""
    return len(piece) > 1 and piece[0] in " \n" and piece[1] != " " and piece[1].isprintable() and piece[-1] != " " and piece[-1].isprintable()


def encode_joined(tokenizer, sizes: np.ndarray, pieces: list[str]) -> list:
    """Ids of every piece. Pieces that join are encoded many at a time and told apart by the bytes of their tokens."""
    out: list = [None] * len(pieces)
    # one blank before visible letters: most pieces, and no closer look is needed
    joins = [len(x) > 1 if x.rfind(" ") == 0 and x.isprintable() else _joins(x) for x in pieces]
    join = [k for k, x in enumerate(joins) if x]
    groups = [join[k : k + JOINED] for k in range(0, len(join), JOINED)]
    alone = [k for k, x in enumerate(joins) if not x]
    lengths = pc.binary_length(pa.array(pieces, pa.large_string())).to_numpy()
    for group, found in zip(groups, tokenizer.encode_batch_fast(["".join([pieces[k] for k in g]) for g in groups], add_special_tokens=False)):
        ids = found.ids
        ends, stops = np.cumsum(sizes[ids]), np.cumsum(lengths[group])
        at = np.searchsorted(ends, stops)
        if at[-1] != len(ids) - 1 or (ends[at] != stops).any():
            alone += group
            continue
        cuts = [0, *(at + 1).tolist()]
        for k, i, j in zip(group, cuts, cuts[1:]):
            out[k] = ids[i:j]
    for k, found in zip(alone, tokenizer.encode_batch_fast([pieces[k] for k in alone], add_special_tokens=False)):
        out[k] = found.ids
    return out


@kept
def _table(tokenizer_file: str) -> PieceTable:
    """One per worker, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    sizes = np.array([len(x) for x in Vocabulary(tokenizer_file).bytes_of], np.int64)
    return PieceTable(partial(encode_joined, tokenizer, sizes))


@tidy
def _encode(batches: Iterator[pa.RecordBatch], tokenizer_file: str, end_id: int) -> Iterator[pa.RecordBatch]:
    table, before = _table(tokenizer_file), 0
    for batch in chunks(batches):
        ids, counts = table.token_ids([x or "" for x in batch.column("text").to_pylist()])
        ids = np.insert(ids, np.cumsum(counts), end_id)
        counts += 1
        first = before + np.cumsum(counts) - counts
        before = int(first[-1] + counts[-1])
        columns = [batch.column("doc_id"), pa.array(first), pa.array(counts), lists(ids.astype(np.int32, copy=False), counts, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "first", "n_tokens", "ids"])


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = 2,
    row_index_stride: int = 1_000,
    bloom_fpp: float = 0.01,
) -> None:
    """Tokenize ``text`` and write the ids in ascending ``doc_id`` order.

    A null text is empty: its row holds only ``end_id``. Repeated ids stand side by
    side, a null id comes first. Other columns are not read. An empty table gives
    files without rows.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        ordered.mapInArrow(partial(_encode, tokenizer_file=tokenizer_file, end_id=end_id), FILE_SCHEMA)
        .write.mode("errorifexists")
        .option("orc.compress", "LZ4")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; stripes and row groups without them are skipped."""
    return read_token_files(spark, path).where(F.col("doc_id").isin(doc_ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
        ends = ends - ends[0]
        raw = memoryview(values).cast("B")
        sums = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])), np.int64, len(ids))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("first"), batch.column("part"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums)],
            ["doc_id", "first", "part", "n_tokens", "ids_crc32"],
        )


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    Totals of files come from their two small columns; one row per file is then
    summed up in file order.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("part")
    files = read_token_files(spark, path)
    totals = files.select(part, "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    rows = files.select("doc_id", "first", part, "ids").mapInArrow(
        _checksums, "doc_id long, first long, part long, n_tokens long, ids_crc32 long"
    )
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
