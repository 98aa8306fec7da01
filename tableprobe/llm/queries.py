"""The operators as queries over the whole given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.llm import (
    alignment,
    bpe,
    collocations,
    decontaminate,
    licenses,
    line_frequency,
    line_spread,
    neighbours,
    personal_data,
    phrases,
    signature_tree,
    suffix_arrays,
    token_files,
)
from tableprobe.plans.storage import scratch_path

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_files(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE))
    return token_files.document_index(spark, path)


WORDS = r"[^\x20\x09-\x0D]+"


@query
def op2_line_spread(spark, sf_dir):
    done = line_spread.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_spread_sql(min_sites: int = 10) -> str:
    return rf"""
WITH raw AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
lines AS (SELECT *, array_to_string(regexp_extract_all(lower(line), '{WORDS}'), ' ') AS folded FROM raw),
spread AS (
  SELECT folded, min(doc_id) AS first FROM lines WHERE folded <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {min_sites} AND count(DISTINCT digest) > 1),
judged AS (SELECT doc_id, line, i, first IS NOT NULL AND first <> doc_id AS removed FROM lines LEFT JOIN spread USING (folded))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256
FROM judged GROUP BY 1
"""


SQL["op2_line_spread"] = line_spread_sql()


@query
def op3_bpe(spark, sf_dir):
    file = public_tokenizers.path(BYTE_BPE)
    tokens = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), file)
    return bpe.decode(tokens, file).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_line_frequency(spark, sf_dir):
    columns = ("doc_id", *line_frequency.MEASURES, "base_failed", "kept", "n_common_words")
    return line_frequency.quality(table(spark, sf_dir, "documents")).select(*columns)


SQL["op4_line_frequency"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
raw AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (
  SELECT doc_id, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w
  FROM raw WHERE regexp_matches(line, '{WORDS}')),
hashed AS (
  SELECT doc_id, source, line, len(w) AS words,
    CAST('0x' || substr(md5(source || chr(10) || array_to_string(w, ' ')), 1, 15) AS BIGINT) AS h FROM lines),
texts AS (SELECT doc_id, md5(t) AS digest FROM d),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY 1),
common AS (
  SELECT source, h FROM hashed JOIN texts USING (doc_id) JOIN hosts USING (source)
  GROUP BY source, h, n HAVING count(DISTINCT digest) > 20 AND count(DISTINCT digest) > 0.01 * n),
lost AS (SELECT doc_id, sum(words) AS n_common_words FROM hashed SEMI JOIN common USING (source, h) GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS c FROM places),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY 1),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
    CAST(coalesce(n_common_words, 0) AS BIGINT) AS n_common_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND n_words - n_common_words >= 0.3 * n_words AS kept FROM judged
"""


@query
def op5_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@query
def op7_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated"
    )


PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL["op7_decontaminate"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PLAIN}') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PLAIN}') AS w
  FROM benchmark),
targets AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS words
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM targets)),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN targets t ON t.n = p.n AND t.words = p.w[p.i:p.i + p.n - 1]),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY 1),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query
def op8_signature_tree(spark, sf_dir):
    return signature_tree.similar_documents(table(spark, sf_dir, "documents"))


@query
def op6_phrases(spark, sf_dir):
    done = phrases.remove_repeated_phrases(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_suffix_arrays(spark, sf_dir):
    done = suffix_arrays.remove_repeated_strings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_personal_data(spark, sf_dir):
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query
def op11_pair_bitmaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


@query
def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM split GROUP BY 1),
phrases AS (
  SELECT lang, m, w[i:i + m - 1] AS words, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, range(1, 6) AS s(m) WHERE len(w) >= m)
  GROUP BY 1, 2, 3 HAVING count(*) >= 100),
candidates AS (SELECT * FROM phrases WHERE m > 1),
inside AS (
  SELECT DISTINCT lang, words[k:k + p - 1] AS words, f
  FROM candidates, range(2, 5) AS a(p), range(1, 5) AS b(k) WHERE p < m AND k + p - 1 <= m),
kept AS (
  SELECT c.* FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.words = c.words AND i.f >= c.f)),
cuts AS (
  SELECT c.lang, c.words, c.f AS a, k, x.f AS l, y.f AS r, t.n,
    CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM kept c, range(1, 5) AS s(k), phrases x, phrases y, totals t
  WHERE k < c.m AND x.lang = c.lang AND x.words = c.words[1:k] AND y.lang = c.lang AND y.words = c.words[k + 1:c.m] AND t.lang = c.lang),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM cuts),
ranked AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank
  FROM weakest WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query
def op13_pruned_graph(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
