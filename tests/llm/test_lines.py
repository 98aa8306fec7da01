"""Sites and documents are counted in full: made-up tables on which counting something less shows."""

import duckdb
import pandas as pd
import pytest

from tableprobe.llm import line_frequency, line_spread
from tableprobe.llm.queries import line_spread_sql
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], SCHEMA).repartition(3)


def numbered(pairs):
    return [{"doc_id": n, "text": text, "source": source} for n, (text, source) in enumerate(pairs)]


@pytest.mark.parametrize("limit", [2, 10, 12, 13])
def test_a_line_of_many_texts_that_are_each_on_many_sites(spark, limit):
    rows = numbered((f"own words of text {t}\nthe shared line", f"s{s}") for t in range(12) for s in range(12))
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in line_spread.dedup_lines(frame(spark, rows), min_sites=limit).collect()}
    assert got == brute.line_spread(rows, limit)
    assert sum(n for n, _ in got.values()) == (143 if limit <= 12 else 0)


def test_copies_of_one_text_alone_make_no_boilerplate(spark):
    rows = numbered(("one line\nand another", f"s{s % 15}") for s in range(60))
    got = line_spread.dedup_lines(frame(spark, rows), min_sites=10).collect()
    assert all(r["n_removed"] == 0 for r in got)


def test_blanks_between_words_do_not_tell_lines_apart(spark):
    blanks = [" ", "  ", "\t", " \t ", "\x0b", "\x0c", "\r", "   "]
    lines = [f"{b}Shared{b}LINE of{b}words{b}" for b in blanks]
    rows = numbered((f"own words of text {n}\n{lines[n % 8]}\nsharedline of words", f"s{n % 12}") for n in range(24))
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in line_spread.dedup_lines(frame(spark, rows), min_sites=12).collect()}
    assert got[0] == (0, rows[0]["text"])
    assert all(got[n] == (2, f"own words of text {n}") for n in range(1, 24))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows))
    said = con.execute(line_spread_sql(12)).fetchall()
    assert {r[0]: r[2] for r in said} == {k: n for k, (n, _) in got.items()}


def words(label, n):
    return " ".join(f"{label}w{k}" for k in range(n))


def kept(spark, rows):
    got = {r["doc_id"] for r in line_frequency.quality(frame(spark, rows)).where("kept").collect()}
    good = brute.good(rows)
    assert got == set(good)
    assert {r["doc_id"]: r["text"] for r in line_frequency.good_documents(frame(spark, rows)).collect()} == good
    return got


def test_documents_of_a_shared_line_are_counted(spark):
    """The more of a document is boilerplate, the surer it goes."""
    shared = words("shared", 60)
    rows = numbered((f"{shared}\n{words(f'h{h}d{d}', 10)}", f"h{h}") for h in range(5) for d in range(60))
    rows += [{"doc_id": 1000 + n, "text": words(f"clean{n}", 70), "source": f"h{n % 5}"} for n in range(40)]
    assert kept(spark, rows) == {1000 + n for n in range(40)}


def test_documents_of_shared_lines_only(spark):
    lines = [words(f"l{k}", 12) for k in range(8)]
    subsets = [[x for k, x in enumerate(lines) if m >> k & 1] for m in range(256)]
    rows = numbered(("\n".join(x), "host") for x in subsets if len(x) >= 5)
    assert kept(spark, rows) == set()


def test_copies_count_once(spark):
    rows = numbered((words("popular", 80), "host") for _ in range(100))
    rows += [{"doc_id": 500 + n, "text": words(f"own{n}", 80), "source": "host"} for n in range(30)]
    assert len(kept(spark, rows)) == 130


def test_common_lines_are_taken_out(spark):
    rows = numbered((f"{words(f'd{d}', 60)}\n  Common \tLINE of the host \n\n{words(f'e{d}', 3)}", "host") for d in range(30))
    assert len(kept(spark, rows)) == 30
    assert all("ommon" not in r["text"] and r["text"].count("\n") == 2 for r in line_frequency.good_documents(frame(spark, rows)).collect())
