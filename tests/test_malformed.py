"""Lines that do not fit their file are an error or are kept aside, never cut."""

import pytest

from tableprobe.sources import readers


def written(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as file:
        file.write(text)
    return path


RAGGED = 'x,y\n1,2\n1,2,3,4\n5\n6,"a, b"\n7,\n"8","q""q"\n'


@pytest.mark.parametrize("multiline", [True, False])
def test_ragged_csv(spark, folder, multiline):
    path = written(folder, "a.csv", RAGGED)
    df, report = readers.load_table(spark, path, multiline=multiline)
    assert sorted((r["x"], r["y"]) for r in df.collect() if r["y"]) == [(1, "2"), (6, "a, b"), (8, 'q"q')] and df.count() == 4
    assert df.select("x").count() == 4 and df.groupBy().sum("x").first()[0] == 22
    assert sorted(tuple(r) for r in report["malformed"].collect()) == [("a.csv", "1,2,3,4"), ("a.csv", "5")]
    assert report["malformed"].count() == 2
    assert [tuple(r) for r in report["malformed_per_file"].collect()] == [("a.csv", 6, 2)]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_csv(spark, path).collect()
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_csv(spark, path).select("x").collect()


def test_well_formed_files_have_nothing_aside(spark, folder):
    path = written(folder, "a.csv", "x,y\n1,2\n3,\n")
    df, report = readers.load_table(spark, path)
    assert df.count() == 2 and report["malformed"].count() == 0
    assert readers.read_csv(spark, path).count() == 2


def test_without_a_header_nothing_is_cut(spark, folder):
    path = written(folder, "notes.csv", 'Machine 7\nmade,today\n a, b ,c; d\n1,2,3\n4,5\n')
    raw = readers.read_csv(spark, path, header=False, with_order=True)
    assert raw.columns == ["_c0", "_c1", "_c2", readers.ORDER]
    df, _ = readers.apply_header_overrides(raw, 2, True)
    assert df.columns == ["a", "b", "c; d"] and sorted(map(tuple, df.collect())) == [(1, 2, 3), (4, 5, None)]


def test_broken_json_lines(spark, folder):
    path = written(folder, "b.json", '{"a":1,"b":"x"}\n{"a":2\n{"a":3,"b":"z"}\n\n"word"\n')
    df, report = readers.load_table(spark, path)
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (3, "z")]
    assert df.columns == ["a", "b"] and df.count() == 2
    assert {r["line"] for r in report["malformed"].collect()} >= {'{"a":2'}
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_json(spark, path).collect()
    with pytest.raises(ValueError, match="no line is a JSON record"):
        readers.load_table(spark, written(folder, "c.jsonl", "{{\n{{\n"))


def test_many_files_say_what_they_kept_aside(spark, folder):
    paths = [written(folder, "a.csv", RAGGED), written(folder, "b.csv", "x,y\n9,9\n"), written(folder, "c.jsonl", '{"x":1}\n{"x"\n'), written(folder, "d.csv", "x,y\n1\n")]
    merged, report = readers.load_many(spark, paths)
    got = {r["file"]: (r["status"], r["rows"], r["malformed"]) for r in report["files"].collect()}
    assert got == {"a.csv": ("ok", 4, 2), "b.csv": ("ok", 1, 0), "c.jsonl": ("ok", 1, 1), "d.csv": ("empty", 0, 1)}
    assert merged.count() == 6
    assert sorted(r["line"] for r in report["malformed"].collect()) == ["1,2,3,4", "5", '{"x"']
    assert any("2 lines do not fit" in m for m in report["messages"])
