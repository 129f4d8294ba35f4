"""CSV records read in small byte ranges, against Python's reader and Spark's whole-file reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from leadflow.sources import csv_records as records
from leadflow.sources.csv_records import BOM, csv_records, header_names, read_csv


@pytest.fixture
def small_ranges(spark, monkeypatch):
    """Text files are read in ranges of some bytes; the table of their lines is read as ever."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    ranges, seen = records._ranges, []

    def reset(lines=None):
        for k, v in old.items():
            spark.conf.set(k, v)
        if lines is not None:
            seen.append(lines.select("file", "range").distinct().count())
            return ranges(lines)

    def at(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return seen

    monkeypatch.setattr(records, "_ranges", reset)
    yield at
    reset()


def written(path, rows, end="\r\n", mark="", sep=","):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end, delimiter=sep)
    writer.writerows(rows)
    path.write_bytes((mark + out.getvalue()).encode("utf-8"))


def cells(draw):
    return "".join(draw.choices(["a", "b", ",", '"', "\n", "\r\n", "é", " ", "\t", "漢"], k=draw.randint(0, 9)))


@pytest.mark.parametrize(("size", "end", "sep", "seed"), [(11, "\r\n", ",", 1), (29, "\n", "\t", 2), (1 << 20, "\n", ",", 4)])
def test_records_across_ranges(spark, tmp_path, small_ranges, size, end, sep, seed):
    draw = random.Random(seed)
    files = {}
    for name in ("a.csv", "b.csv", "c.csv"):
        rows = [["x", "y", "z"], *([str(i), cells(draw), cells(draw)] for i in range(draw.choice([1, 5, 16])))]
        written(tmp_path / name, rows, end, BOM if name != "b.csv" else "", sep)
        files[name] = rows[1:]
    seen = small_ranges(size)
    want = [tuple(c or None for c in row) for name in sorted(files) for row in files[name]]
    got = read_csv(spark, str(tmp_path), sep, index="at").orderBy("at").collect()
    assert [r.at for r in got] == list(range(len(want))) and [tuple(r)[1:] for r in got] == want
    assert size > 1000 or seen[-1] > 2  # one file goes to many tasks


def test_a_cell_over_many_ranges(spark, tmp_path, small_ranges):
    long = "line, with \"quotes\"\n\n" * 400
    written(tmp_path / "a.csv", [["k", "v"], ["1", long], ["2", "short"], ["", long + "\r\n"], ["4", ""]])
    small_ranges(400)
    got = read_csv(spark, str(tmp_path), index="at").orderBy("at").collect()
    assert [(r.at, r.k, r.v) for r in got] == [(0, "1", long), (1, "2", "short"), (2, None, long + "\r\n"), (3, "4", None)]


def test_stray_quotes_as_the_whole_file_reader_takes_them(spark, tmp_path, small_ranges):
    lines = ['h,i,j', '5" pipe,z', '"abc"def,g', '"",', ' lead , "sp" ', "a", "", "  ", "a,b,c,d", 'x,"y ""q"" z', '', 'w"', '"""",""""""', 'a"b","c', 'd",e', 'q""r,s']
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n", newline="")
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "a.csv")).collect()
    for size in (9, 1 << 20):
        small_ranges(size)
        got = read_csv(spark, str(tmp_path / "a.csv"), index="at").orderBy("at").drop("at").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_a_file_without_an_end(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('a,b\n1,"never closed\nx,y\n2,3')
    small_ranges(6)
    got = read_csv(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("1", "never closed\nx,y\n2,3")]


def test_headers(spark, tmp_path):
    assert header_names(' A ,"b\nc",,a', ",") == ["A0", "b\nc", "_c2", "a3"] and header_names("", ",") == []
    (tmp_path / "a.csv").write_text("")
    assert read_csv(spark, str(tmp_path)).collect() == []
    (tmp_path / "b.csv").write_text(BOM + '"Company","row_index"\n"x",7\n')
    (tmp_path / "c.csv").write_text("\n\nCompany,row_index\n")
    rows = read_csv(spark, str(tmp_path), index="_row")
    assert rows.columns == ["_row", "Company", "row_index"] and [tuple(r) for r in rows.collect()] == [(0, "x", "7")]
    heads = csv_records(spark, str(tmp_path)).filter(F.col("number") == 0).collect()
    assert {r.row_index for r in heads} == {-1} and len(heads) == 2
