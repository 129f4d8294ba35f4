"""Records of CSV files, read by byte ranges: one file by many tasks, cells with line breaks included.

Whether a line begins inside a quoted cell depends on all bytes before it. So each line is first taken as a function:
closed or open at its end, if it began closed, and if it began open. A task goes through the lines of its ranges under
both assumptions and numbers the records that begin there. One row per range then tells, by a running composition over
the ranges of a file, which assumption holds and how many records lie before; lines of a record that spans several are
joined, also over the bounds of ranges.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadflow.functions.workspace import workspace

BOM = "\ufeff"
_LINES = (
    "file string, range bigint, line bigint, value string, before0 boolean, before1 boolean, after0 boolean, after1 boolean, "
    "records0 bigint, records1 bigint"
)


def _cell_start(sep: str) -> str:
    return rf"(^|{re.escape(sep)})\""


def _ends_open(sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell, if it begins outside, and if it begins inside one.

    Two quotes in a row are a quote of a cell or an empty cell, both of which leave things as they are; a quote opens a
    cell only at its start, one elsewhere is a sign like others.
    """
    lone = F.replace("value", F.lit('""'), F.lit(""))

    def opens(text: Column) -> Column:
        return F.regexp_replace(text, _cell_start(sep) + '[^"]*"', "$1x").rlike(_cell_start(sep))

    quoted = F.contains("value", F.lit('"'))
    closed = F.when(quoted, opens(lone)).otherwise(False)
    inside = F.when(F.contains(lone, F.lit('"')), opens(F.regexp_replace(lone, '^[^"]*"', "x"))).otherwise(True)
    return closed, inside


def _line_ends_open(line: str, sep: str) -> tuple[bool, bool]:
    """The same for one line, which lost a byte order mark."""
    lone, start = line.replace('""', ""), _cell_start(sep)
    opens = lambda text: re.search(start, re.sub(start + '[^"]*"', r"\1x", text)) is not None
    return opens(lone), opens(re.sub('^[^"]*"', "x", lone)) if '"' in lone else True


def _walked(begin: bool, closed: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Whether each line ends open, if the first one begins so: functions of two values, composed."""
    fixed, flips = closed == inside, np.cumsum(closed & ~inside)
    at = np.maximum.accumulate(np.where(fixed, np.arange(len(closed)), -1))
    odd = ((flips - np.where(at >= 0, flips[at], 0)) & 1).astype(bool)
    return np.where(at >= 0, closed[at], begin) ^ odd


class _Range:
    """What is known of a byte range while its lines pass."""

    def __init__(self):
        self.line, self.open, self.records = 0, [False, True], [0, 0]

    def take(self, closed: np.ndarray, inside: np.ndarray, blank: np.ndarray) -> list[np.ndarray]:
        out = []
        for begin in (0, 1):
            after = _walked(self.open[begin], closed, inside)
            before = np.append(self.open[begin], after[:-1])
            records = self.records[begin] + np.cumsum(~before & ~blank)
            self.open[begin], self.records[begin] = bool(after[-1]), int(records[-1])
            out.append((before, after, records))
        line = self.line + np.arange(len(closed))
        self.line += len(closed)
        (b0, a0, r0), (b1, a1, r1) = out
        return [line, b0, b1, a0, a1, r0, r1]


def _scanned(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            file, start = batch.column(0), batch.column(1).to_numpy()
            values = batch.column(2)
            closed, inside, blank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            change = np.flatnonzero(start[1:] != start[:-1]) + 1
            # two ranges in a row may begin at the same place of two files
            names = file.dictionary_encode().indices.to_numpy()
            bounds = np.union1d(change, np.flatnonzero(names[1:] != names[:-1]) + 1)
            for a, b in zip([0, *bounds], [*bounds, len(batch)], strict=True):
                a, b = int(a), int(b)
                key, part = (file[a].as_py(), int(start[a])), values.slice(a, b - a)
                c, i, e = closed[a:b].copy(), inside[a:b].copy(), blank[a:b].copy()
                if key != current:
                    current, state = key, _Range()
                    first = part[0].as_py()
                    if key[1] == 0 and first.startswith(BOM):
                        first = first.removeprefix(BOM)
                        part = pa.concat_arrays([pa.array([first], part.type), part.slice(1)])
                        (c[0], i[0]), e[0] = _line_ends_open(first, sep), first in ("", "\r")
                line, b0, b1, a0, a1, r0, r1 = map(pa.array, state.take(c, i, e))
                yield pa.RecordBatch.from_arrays(
                    [file.slice(a, b - a), batch.column(1).slice(a, b - a), line, part, b0, b1, a0, a1, r0, r1],
                    names=["file", "range", "line", "value", "before0", "before1", "after0", "after1", "records0", "records1"],
                )

    return run


def _ranges(lines: DataFrame) -> DataFrame:
    """One row per byte range: whether it begins open, and the records before it, in its file and in all of them."""
    last = F.max_by(F.struct("after0", "after1"), "line").alias("after")
    ranges = lines.groupBy("file", "range").agg(last, F.max("records0").alias("records0"), F.max("records1").alias("records1"))
    ranges = ranges.select("file", "range", "after.*", "records0", "records1")
    by_file = Window.partitionBy("file").orderBy("range")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    flip = (F.col("after0") & ~F.col("after1")).cast("int")
    ranges = ranges.withColumn("flips", F.sum(flip).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("after0") == F.col("after1"), F.struct("after0", "flips"))
    ranges = ranges.withColumns({"fixed": F.last(fixed, ignorenulls=True).over(earlier), "turned": F.coalesce(F.lag("flips").over(by_file), F.lit(0))})
    odd = (F.col("turned") - F.coalesce("fixed.flips", F.lit(0))) % 2 == 1
    ranges = ranges.withColumn("open", F.coalesce("fixed.after0", F.lit(False)) != odd)
    ranges = ranges.withColumn("records", F.when(F.col("open"), F.col("records1")).otherwise(F.col("records0")))
    ranges = ranges.withColumn("base", F.coalesce(F.sum("records").over(earlier), F.lit(0)))
    files = ranges.groupBy("file").agg(F.greatest(F.sum("records") - 1, F.lit(0)).alias("rows"))  # without the header
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select(F.col("file").alias("_file"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    return ranges.join(files, F.col("file") == F.col("_file")).select(
        F.col("file").alias("_file"), F.col("range").alias("_range"), "open", "base", "rows_before"
    )


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, number, row_index, record): the whole text of each record, numbered from 0 in its file.

    Number 0 is a file's header. ``row_index`` numbers the others over all files, by file name and place, header records
    left out (-1). Lines end with a line feed, a carriage return before it is not kept at a record's end; bytes in cells
    stay as they are. Blank lines between records count for nothing. A byte order mark is left out. A cell that is never
    closed reaches to the end of its file.

    Files that can be split are read by many tasks; their lines are written once to the shared folder.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    closed, inside = _ends_open(sep)
    seen = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value", closed.alias("closed"),
        inside.alias("inside"), F.col("value").isin("", "\r").alias("blank"),
    )
    stored = workspace(spark, "csv-lines")
    seen.mapInArrow(_scanned(sep), _LINES).write.parquet(stored)
    lines = spark.read.parquet(stored)
    placed = lines.join(_ranges(lines), (F.col("file") == F.col("_file")) & (F.col("range") == F.col("_range")))
    pick = lambda name: F.when(F.col("open"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    placed = placed.select(
        "file", "range", "line", "value", "rows_before", pick("before").alias("before"), pick("after").alias("after"),
        (F.col("base") + pick("records") - 1).alias("number"),
    ).filter(F.col("before") | ~F.col("value").isin("", "\r"))
    alone = placed.filter(~F.col("before") & ~F.col("after")).select("file", "number", "rows_before", F.col("value").alias("text"))
    several = placed.filter(F.col("before") | F.col("after")).groupBy("file", "number").agg(
        F.first("rows_before").alias("rows_before"), F.sort_array(F.collect_list(F.struct("range", "line", "value"))).alias("parts")
    )
    joined = several.select("file", "number", "rows_before", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("text"))
    return alone.unionByName(joined).select(
        "file", "number", F.when(F.col("number") == 0, -1).otherwise(F.col("rows_before") + F.col("number") - 1).alias("row_index"),
        F.regexp_replace("text", r"\r\z", "").alias("record"),
    )


def header_names(record: str, sep: str) -> list[str]:
    """Column names of a header record: trimmed; blank or repeated ones get their place."""
    cells = [c.strip() for c in next(csv.reader(io.StringIO(record, newline=""), delimiter=sep), [])]
    folded = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if folded.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_csv(spark: SparkSession, path: str, sep: str = ",", index: str | None = None) -> DataFrame:
    """Header CSV as strings, empty cells null; ``index`` names a column of row numbers over all files."""
    records = csv_records(spark, path, sep)
    heads = records.filter("number = 0").orderBy("file").limit(1).select("record").collect()
    names = header_names(heads[0]["record"], sep) if heads else []
    if not names:
        return spark.createDataFrame([], f"`{index}` bigint" if index else "_c0 string")
    schema = ", ".join(f"_{i} string" for i in range(len(names)))
    cells = F.from_csv("record", schema, {"sep": sep, "escape": '"'})
    rows = records.filter("number > 0").select("row_index", cells.alias("cells"))
    columns = [F.col(f"cells._{i}").alias(name) for i, name in enumerate(names)]
    return rows.select(*([F.col("row_index").alias(index)] if index else []), *columns)
