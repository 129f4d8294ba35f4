"""CSV and pasted text in, spreadsheet-ready CSV out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions.text import blank_to_null, or_blank, strip
from leadflow.sources.csv_records import BOM, read_csv


def read_header_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Header CSV as strings; quoted line breaks allowed, a byte order mark is ignored."""
    return read_csv(spark, path, sep)


def csv_company_rows(
    spark: SparkSession,
    path: str,
    company_col: str,
    location_col: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Company rows of an uploaded CSV: (row_index, company_name, location).

    The index counts skipped rows too; ``max_rows`` keeps the first ones only.
    """
    raw = read_csv(spark, path, index="_row")
    location = F.lit(None).cast("string")
    if location_col and location_col in raw.columns:
        location = blank_to_null(strip(location_col))
    rows = (
        raw.select(F.col("_row").alias("row_index"), strip(or_blank(company_col)).alias("company_name"), location.alias("location"))
        .filter(F.col("company_name") != "")
    )
    return rows if max_rows is None else rows.orderBy("row_index").limit(max_rows)


def paste_delimiter(header_line: str) -> str:
    """Tab when the header has at least as many tabs as commas."""
    return "\t" if header_line.count("\t") >= header_line.count(",") else ","


def paste_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of pasted text kept in ``path``: delimiter by the first line, header row, no blank lines."""
    first = spark.read.text(path).filter(strip("value") != "").limit(1).collect()
    header = first[0]["value"].lstrip(BOM).strip() if first else ""
    return read_header_csv(spark, path, paste_delimiter(header))


def csv_line(columns: Sequence[str]) -> Column:
    """Cells as one CSV line: quoted where they hold a comma, a quote or a line break, otherwise as they are."""
    def cell(name: str) -> Column:
        value = or_blank(F.col(f"`{name}`").cast("string"))
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(value.rlike('[",\\r\\n]'), quoted).otherwise(value)

    return F.concat_ws(",", *[cell(c) for c in columns])


def csv_sink(
    df: DataFrame, path: str, order: Sequence[str] = ("row_index", "contact_no"), single_file: bool = False
) -> None:
    """Write UTF-8 CSV with a byte order mark, header and CRLF line ends, in row order.

    The columns of ``order`` that the table has sort the lines and are left out. Cells keep their bytes, line
    breaks inside them too. Each part file is complete with its header; ``single_file`` merges them for a
    hand-out of modest size.
    """
    order = [c for c in order if c in df.columns]
    columns = [c for c in df.columns if c not in order]
    header = BOM + ",".join(columns)
    if df.isEmpty():
        lines = df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1)
    else:
        ordered = df.orderBy(*order) if order else df
        if single_file:
            ordered = ordered.coalesce(1)
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its part file
        line = csv_line(columns)
        lines = ordered.select(F.when(first, F.concat(F.lit(header + "\r\n"), line)).otherwise(line).alias("value"))
    lines.write.mode("error").option("lineSep", "\r\n").text(path)
