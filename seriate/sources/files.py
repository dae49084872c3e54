"""CSV files of declared columns, also with vector cells, and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def time_of_day(text: Column) -> Column:
    """Microseconds of the day of ``hh:mm:ss[:fraction]`` or ``hh:mm:ss[.fraction]``; the fraction after a colon counts milliseconds. Null if malformed."""
    m = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2}):([0-5]\d):([0-5]\d)(?:([:.])(\d{1,6}))?\s*$", i)
    whole = (m(1).try_cast("int") * 3600 + m(2).try_cast("int") * 60 + m(3).try_cast("int")).cast("long") * 1_000_000
    part = F.when(m(4) == ":", m(5).try_cast("long") * 1000).when(m(4) == ".", F.rpad(m(5), 6, "0").try_cast("long")).otherwise(0)
    return F.when(m(1).try_cast("int") < 24, whole + part)


def timestamp_text(text: Column) -> Column:
    """A timestamp without zone of ``yyyy-mm-dd hh:mm:ss[:ms]``; a fraction after a point is accepted too. Null if malformed."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"(\d{2}:\d{2}:\d{2}):(\d{1,3})$", "$1.$2")).cast("timestamp_ntz")


def parse_cell(text: Column, declared: str, kind: T.DataType) -> Column:
    """A cell of a file as a value of its column; empty or malformed cells become null."""
    text = F.trim(text, F.lit(" \t\r"))
    name = declared.lower()
    if name in ("time", "timetz"):
        return time_of_day(text)
    if isinstance(kind, T.TimestampNTZType):
        return timestamp_text(text)
    if isinstance(kind, T.StringType):
        return text
    return F.when(text != "", text.try_cast(kind))


def _element(kind: T.DataType):
    return lambda x: F.trim(x, F.lit(" \t")).try_cast(kind)


def load_delimited(spark: SparkSession, path: str, columns: list[tuple[str, str]], types: list[T.DataType], sep: str = ",", element_sep: str | None = None, row_ids: bool = False) -> DataFrame:
    """A file or folder of delimited text by position, its header line skipped; blanks around cells are dropped, empty lines ignored.

    With ``element_sep`` cells of vector columns hold several elements. ``row_ids`` adds ``_rowid``, rising in the order of files and lines.
    Lines with fewer cells give nulls; further cells are ignored.
    """
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    raw = spark.read.schema(text).csv(path, header=True, sep=sep, mode="PERMISSIVE", enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    out = []
    for i, ((name, declared), kind) in enumerate(zip(columns, types)):
        cell = F.col(f"c{i}")
        if isinstance(kind, T.ArrayType) and element_sep:
            out.append(F.when(F.trim(cell) != "", F.transform(F.split(cell, f"\\Q{element_sep}\\E"), _element(kind.elementType))).alias(name))
        else:
            out.append(parse_cell(cell, declared, kind).alias(name))
    return raw.select(*out, *([F.monotonically_increasing_id().alias("_rowid")] if row_ids else []))


def load_by_header(spark: SparkSession, path: str, columns: list[tuple[str, str]], types: list[T.DataType], sep: str = ",") -> DataFrame:
    """The declared columns of a delimited file found by the names in its header, whatever their order; further columns are ignored, absent ones are null."""
    raw = spark.read.csv(path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    there = {c.strip().lower(): c for c in raw.columns}
    return raw.select(*[(parse_cell(F.col(f"`{there[n.lower()]}`"), d, k) if n.lower() in there else F.lit(None).cast(k)).alias(n) for (n, d), k in zip(columns, types)])


def write_delimited(df: DataFrame, path: str, sep: str = ",", single_file: bool = False) -> None:
    """Write a result with a header: a folder of part files in the order of the rows. ``single_file`` brings it into one part, for small results."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True, sep=sep)
