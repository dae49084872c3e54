"""Delimited lines that may fail to parse: valid lines become typed rows, the others come out with the reason.

One anchored pattern per schema recognises a valid line as a whole. Only lines that fail it meet further patterns: one that
consumes the line field by field (quoting), a count of fields, and prefix patterns of 1, 2, ... fields that name the first broken one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[ \t]*+"


@dataclass(frozen=True)
class Field:
    """A column of the lines: ``pattern`` is what its value must match once blanks and quotes are gone, ``kind`` the Spark type."""

    name: str
    pattern: str
    kind: str
    nullable: bool = True
    format: str | None = None


def int_range(low: int, high: int) -> str:
    """A pattern of the whole numbers from ``low`` to ``high`` in digits, leading zeros allowed."""
    return "0*(?:" + "|".join(map(str, range(high, low - 1, -1))) + ")"


def timestamp_pattern() -> str:
    """A pattern of ``m/d/yyyy h:mm`` that accepts only dates that exist."""
    year = r"(?!0000)[0-9]{4}"
    leap = r"(?!0000)(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
    day28, months = r"(?:0?[1-9]|1[0-9]|2[0-8])", r"(?:0?[1-9]|1[0-2])"
    date = rf"(?:{months}/{day28}/{year}|(?:0?[13-9]|1[0-2])/(?:29|30)/{year}|(?:0?[13578]|1[02])/31/{year}|0?2/29/{leap})"
    return rf"{date} (?:[01]?[0-9]|2[0-3]):[0-5][0-9]"


WHOLE, AMOUNT = r"[0-9]+", r"-?[0-9]+(?:\.[0-9]+)?"

#: A field of any content: in quotes, with doubled quotes inside, or without a quote.
ANY_FIELD = rf'(?:{BLANK}"[^"]*+(?:""[^"]*+)*+"{BLANK}|(?!{BLANK}")[^",]*+)'
#: One well-formed field and the comma after it, from where the last match ended.
STEP = rf"\G{ANY_FIELD},"


def field_pattern(f: Field) -> str:
    """The pattern of one field as it stands in a line: bare or quoted, with blanks outside and inside the quotes."""
    value = rf"(?:{f.pattern})"
    inner = rf"(?:{BLANK}{value}{BLANK})" if not f.nullable else rf"{BLANK}(?:{value}{BLANK})?+"
    return rf'(?:{BLANK}"{inner}"{BLANK}|{inner})'


def line_pattern(fields: list[Field], upto: int | None = None) -> str:
    """Anchored pattern of a whole line, or of its first ``upto`` fields."""
    parts = [field_pattern(f) for f in fields[:upto]]
    return r"\A" + ",".join(parts) + (r"\z" if upto is None or upto == len(fields) else ",")


def _line(col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"\r\z", "")


def check_lines(df: DataFrame, line_col: str, fields: list[Field]) -> DataFrame:
    """``df`` with ``__line`` (without a carriage return at its end), ``__reason`` and ``__field``.

    ``__reason`` is null for a valid line, else the first of ``quoting``, ``column_count`` and ``value`` that applies; ``__field``
    is, for ``value``, the name of the first broken field. A null line is taken as an empty one, which has one empty field.
    Lines of any length are handled: no pattern recurses per character or per field.
    """
    line = F.col("__line")
    valid = line.rlike(line_pattern(fields))
    # One more comma makes the last field end like the others; what the steps leave begins with a broken quote.
    ended = F.concat(line, F.lit(","))
    quoting = F.length(F.regexp_replace(ended, STEP, "")) > 0
    count = F.regexp_count(ended, F.lit(STEP))
    broken = F.lit(fields[-1].name)
    for i in range(len(fields) - 1, 0, -1):
        broken = F.when(~line.rlike(line_pattern(fields, i)), F.lit(fields[i - 1].name)).otherwise(broken)
    reason = (
        F.when(valid, F.lit(None).cast("string"))
        .when(quoting, F.lit("quoting"))
        .when(count != len(fields), F.lit("column_count"))
        .otherwise(F.lit("value"))
    )
    out = df.withColumn("__line", _line(line_col)).withColumn("__reason", reason)
    return out.withColumn("__field", F.when(F.col("__reason") == "value", broken))


def rejected_lines(df: DataFrame, line_col: str, fields: list[Field]) -> DataFrame:
    """The lines that are not valid, with the columns of ``df``, ``reason`` and ``broken_field``."""
    bad = check_lines(df, line_col, fields).where(F.col("__reason").isNotNull())
    keep = [c for c in df.columns if c not in ("reason", "broken_field")]
    return bad.select(*keep, F.col("__reason").alias("reason"), F.col("__field").alias("broken_field"))


def typed_rows(df: DataFrame, line_col: str, fields: list[Field], keep: list[str], lost: str = "out_of_range") -> DataFrame:
    """The valid lines as typed rows: the columns ``keep`` of ``df``, then one column per field; empty fields are null.

    A whole number beyond the range of its type, though well-formed, has no value there and becomes null; column ``lost`` names such fields
    (with commas between them; null if there are none).
    """
    line = F.regexp_replace(F.coalesce(F.col(line_col), F.lit("")), r"\r\z", "")
    good = df.withColumn("__line", line).where(F.col("__line").rlike(line_pattern(fields)))
    # A valid line has no comma and no doubled quote inside a field: splitting at commas is exact.
    parts = good.withColumn("__parts", F.split("__line", ","))
    out, gone = [], []
    for i, f in enumerate(fields):
        text = F.regexp_replace(F.col("__parts")[i], r'^[ \t"]+|[ \t"]+$', "")
        text = F.when(text == "", None).otherwise(text)
        if f.kind == "timestamp_ntz":
            value = F.try_to_timestamp(text, F.lit(f.format)).cast("timestamp_ntz")
        else:
            value = text.try_cast(f.kind)
        out.append(value.alias(f.name))
        if f.kind == "int":
            gone.append(F.when(text.isNotNull() & value.isNull(), F.lit(f.name)))
    return parts.select(*keep, *out, F.nullif(F.concat_ws(",", *gone), F.lit("")).alias(lost))


def trip_fields() -> list[Field]:
    """The fields of a taxi trip line."""
    when, place = timestamp_pattern(), int_range(1, 265)
    whole = lambda n, p, **k: Field(n, p, "int", **k)
    amounts = ["fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "total_amount"]
    return [
        whole("VendorID", int_range(1, 2), nullable=False),
        Field("tpep_pickup_datetime", when, "timestamp_ntz", False, "M/d/yyyy H:mm"),
        Field("tpep_dropoff_datetime", when, "timestamp_ntz", True, "M/d/yyyy H:mm"),
        whole("passenger_count", WHOLE),
        Field("trip_distance", AMOUNT, "double"),
        whole("RatecodeID", "0*(?:[1-6]|99)"),
        Field("store_and_fwd_flag", "[YN]", "string"),
        whole("PULocationID", place),
        whole("DOLocationID", place),
        whole("payment_type", int_range(1, 6)),
        *[Field(a, AMOUNT, "double") for a in amounts],
    ]
