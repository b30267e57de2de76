"""Detection of the input's mode and of the line format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Bytes looked at, lines looked at, and the share of lines that decides.
HEAD, NDJSON_LINES, SHARE = 4096, 200, 0.8


def ndjson_share(head: Column) -> Column:
    """Share of the first non-blank lines of a head that begin with an opening brace; null without any."""
    lines = F.slice(F.filter(F.split(head, "\n", -1), lambda x: ~T.is_blank(x)), 1, NDJSON_LINES)
    return F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^[ \t\n\f\r]*\{")))) / F.when(F.size(lines) > 0, F.size(lines))


def head_of(text: Column) -> Column:
    """The first HEAD bytes of a text; a character that is cut goes."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, HEAD).cast("string"))
    return F.when(F.octet_length(text) > HEAD, F.regexp_replace(cut, "\ufffd+\\z", "")).otherwise(text)


def probe_mode(head: Column, override: str | None = None) -> Column:
    """json_document, ndjson_log or log, from the first bytes of an input (head_of)."""
    if override:
        return F.lit(override)
    head = F.regexp_replace(head, "^\ufeff", "")
    return F.when(F.regexp_like(head, F.lit(r"^[ \t\n\f\r]*[{\[]")), "json_document").when(ndjson_share(head) >= SHARE, "ndjson_log").otherwise("log")


def format_shares(lines: DataFrame, by: list[str], line: str = "line", compat: bool = False) -> DataFrame:
    """Shares of non-blank lines in each format, one aggregate for all, and the first format that reaches the share."""
    tests = {"json": T.is_json(line), "logfmt": T.is_logfmt(line, compat), "common_log": T.is_common_log(line), "syslog": T.is_syslog(line)}
    shares = lines.filter(~T.is_blank(line)).groupBy(*by).agg(*[F.avg(t.cast("int")).alias(k) for k, t in tests.items()])
    choice = F.lit("raw")
    for k in reversed(tests):
        choice = F.when(F.col(k) >= SHARE, k).otherwise(choice)
    return shares.withColumn("format", choice)


def first_lines(lines: DataFrame, sample: int = 1000, line: str = "line") -> DataFrame:
    """The first non-empty lines of each file, which its format is judged by."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return lines.filter(F.col(line) != "").withColumn("rank", rank).filter(F.col("rank") <= sample)


def detect_format(lines: DataFrame, sample: int = 1000, line: str = "line") -> str:
    """The format of one input, from its first non-empty lines."""
    row = format_shares(first_lines(lines, sample, line), [], line).first()
    return row["format"] if row else "raw"


def formats(lines: DataFrame, sample: int = 1000, line: str = "line") -> DataFrame:
    """`file, format` of files that have a line."""
    return format_shares(first_lines(lines, sample, line), ["file"], line).select("file", "format")
