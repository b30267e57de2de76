"""Parsing of structured lines into level, time, message and fields.

Fields are arrays of (key, value) in the order of the line, duplicates kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Keys of JSON and logfmt lines that hold the level, the message and the time; names of syslog severities.
LEVEL_KEYS, MESSAGE_KEYS, TIME_KEYS = ["level", "severity", "lvl"], ["msg", "message"], ["ts", "time", "timestamp"]
SEVERITIES = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]
COMMON_FIELDS = r'^(\S+)[ \t]+(\S+)[ \t]+(\S+)[ \t]+\[([0-9A-Za-z_:/]+[ \t][+\-][0-9]{4})\][ \t]+"(.+?)"[ \t]+([0-9]{3})[ \t]+([0-9]+|-)\z'
SYSLOG_FIELDS = r"^<([0-9]{1,3})>([0-9]{0,2}) ?([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) (-|\[[^\]]*\]) ?(.*)\z"
HEURISTIC = r"^(?:([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+Z?)[ \t]+)?(?:\[?([A-Za-z]+)\]?[ \t]+)?(.*)\z"


def _first(value, keys: list[str]) -> Column:  # noqa: ANN001
    return F.coalesce(*[value(k) for k in keys])


def json_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Level, message and time of objects, and all scalar members as fields by key; other lines stay raw."""
    v = F.try_parse_json(F.col(line))
    out = df.withColumn("_v", v)
    get = lambda k: F.try_variant_get("_v", f"$.{k}", "string")
    members = F.map_entries(F.coalesce(F.try_variant_get("_v", "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)")))
    scalars = F.filter(F.transform(members, lambda e: F.struct(e["key"].alias("key"), e["value"].try_cast("string").alias("value"))), lambda e: e["value"].isNotNull())
    return out.withColumns({"level": T.level(_first(get, LEVEL_KEYS)), "message": F.coalesce(_first(get, MESSAGE_KEYS), F.col(line)), "ts_text": _first(get, TIME_KEYS), "fields": F.array_sort(scalars), "was_raw": F.col("_v").isNull()}).drop("_v")


def logfmt(df: DataFrame, line: str = "line") -> DataFrame:
    """Pairs key=value, the value perhaps in quotes."""
    pairs = F.regexp_extract_all(F.col(line), F.lit('([^ \\t="]+)=("[^"]*"|[^ \\t"]*)'), F.lit(0))
    split = lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(F.expr("substring(p, instr(p, '=') + 1)") if isinstance(p, str) else F.substring(p, F.instr(p, "=") + 1, F.length(p)), '^"|"$', "").alias("value"))
    out = df.withColumn("fields", F.transform(pairs, split))
    by = F.map_from_entries(F.array_distinct(F.transform("fields", lambda f: F.struct(f["key"], F.filter("fields", lambda g: g["key"] == f["key"])[0]["value"]))))
    out = out.withColumn("_by", by)
    get = lambda k: F.try_element_at("_by", F.lit(k))
    return out.withColumns({"level": T.level(_first(get, LEVEL_KEYS)), "message": F.coalesce(_first(get, MESSAGE_KEYS), F.col(line)), "ts_text": _first(get, TIME_KEYS), "was_raw": F.size("fields") == 0}).drop("_by")


def common_log(df: DataFrame, line: str = "line") -> DataFrame:
    part = lambda i: F.nullif(F.regexp_extract(line, COMMON_FIELDS, i), F.lit(""))
    ts = F.try_to_timestamp(part(4), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return df.withColumns({"host": part(1), "ident": part(2), "user": part(3), "ts": ts, "request": part(5), "status": part(6).cast("int"), "bytes": part(7).try_cast("long"), "message": F.coalesce(part(5), F.col(line)), "was_raw": part(1).isNull()})


def syslog(df: DataFrame, line: str = "line") -> DataFrame:
    """Priority split into facility and severity, and the header of RFC 5424."""
    part = lambda i: F.nullif(F.regexp_extract(line, SYSLOG_FIELDS, i), F.lit(""))
    pri = part(1).cast("int")
    ok = T.is_syslog(line) & pri.isNotNull()
    cols = {"facility": F.floor(pri / 8).cast("int"), "severity": F.get(F.array(*map(F.lit, SEVERITIES)), pri % 8), "ts_text": part(3), "host": part(4), "app": part(5), "procid": part(6), "msgid": part(7), "message": part(9)}
    return df.withColumns({k: F.when(ok, v) for k, v in cols.items()}).withColumn("was_raw", ~ok)


def heuristic(df: DataFrame, line: str = "line") -> DataFrame:
    """A leading time and level, key=value words as fields, the rest as message."""
    part = lambda i: F.regexp_extract(line, HEURISTIC, i)
    word = part(2)
    known = T.level(word)
    rest = F.when(known.isNull() & (word != ""), F.concat(word, F.lit(" "), part(3))).otherwise(part(3))
    pairs = F.filter(T.tokens(rest), lambda t: F.regexp_like(t, F.lit("^[A-Za-z_][A-Za-z0-9_.]*=.+")))
    fields = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("value")))
    return df.withColumns({"ts_text": F.nullif(part(1), F.lit("")), "level": known, "fields": fields, "message": F.array_join(F.filter(T.tokens(rest), lambda t: ~F.regexp_like(t, F.lit("^[A-Za-z_][A-Za-z0-9_.]*=.+"))), " ")})


PARSERS = {"json": json_lines, "logfmt": logfmt, "common_log": common_log, "syslog": syslog}


def parse(df: DataFrame, format: str, line: str = "line") -> DataFrame:
    """Dispatch on a detected format; raw lines are their own message."""
    return PARSERS[format](df, line) if format in PARSERS else df.withColumns({"message": F.col(line), "was_raw": F.lit(True)})
