"""One query for each operator, over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import detect, drain, fold, jsondoc, parse, render, score
from ..session import folder
from ..sources import corpora as C
from ..sources import dictionary as D
from ..sources import lines as L
from ..sources import state as S
from ..streaming import batches
from .condense import Options, condense, condense_json, entries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


B = r"[ \t\n\f\r]"
DOC, CHAT, PAGE = (C.lines_sql(x) for x in ("doc", "chat", "page"))
TOK = f"list_filter(string_split_regex(message, '{B}+'), lambda t: t <> '')"
BLANK = f"regexp_full_match(line, '{B}*')"
INDENT = f"(length(line) - length(regexp_replace(line, '^{B}+', '')))"
CLF = r"""regexp_matches(line, '^\S+[ \t]+\S+[ \t]+\S+[ \t]+\[[0-9A-Za-z_:/]+[ \t][+\-][0-9]{4}\][ \t]+".+?"[ \t]+[0-9]{3}[ \t]+([0-9]+|-)$')"""
PAIR = r"""regexp_matches(line, '(^|[ \t])[^ \t="]+=("[^"]*"|[^ \t"]+)')"""
SYS = "(regexp_extract(line, '^<([0-9]{1,3})>', 1) <> '' AND coalesce(try_cast(regexp_extract(line, '^<([0-9]{1,3})>', 1) AS INT), 999) <= 191)"
WORDS = "[" + ", ".join(f"'{w}'" for w in T.LEVEL_WORDS) + "]"
LEVEL = lambda x: "CASE " + " ".join(f"WHEN {x} IN ({', '.join(repr(w) for w in ws)}) THEN '{n}'" for n, ws in T.LEVELS.items()) + " END"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.events(spark, sf_dir, C.MIXED, "line")


MIXED = C.events_sql(C.MIXED, "line")

# ---- sources -------------------------------------------------------------------------------------------------


@query(f"SELECT file, line_no, line FROM {PAGE}")
def line_scan(spark, sf):  # noqa: ANN001, ANN201
    return C.lines(spark, sf, "page")


@query(f"SELECT file, line_no, line FROM {DOC} WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no) <= 3")
def first_nonempty(spark, sf):  # noqa: ANN001, ANN201
    return L.first_nonempty(C.lines(spark, sf, "doc"), 3).drop("rank")


def _written(compression: str) -> Callable[[SparkSession, str], DataFrame]:
    """Event lines, a file for each kind, read back with their numbers."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = folder(spark, compression)
        rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type AS kind", "event_id", f"{C.EVENT} AS line")
        rows.repartition("kind").sortWithinPartitions("kind", "event_id").select("kind", "line").write.option("compression", compression).partitionBy("kind").text(path)
        out = L.read_lines(spark, f"{path}/*/*")
        return out.select(F.regexp_extract("file", "kind=([^/]*)", 1).alias("kind"), "line_no", "line")

    return run


_FILES = f"SELECT event_type AS kind, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS line_no, {C.EVENT} AS line FROM events"
for _name, _compression in (("read_text", "none"), ("read_gzip", "gzip"), ("read_bzip2", "bzip2")):
    _run = _written(_compression)
    _run.__name__ = _name
    query(_FILES)(_run)


@query("""SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '","none":null}' AS line FROM events""")
def sink_ndjson(spark, sf):  # noqa: ANN001, ANN201
    path = folder(spark, "ndjson")
    L.write_ndjson(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", F.lit(None).cast("string").alias("none")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"SELECT event_id AS record_id, {C.EVENT} AS line FROM events")
def dictionary_roundtrip(spark, sf):  # noqa: ANN001, ANN201
    """Lines packed with a dictionary that was trained on them, and unpacked again."""
    rows = C.events(spark, sf, C.EVENT, "line")
    made = D.train(rows)
    packed = rows.select("record_id", D.pack(F.col("line"), made, rows).alias("packed"))
    return packed.select("record_id", D.unpack(F.col("packed"), made, rows).alias("line"))


# ---- detection -----------------------------------------------------------------------------------------------

_HEADS = "(SELECT 'doc' AS kind, doc_id AS id, CASE WHEN strlen(text) <= 4096 THEN text ELSE left(text, len(list_filter(range(1, 4097), lambda i: strlen(left(text, i)) <= 4096))) END AS head FROM documents UNION ALL SELECT 'props', event_id, props FROM events)"
_BRACE = rf"regexp_matches(x, '^{B}*\{{')"
_SHARE = f"(SELECT kind, id, head, list_filter(string_split(head, chr(10)), lambda x: NOT regexp_full_match(x, '{B}*'))[1:200] AS l FROM {_HEADS})"


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), detect.head_of(F.col("text")).alias("head"))
    return docs.unionByName(spark.read.parquet(f"{sf}/events.parquet").select(F.lit("props").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("head")))


@query(f"SELECT kind, id, CASE WHEN regexp_matches(head, '^{B}*[{{\\[]') THEN 'json_document' WHEN len(l) > 0 AND len(list_filter(l, lambda x: {_BRACE})) / len(l) >= 0.8 THEN 'ndjson_log' ELSE 'log' END AS mode FROM {_SHARE}")
def probe_mode(spark, sf):  # noqa: ANN001, ANN201
    return _heads(spark, sf).select("kind", "id", detect.probe_mode(F.col("head")).alias("mode"))


@query(f"SELECT kind, id, round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: {_BRACE})) / len(l) END, 6) AS share FROM {_SHARE}")
def ndjson_ratio(spark, sf):  # noqa: ANN001, ANN201
    return _heads(spark, sf).select("kind", "id", F.round(detect.ndjson_share(F.col("head")), 6).alias("share"))


_FORMATS = {"clf": C.COMMON_LOG, "syslog": C.SYSLOG, "logfmt": C.LOGFMT, "ndjson": C.NDJSON, "raw": C.HEURISTIC, "mixed": C.MIXED}


@query(f"""SELECT *, CASE WHEN json >= 0.8 THEN 'json' WHEN logfmt >= 0.8 THEN 'logfmt' WHEN common_log >= 0.8 THEN 'common_log' WHEN syslog >= 0.8 THEN 'syslog' ELSE 'raw' END AS format FROM (
    SELECT corpus, round(avg(CAST(json_valid(line) AS INT)), 6) AS json, round(avg(CAST({PAIR} AS INT)), 6) AS logfmt, round(avg(CAST({CLF} AS INT)), 6) AS common_log, round(avg(CAST({SYS} AS INT)), 6) AS syslog
    FROM ({" UNION ALL ".join(f"SELECT '{k}' AS corpus, {v} AS line FROM events" for k, v in _FORMATS.items())}) WHERE NOT {BLANK} GROUP BY corpus)""")
def format_detect(spark, sf):  # noqa: ANN001, ANN201
    ev = spark.read.parquet(f"{sf}/events.parquet")
    rows = ev.selectExpr(f"inline(array({', '.join(f'struct({k!r} AS corpus, {v} AS line)' for k, v in _FORMATS.items())}))")
    out = detect.format_shares(rows, ["corpus"])
    return out.select("corpus", *[F.round(c, 6).alias(c) for c in ("json", "logfmt", "common_log", "syslog")], "format")


def _predicate(name: str, sql: str, test: Callable[[str], F.Column]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return mixed(spark, sf).select("record_id", test("line").alias("hit"))

    run.__name__ = name
    query(f"SELECT record_id, {sql} AS hit FROM {MIXED}")(run)


_predicate("json_line", "json_valid(line)", T.is_json)
_predicate("logfmt_line", PAIR, T.is_logfmt)
_predicate("logfmt_line_compat", "false", lambda c: T.is_logfmt(c, compat=True))
_predicate("clf_line", CLF, T.is_common_log)
_predicate("syslog_line", SYS, T.is_syslog)
_predicate("ts_prefix", "regexp_matches(line, '^[0-9]{4}[-/T.]')", T.has_time_prefix)
_predicate("level_keyword", f"list_has_any({TOK.replace('message', 'line')}, {WORDS})", T.has_level)


@query(f"SELECT file, line_no, {BLANK} AS hit FROM {CHAT}")
def blank_line(spark, sf):  # noqa: ANN001, ANN201
    return C.lines(spark, sf, "chat").select("file", "line_no", T.is_blank("line").alias("hit"))


@query(f"SELECT word, {LEVEL('word')} AS level, CASE {LEVEL('word')} " + " ".join(f"WHEN '{n}' THEN {i + 1}" for i, n in enumerate(T.LEVELS)) + f" ELSE NULL END AS rank, n FROM (SELECT unnest({TOK.replace('message', 'line')}) AS word, count(*) AS n FROM {MIXED} GROUP BY 1)")
def level_parse(spark, sf):  # noqa: ANN001, ANN201
    words = mixed(spark, sf).select(F.explode(T.tokens("line")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    name = T.level("word")
    return words.select("word", name.alias("level"), F.when(name.isNotNull(), T.level_rank(name)).alias("rank"), "n")


# ---- folding and parsing -------------------------------------------------------------------------------------


def _numbered(lines: str, begins: str) -> str:
    return f"(SELECT *, CAST(sum(CAST(begins AS INT)) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS record_id FROM (SELECT *, CAST(coalesce(sum(strlen(line) + 1) OVER p, 0) AS BIGINT) AS byte_offset, {begins} AS begins FROM {lines} WINDOW w AS (PARTITION BY file ORDER BY line_no), p AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"


_BY_INDENT = f"(row_number() OVER w = 1 OR line = '' OR {INDENT} <= min({INDENT}) OVER p)"
_BY_CHAR = "(row_number() OVER w = 1 OR starts_with(line, 'T'))"
_FOLDED = "SELECT file, record_id, arg_min(line, line_no) AS message, string_agg(line, chr(10) ORDER BY line_no) AS raw_line, CAST(count(*) AS INT) AS n_lines, min(byte_offset) AS byte_offset FROM {} GROUP BY file, record_id"


@query(_FOLDED.format(_numbered(PAGE, _BY_INDENT)))
def fold_indent(spark, sf):  # noqa: ANN001, ANN201
    return fold.fold(C.lines(spark, sf, "page"))


@query(_FOLDED.format(_numbered(DOC, _BY_CHAR)))
def fold_char(spark, sf):  # noqa: ANN001, ANN201
    return fold.fold(C.lines(spark, sf, "doc"), "T")


@query(f"SELECT file, record_id, CAST(count(*) AS BIGINT) AS n FROM {_numbered(CHAT, _BY_INDENT)} GROUP BY file, record_id")
def fold_large_file(spark, sf):  # noqa: ANN001, ANN201
    return fold.number_large(C.lines(spark, sf, "chat"), part_lines=4).groupBy("file", "record_id").agg(F.count("*").alias("n"))


@query(f"SELECT file, line_no, byte_offset FROM {_numbered(DOC, _BY_INDENT)}")
def byte_offset(spark, sf):  # noqa: ANN001, ANN201
    return fold.number_records(C.lines(spark, sf, "doc")).select("file", "line_no", "byte_offset")


@query(f"SELECT CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, count(*) AS lines, CAST(sum(CAST(begins AS INT)) AS BIGINT) AS records, CAST(sum(CAST(begins AS INT)) AS BIGINT) AS unparseable FROM {_numbered(DOC, _BY_INDENT)}")
def run_stats(spark, sf):  # noqa: ANN001, ANN201
    return fold.run_stats(C.lines(spark, sf, "doc"), "syslog")


@query(f"SELECT record_id, {LEVEL('''json_extract_string(line, '$.level')''')} AS level, json_extract_string(line, '$.msg') AS message, json_extract_string(line, '$.host') AS host, json_extract_string(line, '$.port') AS port FROM {C.events_sql(C.NDJSON, 'line')}")
def parse_ndjson(spark, sf):  # noqa: ANN001, ANN201
    rows = parse.json_lines(C.events(spark, sf, C.NDJSON, "line"))
    member = lambda k: F.filter("fields", lambda f: f["key"] == k)[0]["value"]
    return rows.select("record_id", "level", "message", member("host").alias("host"), member("port").alias("port"))


@query(rf"""SELECT record_id, {LEVEL('''regexp_extract(line, 'level=([a-z]+)', 1)''')} AS level, regexp_extract(line, 'msg="([^"]*)"', 1) AS message, '2024-10-10T13:55:00Z' AS ts_text,
    concat('level=', regexp_extract(line, 'level=([a-z]+)', 1), '|msg=', regexp_extract(line, 'msg="([^"]*)"', 1), '|host=', regexp_extract(line, 'host=([^ ]+)', 1), '|port=', regexp_extract(line, 'port=([0-9]+)', 1), '|ts=2024-10-10T13:55:00Z') AS fields FROM {C.events_sql(C.LOGFMT, 'line')}""")
def parse_logfmt(spark, sf):  # noqa: ANN001, ANN201
    rows = parse.logfmt(C.events(spark, sf, C.LOGFMT, "line"))
    return rows.select("record_id", "level", "message", "ts_text", F.array_join(F.transform("fields", lambda f: F.concat(f["key"], F.lit("="), f["value"])), "|").alias("fields"))


@query(f"SELECT record_id, '10.0.0.' || (user_id % 256) AS host, 'user' || (user_id % 256) AS user, CAST(epoch(TIMESTAMP '2024-10-10 13:55:00') AS BIGINT) + 10 + event_id % 50 AS ts, 'GET /' || event_type || '/' || record_id || ' HTTP/1.1' AS request, CAST(200 + record_id % 300 AS INT) AS status, CASE WHEN record_id % 7 <> 0 THEN record_id END AS bytes FROM (SELECT event_id AS record_id, * FROM events)")
def parse_clf(spark, sf):  # noqa: ANN001, ANN201
    return parse.common_log(C.events(spark, sf, C.COMMON_LOG, "line")).select("record_id", "host", "user", F.unix_seconds("ts").alias("ts"), "request", "status", "bytes")


_SEV = "[" + ", ".join(f"'{s}'" for s in parse.SEVERITIES) + "]"


@query(f"SELECT record_id, CASE WHEN p <= 191 THEN CAST(p // 8 AS INT) END AS facility, CASE WHEN p <= 191 THEN {_SEV}[p % 8 + 1] END AS severity, CASE WHEN p <= 191 THEN event_type END AS app, CASE WHEN p <= 191 THEN 'ID' || (record_id % 9) END AS msgid, CASE WHEN p <= 191 THEN event_type || ' by user ' || (user_id % 256) END AS message, p > 191 AS was_raw FROM (SELECT event_id AS record_id, event_id % 200 AS p, * FROM events)")
def parse_syslog(spark, sf):  # noqa: ANN001, ANN201
    return parse.syslog(C.events(spark, sf, C.SYSLOG, "line")).select("record_id", "facility", "severity", "app", "msgid", "message", "was_raw")


@query("SELECT event_id AS record_id, CASE WHEN event_id % 2 = 0 THEN '2024-10-10T13:55:01Z' END AS ts_text, CASE event_id % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' END AS level, CASE WHEN event_id % 4 = 2 THEN 'Notice ' ELSE '' END || 'request ' || event_type || ' done in' AS message, 'user=' || (user_id % 256) || '|k=' || (event_id % 1000) AS fields FROM events")
def parse_heuristic(spark, sf):  # noqa: ANN001, ANN201
    rows = parse.heuristic(C.events(spark, sf, C.HEURISTIC, "line"))
    return rows.select("record_id", "ts_text", "level", "message", F.array_join(F.transform("fields", lambda f: F.concat(f["key"], F.lit("="), f["value"])), "|").alias("fields"))


# ---- scalar functions ----------------------------------------------------------------------------------------

_DOCMSG = f"(SELECT file, line_no, line AS message FROM {DOC})"


@query(f"SELECT file, line_no, array_to_string({TOK}, '|') AS tokens FROM {_DOCMSG}")
def tokenise(spark, sf):  # noqa: ANN001, ANN201
    return C.lines(spark, sf, "doc").select("file", "line_no", F.array_join(T.tokens("line"), "|").alias("tokens"))


@query(f"SELECT file, line_no, CAST(len({TOK}) AS INT) AS words FROM {_DOCMSG}")
def word_count(spark, sf):  # noqa: ANN001, ANN201
    return C.lines(spark, sf, "doc").select("file", "line_no", T.word_count("line").alias("words"))


_NEXT = f"(SELECT record_id, {TOK} AS a, lead({TOK}) OVER (ORDER BY record_id) AS b FROM {C.events_sql(C.EVENT)} QUALIFY b IS NOT NULL)"
_AGREE = "list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] = b[i] THEN a[i] END)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's words and those of the next event, by a join on the number, so that no window holds all events."""
    rows = C.events(spark, sf, C.EVENT).withColumn("a", T.tokens("message"))
    after = rows.select((F.col("record_id") - 1).alias("record_id"), F.col("a").alias("b"))
    return rows.join(after, "record_id")


@query(f"SELECT record_id, round(CASE WHEN len(a) <> len(b) THEN 0.0 ELSE len(list_filter(list_zip(a, b), lambda z: z[1] = z[2])) / len(a) END, 6) AS similarity FROM {_NEXT}")
def similarity(spark, sf):  # noqa: ANN001, ANN201
    return _pairs(spark, sf).select("record_id", F.round(T.similarity("a", "b"), 6).alias("similarity"))


@query(f"SELECT record_id, array_to_string(list_transform({_AGREE}, lambda x: coalesce(x, '*')), ' ') AS pattern, CAST(len(list_filter({_AGREE}, lambda x: x IS NULL)) AS INT) AS wildcards FROM {_NEXT}")
def generalise(spark, sf):  # noqa: ANN001, ANN201
    g = _pairs(spark, sf).select("record_id", T.generalise("a", "b").alias("t"))
    return g.select("record_id", T.render("t").alias("pattern"), T.wildcards("t").alias("wildcards"))


_ID = lambda t: f"('0x' || substr(md5(array_to_string(list_transform({t}, lambda x: coalesce('L' || x, 'W')), ' ')), 1, 15))::BIGINT"


@query(f"SELECT record_id, {_ID(_AGREE)} AS template_id FROM {_NEXT}")
def template_id(spark, sf):  # noqa: ANN001, ANN201
    return _pairs(spark, sf).select("record_id", T.template_id(T.generalise("a", "b")).alias("template_id"))


_OPAQUE = r"regexp_matches(s, '[^\x20-\x7E\t\n\r]')"
_CHARS = "list_distinct(string_split(s, ''))"
_BITS = f"list_sum(list_transform({_CHARS}, lambda c: -((length(s) - length(replace(s, c, ''))) / length(s)) * log2((length(s) - length(replace(s, c, ''))) / length(s))))"
_STRINGS = "(SELECT doc_id AS id, 'doc' AS kind, text AS s FROM documents UNION ALL SELECT item_id, 'bench', text FROM benchmark UNION ALL SELECT conv_id * 1000 + turn, 'chat', text FROM conversations)"


def _strings(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda t, i, k: spark.read.parquet(f"{sf}/{t}.parquet").selectExpr(f"{i} AS id", f"'{k}' AS kind", "text AS s")
    return read("documents", "doc_id", "doc").unionByName(read("benchmark", "item_id", "bench")).unionByName(read("conversations", "conv_id * 1000 + turn", "chat"))


@query(f"SELECT id, kind, round({_BITS}, 6) AS bits FROM {_STRINGS} WHERE NOT {_OPAQUE} AND s <> ''")
def entropy(spark, sf):  # noqa: ANN001, ANN201
    return _strings(spark, sf).filter(~T.is_opaque("s") & (F.col("s") != "")).select("id", "kind", F.round(T.entropy("s"), 6).alias("bits"))


@query(f"SELECT id, kind, CASE WHEN {_OPAQUE} THEN 'opaque' WHEN s <> '' AND {_BITS} > 3.5 THEN 'high' ELSE 'low' END AS class FROM {_STRINGS}")
def entropy_class(spark, sf):  # noqa: ANN001, ANN201
    return _strings(spark, sf).select("id", "kind", T.entropy_class("s").alias("class"))


_CLASS = rf"""CASE WHEN strlen(s) < 60 OR NOT contains(s, ' ') THEN 'scalar' WHEN contains(s, chr(10)) THEN 'multiline' WHEN {_OPAQUE} OR {_BITS} > greatest(3.5, THRESHOLD) THEN 'scalar'
    WHEN regexp_matches(s, '^[0-9]{{4}}[-/T.]') OR list_has_any({TOK.replace('message', 's')}, {WORDS}) OR len({TOK.replace('message', 's')}) >= 5 THEN 'line' ELSE 'scalar' END"""


@query(f"SELECT id, kind, {_CLASS.replace('THRESHOLD', '3.5')} AS class, {_CLASS.replace('THRESHOLD', '4.2')} AS looser FROM {_STRINGS}")
def classify_text(spark, sf):  # noqa: ANN001, ANN201
    return _strings(spark, sf).select("id", "kind", T.text_class("s").alias("class"), T.text_class("s", 4.2).alias("looser"))


@query(f"SELECT id, kind, CAST(floor(strlen(s) / 4.0) AS BIGINT) AS tokens FROM {_STRINGS}")
def token_estimate(spark, sf):  # noqa: ANN001, ANN201
    return _strings(spark, sf).select("id", "kind", T.token_estimate("s").alias("tokens"))


# ---- template mining -----------------------------------------------------------------------------------------


def _routed_sql(corpus: str, depth: int, children: int) -> str:
    """CTEs r0 to r<depth>: each level ranks the words of a node by their first record."""
    ctes = [f"r0 AS (SELECT record_id, message, {TOK} AS tokens, CAST(len({TOK}) AS INT) AS word_count, CAST([] AS VARCHAR[]) AS path FROM {corpus})"]
    for k in range(1, depth + 1):
        ctes.append(f"c{k} AS (SELECT word_count, path, word, dense_rank() OVER (PARTITION BY word_count, path ORDER BY first) AS rank FROM (SELECT word_count, path, tokens[{k}] AS word, min(record_id) AS first FROM r{k - 1} WHERE word_count >= {k} GROUP BY ALL))")
        ctes.append(f"r{k} AS (SELECT record_id, message, tokens, r.word_count, CASE WHEN r.word_count < {k} THEN r.path WHEN rank <= {children} THEN list_append(r.path, 'L' || word) ELSE list_append(r.path, 'W') END AS path FROM r{k - 1} r LEFT JOIN c{k} c ON r.word_count = c.word_count AND r.path = c.path AND tokens[{k}] = word)")
    leaf = f"leaf AS (SELECT word_count, path, count(*) AS count, min(record_id) AS first_record_id FROM r{depth} GROUP BY ALL)"
    spot = f"spot AS (SELECT word_count, path, pos, CASE WHEN min(tok) = max(tok) THEN min(tok) END AS tok FROM (SELECT word_count, path, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS tok FROM r{depth}) GROUP BY ALL)"
    tpl = f"tpl AS (SELECT l.word_count, l.path, count, first_record_id, t.tokens, {_ID('t.tokens')} AS template_id, array_to_string(list_transform(t.tokens, lambda x: coalesce(x, '*')), ' ') AS pattern, CAST(len(list_filter(t.tokens, lambda x: x IS NULL)) AS INT) AS wildcard_count FROM leaf l JOIN (SELECT word_count, path, list(tok ORDER BY pos) AS tokens FROM spot GROUP BY ALL) t ON l.word_count = t.word_count AND l.path = t.path)"
    return "WITH " + ", ".join([*ctes, leaf, spot, tpl]) + " "


_SHORT, _PAIRS, _EVENT = C.events_sql(C.SHORT), C.events_sql(C.PAIRS), C.events_sql(C.EVENT)


def _routed(spark: SparkSession, sf: str, line: str = C.SHORT, depth: int = 4, children: int = 128) -> DataFrame:
    return drain.route(drain.tokenised(C.events(spark, sf, line)), depth, children)


@query(_routed_sql(_SHORT, 4, 6) + "SELECT record_id, word_count, array_to_string(path, ' ') AS path FROM r4")
def route(spark, sf):  # noqa: ANN001, ANN201
    return _routed(spark, sf, children=6).select("record_id", "word_count", F.array_join("path", " ").alias("path"))


@query(_routed_sql(_SHORT, 4, 128) + "SELECT template_id, pattern, wildcard_count, word_count, array_to_string(path, ' ') AS path, count, first_record_id FROM tpl")
def drain_closed(spark, sf):  # noqa: ANN001, ANN201
    return drain.closed_templates(_routed(spark, sf)).select("template_id", "pattern", "wildcard_count", "word_count", F.array_join("path", " ").alias("path"), "count", "first_record_id")


@query(_routed_sql(_EVENT, 4, 3) + "SELECT template_id, pattern, wildcard_count, word_count, array_to_string(path, ' ') AS path, count, first_record_id FROM tpl")
def drain_general(spark, sf):  # noqa: ANN001, ANN201
    """The online loop on twelve-word lines, which are alike enough to make one template a leaf; tests hold it against a plain model."""
    return drain.online_templates(_routed(spark, sf, C.EVENT, 4, 3)).select("template_id", "pattern", "wildcard_count", "word_count", F.array_join("path", " ").alias("path"), "count", "first_record_id")


@query(_routed_sql(_EVENT, 4, 3) + "SELECT template_id, pattern, CAST(sum(count) AS BIGINT) AS count, min(first_record_id) AS first_record_id FROM tpl GROUP BY template_id, pattern")
def drain_batches(spark, sf):  # noqa: ANN001, ANN201
    """Three batches, each mined on top of what those before left: the templates and counts of one run."""
    rows = C.events(spark, sf, C.EVENT)
    share = F.floor(F.col("record_id") * 3 / (rows.agg(F.max("record_id")).first()[0] + 1))
    beginnings, leaves = spark.createDataFrame([], S.BEGINNINGS), spark.createDataFrame([], S.LEAVES)
    for k in range(3):
        mined = batches.advance(rows.filter(share == k), beginnings, leaves, Options(depth=4, max_children=3))
        beginnings, leaves = beginnings.unionByName(mined.beginnings.select(beginnings.columns)), mined.leaves
    return batches.templates_of(leaves).select("template_id", "pattern", "count", "first_record_id")


@query(_routed_sql(_SHORT, 4, 128) + "SELECT template_id, array_to_string(list(message ORDER BY record_id)[1:3], '|') AS examples FROM r4 JOIN tpl USING (word_count, path) GROUP BY template_id")
def template_examples(spark, sf):  # noqa: ANN001, ANN201
    routed = _routed(spark, sf)
    return drain.examples(drain.assign(routed, drain.closed_templates(routed))).select("template_id", F.array_join("examples", "|").alias("examples"))


@query(_routed_sql(_EVENT, 4, 3) + "SELECT record_id, template_id, array_to_string(list_transform(t.tokens, lambda x: coalesce(x, '*')), ' ') AS template FROM r4 JOIN tpl t USING (word_count, path)")
def assigned_records(spark, sf):  # noqa: ANN001, ANN201
    """Every record of long lines with its template."""
    own = drain.assigned(C.events(spark, sf, C.EVENT), 4, 3)
    return own.select("record_id", "template_id", F.array_join(F.transform("template", lambda x: F.coalesce(x, F.lit("*"))), " ").alias("template"))


_PATHED = "CASE record_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a.b' WHEN 2 THEN 'a[].c' ELSE 'd' END"


@query(_routed_sql(_SHORT, 4, 3) + f", p AS (SELECT template_id, {_PATHED} AS path, min(record_id) AS first, count(*) AS n FROM r4 r JOIN tpl USING (word_count, path) GROUP BY 1, 2) SELECT template_id, string_agg(path, '|' ORDER BY first) AS paths FROM p WHERE path <> '' GROUP BY template_id")
def template_paths(spark, sf):  # noqa: ANN001, ANN201
    routed = _routed(spark, sf, children=3)
    rows = drain.assign(routed, drain.closed_templates(routed)).withColumn("source_path", F.expr(_PATHED))
    return drain.source_paths(rows).select("template_id", F.array_join(F.transform("paths", lambda p: p["path"]), "|").alias("paths"))


@query(_routed_sql(_SHORT, 4, 3) + f", p AS (SELECT template_id, {_PATHED} AS path, min(record_id) AS first, count(*) AS n FROM r4 r JOIN tpl USING (word_count, path) GROUP BY 1, 2) SELECT template_id, path, n, CAST(sum(n) OVER (PARTITION BY template_id) AS BIGINT) AS total FROM p WHERE path <> ''")
def cross_path(spark, sf):  # noqa: ANN001, ANN201
    routed = _routed(spark, sf, children=3)
    rows = drain.assign(routed, drain.closed_templates(routed)).withColumn("source_path", F.expr(_PATHED))
    return drain.source_paths(rows).select("template_id", F.inline("paths"), F.col("count").alias("total"))


@query(_routed_sql(_PAIRS, 4, 128) + """, m AS (SELECT template_id, tokens, count, first_record_id, pos, list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN i - 1 = pos THEN 'W' ELSE coalesce('L' || tokens[i], 'W') END) AS mask FROM (SELECT *, unnest(range(len(tokens))) AS pos FROM tpl)),
    k AS (SELECT pos, mask FROM m GROUP BY ALL HAVING count(DISTINCT template_id) > 1), f AS (SELECT template_id, min(pos) AS pos FROM m JOIN k USING (pos, mask) GROUP BY template_id),
    o AS (SELECT t.template_id, t.count, t.first_record_id, f.pos, CASE WHEN f.pos IS NULL THEN t.tokens ELSE list_transform(range(1, len(t.tokens) + 1), lambda i: CASE WHEN i - 1 = f.pos THEN NULL ELSE t.tokens[i] END) END AS tokens FROM tpl t LEFT JOIN f USING (template_id))
    SELECT array_to_string(list_transform(tokens, lambda x: coalesce(x, '*')), ' ') AS pattern, CAST(sum(count) AS BIGINT) AS count, min(first_record_id) AS first_record_id, count(*) AS members FROM o GROUP BY coalesce(pos, -1), CASE WHEN pos IS NULL THEN template_id END, tokens""")
def merge_pass(spark, sf):  # noqa: ANN001, ANN201
    return drain.merge_similar(drain.closed_templates(_routed(spark, sf, C.PAIRS))).select("pattern", "count", "first_record_id", "members")


@query(_routed_sql(_SHORT, 4, 128) + "SELECT t.template_id, t.count, CASE WHEN t.count < 10 THEN any_value(m.message) ELSE any_value(t.pattern) END AS shown FROM tpl t JOIN r4 m ON m.record_id = t.first_record_id GROUP BY t.template_id, t.count")
def min_cluster_size(spark, sf):  # noqa: ANN001, ANN201
    routed = _routed(spark, sf)
    templates = drain.closed_templates(routed)
    return drain.verbatim_small(templates, drain.examples(drain.assign(routed, templates), 1), 10).select("template_id", "count", "shown")


@query(_routed_sql(_SHORT, 4, 3) + "SELECT template_id, CAST(sum(count) AS BIGINT) AS count FROM tpl GROUP BY template_id")
def run_counts(spark, sf):  # noqa: ANN001, ANN201
    return score.run_counts(drain.closed_templates(_routed(spark, sf, children=3)))


@query(f"SELECT record_id, CAST(('0x' || substr(md5(concat_ws('|', {_PATHED}, '', CAST(len({TOK}) AS VARCHAR))), 1, 15))::BIGINT % 128 AS INT) AS shard FROM {_SHORT}")
def shard_key(spark, sf):  # noqa: ANN001, ANN201
    rows = drain.tokenised(C.events(spark, sf, C.SHORT)).withColumn("source_path", F.expr(_PATHED))
    return rows.select("record_id", drain.shard(F.col("source_path"), F.lit(None).cast("string"), F.col("word_count"), 128).alias("shard"))


# ---- history, sketches, scores -------------------------------------------------------------------------------

#: The past: nine of ten events, in nine runs a day apart; the present: the tenth.  Purchases of the present are of kinds of their
#: own, and most clicks of the past too, so that some templates are new and some more frequent than before.
NOW = 1_700_000_000
_NAME = "concat(event_type, ' ', CASE WHEN event_type = 'purchase' AND event_id % 10 = 9 THEN 'new ' WHEN event_type = 'click' AND event_id % 10 <> 9 AND event_id % 7 <> 0 THEN 'old ' ELSE '' END, CAST(event_id % 17 AS STRING))"
_KEY = f"('0x' || substr(md5(concat('L', replace({_NAME}, ' ', ' L'))), 1, 15))::BIGINT"
_HIST = f"(SELECT {_KEY} AS template_id, {NOW} - 86400 * (event_id % 10 + 1) AS run_ts, count(*) AS count FROM events WHERE event_id % 10 <> 9 GROUP BY ALL)"
_CUR = f"(SELECT {_KEY} AS template_id, {_NAME} AS pattern, count(*) AS count FROM events WHERE event_id % 10 = 9 GROUP BY ALL)"
_LAMBDA = "(ln(2) / 168.0)"
_PAST = f"(SELECT template_id, CAST(floor(sum(count * exp(-{_LAMBDA} * ({NOW} - run_ts) / 3600.0))) AS BIGINT) AS past FROM {_HIST} GROUP BY template_id)"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr("*", f"{_NAME} AS pattern").withColumn("template_id", T.template_id(T.tokens("pattern")))


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Counts of the present with patterns, and the history."""
    ev = _named(spark, sf)
    now = ev.filter("event_id % 10 = 9").groupBy("template_id", "pattern").agg(F.count("*").alias("count"))
    old = ev.filter("event_id % 10 <> 9")
    return now, old.withColumn("run_ts", F.lit(NOW) - 86400 * (F.col("event_id") % 10 + 1)).groupBy("template_id", "run_ts").agg(F.count("*").alias("count"))


_COLSQL = lambda i: "CAST(((CAST(template_id AS UHUGEINT) * CAST([" + ", ".join(f"'{m}'" for m in score.MULTIPLIERS) + f"][{i} + 1] AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT)) // CAST('17592186044416' AS UHUGEINT) AS BIGINT)"
_CELLS = f"(SELECT r AS row, {_COLSQL('r')} AS col, CAST(sum(count) AS BIGINT) AS count FROM {_HIST}, (SELECT CAST(unnest(range(5)) AS INT) AS r) GROUP BY ALL)"


@query(f"SELECT row, col, least(count, 4294967295) AS count FROM {_CELLS}")
def cms_increment(spark, sf):  # noqa: ANN001, ANN201
    return score.sketch(_split(spark, sf)[1])


@query(f"SELECT template_id, min(coalesce(c.count, 0)) AS estimate FROM (SELECT template_id, r, {_COLSQL('r')} AS col FROM {_CUR}, (SELECT CAST(unnest(range(5)) AS INT) AS r)) q LEFT JOIN {_CELLS} c ON c.row = q.r AND c.col = q.col GROUP BY template_id")
def cms_estimate(spark, sf):  # noqa: ANN001, ANN201
    now, old = _split(spark, sf)
    return score.estimate(now, score.sketch(old))


@query(f"SELECT row, col, CAST(floor(count * exp(-{_LAMBDA} * 30.0)) AS BIGINT) AS count FROM {_CELLS}")
def cms_decay(spark, sf):  # noqa: ANN001, ANN201
    return score.decay_sketch(score.sketch(_split(spark, sf)[1]), score.decay_factor(F.lit(NOW), F.lit(NOW - 30 * 3600)))


@query(f"SELECT row, col, CAST(sum(count) AS BIGINT) AS count FROM ({_CELLS.replace('FROM (SELECT', 'FROM (SELECT', 1)[1:-1]} UNION ALL SELECT r, {_COLSQL('r')}, count FROM {_CUR}, (SELECT CAST(unnest(range(5)) AS INT) AS r)) GROUP BY row, col")
def cms_merge(spark, sf):  # noqa: ANN001, ANN201
    now, old = _split(spark, sf)
    return score.add_sketches(score.sketch(old), score.sketch(now))


@query(f"SELECT * FROM {_PAST}")
def decay(spark, sf):  # noqa: ANN001, ANN201
    return score.decayed(_split(spark, sf)[1], NOW)


_SCORED = f"""(SELECT *, CASE WHEN unseen THEN 'novelty' WHEN bits >= 3 THEN 'anomaly' WHEN bits >= 1 THEN 'elevated' ELSE 'normal' END AS promotion, CASE WHEN unseen THEN 3 WHEN bits >= 3 THEN 2 WHEN bits >= 1 THEN 1 ELSE 0 END AS promotion_rank
    FROM (SELECT *, past = 0 OR total_past = 0 AS unseen, CASE WHEN past > 0 AND total_past > 0 THEN greatest(0.0, log2((count / total) / (past / total_past))) END AS bits
    FROM (SELECT c.template_id, pattern, count, coalesce(past, 0) AS past, sum(count) OVER () AS total, (SELECT sum(past) FROM {_PAST}) AS total_past FROM {_CUR} c LEFT JOIN {_PAST} h ON c.template_id = h.template_id)))"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    now, old = _split(spark, sf)
    return score.score(now, score.decayed(old, NOW))




def _finite() -> F.Column:
    return F.when(F.col("surprise") < float("inf"), F.round("surprise", 6)).alias("surprise")


@query(f"SELECT template_id, round(bits, 6) AS surprise FROM {_SCORED}")
def surprise(spark, sf):  # noqa: ANN001, ANN201
    return _scored(spark, sf).select("template_id", _finite())


@query(f"SELECT template_id, promotion, CAST(promotion_rank AS INT) AS promotion_rank, CASE promotion WHEN 'novelty' THEN '[NEW]' WHEN 'anomaly' THEN '[ANOMALY]' WHEN 'elevated' THEN '[ELEVATED]' ELSE '' END AS tag, CASE promotion WHEN 'novelty' THEN chr(27) || '[1;35m' WHEN 'anomaly' THEN chr(27) || '[1;31m' WHEN 'elevated' THEN chr(27) || '[1;33m' ELSE chr(27) || '[0m' END AS colour FROM {_SCORED}")
def promotion(spark, sf):  # noqa: ANN001, ANN201
    p = F.col("promotion")
    return _scored(spark, sf).select("template_id", "promotion", "promotion_rank", score.lookup(score.PROMOTIONS, p).alias("tag"), score.lookup(score.COLOURS, p).alias("colour"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY promotion_rank DESC, count DESC, pattern, template_id) AS INT) AS place, pattern, count, promotion, past AS historic_estimate FROM {_SCORED} QUALIFY place <= 40")
def score_rank(spark, sf):  # noqa: ANN001, ANN201
    top = _scored(spark, sf).orderBy(*score.ranking()).limit(40)  # the top of the ranking is the feature
    place = F.row_number().over(Window.orderBy(*score.ranking()))
    return top.select(place.alias("place"), "pattern", "count", "promotion", "historic_estimate")


@query(f"SELECT template_id, CAST(sum(count) AS BIGINT) AS count FROM {_HIST} WHERE run_ts IN (SELECT DISTINCT run_ts FROM {_HIST} ORDER BY run_ts DESC LIMIT 3) GROUP BY template_id")
def history_window(spark, sf):  # noqa: ANN001, ANN201
    return score.run_counts(score.last_runs(_split(spark, sf)[1], 3))


@query(f"SELECT round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS distance FROM (SELECT CAST(coalesce(a.count, 0) AS DOUBLE) AS x, CAST(coalesce(b.count, 0) AS DOUBLE) AS y FROM {_CUR} a FULL JOIN (SELECT template_id, sum(count) AS count FROM {_HIST} GROUP BY 1) b ON a.template_id = b.template_id)")
def cosine_drift(spark, sf):  # noqa: ANN001, ANN201
    now, old = _split(spark, sf)
    return score.cosine_distance(now, score.run_counts(old)).select(F.round("distance", 6).alias("distance"))


@query(f"SELECT template_id, pattern FROM {_CUR} WHERE template_id NOT IN (SELECT template_id FROM {_PAST})")
def novel_anti_join(spark, sf):  # noqa: ANN001, ANN201
    now, old = _split(spark, sf)
    return score.novel(now, score.decayed(old, NOW)).select("template_id", "pattern")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat_ws(':', '0', o_custkey, o_orderkey)), o_orderkey) <= 5")
def reservoir_sample(spark, sf):  # noqa: ANN001, ANN201
    """A sample of each customer's orders; which rows is the hash's choice."""
    return score.sample(spark.read.parquet(f"{sf}/orders.parquet"), ["o_custkey"], "o_orderkey", 5).select("o_custkey", "o_orderkey")


def _state(spark: SparkSession, sf: str) -> S.State:
    """The past as runs in a state of its own."""
    state = S.State(spark, folder(spark, "state"), "catalog")
    old = _named(spark, sf).filter("event_id % 10 <> 9").withColumn("run", F.col("event_id") % 3)
    for k in range(3):
        state.append(old.filter(F.col("run") == k).groupBy("template_id", "pattern").agg(F.count("*").alias("count")), f"r{k}", NOW - 3600 * (k + 1))
    return state


_RUNS = f"(SELECT {_KEY} AS template_id, {_NAME} AS pattern, count(*) AS count, 'r' || (event_id % 3) AS run_id, {NOW} - 3600 * (event_id % 3 + 1) AS run_ts FROM events WHERE event_id % 10 <> 9 GROUP BY ALL)"


@query(f"SELECT template_id, count, run_id, run_ts FROM {_RUNS}")
def state_history(spark, sf):  # noqa: ANN001, ANN201
    return _state(spark, sf).history()


@query(f"SELECT template_id, pattern, count, run_id, run_ts FROM {_RUNS}")
def state_templates(spark, sf):  # noqa: ANN001, ANN201
    return _state(spark, sf).templates().drop("project")


@query(f"SELECT template_id, CAST(sum(c) AS BIGINT) AS count FROM (SELECT template_id, floor(sum(count * exp(-{_LAMBDA} * ({NOW} - run_ts) / 3600.0))) AS c FROM {_RUNS} GROUP BY template_id UNION ALL SELECT template_id, count FROM {_CUR}) GROUP BY template_id")
def flush(spark, sf):  # noqa: ANN001, ANN201
    """Counts of the past, decayed, and those of the present in one."""
    return score.flush(_state(spark, sf).history(), _split(spark, sf)[0], NOW)


# ---- compression and rendering -------------------------------------------------------------------------------


def _assigned(spark: SparkSession, sf: str, children: int = 3) -> DataFrame:
    routed = _routed(spark, sf, C.SHORT, 4, children)
    return drain.assign(routed, drain.closed_templates(routed))


_ASSIGNED = _routed_sql(_SHORT, 4, 3) + ", s AS (SELECT * FROM (SELECT template_id, record_id, CAST(generate_subscripts(r.tokens, 1) - 1 AS INT) AS pos, unnest(r.tokens) AS tok, unnest(t.tokens) AS lit FROM r4 r JOIN tpl t USING (word_count, path)) WHERE lit IS NULL) "


@query(_ASSIGNED + "SELECT template_id, pos, count(*) AS n, count(v) = count(*) AS is_numeric, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99, count(DISTINCT tok) AS distinct FROM (SELECT *, try_cast(tok AS DOUBLE) AS v FROM s) GROUP BY template_id, pos")
def slot_numeric(spark, sf):  # noqa: ANN001, ANN201
    return render.slot_stats(_assigned(spark, sf), exact=True).withColumns({"p50": F.round("p50", 6), "p99": F.round("p99", 6)})


@query(_ASSIGNED + "SELECT template_id, pos, string_agg(DISTINCT tok, '|' ORDER BY tok) AS words FROM s GROUP BY template_id, pos HAVING count(DISTINCT tok) <= 20")
def slot_strings(spark, sf):  # noqa: ANN001, ANN201
    return render.slot_words(_assigned(spark, sf)).select("template_id", "pos", F.array_join("words", "|").alias("words"))


_GAPS = _routed_sql(_SHORT, 4, 3) + ", a AS (SELECT template_id, record_id, e.ts, r.tokens FROM r4 r JOIN tpl USING (word_count, path) JOIN events e ON e.event_id = r.record_id) "


@query(_GAPS + "SELECT template_id, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.99), 4) AS p99, max(ts) AS last_seen FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY template_id ORDER BY record_id))) / 1000 AS ms FROM a) GROUP BY template_id")
def delta_quantiles(spark, sf):  # noqa: ANN001, ANN201
    ts = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("record_id"), "ts")
    out = render.gaps(_assigned(spark, sf).join(ts, "record_id"), exact=True)
    return out.select("template_id", F.round("p50", 4).alias("p50"), F.round("p99", 4).alias("p99"), "last_seen")


@query(_GAPS + "SELECT template_id, record_id, array_to_string(list_filter(list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN tokens[i] <> before[i] THEN (i - 1) || '=' || tokens[i] END), lambda x: x IS NOT NULL), ' ') AS changed FROM (SELECT *, lag(tokens) OVER (PARTITION BY template_id ORDER BY record_id) AS before FROM a) WHERE before IS NOT NULL")
def semantic_delta(spark, sf):  # noqa: ANN001, ANN201
    return render.changes(_assigned(spark, sf)).select("template_id", "record_id", F.array_join("changed", " ").alias("changed"))


_LINE = "(CASE promotion WHEN 'novelty' THEN '[NEW]' WHEN 'anomaly' THEN '[ANOMALY]' WHEN 'elevated' THEN '[ELEVATED]' ELSE '' END || ' ' || pattern || ' (count: ' || count || ')')"


@query(f"SELECT template_id, pattern, count, promotion, past AS historic_estimate, round(bits, 6) AS surprise FROM {_SCORED}")
def compress_entries(spark, sf):  # noqa: ANN001, ANN201
    return render.entries(_scored(spark, sf)).select("template_id", "pattern", "count", "promotion", "historic_estimate", _finite())


@query(f"SELECT template_id, tokens_needed, must OR used <= 400 AS kept FROM (SELECT *, sum(tokens_needed) OVER (ORDER BY must DESC, count DESC, pattern, template_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT *, promotion IN ('novelty', 'anomaly') AS must, CAST(floor((strlen({_LINE}) + 1) / 4.0) AS BIGINT) AS tokens_needed FROM {_SCORED}))")
def token_budget(spark, sf):  # noqa: ANN001, ANN201
    return render.within_budget(_scored(spark, sf), 400).select("template_id", "tokens_needed", "kept")


@query(f"SELECT section, CAST(place AS INT) AS place, line FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY promotion_rank DESC, count DESC, pattern, template_id) AS place, {_LINE} AS line FROM (SELECT *, CASE promotion WHEN 'novelty' THEN 'NEW' WHEN 'anomaly' THEN 'ANOMALY' ELSE 'NORMAL' END AS section FROM {_SCORED})) WHERE section <> 'NORMAL' OR place <= 50")
def render_text_lines(spark, sf):  # noqa: ANN001, ANN201
    return render.summary_lines(_scored(spark, sf))


@query(f"SELECT template_id, '{{\"pattern\":\"' || pattern || '\",\"count\":' || count || ',\"promotion\":\"' || promotion || '\",\"historic_estimate\":' || past || '}}' AS json FROM {_SCORED}")
def render_ndjson(spark, sf):  # noqa: ANN001, ANN201
    return render.ndjson(_scored(spark, sf))


@query(f"SELECT record_id, line AS message, line AS raw_line, true AS was_raw FROM {MIXED}")
def render_raw(spark, sf):  # noqa: ANN001, ANN201
    return parse.parse(mixed(spark, sf), "raw").select("record_id", "message", F.col("line").alias("raw_line"), "was_raw")


# ---- JSON documents ------------------------------------------------------------------------------------------

_TREE = f"""(SELECT doc, '$' || substr(fullkey, 2) AS place, regexp_replace(regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g'), '^\\$\\.?', '') AS path, CASE WHEN fullkey = '$' THEN NULL ELSE path END AS parent,
      CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS type,
      CASE WHEN type IN ('OBJECT', 'ARRAY') THEN NULL ELSE json_extract_string(atom, '$') END AS value, CASE WHEN ends_with(fullkey, ']') THEN CAST(key AS INT) END AS index FROM {C.ORDERS_JSON_SQL} d, json_tree(d.json))"""


def _nodes(spark: SparkSession, sf: str, max_depth: int = jsondoc.MAX_DEPTH) -> DataFrame:
    return jsondoc.walk(C.orders_json(spark, sf), max_depth=max_depth)


#: Orders in documents of their own for every 50,000 keys: an object with an array of objects, with a line for each.
_FILE_JSON = "concat('{\"orderkey\":', o_orderkey, ',\"customer\":{\"key\":', o_custkey, '},\"priority\":\"', o_orderpriority, '\"}')"


@query("""WITH o AS (SELECT o_orderkey // 50000 AS doc, * FROM orders), n AS (SELECT doc, count(*) AS n FROM o GROUP BY doc)
    SELECT doc, '' AS path, 'object' AS type, 1 AS n, 2 AS size, NULL AS least, NULL AS most FROM n UNION ALL SELECT doc, 'rows', 'array', 1, n, NULL, NULL FROM n UNION ALL SELECT doc, 'kind', 'string', 1, NULL, NULL, NULL FROM n
    UNION ALL SELECT doc, 'rows[]', 'object', count(*), 3 * count(*), NULL, NULL FROM o GROUP BY doc UNION ALL SELECT doc, 'rows[].customer', 'object', count(*), count(*), NULL, NULL FROM o GROUP BY doc
    UNION ALL SELECT doc, 'rows[].priority', 'string', count(*), NULL, NULL, NULL FROM o GROUP BY doc
    UNION ALL SELECT doc, 'rows[].orderkey', 'int', count(*), NULL, min(o_orderkey), max(o_orderkey) FROM o GROUP BY doc UNION ALL SELECT doc, 'rows[].customer.key', 'int', count(*), NULL, min(o_custkey), max(o_custkey) FROM o GROUP BY doc""")
def json_files(spark, sf):  # noqa: ANN001, ANN201
    """Files of one large document each, written and read again in blocks that end anywhere."""
    path = folder(spark, "documents")
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey div 50000 AS doc", "o_orderkey AS key", f"{_FILE_JSON} AS line")
    # a window needs a document's rows in one task whatever becomes of joins before it, so a document is one file
    ordered = Window.partitionBy("doc").orderBy("key")
    before = F.when(F.row_number().over(ordered) == 1, F.lit('{"kind":"a,b", "rows":[\n')).otherwise(F.lit(","))
    after = F.when(F.lead("key").over(ordered).isNull(), F.lit("\n]}")).otherwise(F.lit(""))
    lines = rows.select("doc", "key", F.concat(before, "line", after).alias("line"))
    lines.sortWithinPartitions("doc", "key").select("doc", "line").write.partitionBy("doc").text(path)
    nodes = jsondoc.walk_files(spark, f"{path}/*", block=1 << 18).withColumn("doc", F.regexp_extract("doc", "doc=([0-9]+)", 1).cast("long"))
    number = F.when(F.col("type") == "int", F.col("value").cast("long"))
    return nodes.groupBy("doc", "path", "type").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min(number).alias("least"), F.max(number).alias("most"))


@query(f"SELECT doc, place, path, type, value FROM {_TREE}")
def json_walk(spark, sf):  # noqa: ANN001, ANN201
    return _nodes(spark, sf).select("doc", "place", "path", "type", "value")


_TYPECOUNTS = f"(SELECT path, {', '.join(f'''count(*) FILTER (type = '{t}') AS n_{t}''' for t in jsondoc.TYPES)}, count(*) AS observed FROM {_TREE} GROUP BY path)"


@query(f"SELECT * FROM {_TYPECOUNTS}")
def json_type_counts(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.type_counts(_nodes(spark, sf))


@query(f"SELECT path, arg_max(type, n * 10 + i) AS dominant FROM (SELECT path, type, count(*) AS n, list_position([{', '.join(repr(t) for t in jsondoc.TYPES)}], type) AS i FROM {_TREE} GROUP BY path, type) GROUP BY path")
def json_dominant(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.dominant(jsondoc.type_counts(_nodes(spark, sf))).select("path", "dominant")


@query(f"SELECT path, count(*) AS n, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99 FROM (SELECT path, CAST(value AS DOUBLE) AS v FROM {_TREE} WHERE type IN ('int', 'float')) GROUP BY path")
def json_numeric(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.numeric_stats(_nodes(spark, sf), exact=True).withColumns({"p50": F.round("p50", 6), "p99": F.round("p99", 6)})


@query(f"SELECT path, array_to_string(list(value ORDER BY doc, place)[1:5], '|') AS samples FROM {_TREE} WHERE type = 'string' GROUP BY path")
def json_strings(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.string_samples(_nodes(spark, sf)).select("path", F.array_join("samples", "|").alias("samples"))


@query(f"SELECT path, count(DISTINCT value) AS distinct FROM {_TREE} WHERE type NOT IN ('object', 'array', 'null') GROUP BY path")
def json_cardinality(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.cardinality(_nodes(spark, sf), exact=True)


_LEN = f"(SELECT a.doc, a.place, a.path, count(e.place) AS n FROM {_TREE} a LEFT JOIN {_TREE} e ON e.doc = a.doc AND e.parent = a.place AND e.index IS NOT NULL WHERE a.type = 'array' GROUP BY ALL)"


@query(f"SELECT path, count(*) AS arrays, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM {_LEN} GROUP BY path")
def json_array_len(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.array_lengths(_nodes(spark, sf))


@query(f"SELECT DISTINCT doc, place AS \"array\", n, CAST(CASE WHEN n <= 8 THEN k ELSE floor(k * (n - 1) / 2) END AS INT) AS index FROM (SELECT *, unnest(range(CASE WHEN n <= 8 THEN n ELSE 3 END)) AS k FROM {_LEN}) WHERE n > 0")
def json_array_sample(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.array_samples(_nodes(spark, sf), inline=8)


@query(f"SELECT doc, parent AS place, count(*) AS keys, '[depth limit reached — subtree has ' || count(*) || ' keys, use --json-path \"' || regexp_replace(regexp_replace(parent, '\\[[0-9]+\\]', '[]', 'g'), '^\\$\\.?', '') || '\" to expand]' AS note FROM {_TREE} WHERE len(regexp_extract_all(place, '\\.|\\[')) = 3 GROUP BY doc, parent")
def json_depth_limit(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.depth_notes(_nodes(spark, sf, 2), 2)


@query(f"SELECT doc, place, type, value FROM {_TREE} WHERE regexp_matches(place, '^\\$\\.orders\\[[0-9]+\\]\\.status([.\\[].*)?$')")
def json_path_focus(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.walk_at(C.orders_json(spark, sf), "orders[*].status").select("doc", "place", "type", "value")


@query(f"SELECT path, value, count(*) AS n FROM {_TREE} WHERE path = 'orders[].status' GROUP BY path, value")
def json_leaf_scan(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.value_counts(jsondoc.walk_at(C.orders_json(spark, sf), "orders[*].status"))


@query(f"SELECT doc, place, path, type, value FROM {_TREE} WHERE regexp_matches(place, '^\\$\\.orders\\[1\\]([.\\[].*)?$') UNION ALL SELECT doc, place, path, type, value FROM {_TREE} WHERE place = '$.who.name'")
def json_path_steps(spark, sf):  # noqa: ANN001, ANN201
    """One element with all below it, and the key of a key."""
    docs = C.orders_json(spark, sf)
    return jsondoc.walk_at(docs, "orders[1]").unionByName(jsondoc.walk_at(docs, ".who.name")).select("doc", "place", "path", "type", "value")


def _merged_sketches(nodes: DataFrame) -> DataFrame:
    """Sketches of four runs, put together."""
    runs = [jsondoc.sketches(nodes.filter(F.col("doc") % 4 == k)) for k in range(4)]
    return jsondoc.estimates(jsondoc.merged(runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(runs[3])))


@query(f"SELECT path, count(DISTINCT value) AS distinct, true AS close FROM {_TREE} WHERE type NOT IN ('object', 'array', 'null') GROUP BY path")
def json_distinct_sketch(spark, sf):  # noqa: ANN001, ANN201
    """Distinct values by sketches of four runs, within 2 % of the exact number."""
    nodes = _nodes(spark, sf)
    both = jsondoc.cardinality(nodes, exact=True).join(_merged_sketches(nodes).withColumnRenamed("distinct", "estimate"), "path")
    return both.select("path", "distinct", (F.abs(F.col("estimate") - F.col("distinct")) <= 0.02 * F.col("distinct") + 0.5).alias("close"))


@query(f"SELECT path, count(*) AS n, true AS close FROM {_TREE} WHERE type IN ('int', 'float') GROUP BY path")
def json_quantile_sketch(spark, sf):  # noqa: ANN001, ANN201
    """Quantiles by sketches of four runs, whose ranks in the values are within 2 % of what was asked for."""
    nodes = _nodes(spark, sf)
    found = _merged_sketches(nodes).filter("n > 0").select("path", "p50", "p99")
    x = F.col("value").cast("double")
    rank = lambda q, p: (F.avg((x < F.col(q)).cast("double")) <= p + 0.02) & (F.avg((x <= F.col(q)).cast("double")) >= p - 0.02)
    return nodes.filter("type in ('int', 'float')").join(found, "path").groupBy("path").agg(F.count("*").alias("n"), (rank("p50", 0.5) & rank("p99", 0.99)).alias("close"))


@query(f"SELECT path, count(*) AS observed, CASE WHEN path = 'orders[]' THEN (SELECT count(*) FROM {_TREE} WHERE path = 'orders[].priority') ELSE 0 END AS hidden FROM {_TREE} WHERE path IN ('orders[]', 'orders[].orderkey', 'orders[].status') GROUP BY path")
def json_bounded_schema(spark, sf):  # noqa: ANN001, ANN201
    """The three most frequent paths, and how many children of theirs are not shown."""
    return jsondoc.bounded_schema(_nodes(spark, sf), 3, samples=False).select("path", "observed", "hidden")


_SENT = "concat_ws(' ', upper(event_type), 'was', 'sent', 'to', CAST(user_id AS STRING), 'with', 'the', 'payload', 'that', 'follows', 'of', 'kind', event_type, props)"


@query(f"""WITH e AS (SELECT event_type AS t, CASE WHEN event_id % 2 = 0 THEN 'log.text' ELSE 'errors[].text' END AS path, string_split({_SENT}, ' ') AS tokens FROM events),
    s AS (SELECT t, path, len(tokens) AS size, pos, CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '*' END AS tok, count(*) AS n FROM (SELECT t, path, tokens, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS tok FROM e) GROUP BY ALL),
    p AS (SELECT t, path, string_agg(tok, ' ' ORDER BY pos) AS pattern, max(n) AS n FROM s GROUP BY t, path, size)
    SELECT pattern, CAST(sum(n) AS BIGINT) AS count, string_agg(path || '=' || n, '|' ORDER BY path) AS paths FROM p GROUP BY pattern""")
def json_templates(spark, sf):  # noqa: ANN001, ANN201
    """Templates of texts in documents, mined by path, with the paths they come from."""
    text = F.expr(_SENT)
    even = F.col("event_id") % 2 == 0
    docs = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("doc"), F.to_json(F.when(even, F.struct(F.struct(text.alias("text")).alias("log"), F.lit(None).cast("array<struct<text:string>>").alias("errors"))).otherwise(F.struct(F.lit(None).cast("struct<text:string>").alias("log"), F.array(F.struct(text.alias("text"))).alias("errors")))).alias("json"))
    found = condense_json(jsondoc.walk(docs), None, Options(entropy_threshold=8.0))
    return found.select("pattern", "count", F.array_join(F.transform(F.array_sort(F.transform("paths", lambda p: F.struct(p["path"].alias("path"), p["n"].alias("n")))), lambda p: F.concat(p["path"], F.lit("="), p["n"].cast("string"))), "|").alias("paths"))


@query(f"""WITH o AS (SELECT path AS object, count(*) AS total FROM {_TREE} WHERE type = 'object' GROUP BY path), k AS (SELECT regexp_replace(path, '\\.?[^.\\[\\]]+$', '') AS object, path, count(*) AS seen FROM {_TREE} WHERE index IS NULL AND parent IS NOT NULL GROUP BY ALL)
    SELECT object, path, seen, total, CASE WHEN seen / total > 0.8 THEN 'common' WHEN seen / total >= 0.2 THEN 'partial' ELSE 'polymorphic' END AS tier FROM k JOIN o USING (object)""")
def json_key_tiers(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.key_tiers(_nodes(spark, sf))


#: Documents whose member `k` is a number, a string or null, by the event.
_ODD = "concat('{\"k\":', CASE WHEN event_id % 10 = 0 THEN '\"x\"' WHEN event_id % 10 = 1 THEN 'null' WHEN event_id % 10 = 2 THEN '1.5' ELSE CAST(event_id AS STRING) END, '}')"


@query(f"WITH t AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'string' WHEN event_id % 10 = 1 THEN 'null' WHEN event_id % 10 = 2 THEN 'float' ELSE 'int' END AS type FROM events), c AS (SELECT type, count(*) AS n, (SELECT count(*) FROM t) AS observed FROM t GROUP BY type) SELECT 'k' AS path, 'int' AS dominant, observed, type, n FROM c WHERE type NOT IN ('int', 'null')")
def json_type_variance(spark, sf):  # noqa: ANN001, ANN201
    docs = C.events(spark, sf, _ODD, "json").withColumnRenamed("record_id", "doc")
    return jsondoc.type_variance(jsondoc.type_counts(jsondoc.walk(docs, max_depth=1)))


@query(f"""WITH c AS (SELECT * FROM {_TYPECOUNTS}), h AS (SELECT regexp_replace(path, '(\\.?[^.\\[\\]]+|\\[\\])$', '') AS up, count(*) AS children FROM c WHERE path <> '' GROUP BY 1)
    SELECT path, observed, coalesce(children, 0) AS children, evicted, CASE WHEN evicted THEN CASE WHEN n_object > 0 THEN '<VAR_MAP>' ELSE '<OPAQUE_JSON>' END END AS becomes FROM (SELECT *, CASE WHEN n_object + n_array > 0 THEN coalesce(children, 0) < 2 ELSE observed < 5 END AS evicted FROM c LEFT JOIN h ON c.path = h.up)""")
def json_evict(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.evict(jsondoc.type_counts(_nodes(spark, sf))).select("path", "observed", "children", "evicted", "becomes")


@query(f"SELECT max(len(string_split(path, '.'))) AS depth FROM {_TREE}")
def json_schema_depth(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.schema_depth(_nodes(spark, sf)).select(F.col("depth").cast("long").alias("depth"))


@query(f"SELECT path, dominant, observed FROM (SELECT path, arg_max(type, n * 10 + i) AS dominant, CAST(sum(n) AS BIGINT) AS observed FROM (SELECT path, type, count(*) AS n, list_position([{', '.join(repr(t) for t in jsondoc.TYPES)}], type) AS i FROM {_TREE} GROUP BY path, type) GROUP BY path)")
def json_schema_only(spark, sf):  # noqa: ANN001, ANN201
    return jsondoc.schema(_nodes(spark, sf), samples=False).select("path", "dominant", "observed")


_TEXTS = "concat('{\"level\":\"ERROR\",\"id\":', CAST(event_id AS STRING), ',\"msg\":\"', CASE event_id % 3 WHEN 0 THEN 'aaaa aaaa aaaa aaaa aaaa bbbb bbbb bbbb bbbb bbbb aaaa aaaa aaaa aaaa' WHEN 1 THEN 'java.lang.Error: at the very start of this long line of text\\\\\\\\n\\\\\\\\tat com.example.Main' ELSE event_type END, '\"}')".replace("\\\\\\\\", "\\\\")
_TEXTS_SQL = _TEXTS.replace("\\\\", "\\")


@query(f"""SELECT doc, '$.msg' AS place, 'msg' AS source_path, CASE WHEN contains(s, chr(10)) THEN 'multiline' ELSE 'line' END AS class, string_split(s, chr(10))[1] AS message, s AS raw_line, 'id=' || doc || '|level=ERROR' AS fields
    FROM (SELECT event_id AS doc, json_extract_string({_TEXTS_SQL}, '$.msg') AS s FROM events WHERE event_id % 3 <> 2)""")
def json_text_extract(spark, sf):  # noqa: ANN001, ANN201
    docs = C.events(spark, sf, _TEXTS, "json").withColumnRenamed("record_id", "doc")
    out = jsondoc.text_records(jsondoc.walk(docs, max_depth=1))
    return out.select("doc", "place", "source_path", "class", "message", "raw_line", F.array_join(F.transform("fields", lambda f: F.concat(f["key"], F.lit("="), f["value"])), "|").alias("fields"))


# ---- the whole run -------------------------------------------------------------------------------------------


@query(_routed_sql(_SHORT, 4, 128) + "SELECT template_id, pattern, CAST(sum(count) AS BIGINT) AS count, 'novelty' AS promotion FROM tpl GROUP BY template_id, pattern")
def condense_first_run(spark, sf):  # noqa: ANN001, ANN201
    """Without history every template is new."""
    return condense(C.events(spark, sf, C.SHORT)).select("template_id", "pattern", "count", "promotion")


@query(_routed_sql(_SHORT, 4, 128) + "SELECT template_id, CAST(sum(t.count) AS BIGINT) AS count, CASE WHEN sum(t.count) < 10 THEN any_value(m.message) ELSE any_value(t.pattern) END AS pattern FROM tpl t JOIN r4 m ON m.record_id = t.first_record_id GROUP BY t.template_id")
def condense_small_verbatim(spark, sf):  # noqa: ANN001, ANN201
    return condense(C.events(spark, sf, C.SHORT), None, Options(min_cluster_size=10)).select("template_id", "count", "pattern")


@query(SQL["merge_pass"].replace("SELECT array_to_string(list_transform(tokens", "SELECT pattern, CAST(sum(count) AS BIGINT) AS count, min(first_record_id) AS first_record_id FROM (SELECT array_to_string(list_transform(tokens", 1) + ") GROUP BY pattern")
def condense_merged(spark, sf):  # noqa: ANN001, ANN201
    return condense(C.events(spark, sf, C.PAIRS), None, Options(merge=True)).select("pattern", "count", "first_record_id")


_LONG = _routed_sql(_EVENT, 4, 3) + f", a AS (SELECT t.template_id, record_id, message, e.ts, r.tokens, t.tokens AS template, {_PATHED} AS source_path FROM r4 r JOIN tpl t USING (word_count, path) JOIN events e ON e.event_id = r.record_id) "


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of twelve-word lines, which go through the online loop."""
    ts = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("record_id"), "ts")
    rows = C.events(spark, sf, C.EVENT).withColumn("source_path", F.expr(_PATHED)).join(ts, "record_id")
    return entries(rows, None, Options(max_children=3), exact=True)


@query(_LONG + "SELECT template_id, array_to_string(list(message ORDER BY record_id)[1:3], '|') AS examples FROM a GROUP BY template_id")
def entry_examples(spark, sf):  # noqa: ANN001, ANN201
    return _entries(spark, sf).select("template_id", F.array_join("examples", "|").alias("examples"))


@query(_LONG + ", s AS (SELECT template_id, unnest(tokens) AS tok, unnest(template) AS lit, CAST(generate_subscripts(tokens, 1) - 1 AS INT) AS pos FROM a) SELECT template_id, pos, n, is_numeric, CASE WHEN is_numeric THEN lo END AS min, CASE WHEN is_numeric THEN p50 END AS p50, CASE WHEN is_numeric THEN hi END AS max, \"distinct\", CASE WHEN NOT is_numeric AND \"distinct\" <= 20 THEN words END AS words FROM (SELECT template_id, pos, count(*) AS n, count(v) = count(*) AS is_numeric, min(v) AS lo, max(v) AS hi, round(quantile_cont(v, 0.5), 6) AS p50, count(DISTINCT tok) AS \"distinct\", string_agg(DISTINCT tok, '|' ORDER BY tok) AS words FROM (SELECT *, try_cast(tok AS DOUBLE) AS v FROM s WHERE lit IS NULL) GROUP BY template_id, pos)")
def entry_slots(spark, sf):  # noqa: ANN001, ANN201
    out = _entries(spark, sf).select("template_id", F.inline("slots"))
    return out.select("template_id", "pos", "n", "is_numeric", "min", F.round("p50", 6).alias("p50"), "max", "distinct", F.array_join("words", "|").alias("words"))


@query(_LONG + "SELECT template_id, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.99), 4) AS p99, min(ts) AS first_seen, max(ts) AS last_seen FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY template_id ORDER BY record_id))) / 1000 AS ms FROM a) GROUP BY template_id")
def entry_times(spark, sf):  # noqa: ANN001, ANN201
    return _entries(spark, sf).select("template_id", F.round("p50", 4).alias("p50"), F.round("p99", 4).alias("p99"), "first_seen", "last_seen")


@query(_LONG + ", p AS (SELECT template_id, source_path AS path, min(record_id) AS first, count(*) AS n FROM a WHERE source_path <> '' GROUP BY 1, 2) SELECT template_id, string_agg(path || ':' || n, '|' ORDER BY first) AS paths FROM p GROUP BY template_id")
def entry_paths(spark, sf):  # noqa: ANN001, ANN201
    return _entries(spark, sf).filter("paths is not null").select("template_id", F.array_join(F.transform("paths", lambda p: F.concat(p["path"], F.lit(":"), p["n"].cast("string"))), "|").alias("paths"))


_THEN, _NOWQ = f"(SELECT * FROM {_SHORT} WHERE record_id % 10 <> 9)", f"(SELECT * FROM {_SHORT} WHERE record_id % 10 = 9)"
_TWO = (
    _routed_sql(_NOWQ, 4, 16)
    + ", cur AS (SELECT template_id, pattern, CAST(sum(count) AS BIGINT) AS count FROM tpl GROUP BY ALL), past AS (SELECT template_id, CAST(sum(count) AS BIGINT) AS past FROM ("
    + _routed_sql(_THEN, 4, 16)
    + "SELECT template_id, count FROM tpl) GROUP BY template_id)"
)


@query(_TWO + """ SELECT template_id, pattern, count, coalesce(past, 0) AS historic_estimate, CASE WHEN past IS NULL THEN 'novelty' WHEN bits >= 3 THEN 'anomaly' WHEN bits >= 1 THEN 'elevated' ELSE 'normal' END AS promotion, round(bits, 6) AS surprise
    FROM (SELECT *, greatest(0.0, log2((count / sum(count) OVER ()) / nullif(past / (SELECT sum(past) FROM past), 0))) AS bits FROM cur LEFT JOIN past USING (template_id))""".replace("round(bits, 6)", "CASE WHEN past IS NOT NULL THEN round(bits, 6) END"))
def condense_with_history(spark, sf):  # noqa: ANN001, ANN201
    """Two runs: the first makes the history of the second."""
    rows, options = C.events(spark, sf, C.SHORT), Options(max_children=16)
    first = condense(rows.filter("record_id % 10 <> 9"), None, options)
    past = score.run_counts(first).withColumnRenamed("count", "past")
    return condense(rows.filter("record_id % 10 = 9"), past, options).select("template_id", "pattern", "count", "historic_estimate", "promotion", _finite())
