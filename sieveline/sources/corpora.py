"""Corpora of log lines and JSON documents derived from the driver's tables, as SQL that Spark and DuckDB both read.

Only integer and string columns are used, for engines print doubles differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import text_lines

EVENT = "concat_ws(' ', upper(event_type), 'user', CAST(user_id AS STRING), 'sent', 'event', 'of', 'kind', event_type, 'with', 'payload', props)"
SHORT = "concat_ws(' ', upper(event_type), 'user', CAST(user_id AS STRING), 'k', props)"
_N = "CAST(user_id % 256 AS STRING)"
_I = "CAST(event_id AS STRING)"
COMMON_LOG = f"concat('10.0.0.', {_N}, ' - user', {_N}, ' [10/Oct/2024:13:55:', CAST(10 + event_id % 50 AS STRING), ' +0000] \"GET /', event_type, '/', {_I}, ' HTTP/1.1\" ', CAST(200 + event_id % 300 AS STRING), ' ', CASE WHEN event_id % 7 = 0 THEN '-' ELSE {_I} END)"
SYSLOG = f"concat('<', CAST(event_id % 200 AS STRING), '>1 2024-10-10T13:55:', CAST(10 + event_id % 50 AS STRING), 'Z host', {_N}, ' ', event_type, ' ', {_I}, ' ID', CAST(event_id % 9 AS STRING), ' - ', event_type, ' by user ', {_N})"
LOGFMT = f"concat('level=', CASE event_id % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' WHEN 3 THEN 'debug' ELSE 'odd' END, ' msg=\"', event_type, ' by user\" host=h', {_N}, ' port=', CAST(event_id % 1000 AS STRING), ' ts=2024-10-10T13:55:00Z')"
NDJSON = f"concat('{{\"level\":\"', CASE event_id % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'ERROR' ELSE 'other' END, '\",\"msg\":\"', event_type, ' by user\",\"host\":\"h', {_N}, '\",\"port\":', CAST(event_id % 1000 AS STRING), '}}')"
HEURISTIC = f"concat(CASE WHEN event_id % 2 = 0 THEN '2024-10-10T13:55:01Z ' ELSE '' END, CASE event_id % 4 WHEN 0 THEN 'ERROR ' WHEN 1 THEN '[warn] ' WHEN 2 THEN 'Notice ' ELSE '' END, 'request ', event_type, ' user=', {_N}, ' done in k=', CAST(event_id % 1000 AS STRING))"
MIXED = f"CASE event_id % 6 WHEN 0 THEN {COMMON_LOG} WHEN 1 THEN {SYSLOG} WHEN 2 THEN {LOGFMT} WHEN 3 THEN {NDJSON} WHEN 4 THEN {HEURISTIC} ELSE {EVENT} END"
PAIRS = "concat_ws(' ', event_type, CAST(event_id % 11 AS STRING), 'at', CASE WHEN event_id % 3 = 0 THEN 'north' ELSE 'south' END)"


def events(spark: SparkSession, sf_dir: str, line: str, name: str = "message") -> DataFrame:
    """`record_id` and one of the expressions above, of every event."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS record_id", f"{line} AS {name}")


def events_sql(line: str, name: str = "message") -> str:
    return f"(SELECT event_id AS record_id, {line} AS {name} FROM events)"


TABLES = {"doc": ("documents", "doc_id", "text"), "chat": ("conversations", "conv_id * 1000 + turn", "text"), "page": ("pages", "page_id", "html")}


def lines(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    table, file, text = TABLES[which]
    return text_lines(spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{file} AS file_no", f"{text} AS body"), "file_no", "body")


def lines_sql(which: str) -> str:
    table, file, text = TABLES[which]
    return f"""(SELECT file, CAST(line_no AS BIGINT) AS line_no, CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS line
      FROM (SELECT file, len(l) AS n, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT {file} AS file, string_split({text}, chr(10)) AS l FROM {table}))
      WHERE line_no < n - 1 OR line <> '')"""


def orders_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each customer with orders: an object that holds an array of objects."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    own = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("priority")))).alias("orders"))
    rows = own.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_custkey").alias("doc"), F.to_json(F.struct(F.col("c_custkey").alias("custkey"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("who"), "orders")).alias("json"))


#: Keys without a value are left out, as Spark's writer does.
ORDERS_JSON_SQL = """(SELECT c_custkey AS doc, CAST('{"custkey":' || c_custkey || ',"who":{"name":"' || c_name || '","segment":"' || c_mktsegment || '"},"orders":[' ||
      string_agg('{"orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '"' || CASE WHEN o_orderkey % 5 = 0 THEN ',"priority":"' || o_orderpriority || '"' ELSE '' END || '}', ',' ORDER BY o_orderkey) || ']}' AS JSON) AS json
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment)"""
