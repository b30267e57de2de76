"""JSON documents: the walk over paths, types and values, schema statistics, arrays, text, tiers, focus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources import jsonparts
from . import fold

#: The types in the order that breaks ties (the later one wins), greatest depth, samples, inline elements.
TYPES = ["null", "bool", "int", "float", "string", "object", "array"]
MAX_DEPTH, SAMPLES, INLINE, ARRAY_SAMPLES = 12, 5, 20, 3


def kind(v: Column) -> Column:
    """The type of a scalar variant; a decimal without a fraction that is too long for a long is an integer."""
    s = F.schema_of_variant(v)
    whole = F.regexp_like(s, F.lit(r"^DECIMAL\((19|[23][0-9]),0\)"))
    return F.when(s == "STRING", "string").when(s == "BOOLEAN", "bool").when(s == "VOID", "null").when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | whole, "int").otherwise("float")


def walk(docs: DataFrame, doc: str = "doc", json: str = "json", max_depth: int = MAX_DEPTH) -> DataFrame:
    """`doc, place, path, parent, depth, type, value, index, size`: every node; `place` has array positions, `path` has [] for them,
    `size` is the number of elements or keys.

    A document is parsed once, and its nodes are found level by level within its row: what the last level had is replaced by its
    children, and one explode brings all of them out.  Subtrees below `max_depth` are not entered.
    """
    start = "named_struct('place', '$', 'path', '', 'parent', cast(null as string), 'depth', 0, 'index', cast(null as int), 'v', v)"
    return _nodes(docs.select(F.col(doc).alias("doc"), F.try_parse_json(F.col(json)).alias("v")).filter("v is not null"), start, max_depth)


def walk_parts(values: DataFrame, around: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """walk() of documents that come cut into parts (see sources.jsonparts), with the same result."""
    start = "named_struct('place', place, 'path', path, 'parent', parent, 'depth', depth, 'index', index, 'v', v)"
    inner = _nodes(values.filter(F.col("depth") <= max_depth), start, max_depth)
    outer = around.filter(F.col("depth") <= max_depth).withColumn("value", F.lit(None).cast("string"))
    return inner.unionByName(outer.select(inner.columns))


def walk_files(spark: SparkSession, path: str, max_depth: int = MAX_DEPTH, block: int = jsonparts.BLOCK) -> DataFrame:
    """walk() of files of any size, cut wherever Spark cuts them."""
    return walk_parts(*jsonparts.cut(spark, path, block), max_depth)


def _nodes(rows: DataFrame, start: str, max_depth: int) -> DataFrame:
    node = "struct<place:string,path:string,parent:string,depth:int,index:int,v:variant>"
    children = """concat(
        transform(coalesce(map_entries(try_variant_get(x.v, '$', 'map<string,variant>')), array()),
          e -> named_struct('place', concat(x.place, '.', e.key), 'path', if(x.path = '', e.key, concat(x.path, '.', e.key)), 'parent', x.place, 'depth', x.depth + 1, 'index', cast(null AS int), 'v', e.value)),
        transform(coalesce(try_variant_get(x.v, '$', 'array<variant>'), array()),
          (e, i) -> named_struct('place', concat(x.place, '[', i, ']'), 'path', concat(x.path, '[]'), 'parent', x.place, 'depth', x.depth + 1, 'index', i, 'v', e)))"""
    # sizes come with the nodes: as columns after them they would be computed anew in every filter and condition on a type or value
    elements, keys = (f"cast(size(try_variant_get(x.v, '$', '{t}')) as bigint)" for t in ("array<variant>", "map<string,variant>"))
    nodes = rows.selectExpr(
        "doc",
        f"""inline(aggregate(sequence(1, {max_depth}),
          named_struct('done', cast(array() as array<{node}>), 'front', cast(array({start}) as array<{node}>)),
          (a, d) -> if(size(a.front) = 0, a, named_struct('done', concat(a.done, a.front), 'front', flatten(transform(filter(a.front, x -> x.depth < {max_depth}), x -> {children})))),
          a -> transform(concat(a.done, a.front), x -> named_struct('place', x.place, 'path', x.path, 'parent', x.parent, 'depth', x.depth, 'index', x.index, 'v', x.v, '_a', {elements}, '_o', {keys}))))""",
    )
    scalar = F.col("_a").isNull() & F.col("_o").isNull()
    nodes = nodes.withColumn("type", F.when(F.col("_a").isNotNull(), "array").when(F.col("_o").isNotNull(), "object").otherwise(kind(F.col("v"))))
    return nodes.select("doc", "place", "path", "parent", "depth", "type", F.when(scalar, F.col("v").try_cast("string")).alias("value"), "index", F.coalesce("_a", "_o").alias("size"))


def _type_counts() -> list[Column]:
    return [*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES], F.count("*").alias("observed")]


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("path").agg(*_type_counts())


def dominant(counts: DataFrame) -> DataFrame:
    """The most frequent type of each path."""
    best = F.array_max(F.array(*[F.struct(F.col(f"n_{t}").alias("n"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(TYPES)]))
    return counts.withColumn("dominant", F.when(best["n"] > 0, best["t"]))


def numeric_stats(nodes: DataFrame, exact: bool = False) -> DataFrame:
    x = F.col("value").try_cast("double")
    q = lambda p: F.percentile(x, p) if exact else F.percentile_approx(x, p, F.lit(10000))
    return nodes.filter(F.col("type").isin("int", "float")).groupBy("path").agg(F.count("*").alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), q(0.5).alias("p50"), q(0.99).alias("p99"))


def string_samples(nodes: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first string values of each path, not made distinct, in the order of documents and places."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy("doc", "place"))
    first = nodes.filter("type = 'string'").withColumn("rank", rank).filter(F.col("rank") <= n)
    return first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("samples"))


def cardinality(nodes: DataFrame, exact: bool = False) -> DataFrame:
    """Distinct scalar values of each path; approximate unless asked for exact."""
    scalars = nodes.filter("type not in ('object', 'array', 'null')")
    return scalars.groupBy("path").agg((F.countDistinct("value") if exact else F.approx_count_distinct("value", 0.008)).alias("distinct"))


def array_lengths(nodes: DataFrame) -> DataFrame:
    """Of each array path: arrays, and the least, greatest and summed length."""
    return nodes.filter("type = 'array'").groupBy("path").agg(F.count("*").alias("arrays"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("total"))


def array_samples(nodes: DataFrame, samples: int = ARRAY_SAMPLES, inline: int = INLINE) -> DataFrame:
    """Positions of arrays that a summary shows: all of short ones, else the first, evenly spread ones and the last."""
    n = F.col("n")
    spread = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.floor(k * (n - 1) / max(1, samples - 1)).cast("int"))
    shown = F.when(n <= inline, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array_distinct(spread))
    return nodes.filter("type = 'array' and size > 0").select("doc", F.col("place").alias("array"), F.col("size").alias("n")).withColumn("index", F.explode(shown))


def depth_notes(nodes: DataFrame, limit: int) -> DataFrame:
    """Objects and arrays at the limit, how many keys they hide, and where to look on."""
    note = F.concat(F.lit("[depth limit reached — subtree has "), F.col("size").cast("string"), F.lit(' keys, use --json-path "'), F.col("path"), F.lit('" to expand]'))
    return nodes.filter((F.col("depth") == limit) & (F.col("size") > 0)).select("doc", "place", F.col("size").alias("keys"), note.alias("note"))


def steps(path: str) -> list[str | int | None]:
    """`.key`, `[N]` and `[*]`: keys, numbers, and None for all elements."""
    out: list[str | int | None] = []
    at = 0
    for m in re.finditer(r"\.?([^.\[\]]+)|\[(\*|[0-9]*)\]", path):
        if m.start() != at:
            raise ValueError(f"cannot read the path {path!r} at {at}")
        at = m.end()
        out.append(m[1] if m[1] else None if m[2] in ("*", "") else int(m[2]))
    if at != len(path):
        raise ValueError(f"cannot read the path {path!r} at {at}")
    return out


def focus(nodes: DataFrame, path: str) -> DataFrame:
    """The subtree at a path; [*] and [] stand for every element, [N] for one."""
    pattern = r"^[$]" + "".join(r"\[[0-9]+\]" if s is None else rf"\[{s}\]" if isinstance(s, int) else r"\." + re.escape(s) for s in steps(path)) + r"([.\[].*)?\z"
    return nodes.filter(F.regexp_like("place", F.lit(pattern)))


def leaf_scan(nodes: DataFrame, path: str) -> DataFrame:
    """All values at a path, over every element, without sampling."""
    return value_counts(focus(nodes, path))


def value_counts(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type not in ('object', 'array')").groupBy("path", "value").agg(F.count("*").alias("n"))


def walk_at(docs: DataFrame, path: str, doc: str = "doc", json: str = "json", max_depth: int = MAX_DEPTH) -> DataFrame:
    """focus(walk(docs), path) without the walk: the path becomes a chain of gets, and an explode for each [*]; what is beside it is
    not entered."""
    rows = docs.select(F.col(doc).alias("doc"), F.try_parse_json(F.col(json)).alias("v"), F.lit("$").alias("place"), F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("index"))
    depth = 0
    for step in steps(path):
        depth += 1
        rows = rows.withColumn("parent", F.col("place"))
        if isinstance(step, str):
            plain = not set(step) & set("'\\")
            got = F.try_variant_get("v", f"$['{step}']", "variant") if plain else F.try_element_at(F.try_variant_get("v", "$", "map<string,variant>"), F.lit(step))
            rows = rows.withColumns({"v": got, "place": F.concat("place", F.lit("." + step)), "path": F.when(F.col("path") == "", F.lit(step)).otherwise(F.concat("path", F.lit("." + step))), "index": F.lit(None).cast("int")})
        elif step is None:
            rows = rows.select("doc", "place", "path", "parent", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("index", "v"))
        else:
            rows = rows.withColumns({"v": F.try_variant_get("v", f"$[{step}]", "variant"), "index": F.lit(step)})
        if not isinstance(step, str):
            rows = rows.withColumns({"place": F.concat("place", F.lit("["), F.col("index").cast("string"), F.lit("]")), "path": F.concat("path", F.lit("[]"))})
        rows = rows.filter("v is not null")
    start = f"named_struct('place', place, 'path', path, 'parent', parent, 'depth', {depth}, 'index', index, 'v', v)"
    return _nodes(rows.filter("v is not null").filter(F.lit(depth <= max_depth)), start, max(max_depth, 1))


#: Sketches: 2 ** HLL_BITS registers (a standard error of 0.8 %), and the size of the quantile sketch (a rank error of about 1 %).
HLL_BITS, KLL_SIZE = 14, 400


def sketches(nodes: DataFrame) -> DataFrame:
    """`path, hll, kll`: sketches of the distinct scalars and of the numbers of each path, which merged() puts together over documents, runs
    and batches."""
    scalar = F.when(~F.col("type").isin("object", "array", "null"), F.col("value"))
    number = F.when(F.col("type").isin("int", "float"), F.col("value").try_cast("double"))
    return nodes.groupBy("path").agg(F.hll_sketch_agg(scalar, HLL_BITS).alias("hll"), F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)).alias("kll"))


def merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll", F.lit(KLL_SIZE)).alias("kll"))


def estimates(rows: DataFrame) -> DataFrame:
    """`path, distinct, n, p50, p99` of sketches; `n` counts numbers."""
    n = F.kll_sketch_get_n_double("kll")
    quantile = lambda p: F.when(n > 0, F.kll_sketch_get_quantile_double("kll", F.lit(p)))
    return rows.select("path", F.hll_sketch_estimate("hll").alias("distinct"), n.alias("n"), quantile(0.5).alias("p50"), quantile(0.99).alias("p99"))


def key_tiers(nodes: DataFrame) -> DataFrame:
    """How many of the objects at a path have a key, and the tier that share gives; one pass over the nodes."""
    is_object = F.when(F.col("type") == "object", F.struct(F.col("path").alias("object"), F.lit(None).cast("string").alias("path")))
    is_key = F.when(F.col("index").isNull() & F.col("parent").isNotNull(), F.struct(F.regexp_replace("path", r"\.?[^.\[\]]+\z", "").alias("object"), "path"))
    counts = nodes.select(F.inline(F.filter(F.array(is_object, is_key), lambda x: x.isNotNull()))).groupBy("object", "path").agg(F.count("*").alias("seen"))
    total = F.max(F.when(F.col("path").isNull(), F.col("seen"))).over(Window.partitionBy("object"))  # a row for each key of an object path
    keys = counts.withColumn("total", total).filter("path is not null")
    return keys.withColumn("tier", T.key_tier("seen", "total"))


def type_variance(counts: DataFrame) -> DataFrame:
    """Types of a path other than its dominant one, nulls apart."""
    seen = F.filter(F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"n_{t}").alias("n")) for t in TYPES if t != "null"]), lambda s: s["n"] > 0)
    return dominant(counts).select("path", "dominant", "observed", F.inline(seen)).filter("type <> dominant")


def evict(counts: DataFrame, least_seen: int = 5, least_children: int = 2) -> DataFrame:
    """Rare leaves and inner nodes with few children, which a bounded schema gives up, with what they become."""
    child = counts.filter("path <> ''").withColumn("up", F.regexp_replace("path", r"(\.?[^.\[\]]+|\[\])\z", "")).groupBy("up").agg(F.count("*").alias("children"))
    out = counts.join(child, F.col("path") == F.col("up"), "left").drop("up").na.fill(0, ["children"])
    inner = (F.col("n_object") + F.col("n_array")) > 0
    gone = F.when(inner, F.col("children") < least_children).otherwise(F.col("observed") < least_seen)
    return out.withColumn("evicted", gone).withColumn("becomes", F.when(gone, F.when(F.col("n_object") > 0, "<VAR_MAP>").otherwise("<OPAQUE_JSON>")))


#: Paths that a bounded schema has at most, and those that are tracked while they are counted.
SCHEMA_PATHS, TRACKED = 10_000, 100_000


def frequent_paths(nodes: DataFrame, most: int = SCHEMA_PATHS, tracked: int = TRACKED) -> DataFrame:
    """`path`: the `most` frequent ones, by a summary of bounded size that gives up rare paths while it aggregates.

    A path with more than about 3.5 / `tracked` of all nodes is always among the tracked; with no more paths than that all counts are exact.
    """
    top = nodes.agg(F.expr(f"approx_top_k(path, {int(most)}, {int(tracked)})").alias("top"))
    return top.select(F.explode("top").alias("t")).select("t.item").withColumnRenamed("item", "path").filter("path is not null")


def bounded_schema(nodes: DataFrame, most: int = SCHEMA_PATHS, tracked: int = TRACKED, samples: bool = True) -> DataFrame:
    """schema() of the most frequent paths, with exact statistics, and what stands for their other children: `hidden` counts these, and
    `becomes` is what they are shown as."""
    top = F.broadcast(frequent_paths(nodes, most, tracked))  # at most `most` rows
    above = F.regexp_replace("path", r"(\.?[^.\[\]]+|\[\])\z", "")
    rest = nodes.join(top, "path", "left_anti").filter("path <> ''").select(above.alias("path"), "index").join(top, "path", "left_semi")
    hidden = rest.groupBy("path").agg(F.count("*").alias("hidden"), F.when(F.count("index") == 0, F.lit("<VAR_MAP>")).otherwise(F.lit("<OPAQUE_JSON>")).alias("becomes"))
    return schema(nodes.join(top, "path", "left_semi"), samples).join(hidden, "path", "left").na.fill(0, ["hidden"])


def schema(nodes: DataFrame, samples: bool = True) -> DataFrame:
    """One row for each path with all statistics, in one aggregate; without samples if only the schema is asked for."""
    number = F.when(F.col("type").isin("int", "float"), F.col("value").try_cast("double"))
    scalar = F.when(~F.col("type").isin("object", "array", "null"), F.col("value"))
    q = lambda p: F.percentile_approx(number, p, F.lit(10000))
    stats = [F.min(number).alias("min"), F.max(number).alias("max"), q(0.5).alias("p50"), q(0.99).alias("p99"), F.when(F.count(scalar) > 0, F.approx_count_distinct(scalar, 0.008)).alias("distinct")]
    out = dominant(nodes.groupBy("path").agg(*_type_counts(), *stats))
    return out.join(string_samples(nodes), "path", "left") if samples else out


def schema_depth(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.max(F.size(F.split("path", r"\."))).alias("depth"))


def text_records(nodes: DataFrame, threshold: float = T.DENSE) -> DataFrame:
    """Strings that read like messages, as records: first line, whole text, path, position, and the scalars beside them."""
    strings = nodes.filter("type = 'string'").withColumn("class", T.text_class("value", threshold)).filter("class <> 'scalar'")
    # elements of an array are no fields of one another
    beside = nodes.filter("type not in ('object', 'array') and index is null").groupBy("doc", "parent").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("all"))
    out = strings.join(beside, ["doc", "parent"], "left").withColumn("all", F.when(F.col("index").isNull(), F.col("all")).otherwise(F.expr("cast(array() as array<struct<place:string,value:string>>)")))
    siblings = F.transform(F.filter("all", lambda s: s["place"] != F.col("place")), lambda s: F.struct(F.regexp_extract(s["place"], r"[^.\[\]]+\z", 0).alias("key"), s["value"].alias("value")))
    return out.select("doc", "place", F.col("path").alias("source_path"), F.regexp_extract("place", r"\[([0-9]+)\][^\[]*\z", 1).try_cast("long").alias("json_index"), "class", F.substring_index("value", "\n", 1).alias("message"), F.col("value").alias("raw_line"), siblings.alias("fields"))


def fold_texts(texts: DataFrame) -> DataFrame:
    """Multiline texts folded by indentation: `doc, place, source_path, record_id, message, raw_line, n_lines`, a row for each record of a text."""
    rows = texts.filter("class = 'multiline'").select(F.struct("doc", "place", "source_path").alias("file"), F.posexplode(F.split("raw_line", "\n", -1)).alias("line_no", "line"))
    return fold.fold(rows.withColumn("line_no", F.col("line_no").cast("long"))).select("file.*", "record_id", "message", "raw_line", "n_lines")
