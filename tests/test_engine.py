"""Edges that the tables do not hold, plain models, sources, state, rendering, streaming."""

import collections
import gzip
import io
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import detect, drain, fold, jsondoc, parse, prefix, render, score
from sieveline.plans.condense import Options, condense, condense_json, condense_onward, entries, past_of, records, summary
from sieveline.sources import dictionary
from sieveline.sources import lines as L
from sieveline.sources.state import State, project_slug


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(expr("x").alias("y"), "i").orderBy("i").select("y").collect()]


def test_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\rstill two\n\nlast")
    got = [tuple(r) for r in L.read_lines(spark, str(tmp_path / "a.log")).orderBy("line_no").select("line_no", "line").collect()]
    assert got == [(0, "one"), (1, "two\rstill two"), (2, ""), (3, "last")]
    with gzip.open(tmp_path / "b.log.gz", "wb") as f:
        f.write(b"x\ny\n")
    assert [r.line for r in L.read_lines(spark, str(tmp_path / "b.log.gz")).orderBy("line_no").collect()] == ["x", "y"]
    (tmp_path / "empty.log").write_bytes(b"")
    assert L.read_lines(spark, str(tmp_path / "empty.log")).count() == 0


def test_split_file_is_numbered_through(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = L.read_lines(spark, str(tmp_path / "big.log"))
        assert df.filter("line <> concat('line ', line_no)").count() == 0 and df.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("head,mode", [('\ufeff{"a":1}', "json_document"), ("  [2026] x", "json_document"), ("plain\n" + '{"a":1}\n' * 4, "ndjson_log"), ("a\nb\n{", "log"), ("\n \n", "log"), ("", "log")])
def test_mode(spark, head, mode):
    assert col(spark, [head], lambda c: detect.probe_mode(F.col(c))) == [mode]


def test_priority(spark):
    assert col(spark, ["<0>x", "<191>x", "<192>x", "<1234>x", "<007>x", "<>x", "x"], T.is_syslog) == [True, True, False, False, True, False, False]


def test_common_log_bytes(spark):
    line = '1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 {}'
    assert col(spark, [line.format("17"), line.format("-"), line.format("x"), "x"], T.is_common_log) == [True, True, False, False]
    df = spark.createDataFrame([(line.format("17"),), ("junk",)], "line string")
    got = parse.common_log(df).orderBy("was_raw").select("status", "bytes", F.col("ts").cast("string"), "was_raw").collect()
    assert tuple(got[0]) == (200, 17, "2000-10-10 20:55:36", False) and got[1].was_raw


def test_levels(spark):
    assert col(spark, ["Info", "INFO", "WRN", "Warn", "critical", "crit"], T.level) == [None, "INFO", "WARN", None, None, "FATAL"]


def test_classes(spark):
    words = "aaaa " * 11 + "aaaa"  # 59 bytes
    values = [words, words + "a", "a" * 80, words + "a\nb", words + "é", "ab " * 30, "x\x7f" + words + words, "INFO" + " " * 60]
    assert col(spark, values, T.text_class) == ["scalar", "line", "scalar", "multiline", "scalar", "line", "scalar", "line"]


def test_format_at_the_share(spark):
    make = lambda n: spark.createDataFrame([("f", i, "<1>x" if i < n else "plain") for i in range(10)], "file string, line_no int, line string")
    assert detect.detect_format(make(8)) == "syslog" and detect.detect_format(make(7)) == "raw" and detect.detect_format(make(8).limit(0)) == "raw"


def folded(rows, start=None):
    """The sequential rule."""
    out, anchor = [], None
    for line in rows:
        pad = len(line) - len(line.lstrip(" \t\n\f\r"))
        new = anchor is None or (line.startswith(start) if start else line == "" or pad <= anchor)
        if new:
            anchor = pad
            out.append([line])
        else:
            out[-1].append(line)
    return out


@pytest.mark.parametrize("start", [None, "["])
def test_folding(spark, start):
    rng = random.Random(7)
    files = {f"f{k}": [rng.choice(["", " ", "  ", "\t", "[", " ["]) + rng.choice(["", "a", "b"]) for _ in range(rng.randint(0, 12))] for k in range(60)}
    df = spark.createDataFrame([(f, i, x) for f, rows in files.items() for i, x in enumerate(rows)], "file string, line_no long, line string")
    got = {f: [] for f in files}
    for r in fold.fold(df, start).orderBy("file", "record_id").collect():
        got[r.file].append((r.message, r.raw_line))
    assert got == {f: [(x[0], "\n".join(x)) for x in folded(rows, start)] for f, rows in files.items()}
    columns = ["file", "line_no", "begins", "record_id", "byte_offset"]
    whole = {tuple(r) for r in fold.number_records(df, start).select(columns).collect()}
    assert whole == {tuple(r) for r in fold.number_large(df, start, part_lines=3).select(columns).collect()}


class Model:
    """The online tree, message by message."""

    def __init__(self, depth, children, threshold):
        self.depth, self.children, self.threshold = depth, children, threshold
        self.kids, self.leaves, self.order = {}, {}, []

    def add(self, message):
        words = message.split()
        node = (len(words),)
        for w in words[: self.depth]:
            own = self.kids.setdefault(node, {})
            if "L" + w not in own and len([k for k in own if k != "W"]) < self.children:
                own["L" + w] = 1
            node = (*node, "L" + w if "L" + w in own else "W")
        leaf = self.leaves.setdefault(node, [])
        best = None
        for i, (t, _) in enumerate(leaf):
            same = sum(b is None or a == b for a, b in zip(words, t))
            rank = (same / len(t) if t else 1.0, -t.count(None), -i)
            if best is None or rank > best[0]:
                best = rank, i
        if best and best[0][0] >= self.threshold:
            t, n = leaf[best[1]]
            leaf[best[1]] = [a if a == b else None for a, b in zip(words, t)], n + 1
        else:
            leaf.append((list(words), 1))

    def result(self):
        return sorted((" ".join("*" if x is None else x for x in t), n) for own in self.leaves.values() for t, n in own)


@pytest.mark.parametrize("children,depth,longest", [(2, 4, 12), (3, 2, 9), (128, 4, 8)])
def test_mining_against_the_model(spark, children, depth, longest):
    rng = random.Random(children)
    messages = [" ".join(rng.choice("a b c d *".split()) for _ in range(rng.randint(0, longest))) for _ in range(400)]
    model = Model(depth, children, 0.5)
    for m in messages:
        model.add(m)
    df = spark.createDataFrame(list(enumerate(messages)), "record_id long, message string")
    got = sorted((r.pattern, r["count"]) for r in drain.mine(df, depth, children).collect())
    assert got == model.result()


def test_entries_of_leaves_with_several_templates(spark):
    rng = random.Random(9)
    messages = [" ".join(rng.choice("a b c d".split()) for _ in range(9)) for _ in range(200)] + ["x y"] * 5
    rows = [(i, m, f"p{i % 3}", 1_700_000_000 + 10 * i) for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "record_id long, message string, source_path string, seconds long").withColumn("ts", F.timestamp_seconds("seconds")).drop("seconds")
    own = drain.assigned(df, 2, 2).collect()
    assert sorted(r.record_id for r in own) == list(range(205))
    assert all(a is None or a == b for r in own for a, b in zip(r.template, r.message.split(), strict=True))
    model = Model(2, 2, 0.5)
    for m in messages:
        model.add(m)
    patterns = collections.Counter(" ".join(x or "*" for x in r.template) for r in own)
    want = collections.Counter()
    for p, n in model.result():
        want[p] += n
    assert patterns == want
    by = collections.defaultdict(list)
    for r in sorted(own, key=lambda r: r.record_id):
        by[r.template_id].append(r)
    for e in entries(df, None, Options(depth=2, max_children=2, min_cluster_size=4), exact=True).collect():
        mine = by[e.template_id]
        assert e["count"] == len(mine) and e.examples == [r.message for r in mine[:3]]
        assert e.pattern == (mine[0].message if len(mine) < 4 else " ".join(x or "*" for x in mine[0].template))
        assert {p.path: p.n for p in e.paths} == collections.Counter(r.source_path for r in mine)
        spots = [i for i, x in enumerate(mine[0].template) if x is None]
        assert [s.pos for s in e.slots or []] == spots
        assert all(s.words == sorted({r.message.split()[s.pos] for r in mine}) and s.n == len(mine) for s in e.slots or [])
        assert (e.last_seen - e.first_seen).total_seconds() == 10 * (mine[-1].record_id - mine[0].record_id)
    lines = render.render_report(entries(df, None, Options(depth=2, max_children=2)), "x")
    assert any(x.startswith("    slot 3: a") for x in lines) and any(x.startswith("    path: p0 ×") for x in lines)


def test_previous_records_across_spans(spark):
    rng = random.Random(4)
    rows = sorted((i, rng.choice([1, 1, 1, 2, 3]), rng.choice(["a", "b", None])) for i in rng.sample(range(500), 120))
    df = spark.createDataFrame(rows, "record_id long, template_id long, x string")
    seen, want = {}, set()
    for i, t, x in rows:
        want.add((i, seen.get(t)))
        seen[t] = x
    assert {(r.record_id, r.before) for r in render.previous(df, "x", 7).collect()} == want


def test_merge_pass(spark):
    rows = [(1, ["a", "b", "c"], 5, 0, "s"), (2, ["a", "x", "c"], 7, 1, "s"), (3, ["k", "l"], 1, 2, "s"), (4, ["k", "m"], 1, 3, "t")]
    df = spark.createDataFrame(rows, "template_id long, tokens array<string>, count long, first_record_id long, shard string")
    got = lambda **how: sorted((r.pattern, r["count"]) for r in drain.merge_similar(df, **how).collect())
    assert got() == [("a * c", 12), ("k *", 2)]
    assert got(shard="shard") == [("a b c", 5), ("a x c", 7), ("k *", 2)]
    messages = spark.createDataFrame([(0, "go north now"), (1, "go north now"), (2, "go south now"), (3, "stop")], "record_id long, message string")
    assert sorted((r.pattern, r["count"]) for r in condense(messages, None, Options(merge=True)).collect()) == [("go * now", 3), ("stop", 1)]
    assert {(r.pattern, r["count"], len(r.examples)) for r in entries(messages, None, Options(merge=True)).collect()} == {("go * now", 3, 3), ("stop", 1, 1)}


def test_dictionary(spark, tmp_path):
    lines = spark.createDataFrame([(f"service=payments host=db-{i % 7} request {i} took {i * 3} ms",) for i in range(3000)] + [("",), (None,)], "line string")
    made = dictionary.train(lines)
    assert 0 < len(made) <= dictionary.SIZE and dictionary.train(lines) == made
    packed = lines.select("line", dictionary.pack(F.col("line"), made, lines).alias("p"), dictionary.pack(F.col("line"), b"", lines).alias("plain"))
    back = packed.select("line", dictionary.unpack(F.col("p"), made, lines).alias("u"), F.length("p").alias("a"), F.length("plain").alias("b")).collect()
    assert all(r.line == r.u for r in back) and sum(r.a or 0 for r in back) < 0.7 * sum(r.b or 0 for r in back)
    assert dictionary.train(lines.limit(0)) == b""
    state = State(spark, str(tmp_path / "state"), "p")
    assert not state.refresh_dictionary(lines) and state.dictionary() == b""
    run = lambda k, ids: state.append(spark.createDataFrame([(i, str(i), 5) for i in ids], "template_id long, pattern string, count long"), f"r{k}", 1000 + k)
    run(0, [1, 2])
    assert state.refresh_dictionary(lines) and len(state.dictionary()) > 0
    run(1, [1, 2])
    assert not state.refresh_dictionary(lines)
    run(2, [1, 7, 8, 9])  # far from what it was made after
    assert state.refresh_dictionary(lines)


def test_multiline_texts_are_folded(spark):
    text = "NullPointerException: Cannot invoke foo()\\n\\tat com.example.Svc.handle(Svc.java:42)\\n\\tat com.example.Main"
    nodes = jsondoc.walk(spark.createDataFrame([(1, f'{{"error":"{text}","tags":["aaaa aaaa aaaa bbbb bbbb bbbb aaaa bbbb aaaa bbbb aaaa bbbb aaaa","{text}"],"n":3}}')], "doc long, json string"))
    texts = jsondoc.text_records(nodes)
    assert {r.place: {f.key: f.value for f in r.fields} for r in texts.collect()} == {"$.error": {"n": "3"}, "$.tags[0]": {}, "$.tags[1]": {}}
    assert [(r.place, r.message, r.n_lines) for r in jsondoc.fold_texts(texts).orderBy("place").collect()] == [(p, "NullPointerException: Cannot invoke foo()", 3) for p in ("$.error", "$.tags[1]")]


def json_like(rng, depth=0):
    if depth > 4 or rng.random() < 0.35:
        return rng.choice([1, -2.5, True, None, "a", "x,y", 'q"{[\\', "", "}]:,\\\\", "é,中", 10**25])
    if rng.random() < 0.5:
        return [json_like(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {rng.choice(["k", "a,b", 'x"y', "é", ":{", "z"]) + str(i): json_like(rng, depth + 1) for i in range(rng.randrange(5))}


def test_files_cut_anywhere_have_the_same_nodes(spark, tmp_path):
    rng = random.Random(2)
    texts = []
    for k in range(9):
        doc = [json_like(rng) for _ in range(12)]
        texts.append(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": ")])))
    texts += ["", " ", "1", ' "a,b" ', "[1,2", "[1,]", '{"a":1,"b":2,"a":3}', '{"a" 1,"b":2}', "[1}", "[1 2,3]", '{"a":{"b":[1,2,3]},"a.b":[4,5],"x":1}', "[tru,1]", '["a" "b",1]', "[[],[1,[]],{}]", '\ufeff[1,2]']
    for k, t in enumerate(texts):
        (tmp_path / f"{k:03d}.json").write_text(t)
    whole = spark.createDataFrame([(k, t.lstrip("\ufeff")) for k, t in enumerate(texts)], "doc long, json string")
    rows = lambda nodes: sorted(tuple(str(x) for x in r) for r in nodes.withColumn("doc", F.regexp_extract(F.col("doc").cast("string"), "([0-9]+)([.]json)?$", 1).cast("int")).collect())
    for depth, block, split in ((12, 1, "500"), (3, 40, "700"), (12, 4 << 20, "128m")):
        expected = rows(jsondoc.walk(whole, max_depth=depth))
        assert len(expected) > 300
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            assert rows(jsondoc.walk_files(spark, str(tmp_path), depth, block)) == expected
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for k, text in enumerate(("[1,2]\n[3]", "[1,2]]", "[1,2]x")):
        (tmp_path / f"after{k}.json").write_text(text)
    assert jsondoc.walk_files(spark, str(tmp_path / "after*")).count() == 0


def test_large_document_has_the_statistics_of_the_whole(spark, tmp_path):
    doc = {"head": "x", "rows": [{"k": i, "s": ["a"] * (i % 3)} for i in range(500)]}
    for name, text in (("line", json.dumps(doc)), ("pretty", json.dumps(doc, indent=2)), ("rows", '{"head":"x","rows":[' + ",\n".join(json.dumps(r) for r in doc["rows"]) + "]}")):
        (tmp_path / f"{name}.json").write_text(text)
        nodes = jsondoc.walk_files(spark, str(tmp_path / f"{name}.json"), block=100)
        assert {(r.path, r.arrays, r.least, r.most, r.total) for r in jsondoc.array_lengths(nodes).collect()} == {("rows", 1, 500, 500, 500), ("rows[].s", 500, 0, 2, 499)}
        assert {(r.path, r.value, r.n) for r in jsondoc.leaf_scan(nodes, "rows[7].k").collect()} == {("rows[].k", "7", 1)}


def test_walk_at_a_path_equals_the_focus_of_the_whole(spark):
    rng = random.Random(3)
    docs = [json.dumps({"a": [json_like(rng) for _ in range(4)], "it's": {"b": json_like(rng)}, "n": None}) for _ in range(40)] + ["", "[1]", "[tru", '{"a":{"0":1}}', None]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc long, json string")
    nodes = jsondoc.walk(frame, max_depth=5).persist()
    key = lambda df: sorted(map(str, df.select("doc", "place", "path", "parent", "depth", "type", "value", "index", "size").collect()))
    for path in ("a[*]", "a[2]", "a", ".it's.b", "n", "a[*].k0", "a[0][*]", "[0]", "x.y", "a[*][1]"):
        assert key(jsondoc.walk_at(frame, path, max_depth=5)) == key(jsondoc.focus(nodes, path)), path
    plan = jsondoc.walk_at(frame, "a[2]")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # only the nodes below, no walk of the whole
    nodes.unpersist()


def test_sketches_of_runs(spark, tmp_path):
    rows = [(i, json.dumps({"k": i % 3000, "s": f"v{i}", "e": []})) for i in range(6000)]
    nodes = jsondoc.walk(spark.createDataFrame(rows, "doc long, json string").repartition(8))
    state = State(spark, str(tmp_path), "p")
    assert state.sketches().count() == 0
    for k in range(3):
        state.put("sketches", jsondoc.sketches(nodes.filter(F.col("doc") % 3 == k)), f"r{k}")
    got = {r.path: r for r in jsondoc.estimates(state.sketches()).collect()}
    assert abs(got["k"].distinct - 3000) <= 60 and abs(got["s"].distinct - 6000) <= 120
    assert got["k"].n == 6000 and abs(got["k"].p50 - 1500) <= 60 and abs(got["k"].p99 - 2970) <= 60
    assert got["e"].distinct == 0 and got["e"].p50 is None


def test_every_file_has_its_format(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"level":"error","msg":"one two"}\n{"level":"info","msg":"three"}\n')
    (tmp_path / "b.log").write_text("<34>1 2024-10-10T13:55:10Z host app 1 ID1 - hello there\n")
    (tmp_path / "c.log").write_text("plain line one\n  folded\n")
    (tmp_path / "d.log").write_text("")
    rows = records(L.read_lines(spark, str(tmp_path)))
    got = [(r.file[-5:], r.message, r.level) for r in rows.orderBy("record_id").collect()]
    assert got == [("a.log", "one two", "ERROR"), ("a.log", "three", "INFO"), ("b.log", "hello there", got[2][2]), ("c.log", "plain line one", None)]


def test_schema_of_random_keys_is_bounded(spark):
    rows = [(i, json.dumps({"k": i, "m": {f"r{i}a": 1, f"r{i}b": [i]}, **({"rare": 1} if i < 3 else {})})) for i in range(3000)]
    nodes = jsondoc.walk(spark.createDataFrame(rows, "doc long, json string").repartition(8))
    got = {r.path: r for r in jsondoc.bounded_schema(nodes, most=3, tracked=512).collect()}
    assert {p: (r.observed, r.dominant, r.hidden, r.becomes) for p, r in got.items()} == {"": (3000, "object", 3, "<VAR_MAP>"), "k": (3000, "int", 0, None), "m": (3000, "object", 6000, "<VAR_MAP>")}
    assert (got["k"].min, got["k"].max) == (0, 2999)
    whole = jsondoc.bounded_schema(nodes.filter("doc < 20")).drop("hidden", "becomes")
    assert sorted(map(str, whole.collect())) == sorted(map(str, jsondoc.schema(nodes.filter("doc < 20")).select(whole.columns).collect()))


def test_running_sum(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(30), rng.randrange(100), k) for k in range(500)]
    got = prefix.running_sum(spark.createDataFrame(rows, "a long, v long, k long").repartition(7), "v", [F.col("a").desc(), F.col("k")], "upto").collect()
    total, expected = 0, {}
    for a, v, k in sorted(rows, key=lambda r: (-r[0], r[2])):
        total += v
        expected[k] = total
    assert {r.k: r.upto for r in got} == expected
    assert prefix.running_sum(spark.createDataFrame([], "a long, v long"), "v", ["a"], "upto").count() == 0


def test_spooled_input(spark):
    path = L.spool(spark, io.BytesIO(b"one\r\n\ntwo"), size=4)
    assert [(r.line_no, r.line) for r in L.read_lines(spark, path).orderBy("line_no").collect()] == [(0, "one"), (1, ""), (2, "two")]


def test_literal_star_is_no_wildcard(spark):
    ids = col(spark, [["a", "*"], ["a", None]], T.template_id, "array<string>")
    assert ids[0] != ids[1]


def test_surprise_and_promotion(spark):
    rows = [(1, 10, 0, 10), (1, 10, 1, 0), (1, 0, 1, 1), (1, 10, 1, 10), (2, 10, 1, 10), (8, 10, 1, 10), (1, 10, 8, 10)]
    df = spark.createDataFrame(rows, "c long, t long, p long, q long").withColumn("s", score.surprise(F.col("c"), F.col("t"), F.col("p"), F.col("q")))
    got = [(r.s, r.k) for r in df.select("s", score.promotion(F.col("s")).alias("k")).collect()]
    assert got == [(math.inf, "novelty"), (math.inf, "novelty"), (0.0, "normal"), (0.0, "normal"), (1.0, "elevated"), (3.0, "anomaly"), (0.0, "normal")]


def test_sketch(spark):
    rng = random.Random(1)
    counts = {rng.getrandbits(60): rng.randint(1, 99) for _ in range(500)}
    df = spark.createDataFrame(list(counts.items()), "template_id long, count long")
    cells = score.sketch(df)
    column = lambda i, r: (i * score.MULTIPLIERS[r] % 2**64) >> 44
    assert {(r.row, r.col) for r in cells.collect()} == {(r, column(i, r)) for i in counts for r in range(5)}
    assert all(r.estimate >= counts[r.template_id] for r in score.estimate(df, cells).collect())
    top = spark.createDataFrame([(5, 4294967295), (5, 7)], "template_id long, count long")
    assert {r["count"] for r in score.sketch(top).collect()} == {4294967295}


def test_decay_clamps_time(spark):
    got = spark.range(1).select(score.decay_factor(F.lit(0), F.lit(3600)), score.decay_factor(F.lit(168 * 3600), F.lit(0))).first()
    assert got[0] == 1.0 and abs(got[1] - 0.5) < 1e-12


def scored(spark, rows):
    df = spark.createDataFrame(rows, "template_id long, pattern string, count long, promotion string")
    return df.withColumn("promotion_rank", score.promotion_rank(F.col("promotion"))).withColumn("historic_estimate", F.lit(0))


def test_render(spark):
    assert render.render_text(scored(spark, [])) == ["## NEW", "## ANOMALY", "## NORMAL"]
    many = scored(spark, [(i, f"p{i:02d}", 100 - i, "normal") for i in range(51)] + [(90, "e", 1, "elevated"), (91, "n *", 2, "novelty")])
    out = render.render_text(many)
    assert out[:5] == ["## NEW", "[NEW] n * (count: 2)", "## ANOMALY", "## NORMAL", "[ELEVATED] e (count: 1)"]
    assert out[5] == " p00 (count: 100)" and out[-1] == "2 normal patterns omitted for brevity" and len(out) == 4 + 50 + 1
    assert "(1 more templates)" in "\n".join(render.render_report(many, "x", 51))
    assert render.render_human(many)[1].startswith("\x1b[")


def test_budget_keeps_new_ones(spark):
    df = scored(spark, [(1, "x" * 400, 1, "novelty"), (2, "a", 9, "normal"), (3, "b", 8, "normal")])
    out = summary(df, Options(tokens=5))
    assert out[1].startswith("[NEW]") and out[-1] == "[...truncated: 2 templates omitted]"


def test_three_line_log(spark, tmp_path):
    (tmp_path / "x.log").write_text("".join(f"2026-03-28T14:0{i}:00Z INFO request done host=a latency_ms={i}\n" for i in range(3)))
    rows = records(L.read_lines(spark, str(tmp_path / "x.log")), Options(format="raw"))
    out = summary(condense(rows.select("record_id", "message")))
    assert [x[:5] for x in out] == ["## NE", "[NEW]", "[NEW]", "[NEW]", "## AN", "## NO"]


def test_state(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"), "p")
    assert state.history().count() == 0
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 7)], "template_id long, pattern string, count long")
    state.append(df, "r1", 1000)
    state.append(df, "r1", 1000)  # a repeated run replaces itself
    state.append(df, "r2", 2000)
    assert {(r.template_id, r["count"], r.run_ts) for r in state.history().collect()} == {(1, 5, 1000), (2, 7, 1000), (1, 5, 2000), (2, 7, 2000)}
    assert {r.past for r in past_of(state.history(), 2000, Options(history_runs=1)).collect()} == {5, 7}
    assert State(spark, str(tmp_path / "state"), "other").history().count() == 0
    state.reset()
    assert state.history().count() == 0
    assert project_slug("/a") == project_slug("/a") != project_slug("/b")


def test_walk_edges(spark):
    docs = [(1, '{"a":[1,1.0,1.5,true,null,"s",{"b":[]},[2]],"big":12345678901234567890}'), (2, "not json {"), (3, None), (4, "5")]
    nodes = jsondoc.walk(spark.createDataFrame(docs, "doc long, json string"))
    got = {(r.place, r.type) for r in nodes.filter("doc = 1").collect()}
    assert {("$", "object"), ("$.a", "array"), ("$.a[0]", "int"), ("$.a[2]", "float"), ("$.a[3]", "bool"), ("$.a[4]", "null"), ("$.a[5]", "string"), ("$.a[6].b", "array"), ("$.a[7][0]", "int"), ("$.big", "int")} <= got
    assert nodes.filter("doc in (2, 3)").count() == 0 and nodes.filter("doc = 4").first().type == "int"
    assert [r.place for r in jsondoc.focus(nodes, "a[7]").orderBy("place").collect()] == ["$.a[7]", "$.a[7][0]"]
    assert jsondoc.steps("a[*].b[2].c") == ["a", None, "b", 2, "c"]
    with pytest.raises(ValueError):
        jsondoc.steps("a[?]")


def test_depth_limit(spark):
    deep = "{" + '"k":{' * 13 + '"x":1,"y":2' + "}" * 14
    nodes = jsondoc.walk(spark.createDataFrame([(1, deep)], "doc long, json string"))
    assert nodes.agg(F.max("depth")).first()[0] == 12


def test_tie_goes_to_the_later_type(spark):
    nodes = jsondoc.walk(spark.createDataFrame([(1, '{"k":1}'), (2, '{"k":"a"}')], "doc long, json string"))
    assert {r.path: r.dominant for r in jsondoc.dominant(jsondoc.type_counts(nodes)).collect()}["k"] == "string"


def test_tiers(spark):
    df = spark.createDataFrame([(81, 100), (80, 100), (20, 100), (19, 100), (0, 0)], "a long, b long")
    assert [r[0] for r in df.select(T.key_tier("a", "b")).collect()] == ["common", "partial", "partial", "polymorphic", "common"]


def test_json_run(spark):
    text = "Error at start of a long line\\n\\tat com.example.Svc.handle(Svc.java:42) and so on it goes"
    nodes = jsondoc.walk(spark.createDataFrame([(1, f'{{"r":[{{"m":"{text}"}},{{"m":"{text}"}}]}}')], "doc long, json string"))
    out = condense_json(nodes)
    assert {r.path for r in jsondoc.schema(nodes).collect()} == {"", "r", "r[]", "r[].m"}
    assert [(r.pattern, r["count"], [(p.path, p.n) for p in r.paths]) for r in out.collect()] == [("Error at start of a long line", 2, [("r[].m", 2)])]


def test_json_run_walks_documents_once(spark):
    walked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        walked.add(1)
        return text

    line = "ERROR was sent to {} with the payload that follows of kind some other word"
    docs = [(k, json.dumps({"log": line.format(k)} if k % 3 else {"trace": line.format(k) + "\n\tat com.example.Main"})) for k in range(30)]
    rows = spark.createDataFrame(docs, "doc long, json string").withColumn("json", counted.asNondeterministic()("json"))
    out = condense_json(jsondoc.walk(rows), None, Options(entropy_threshold=8.0)).collect()
    pattern = line.format("*")
    assert {(r.pattern, r["count"], tuple(sorted((p.path, p.n) for p in r.paths))) for r in out} == {(pattern, 30, (("log", 20), ("trace", 10)))}
    assert walked.value == 30


def test_stream(spark, tmp_path):
    from sieveline.streaming.batches import condense_stream

    (tmp_path / "in").mkdir()
    state = State(spark, str(tmp_path / "state"), "s")
    for k, body in enumerate(["alpha one two\n" * 3, "alpha one two\n" * 2 + "brand new line here\n"]):
        (tmp_path / "in" / f"{k}.log").write_text(body)
        q = condense_stream(spark, str(tmp_path / "in"), state, str(tmp_path / "out"), str(tmp_path / "ck"), clock=lambda n: 1000 + n)
        q.awaitTermination(120)
    last = {r.pattern: r.promotion for r in spark.read.parquet(str(tmp_path / "out" / "batch=1")).collect()}
    assert last == {"alpha one two": "normal", "brand new line here": "novelty"}


def several_templates(rng, n=400):
    """Messages of two lengths whose leaves hold several templates that change over time."""
    words = lambda k: [rng.choice("abcdefg") for _ in range(k)]
    return [" ".join([rng.choice(["p", "q", "r", "s", "t"]), *words(rng.choice([3, 4]))]) for _ in range(n)]


def test_evolving_templates_equal_the_loop():
    for seed in range(300):
        rng = random.Random(seed)
        width, least = rng.randrange(6), rng.choice([0.0, 0.3, 0.5, 0.7, 1.0])
        messages = [[rng.choice("abc") for _ in range(width)] for _ in range(rng.randrange(1, 50))]
        templates, chosen = drain.online(messages, least)
        for cut in (0, rng.randrange(len(messages) + 1)):
            now, got = [], []
            for part in (list(enumerate(messages))[:cut], list(enumerate(messages))[cut:]):
                first = {}
                for i, m in part:
                    first.setdefault(tuple(m), i)
                if part:
                    now, since = drain.evolve([list(m) for m in first], list(first.values()), least, now)
                    by = dict(zip(first, since, strict=True))
                    got += [[k for at, k in by[tuple(m)] if at <= i][-1] for i, m in part]
            assert now == templates and got == chosen


def test_a_json_document_is_one_file_when_joins_change(spark, tmp_path):
    """Tables that are larger than a broadcast and in several parts."""
    from sieveline.plans import catalog

    orders = spark.range(120_000).selectExpr("id AS o_orderkey", "id % 1000 AS o_custkey", "concat('p', id % 5) AS o_orderpriority")
    orders.repartition(6).write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        got = {(r.doc, r.path): (r.n, r.size, r.least, r.most) for r in catalog.json_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 3 * 8
    for doc, n in enumerate((50_000, 50_000, 20_000)):
        assert got[doc, "rows"] == (1, n, None, None)
        assert got[doc, "rows[].orderkey"] == (n, None, 50_000 * doc, 50_000 * doc + n - 1)


def test_records_of_order_dependent_leaves(spark):
    messages = several_templates(random.Random(7))
    rows = spark.createDataFrame(list(enumerate(messages)), "record_id long, message string").repartition(5)
    routed = drain.route(drain.tokenised(rows), 2, 2)
    got = {r.record_id: r.template for r in drain.online_assigned(routed, 0.6).collect()}
    leaves = collections.defaultdict(list)
    for r in sorted(routed.collect(), key=lambda r: r.record_id):
        leaves[r.word_count, tuple(r.path)].append(r)
    assert max(len(drain.online([r.tokens for r in own], 0.6)[0]) for own in leaves.values()) > 3
    for own in leaves.values():
        templates, chosen = drain.online([r.tokens for r in own], 0.6)
        assert [got[r.record_id] for r in own] == [templates[c] for c in chosen]


def test_only_messages_that_change_a_template_meet_the_loop(spark):
    """A few records ahead and one template in a list, so that both steps and several lists have something to do."""
    messages = several_templates(random.Random(11))
    rows = spark.createDataFrame(list(enumerate(messages)), "record_id long, message string").repartition(5)
    routed = drain.route(drain.tokenised(rows), 2, 2).persist()
    leaves = collections.defaultdict(list)
    for r in sorted(routed.collect(), key=lambda r: r.record_id):
        leaves[r.word_count, tuple(r.path)].append(r)
    for ahead, page in ((3, 1), (40, 2)):
        templates, owned = drain.evolved(routed, 0.6, ahead=ahead, page=page)
        by = {(r.word_count, tuple(r.path), r.k): r.tokens for r in templates.collect()}
        got = {r.record_id: by[r.word_count, tuple(r.path), r.k] for r in owned.collect()}
        for own in leaves.values():
            expected, chosen = drain.online([r.tokens for r in own], 0.6)
            assert [got[r.record_id] for r in own] == [expected[c] for c in chosen]
    routed.unpersist()
    # what passes is not remembered, only the words of templates are
    leaf = drain.Leaf(3)
    changed = [leaf.take([f"w{i}", "is", "here"], 0.5) for i in range(5000)]
    assert changed == [0, 0, *[None] * 4998] and leaf.template(0) == [None, "is", "here"] and len(leaf.words) == 3


def test_a_batch_looks_again_only_at_what_earlier_templates_lack(spark, monkeypatch):
    frame = lambda part: spark.createDataFrame(part, "record_id long, message string")
    route = lambda part: drain.route(drain.tokenised(frame(part)), 1, 1)
    old = [(i, f"go job {i} ends well") for i in range(30)]
    earlier, _ = drain.evolved(route(old), 0.6)
    seen, owned = [], drain._owned

    def counting(rows, *args):
        seen.append(rows.count())
        return owned(rows, *args)

    monkeypatch.setattr(drain, "_owned", counting)
    now = [(100 + i, f"go job {i} ends well") for i in range(40)] + [(200, "go far away from here"), (201, "go near away from here")]
    templates, records = drain.evolved(route(now), 0.6, earlier, ahead=1)
    assert seen == [42, 2, 42]
    assert sorted(" ".join(t or "*" for t in r.tokens) for r in templates.collect()) == ["go * away from here", "go job * ends well"]
    assert {r["k"]: r["n"] for r in records.groupBy("k").agg(F.count("*").alias("n")).collect()} == {0: 40, 1: 2}


def test_templates_are_named_once_not_for_each_record(spark):
    rows = spark.createDataFrame([(i, f"go job {i} ends well") for i in range(9)], "record_id long, message string")
    own = drain.online_assigned(drain.route(drain.tokenised(rows), 1, 1), 0.6)
    above = own._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]  # what is done to joined records
    assert "md5" not in above
    assert {tuple(r) for r in own.select("template_id", T.template_id("template")).distinct().collect()} == {(own.first().template_id,) * 2}


def test_batches_give_the_templates_of_one_run(spark, tmp_path):
    from sieveline.sources.state import BEGINNINGS, LEAVES
    from sieveline.streaming.batches import advance, templates_of

    rng = random.Random(9)
    messages = several_templates(rng) + [f"job {i} done" for i in range(60)] + ["", "one"] + several_templates(rng, 200)
    rng.shuffle(messages)
    frame = lambda part: spark.createDataFrame(part, "record_id long, message string")
    numbered = list(enumerate(messages))
    options = Options(depth=2, max_children=3, sim_threshold=0.6)
    state = State(spark, str(tmp_path), "p")
    for k, (a, b) in enumerate([(0, 150), (150, 400), (400, len(messages))]):
        mined = advance(frame(numbered[a:b]), state.before("beginnings", BEGINNINGS, f"b{k}"), state.latest("leaves", LEAVES, f"b{k}"), options)
        assert mined.templates.agg(F.sum("count")).first()[0] == b - a
        state.put("beginnings", mined.beginnings, f"b{k}")
        state.put("leaves", mined.leaves, f"b{k}")
    key = lambda df: sorted((r.pattern, r["count"], r.first_record_id) for r in df.collect())
    whole = drain.mine(frame(numbered), 2, 3, 0.6).groupBy("template_id", "pattern").agg(F.sum("count").alias("count"), F.min("first_record_id").alias("first_record_id"))
    assert key(templates_of(state.latest("leaves", LEAVES, "b9"))) == key(whole)


def test_templates_go_on(spark):
    first = spark.createDataFrame([(i, f"job {i} done") for i in range(5)] + [(9, "a * b"), (10, "")], "record_id long, message string")
    old = condense(first, None, Options(max_children=2)).select("template_id", "pattern", "count")
    assert sorted(r.pattern for r in old.collect()) == ["", "a * b", "job * done", "job 0 done", "job 1 done"]
    second = spark.createDataFrame([(0, "job 0 done"), (1, "job 77 done"), (2, "a x b"), (3, "a * b"), (4, "job 5 failed"), (5, ""), (6, "job 78 done")], "record_id long, message string")
    got = condense_onward(second, old, old.select("template_id", F.col("count").alias("past")), Options(max_children=2))
    assert {(r.pattern, r["count"], r.promotion == "novelty") for r in got.collect()} == {("job 0 done", 1, False), ("job * done", 2, False), ("a * b", 1, False), ("a x b", 1, True), ("job 5 failed", 1, True), ("", 1, False)}


def test_command_line(spark, tmp_path):
    from sieveline.__main__ import run

    log = tmp_path / "a.log"
    log.write_text("".join(f"job {i} done in time\n" for i in range(200)) + "  trace\nodd line here\n")
    state = ["--state-dir", str(tmp_path / "state"), "--project", "p"]
    first = run(spark, [str(log), *state, "--max-children", "3", "-v"])
    assert first[0] == "## NEW" and any("[NEW] job * done in time (count: 197)" in x for x in first) and "records: 201" in first
    log.write_text("".join(f"job {i} done in time\n" for i in range(3, 200)))
    again = run(spark, [str(log), *state, "--max-children", "3", "-f", "json"])
    assert any('"historic_estimate":196' in x or '"historic_estimate":197' in x for x in again)  # seconds passed, and decay cuts
    assert run(spark, [str(log), "--no-state", "-f", "raw"])[0].startswith('{"file"')
    assert run(spark, [str(log), "--no-state", "-f", "json", "-o", str(tmp_path / "out")]) == []
    assert spark.read.text(str(tmp_path / "out")).count() == len(run(spark, [str(log), "--no-state", "-f", "json"])) > 0
    assert '"examples":["job 131 done in time",' in run(spark, [str(log), "--no-state", "-f", "json", "--examples"])[0]
    assert run(spark, [str(log), *state, "--reset-state"]) == [] and run(spark, [str(log), *state, "--max-children", "3"])[1].startswith("[NEW]")
    doc = tmp_path / "d.json"
    doc.write_text('{"rows":[\n{"k":1,"s":"a"},\n{"k":2,"s":"b"}]}')
    out = run(spark, [str(doc), "--no-state"])
    assert any(x.startswith("rows[].k: int ×2") for x in out)
    assert run(spark, [str(doc), "--no-state", "--schema-only", "--json-path", "rows[*].s"]) == ["rows[].s: a ×1", "rows[].s: b ×1"]
