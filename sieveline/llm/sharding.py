"""Resharding by minimum-cost flow.

Documents lie in old shards and are to lie in new ones of equal capacity.  Every old shard is cut into at most
`BLOCKS` blocks by a hash of ids and texts; the sizes of the blocks are the only thing the driver sees, at most
`n_old * BLOCKS` rows whatever the input.  On the graph source - old shards - new shards - sink a byte that
leaves its shard costs one (or what `cost` says), and successive shortest paths find the transfers that move the
fewest bytes.  Whole blocks then fill the transfers, largest first, and a last pass trades blocks between the
fullest and the emptiest shard as long as that evens them out.

Defined cases: a null text counts as empty (size 1, checksum 0); rows with a null id go by their
texts; repeated rows are rows of their own, in any order among themselves; an empty table gives an
empty result; reshard() reads no columns of the input other than id, text and old shard, rewrite() carries all.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import Scratch, remove

BLOCKS = 4096
#: Bytes of text in a file that rewrite() makes, about.
FILE_BYTES = 16 << 20


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Cheapest flow of all supply into the capacities, by successive shortest paths (Dijkstra with potentials)."""
    n, m = len(supply), len(capacity)
    s, t = n + m, n + m + 1
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, c: int, w: int) -> None:
        for x, y, r, p in ((a, b, c, w), (b, a, 0, -w)):
            at[x].append(len(to))
            to.append(y), room.append(r), price.append(p)

    for i, x in enumerate(supply):
        edge(s, i, x, 0)
        for j in range(m):
            edge(i, n + j, x, cost(i, j))
    for j, x in enumerate(capacity):
        edge(n + j, t, x, 0)
    potential = [0] * (n + m + 2)
    while True:
        best, by = {s: 0}, {}
        heap, closed = [(0, s)], set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in closed:
                continue
            closed.add(x)
            for e in at[x]:
                if room[e] and (w := d + price[e] + potential[x] - potential[to[e]]) < best.get(to[e], 1 << 62):
                    best[to[e]], by[to[e]] = w, e
                    heapq.heappush(heap, (w, to[e]))
        if t not in best:
            break
        for x, d in best.items():
            potential[x] += d
        x, push = t, 1 << 62
        while x != s:
            push, x = min(push, room[by[x]]), to[by[x] ^ 1]
        x = t
        while x != s:
            room[by[x]] -= push
            room[by[x] ^ 1] += push
            x = to[by[x] ^ 1]
    return {(i, to[e] - n): room[e ^ 1] for i in range(n) for e in at[i] if not e & 1 and n <= to[e] < n + m and room[e ^ 1]}


def plan(blocks: Sequence[tuple[int, int, int, int]], n_old: int, n_new: int, cost: Callable[[int, int], int] | None = None) -> tuple[list[tuple[int, int, int, int]], dict[tuple[int, int], int]]:
    """From (old shard, block, bytes, rows) to (old shard, block, new shard, first slot), and the solved transfers in bytes."""
    total = sum(b[2] for b in blocks)
    supply = [0] * n_old
    for old, _, size, _ in blocks:
        supply[old] += size
    capacity = [total // n_new + (j < total % n_new) for j in range(n_new)]
    flow = min_cost_flow(supply, capacity, cost or (lambda i, j: int(i != j)))
    own = defaultdict(list)
    for b in blocks:
        own[b[0]].append(b)
    held: list[dict[tuple[int, int], tuple[int, int]]] = [{} for _ in range(n_new)]
    load = [0] * n_new
    for i, rows in sorted(own.items()):
        need = [(-f, j) for (a, j), f in flow.items() if a == i] or [(0, i % n_new)]
        heapq.heapify(need)
        for old, block, size, count in sorted(rows, key=lambda b: (-b[2], b[1])):
            f, j = need[0]
            heapq.heapreplace(need, (f + size, j))
            held[j][old, block] = size, count
            load[j] += size
    for _ in range(64 * n_new):
        high, low = max(range(n_new), key=load.__getitem__), min(range(n_new), key=load.__getitem__)
        half = (load[high] - load[low]) / 2
        key = min(held[high], key=lambda k: (abs(held[high][k][0] - half), k[0] == high, k), default=None)
        if key is None or held[high][key][0] >= load[high] - load[low]:
            break
        held[low][key] = held[high].pop(key)
        load[high] -= held[low][key][0]
        load[low] += held[low][key][0]
    out = []
    for j, blocks_of in enumerate(held):
        slot = 0
        for (old, block), (_, count) in sorted(blocks_of.items()):
            out.append((old, block, j, slot))
            slot += count
    return out, flow


def _block(doc_id: str, raw: Column, blocks: int) -> Column:
    """By id and text, so that rows with null or repeated ids spread over the blocks unless they are wholly equal."""
    return F.pmod(F.xxhash64(F.col(doc_id), raw), F.lit(blocks)).cast("int")


def reshard(docs: DataFrame, old: Column, *, n_old: int, n_new: int, doc_id: str = "doc_id", text: str = "text", blocks: int = BLOCKS, cost: Callable[[int, int], int] | None = None) -> DataFrame:
    """`doc_id, size, text_crc32, old_shard, block, shard, slot` of every row; `old` gives the old shard, 0 to n_old - 1."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), old.cast("int").alias("old_shard"), _block(doc_id, raw, blocks).alias("block"))
    rows = Scratch(spark, "sharding").table(rows, "rows")
    sizes = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    placed, _ = plan(sorted((r["old_shard"], r["block"], r["b"], r["n"]) for r in sizes), n_old, n_new, cost)
    where = spark.createDataFrame(placed, "old_shard int, block int, shard int, first long")  # at most n_old * blocks rows
    rank = F.row_number().over(Window.partitionBy("old_shard", "block").orderBy("_id", "text_crc32"))
    out = rows.join(F.broadcast(where), ["old_shard", "block"]).withColumn("slot", F.col("first") + rank - 1)
    return out.select(F.col("_id").alias(doc_id), "size", "text_crc32", "old_shard", "block", "shard", "slot")


def rewrite(docs: DataFrame, placed: DataFrame, path: str, *, old: Column | None = None, doc_id: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> list[int]:
    """Write the shards that a transfer touches, as folders shard=N under `path`; return their numbers.

    A shard that neither gives nor receives a block keeps the files it has; one that gives all it has loses its folder.
    Files hold the columns of `docs` and `slot`, in the order of slots; columns `shard` and `slot` of `docs` are replaced.
    `old` and `blocks` are what reshard() got: with them a row finds its block by itself.  Without `old` its old shard is
    looked up by id and text, and rows of one id and text in several old shards are an error.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # the row goes along whole, so its columns can have any names
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), docs[doc_id].alias("_key"), (old if old is not None else F.lit(None)).cast("int").alias("_old"), _block(doc_id, raw, blocks).alias("_block"), (F.octet_length(raw) + 1).cast("long").alias("_size"), F.crc32(raw).alias("_crc"))
    if old is None:
        lies = placed.groupBy(F.col(doc_id).alias("_id"), F.col("size").alias("_s"), F.col("text_crc32").alias("_c")).agg(F.min("old_shard").alias("_least"), F.max("old_shard").alias("_most"))
        lies = Scratch(spark, "sharding").table(lies, "old")
        if not lies.filter("_least <> _most").isEmpty():
            raise ValueError("rows of one id and text lie in several old shards: give `old`")
        rows = rows.join(lies, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_size") == F.col("_s")) & (F.col("_crc") == F.col("_c"))).withColumn("_old", F.col("_least")).drop("_id", "_s", "_c", "_least", "_most")
    plan_ = placed.groupBy("old_shard", "block").agg(F.min("shard").alias("shard"), F.min("slot").alias("first"), F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # at most n_old * blocks rows
    touched = sorted({x for r in plan_ if r["old_shard"] != r["shard"] for x in (r["old_shard"], r["shard"])})
    load, count = defaultdict(int), defaultdict(int)
    for r in plan_:
        load[r["shard"]] += r["b"]
        count[r["shard"]] += r["n"]
    files = {j: -(-b // FILE_BYTES) for j, b in load.items()}
    where = [(r["old_shard"], r["block"], r["shard"], r["first"], r["first"] * files[r["shard"]] // count[r["shard"]]) for r in plan_ if r["shard"] in set(touched)]
    if where:
        at = F.broadcast(spark.createDataFrame(where, "_old int, _block int, _shard int, _first long, _file long"))
        rank = F.row_number().over(Window.partitionBy("_shard", "_file", "_old", "_block").orderBy("_key", "_crc"))
        rows = rows.join(at, ["_old", "_block"]).repartition("_shard", "_file").withColumn("_slot", F.col("_first") + rank - 1)
        out = rows.select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))
        out.sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for j in set(touched) - set(load):
        remove(spark, f"{path}/shard={j}")
    return touched
