"""Operator 4: shards of near-equal bytes by Karmarkar-Karp differencing.

Documents with equal texts form an indivisible group. Differencing starts from one partial
partition per item and repeatedly combines the two with the largest spread, oppositely
ordered, until one is left. Where there are more than ITEMS groups, tasks difference ITEMS
of them each into LUMPS lumps, which are the next turn's items, until ITEMS or fewer are left
for the shards. Groups over 1 / (HEAVY * shards) of all bytes, of which there are at most
HEAVY * shards, stay whole items to the end, as no lump could balance them. Sums, counts,
lookups and slots are Spark's work on all rows.

Defined results: null text has 8 bytes, crc32 0 and is the group of empty payloads with
text null; repeated rows stay in their text's shard with slots of their own; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Items of one differencing; lumps that a task makes of as many; a group is heavy from total / (HEAVY * shards) bytes on; rows in one numbering run.
ITEMS, LUMPS, HEAVY, RUN_ROWS = 12_000, 240, 32, 20_000


def differencing(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Karmarkar-Karp: (item, size) pairs to item -> shard.

    A partial partition holds `shards` sums, ascending, and for each the tree of items in
    it: a tree is None, an item, or a pair of trees, so combining costs no copying.
    """
    heap, tick = [], 0
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        heap.append((-size, tick, [0] * (shards - 1) + [size], [None] * (shards - 1) + [(item,)]))
        tick += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        merged = sorted(((s + t, i) for i, (s, t) in enumerate(zip(a, reversed(b)))))
        y = y[::-1]
        trees = [x[i] if y[i] is None else y[i] if x[i] is None else (x[i], y[i]) for _, i in merged]
        sums = [s for s, _ in merged]
        low = sums[0]  # only differences matter
        heapq.heappush(heap, (low - sums[-1], tick, [s - low for s in sums], trees))
        tick += 1
    out: dict[int, int] = {}
    for shard, tree in enumerate(heap[0][3] if heap else ()):
        stack = [tree] if tree is not None else []
        while stack:
            node = stack.pop()
            if len(node) == 1:
                out[node[0]] = shard
            else:
                stack += node
    return out


def _lumps(count: int):
    """Numbers a slice's items by the lump that differencing puts them in."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        items, base = table.column("item").to_pylist(), key[0].as_py() * count
        dealt = differencing(list(zip(items, table.column("bytes").to_pylist())), count)
        return pa.Table.from_arrays([table.column("item"), pa.array([base + dealt[i] for i in items], pa.int64())], names=["item", "lump"])

    return run


def shard_by_bytes(docs: DataFrame, shards: int = 24, items_at_once: int = ITEMS, lumps: int = LUMPS) -> DataFrame:
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.xxhash64(text).alias("group_id"),
    )
    rows = cut(rows, "shard-sizes").df
    groups = cut(rows.groupBy("group_id").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups").df
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = F.col("bytes") >= max(1, total // (HEAVY * shards))
    # whose item a group is: its own if heavy, else its lump's of the last turn
    light = groups.where(~heavy).select("group_id", F.col("group_id").alias("item"))
    sizes = groups.where(~heavy).select(F.col("group_id").alias("item"), "bytes", "n")
    while (count := sizes.count()) > items_at_once:
        slices = -(-count // items_at_once)
        sliced = sizes.withColumn("slice", F.expr(f"pmod(xxhash64(item, 7), {slices})"))
        lumped = cut(sliced.select("slice", "item", "bytes").groupBy("slice").applyInArrow(_lumps(lumps), "item long, lump long"), "shard-lumps").df
        light = cut(light.join(lumped, "item").select("group_id", F.col("lump").alias("item")), "shard-items").df
        sizes = cut(sizes.join(lumped, "item").groupBy(F.col("lump").alias("item")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "shard-sums").df
    # at most ITEMS lumps and HEAVY * shards groups
    left = [("l", r.item, r.bytes, r.n) for r in sizes.collect()] + [("g", r.group_id, r.bytes, r.n) for r in groups.where(heavy).collect()]
    left.sort(key=lambda x: x[:2])
    dealt = differencing([(i, x[2]) for i, x in enumerate(left)], shards)
    plan = [(x[0] == "g", x[1], i, dealt[i], max(1, -(-x[3] // RUN_ROWS))) for i, x in enumerate(left)]
    placed = F.broadcast(spark.createDataFrame(plan or [(False, 0, 0, 0, 1)], "heavy boolean, item long, lump int, shard int, runs int").limit(len(plan)))
    both = light.select("group_id", "item", F.lit(False).alias("heavy")).union(groups.where(heavy).select("group_id", "group_id", F.lit(True)))
    where = cut(both.join(placed, ["heavy", "item"]).select("group_id", "lump", "shard", "runs"), "shard-groups-placed").df
    # a group may hold a third of all rows: those of heavy groups, at most HEAVY * shards, are looked up without a shuffle
    few = F.broadcast(where.join(F.broadcast(groups.where(heavy).select("group_id")), "group_id").withColumnsRenamed({"lump": "l", "shard": "s", "runs": "r"}))
    split = rows.join(few, "group_id", "left")
    own = split.where("l is not null").select("row", "doc_id", "size", "text_crc32", F.col("l").alias("lump"), F.col("s").alias("shard"), F.col("r").alias("runs"))
    out = split.where("l is null").join(where, "group_id").select(*own.columns).union(own)
    out = cut(out.withColumn("run", F.expr("cast(pmod(xxhash64(row, 3), runs) as int)")), "shard-rows").df
    # gapless slots: number within runs of bounded length, then add what comes before each run
    counts = out.groupBy("shard", "lump", "run").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("lump", "run", F.expr("sum(n) over (partition by shard order by lump, run rows between unbounded preceding and current row) - n").alias("first"))
    numbered = out.withColumn("nth", F.expr("row_number() over (partition by lump, run order by doc_id, text_crc32, row)"))
    joined = numbered.join(before, ["lump", "run"])
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
