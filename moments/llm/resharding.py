"""Resharding by minimum-cost flow.

The old layout is a table of files, each one block of one old shard. Sizes of old shards and capacities of new ones make
a small transport network, whose cheapest flow moves the fewest bytes. The flow is laid along each old shard's rows as
intervals of bytes, so that every row finds its new shard, and its place in it, from its own block, position and running
size. Blocks that stay whole are left as they are; only the others are read and written again.

Rows come in two classes, those below half of the mean size last: they level out what the larger ones leave, so that the
new shards are equal to within a few small rows. For that, room for two of the largest rows is held back in each shard
for the smaller ones, which may move so much more than the least.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moments.llm.util import Scratch, text_or_empty

SHARDS = 24
BLOCK_BYTES = 16 << 20
#: Blocks grow beyond that rather than be more than about so many, as the driver holds a row for each.
MOST_BLOCKS = 50_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] from old shard i to new shard j: all of the supply at the least total cost (successive shortest paths)."""
    n, m = len(supply), len(capacity)
    end = n + m + 1
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, room, price = [], [], []

    def edge(a: int, b: int, c: int, p: int) -> None:
        for x, y, r, q in ((a, b, c, p), (b, a, 0, -p)):
            graph[x].append(len(to))
            to.append(y), room.append(r), price.append(q)

    for i, s in enumerate(supply):
        edge(0, i + 1, s, 0)
    for i, s in enumerate(supply):
        for j in range(m):
            edge(i + 1, n + 1 + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        edge(n + 1 + j, end, c, 0)
    while True:
        far: list[float] = [float("inf")] * (end + 1)
        far[0], via, queue, queued = 0, [-1] * (end + 1), deque([0]), {0}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in graph[a]:
                if room[e] and far[a] + price[e] < far[to[e]]:
                    far[to[e]], via[to[e]] = far[a] + price[e], e
                    if to[e] not in queued:
                        queue.append(to[e]), queued.add(to[e])
        if via[end] < 0:
            break
        path, a = [], end
        while a:
            path.append(via[a])
            a = to[via[a] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    if any(room[2 * i] for i in range(n)):
        raise ValueError("the capacities don't hold the supply")
    at = 2 * n
    return [[room[at + 2 * (i * m + j) + 1] for j in range(m)] for i in range(n)]


def write_layout(spark: SparkSession, docs: DataFrame, old_shard, scratch: Scratch, shards: int) -> DataFrame:
    """The old files: shard, cls, piece (the block), pos and before (rows and bytes of the block in front), doc_id, text, size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), old_shard.cast("int").alias("old"), (F.octet_length(text_or_empty()) + 8).cast("long").alias("size"))
    per = {r.old: r for r in rows.groupBy("old").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    mean = sum(r.b for r in per.values()) / max(1, sum(r.n for r in per.values()))
    block = max(BLOCK_BYTES, sum(r.b for r in per.values()) // MOST_BLOCKS)
    pieces = F.create_map(*[F.lit(x) for k in range(shards) for x in (k, 1 + (per[k].b if k in per else 0) // block)])
    rows = rows.withColumn("cls", (F.col("size") * 2 < mean).cast("int")).withColumn("piece", F.pmod(F.xxhash64("doc_id", "text"), pieces[F.col("old")]).cast("int"))
    # A block holds about BLOCK_BYTES, so its running sum fits one task. Rows of one id or of none spread by their texts.
    w = Window.partitionBy("old", "cls", "piece").orderBy("doc_id", "size", F.xxhash64("text"))
    placed = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("before", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return scratch.write(placed.withColumn("before", F.coalesce("before", F.lit(0))), "old", "old", "cls", "piece")


def reshard(spark: SparkSession, old: DataFrame, scratch: Scratch, shards: int = SHARDS) -> tuple[DataFrame, dict]:
    """Rows of the new layout (doc_id, text, shard, slot), and what was moved and rewritten.

    The driver holds one row a block and one an interval of the flow: some per gigabyte, none per document.
    """
    blocks = {(r.old, r.cls, r.piece): (r.b, r.n) for r in old.groupBy("old", "cls", "piece").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    largest = old.agg(F.max("size")).first()[0] or 0
    total = sum(b for b, _ in blocks.values())
    goal = [total // shards + (j < total % shards) for j in range(shards)]
    cost = [[int(i != j) for j in range(shards)] for i in range(shards)]
    small = sum(b for (_, c, _), (b, _) in blocks.items() if c)
    spare = min(2 * largest, small // shards)
    left, cuts, moved = list(goal), [], 0
    for cls in (0, 1):
        lines = [sorted((p, b) for (i, c, p), (b, _) in blocks.items() if i == k and c == cls) for k in range(shards)]
        supply = [sum(b for _, b in line) for line in lines]
        room = [max(0, x - spare) if cls == 0 else max(0, x) for x in left]
        room[0] += max(0, sum(supply) - sum(room))
        flow = min_cost_flow(supply, room, cost)
        part = []
        for i, line in enumerate(lines):
            order = [i, *(j for j in range(shards) if j != i)]
            ends, at = [], 0
            for j in order:
                if flow[i][j]:
                    ends.append((at, at + flow[i][j], j))
                    at += flow[i][j]
            moved += supply[i] - flow[i][i]
            base = 0
            for piece, b in line:
                part += [(i, cls, piece, a - base, e - base, j) for a, e, j in ends if a < base + b and e > base]
                base += b
        cuts += part
        if cls == 0:  # what really went where, as rows are whole
            got = _assigned(spark, old.where("cls = 0"), part).groupBy("shard").agg(F.sum("size").alias("b")).collect()
            for r in got:
                left[r.shard] -= r.b
    placed = _assigned(spark, old, cuts)
    runs = [tuple(r) for r in placed.groupBy("old", "cls", "piece", "shard").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).collect()]
    slots, seen = [], dict.fromkeys(range(shards), 0)
    for i, c, p, j, first, n in sorted(runs):
        slots.append((i, c, p, j, seen[j] - first))
        seen[j] += n
    stay = {b for b in blocks if all(r[3] == b[0] for r in runs if r[:3] == b)}
    shift = spark.createDataFrame(slots, "old int, cls int, piece int, shard int, shift long") if slots else spark.createDataFrame([], "old int, cls int, piece int, shard int, shift long")
    out = placed.join(F.broadcast(shift), ["old", "cls", "piece", "shard"]).withColumn("slot", F.col("pos") + F.col("shift"))
    kept = spark.createDataFrame(sorted(stay), "old int, cls int, piece int") if stay else spark.createDataFrame([], "old int, cls int, piece int")
    fields = ["doc_id", "text", "slot"]
    scratch.write(out.join(F.broadcast(kept), ["old", "cls", "piece"], "left_anti").select(*fields, "shard"), "new", "shard")
    schema = out.select(*fields, "shard").schema
    rewritten = scratch.read("new", schema)
    untouched = out.join(F.broadcast(kept), ["old", "cls", "piece"], "left_semi").select(*fields, "shard")
    return rewritten.unionByName(untouched), {"moved_bytes": moved, "total_bytes": total, "blocks": len(blocks), "untouched_blocks": len(stay), "goal": goal}


def _assigned(spark: SparkSession, rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """shard of each row: of the interval that holds its first byte."""
    table = spark.createDataFrame(cuts, "old int, cls int, piece int, a long, e long, shard int") if cuts else spark.createDataFrame([], "old int, cls int, piece int, a long, e long, shard int")
    return rows.join(F.broadcast(table), ["old", "cls", "piece"]).where("before >= a and before < e").drop("a", "e")


def reshard_documents(spark: SparkSession, docs: DataFrame, old_shard, shards: int = SHARDS) -> DataFrame:
    """Puts all documents into shards of nearly equal bytes, moving the fewest bytes from the old ones.

    Reads ``doc_id, text`` and what ``old_shard`` (a column, 0 to shards - 1) needs; other columns are ignored. One row per
    input row, repeated ids included: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, size and checksum taken
    from the rewritten files. A null text has a size of 8 and the checksum of nothing; an empty table gives no rows.
    A row is never cut, so with fewer rows than shards, or rows above the mean, shards can only be as equal as rows allow.
    """
    scratch = Scratch(spark, "reshard")
    new, _ = reshard(spark, write_layout(spark, docs, old_shard, scratch, shards), scratch, shards)
    text = text_or_empty()
    return new.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def source_shard(shards: int = SHARDS):
    """The old law of the query: all documents of a source in one shard."""
    return F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(shards))


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), source_shard())
