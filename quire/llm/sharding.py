"""Resharding by minimum-cost flow: from old shard sizes and new capacities to block transfers that move the
fewest bytes, then the rewrite of the files concerned.

An old shard is one input file. File i stays at home in shard i; a file beyond the number of shards is at home in
the shard that holds least when it comes, in falling size, for a shard may consist of several files and a file that
changes its number alone moves nothing. A flow network joins homes to shards: a byte that stays costs nothing, a
byte that moves costs one, capacities are the shards' equal shares. Files of one home have the same costs, so they
are one source and the network has SHARDS sources whatever the number of files. Successive shortest paths solve it.

What leaves a home is taken from its greatest files, as few as hold it. Only these files are affected: their rows
fall into hash blocks, BLOCKS in all, the flow is filled with whole blocks, and the last differences are evened out
by the smallest moves. Affected files are rewritten without what leaves, and what moves is written beside the
files of its new shard; no other file is read for the rewrite or written. The manifest names the files left alone.

Law: `bytes` (sizes near equal: to SLACK of the share where a shard is left alone, else to about one block or one
document, whichever is greater).

On the driver: one row a file (as Spark's own listing has), the sizes of at most BLOCKS blocks, two arrays of SHARDS
by SHARDS. Tasks hold blocks of one shard; they are dealt to partitions by number, not by hash.

Results: null text has size 16 and the checksum of an empty text. A null doc_id is dealt by its text. Repeated
rows share a block. A very long text is one row of its block. An empty table gives no rows. Columns of the input
that have the name of a result get the suffix _input; any other name is kept.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import scratch_path

SHARDS, BLOCKS, ROW_BYTES, SLACK = 40, 10_240, 16, 0.002
RESULTS = ("shard", "slot", "shard_size", "shard_crc32", "old_shard")


def min_cost_flow(supply: list[int], demand: list[int], cost: np.ndarray) -> np.ndarray:
    """The cheapest flow from sources to sinks (dense costs, total supply <= total demand) by successive shortest paths.

    Distances over the residual network are found by relaxing whole cost matrices; each augmentation empties a
    source, fills a sink or cancels a flow."""
    supply_left, demand_left = np.array(supply, dtype=np.int64), np.array(demand, dtype=np.int64)
    flow = np.zeros(cost.shape, dtype=np.int64)
    far = np.int64(1) << 50
    cost = cost.astype(np.int64)
    while supply_left.any():
        left = np.where(supply_left > 0, 0, far)
        right = np.full(len(demand_left), far)
        from_left = np.full(len(demand_left), -1)
        from_right = np.full(len(supply_left), -1)
        while True:  # Bellman-Ford on the bipartite residual graph
            offer = left[:, None] + cost
            by = offer.argmin(axis=0)
            new = offer[by, np.arange(len(right))]
            better = new < right
            right, from_left = np.where(better, new, right), np.where(better, by, from_left)
            back = np.where(flow > 0, right[None, :] - cost, far)
            by = back.argmin(axis=1)
            new = back[np.arange(len(left)), by]
            worse = new < left
            left, from_right = np.where(worse, new, left), np.where(worse, by, from_right)
            if not better.any() and not worse.any():
                break
        reach = np.where(demand_left > 0, right, far)
        sink = int(reach.argmin())
        if reach[sink] >= far:
            raise ValueError("demand is less than supply")
        path, j, amount = [], sink, int(demand_left[sink])
        while True:
            i = int(from_left[j])
            path.append((i, j, 1))
            if from_right[i] < 0:
                amount = min(amount, int(supply_left[i]))
                source = i
                break
            j = int(from_right[i])
            amount = min(amount, int(flow[i, j]))
            path.append((i, j, -1))
        for i, j, sign in path:
            flow[i, j] += sign * amount
        supply_left[source] -= amount
        demand_left[sink] -= amount
    return flow


@dataclass
class Transfers:
    """What moves: by home and shard the bytes, the home of each file, the affected files, the shards left as they are."""

    flow: np.ndarray
    homes: list[int]
    affected: list[int]
    settled: np.ndarray

    @property
    def moved(self) -> int:
        return int(self.flow.sum() - np.trace(self.flow))


def plan_transfers(sizes: list[int], shards: int, slack: float = SLACK) -> Transfers:
    """The cheapest flow from files of these sizes to equal shards, and the files it has to touch."""
    homes = list(range(min(len(sizes), shards))) + [0] * max(0, len(sizes) - shards)
    held = np.zeros(shards, dtype=np.int64)
    held[: len(sizes[:shards])] = sizes[:shards]
    least = [(int(h), j) for j, h in enumerate(held)]
    heapq.heapify(least)
    for i in sorted(range(shards, len(sizes)), key=lambda i: (-sizes[i], i)):
        size, j = heapq.heappop(least)
        homes[i] = j
        heapq.heappush(least, (size + sizes[i], j))
        held[j] += sizes[i]
    share = held.sum() / shards
    settled = np.abs(held - share) <= slack * share
    open_ = np.flatnonzero(~settled)
    demand = held.copy()
    if len(open_):
        rest = int(held[open_].sum())
        demand[open_] = [rest // len(open_) + (k < rest % len(open_)) for k in range(len(open_))]
    flow = min_cost_flow(held.tolist(), demand.tolist(), 1 - np.eye(shards, dtype=np.int64))
    affected = []
    by_home: list[list[int]] = [[] for _ in range(shards)]
    for i, j in enumerate(homes):
        by_home[j].append(i)
    for j in range(shards):
        out = int(flow[j].sum() - flow[j, j])
        for i in sorted(by_home[j], key=lambda i: (-sizes[i], i)):
            if out <= 0:
                break
            affected.append(i)
            out -= sizes[i]
    return Transfers(flow, homes, sorted(affected), settled)


def place_blocks(plan: Transfers, sizes: list[int], blocks: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """(file, bucket) -> shard, for the blocks (file, bucket, bytes) of the affected files."""
    shards = len(plan.flow)
    held = np.zeros(shards, dtype=np.int64)
    touched = set(plan.affected)
    for i, j in enumerate(plan.homes):
        if i not in touched:
            held[j] += sizes[i]
    target: dict[tuple[int, int], int] = {}
    by_home: list[list[tuple[int, int, int]]] = [[] for _ in range(shards)]
    for i, bucket, size in blocks:
        by_home[plan.homes[i]].append((size, i, bucket))
    stay = held.copy()
    for home, own in enumerate(by_home):
        wanted = plan.flow[home].astype(np.int64).copy()
        wanted[home] -= stay[home]
        for size, i, bucket in sorted(own, reverse=True):  # the greatest blocks first, to where most is still wanted; home wins ties
            j = int(wanted.argmax())
            if wanted[home] == wanted[j]:
                j = home
            target[(i, bucket)] = j
            wanted[j] -= size
            held[j] += size
    even_out(blocks, target, held, plan.settled)
    return target


def even_out(blocks: list[tuple[int, int, int]], target: dict[tuple[int, int], int], held: np.ndarray, settled: np.ndarray | None = None) -> None:
    """Move the block that most reduces the gap between the fullest and the emptiest shard, as long as one does; each move lessens the sum of squares, so it ends."""
    members: list[dict[tuple[int, int], int]] = [{} for _ in held]
    for old, bucket, size in blocks:
        members[target[(old, bucket)]][(old, bucket)] = size
    open_ = np.flatnonzero(~settled) if settled is not None else np.arange(len(held))
    while len(open_) > 1:
        high, low = int(open_[held[open_].argmax()]), int(open_[held[open_].argmin()])
        gap = int(held[high] - held[low])
        fits = [(abs(gap - 2 * size), key) for key, size in members[high].items() if 0 < size < gap]
        if not fits:
            return
        _, key = min(fits)
        size = members[high].pop(key)
        members[low][key] = size
        target[key] = low
        held[high] -= size
        held[low] += size


def _dealt(spark: SparkSession, n: int) -> list[int]:
    """For each partition number below n an integer that Spark's hash partitioning puts there."""
    found = spark.range(n * (16 + 2 * math.ceil(math.log(n + 1)))).select(F.col("id").cast("int").alias("x")).groupBy(F.expr(f"pmod(hash(x), {n})").alias("p")).agg(F.min("x").alias("x")).collect()  # n rows
    place = {r.p: r.x for r in found}
    return [place.get(p, p) for p in range(n)]


def reshard(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, folder: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Bring docs, read from files and with nothing but columns dropped since, to `shards` shards and return all rows.

    Columns: those of docs (one that has the name of a result gets the suffix _input), and shard_size, shard_crc32,
    shard, slot (gapless in each shard), old_shard (the number of the file, in order of names). In `folder`: rows/
    with one directory a shard for what was rewritten, manifest/ with a row a file left alone (shard, path, first
    slot, rows, bytes) and summary/ with the bytes moved, the least that had to move, and the bytes rewritten."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "shards")
    taken = {c.lower() for c in docs.columns} | set(RESULTS)
    columns = {}
    for c in docs.columns:
        columns[c] = c
        while columns[c].lower() in RESULTS or (columns[c] != c and columns[c].lower() in taken):
            columns[c] += "_input"
        taken.add(columns[c].lower())
    text, key = columns[text], columns[key]
    names = []
    for name in ("file", "bucket", "first", "lane", "crc", "row"):
        while (name := f"_{name}").lower() in taken:
            pass
        names.append(name)
    file_, bucket, first, lane, crc, row = names
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()], F.col("_metadata.file_path").alias(file_), F.col("_metadata.row_index").alias(row))
    sized = named.withColumn("shard_size", F.length(raw).cast("long") + ROW_BYTES)
    listed = sorted((tuple(r) for r in sized.groupBy(file_).agg(F.sum("shard_size"), F.count("*")).collect()))
    sizes = [r[1] for r in listed]
    plan = plan_transfers(sizes, shards)
    touched = [listed[i][0] for i in plan.affected]  # at most about two a shard
    number = {listed[i][0]: i for i in plan.affected}
    # the files left alone, first in their shards, by number
    filled = [0] * shards
    kept = []
    for i, (path, size, count) in enumerate(listed):
        if path not in number:
            kept.append((path, i, plan.homes[i], filled[plan.homes[i]], count, size))
            filled[plan.homes[i]] += count
    # the blocks of the affected files
    buckets = max(1, blocks // max(1, len(touched)))
    moving = sized.where(F.col(file_).isin(touched)).withColumn(bucket, F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.crc32(raw).cast("string")), F.lit(5)), F.lit(buckets)).cast("int"))
    found = [tuple(r) for r in moving.groupBy(file_, bucket).agg(F.sum("shard_size"), F.count("*")).collect()] if touched else []  # at most BLOCKS rows, or one an affected file
    target = place_blocks(plan, sizes, [(number[f], b, s) for f, b, s, _ in found])
    counts = {(number[f], b): n for f, b, _, n in found}
    rows, rewritten, moved = [], 0, 0
    for (i, b), j in sorted(target.items()):
        rows.append((listed[i][0], b, i, j, filled[j]))
        filled[j] += counts[(i, b)]
    for f, b, s, _ in found:
        rewritten += s
        moved += s * (target[(number[f], b)] != plan.homes[number[f]])
    # a task holds whole blocks of one shard, several tasks a shard where there are more tasks than shards
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, round(parallel / shards))
    deal = _dealt(spark, shards * lanes) if rows else []
    placed_rows = [(f, b, i, j, at, deal[j * lanes + b % lanes]) for f, b, i, j, at in rows]
    where = spark.createDataFrame(placed_rows, f"`{file_}` string, `{bucket}` int, old_shard int, shard int, `{first}` long, `{lane}` int")
    if len(placed_rows) <= 4 * BLOCKS:  # counted, not guessed: the texts needn't be shuffled for the join
        where = F.broadcast(where)
    order = Window.partitionBy(lane, file_, bucket).orderBy(F.col(f"`{key}`"), crc)
    out = moving.withColumn(crc, F.crc32(raw)).join(where, [file_, bucket]).repartition(shards * lanes, lane).withColumn("slot", F.col(first) + F.row_number().over(order) - 1)
    result = [F.col(f"`{c}`") for c in columns.values()]
    out = out.select(*result, "shard_size", F.col(crc).alias("shard_crc32"), "slot", "old_shard", "shard")
    out.write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/rows")
    stays = spark.createDataFrame(kept, "path string, old_shard int, shard int, first_slot long, rows long, bytes long")
    stays.write.mode("overwrite").parquet(f"{folder}/manifest")
    least = plan.moved
    spark.createDataFrame([(moved, least, rewritten, sum(sizes), len(touched), len(listed))], "moved long, least long, rewritten long, bytes long, affected int, files int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/summary")
    written = spark.read.schema(out.schema).parquet(f"{folder}/rows") if rows else out.limit(0)
    left = stays.select(F.col("path").alias(file_), "old_shard", "shard", F.col("first_slot").alias(first))
    alone = sized.where(~F.col(file_).isin(touched)) if touched else sized
    alone = alone.join(left, file_).select(*result, "shard_size", F.crc32(raw).alias("shard_crc32"), (F.col(first) + F.col(row)).alias("slot"), "old_shard", "shard")
    return written.unionByName(alone) if kept else written
