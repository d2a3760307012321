import itertools
import os
import random
import zlib

import numpy as np

from quire.llm import sharding


def cheapest(supply, demand, cost):
    """The least cost by trying every split."""
    def go(i, room):
        if i == len(supply):
            return 0
        best = 10**9
        for parts in itertools.product(*(range(min(supply[i], r) + 1) for r in room)):
            if sum(parts) == supply[i]:
                best = min(best, sum(p * c for p, c in zip(parts, cost[i])) + go(i + 1, [r - p for r, p in zip(room, parts)]))
        return best

    return go(0, demand)


def test_flow_is_cheapest():
    rng = random.Random(8)
    for _ in range(40):
        supply = [rng.randint(0, 4) for _ in range(3)]
        demand = [rng.randint(0, 4) for _ in range(3)]
        demand[0] += max(0, sum(supply) - sum(demand))
        cost = np.array([[rng.randint(0, 5) for _ in range(3)] for _ in range(3)])
        flow = sharding.min_cost_flow(supply, demand, cost)
        assert (flow.sum(axis=1) == supply).all() and (flow.sum(axis=0) <= demand).all() and (flow >= 0).all()
        assert (flow * cost).sum() == cheapest(supply, demand, cost.tolist())


def placed(sizes, shards, rng):
    """The plan, and where each file or block of it goes."""
    plan = sharding.plan_transfers(sizes, shards)
    blocks = []
    for i in plan.affected:
        left, b = sizes[i], 0
        while left:
            size = min(left, rng.randint(50, 150))
            blocks.append((i, b, size))
            left, b = left - size, b + 1
    target = sharding.place_blocks(plan, sizes, blocks)
    held = np.zeros(shards, dtype=int)
    for i, size in enumerate(sizes):
        if i not in plan.affected:
            held[plan.homes[i]] += size
    moved = 0
    for i, b, size in blocks:
        held[target[(i, b)]] += size
        moved += size * (target[(i, b)] != plan.homes[i])
    return plan, held, moved


def test_no_more_moves_than_the_flow_and_shards_are_even():
    rng = random.Random(9)
    for sizes in ([4000, 1000, 2500], [9000], [rng.randint(100, 9000) for _ in range(5)], [rng.randint(100, 3000) for _ in range(700)], [0, 5000, 0]):
        plan, held, moved = placed(sizes, 5, rng)
        share = sum(sizes) / 5
        assert held.sum() == sum(sizes) and (np.abs(held - share) <= 150 + sharding.SLACK * share).all()
        own = np.zeros(5)
        for size, j in zip(sizes, plan.homes):
            own[j] += size
        assert abs(plan.moved - np.maximum(0, own - share).sum()) <= 5 + 5 * sharding.SLACK * share
        assert moved <= plan.moved + 5 * 150
        assert len(plan.affected) <= 10


def test_even_shards_are_left_alone():
    plan = sharding.plan_transfers([1000, 1001, 999, 1000], 4)
    assert plan.moved == 0 and plan.affected == [] and plan.settled.all()


def write(spark, docs, folder, parts):
    """docs in as many files, each of the rows that parts gives it."""
    for i, rows in enumerate(parts):
        docs.where(docs.doc_id.isin(list(rows))).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def test_rows_are_whole_and_untouched_files_are_not_written(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, None if i == 7 else "" if i == 8 else "é " * rng.randint(1, 200), i % 3, "x", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _bucket int, Slot string, _file long")
    source = write(spark, docs, f"{tmp_path}/in", [range(0, 90), range(90, 180), range(180, 400)] )
    got_df = sharding.reshard(source, shards=3, blocks=300, folder=f"{tmp_path}/out")
    assert got_df.columns == ["doc_id", "text", "_bucket", "Slot_input", "_file", "shard_size", "shard_crc32", "slot", "old_shard", "shard"]
    got = got_df.toPandas()
    assert sorted(got.doc_id) == list(range(400))
    by_id = {r[0]: r for r in rows}
    for r in got.itertuples():
        raw = (by_id[r.doc_id][1] or "").encode()
        assert (r.shard_size, r.shard_crc32, r.text) == (len(raw) + 16, zlib.crc32(raw), by_id[r.doc_id][1])
        assert (r._3, r.Slot_input, r._5) == by_id[r.doc_id][2:]
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = got.groupby("shard").shard_size.sum()
    assert sizes.max() - sizes.min() <= got.shard_size.max() + 3 * sharding.SLACK * sizes.mean()
    told = spark.read.parquet(f"{tmp_path}/out/summary").first()
    assert told.affected == 1 and told.files == 3 and abs(told.moved - told.least) <= 3 * got.shard_size.max()
    alone = spark.read.parquet(f"{tmp_path}/out/manifest").toPandas()
    assert len(alone) == 2 and told.rewritten == got[~got.old_shard.isin(alone.old_shard)].shard_size.sum()
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == len(got[~got.old_shard.isin(alone.old_shard)])


def test_many_small_files_one_empty_table_and_repeated_rows(spark, tmp_path):
    docs = spark.range(3000).selectExpr("if(id % 10 = 0, null, id % 50) as doc_id", "repeat('ab ', cast(id % 40 as int)) as text")
    docs.repartition(60).write.parquet(f"{tmp_path}/many")
    got = sharding.reshard(spark.read.parquet(f"{tmp_path}/many"), folder=f"{tmp_path}/out").toPandas()
    assert len(got) == 3000
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = got.groupby("shard").shard_size.sum()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 0.35 * sizes.mean()  # repeated rows are one block
    docs.limit(0).write.parquet(f"{tmp_path}/none")
    assert sharding.reshard(spark.read.parquet(f"{tmp_path}/none")).count() == 0


def test_the_query_has_even_shards(spark, sf_dir):
    from quire.llm import queries

    got = queries.op7_resharding(spark, sf_dir).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 200 and sizes.max() - sizes.min() <= got["size"].max() and os.path.exists(sf_dir)
