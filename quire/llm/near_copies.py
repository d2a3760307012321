"""Near copies: SimHash by ball hashing first, then every other pair of Jaccard similarity 0.8, exactly.

A text is the set of its shingles of SHINGLE words (lower case in A-Z, hashed to 64 bits); two texts link if
their sets have a similarity of 4/5 or more. Texts with one set are taken together first. A pair becomes a
candidate in one of three ways, and every candidate is verified on the whole sets:

1. SimHash: the fingerprints of 5-word shingles meet on their variants (simhash.links), at 2 bits or fewer. This
   joins most copies, and large groups of them, with few rows.
2. Two sets of similarity 4/5 share one of the first n // 5 + 1 shingles of each in any one order of all shingles,
   its prefix. The order is: rare shingles by their hash, then frequent ones by theirs, so a passage that thousands
   of unlike documents share, or a common phrase, is in no prefix unless four fifths of the document are such. On
   each prefix shingle every set meets the least one, and the one next to it in size.
3. The components of these links are found, and pairs of different components that share a prefix shingle are
   candidates; within a component no pair is needed any more. With this no link between components is lost. The least set
   of a shingle has met all others there and takes no part; of shingles that the same sets have only the first in the
   order is taken; and a pair meets only where enough of both sets comes after, as it does on the first shingle that two
   similar sets share. Pairs whose parity signatures (of one to two bits a shingle) prove them unlike never leave the join, and no candidate that they prove
   unlike is verified.

Frequent is what over GROUP sets have among their least hashes (a quarter more than a prefix, so that most sets know
a whole prefix of rare ones), and what over GROUP of those sets have at all that know too few, unless another set's
prefix holds it. Any choice of the frequent shingles gives the same result; the choice only saves pairs. Sets of a
rare shingle are found by a window over it; those of a frequent one are never brought together but by joins on the
shingle, which Spark splits where they are skewed. Sets are shuffled under 64 bits of their 128-bit name; a collision
there only adds candidates.

Results: word-less texts (null, empty, white space) are one group; a text shorter than the shingle is one shingle;
of each component the document with the smallest doc_id stays (nulls last, then the smallest row key); of rows equal
in id and text one stays. An empty table gives an empty one. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.batches import column, free_name, map_batches, texts_of, with_row_key
from quire.session import Scratch

SHINGLE, GROUP = 5, 16
#: Longs of a set's parity signature at least.
LEAST = 8


def _unique(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.view(np.int64))


def shingle_set(raw: bytes) -> np.ndarray:
    """The sorted different hashes of a text's shingles."""
    return _unique(simhash.shingle_hashes(raw, SHINGLE))


def signature(found: np.ndarray) -> np.ndarray:
    """For each bit the parity of the shingles that hash to it: two sets' signatures differ in no more bits than the sets differ in shingles.

    There are 64 * LEAST bits, or as many as a power of two gives between one and two a shingle; a signature of half the
    length is made by xor of its halves."""
    bits = 64 * LEAST << (len(found) // (64 * LEAST)).bit_length()
    odd = np.bincount((found.view(np.uint64) >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(s) for s in sets])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)))


def _name(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.astype("<i8").tobytes(), 7)


def _id(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, _k (row key), name (128-bit hash of the set), id (64 bits of it), n (its size), least (its n // 5 + 1 least hashes
    and a quarter more), fp (the fingerprint) and sig (the parity signature)."""

    def work(batch: pa.RecordBatch) -> dict:
        hashes = [simhash.shingle_hashes(t, SHINGLE) for t in texts_of(batch)]
        sets = [_unique(h) for h in hashes]
        names = [_name(s) for s in sets]
        fps = np.array([simhash.majority(h) for h in hashes], dtype=np.uint64)
        return {"doc_id": column(batch, "doc_id"), "_k": column(batch, "_k"), "name": names, "id": [_id(x) for x in names], "n": [len(s) for s in sets], "least": _lists([s[: len(s) // 5 + len(s) // 20 + 4] for s in sets]), "fp": pa.array(fps.view(np.int64)), "sig": _lists([signature(s) for s in sets])}

    return map_batches(with_row_key(docs.select("doc_id", "text")), work, "doc_id long, _k binary, name binary, id long, n int, least array<long>, fp long, sig array<long>")


def _whole(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """id, name and whole (the sorted set) of the texts with these row keys."""

    def work(batch: pa.RecordBatch) -> dict:
        found = [shingle_set(t) for t in texts_of(batch)]
        names = [_name(s) for s in found]
        return {"id": [_id(x) for x in names], "name": names, "whole": _lists(found)}

    texts = with_row_key(docs.select("doc_id", "text")).join(keys, "_k", "left_semi").dropDuplicates(["_k"]).select("text")
    return map_batches(texts, work, "id long, name binary, whole array<long>")


def _ordered(known: str) -> str:
    """The prefix out of the sorted hashes `known` of a set, those in `late` last."""
    return f"slice(if(late is null, {known}, concat(array_except({known}, late), array_intersect({known}, late))), 1, n div 5 + 1)"


def _frequent(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h").count().where(F.col("count") > GROUP).select("h")


def _late(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """id and late, the frequent ones among its rows (id, h)."""
    return rows.join(frequent, "h", "left_semi").groupBy("id").agg(F.collect_list("h").alias("late"))


def prefix_rows(docs: DataFrame, sets: DataFrame, tables: Scratch) -> DataFrame:
    """id, n, pos, h, first: the prefix shingles (h, the pos-th) that more than one set has, with the least (n, id) of each shingle's sets."""
    known = sets.select("id", F.explode("least").alias("h"))
    frequent = tables.keep(_frequent(known), "frequent")
    own = sets.join(_late(known, frequent), "id", "left")
    rare = F.expr("size(least) - coalesce(size(array_intersect(least, late)), 0)")
    enough = (rare >= F.expr("n div 5 + 1")) | (F.size("least") == F.col("n"))
    own = tables.keep(own.select("id", "_k", "n", F.when(enough, F.expr(_ordered("least"))).alias("prefix")), "own")
    rows = own.where("prefix is not null").select("id", "n", F.posexplode("prefix").alias("pos", "h"))
    whole = tables.keep(_whole(docs, own.where("prefix is null").select("_k")), "whole")
    every = whole.select("id", F.explode("whole").alias("h"))
    crowd = tables.keep(_frequent(every), "crowd")
    # a shingle of another set's prefix stays where it is, or the two would have two orders
    settled = rows.join(crowd, "h", "left_semi").select("h").distinct()
    frequent = tables.keep(frequent.union(crowd.join(settled, "h", "left_anti")).distinct(), "all-frequent")
    more = whole.join(_late(every, frequent), "id", "left").withColumn("n", F.size("whole"))
    rows = tables.keep(rows.union(more.select("id", "n", F.posexplode(F.expr(_ordered("whole"))).alias("pos", "h"))), "rows")
    tables.drop("frequent", "own", "whole", "crowd")
    with_h = Window.partitionBy("h")
    least = F.min(F.struct("n", "id"))
    # whatever is frequent in prefixes, rare or not at large, is brought together by joins
    crowded = tables.keep(_frequent(rows), "crowded")
    few = rows.join(crowded, "h", "left_anti").withColumn("c", F.count("*").over(with_h)).withColumn("first", least.over(with_h))
    many = rows.join(crowded, "h", "left_semi")
    many = many.join(many.groupBy("h").agg(F.count("*").alias("c"), least.alias("first")), "h").select("id", "n", "pos", "h", "c", "first")
    shared = tables.keep(few.unionByName(many).where("c > 1").select("id", "n", "pos", "h", "first"), "shared")
    tables.drop("rows", "all-frequent", "crowded")
    return shared


def _sized(pairs: DataFrame) -> DataFrame:
    """Ids (a, b), a < b, of the different pairs (x, y) whose sizes allow a similarity of 4/5."""
    return pairs.where("5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n").select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def starred(shared: DataFrame) -> DataFrame:
    """Candidates (a, b), a < b: on each prefix shingle every set and the least one."""
    return _sized(shared.where("id <> first.id").select(F.col("first").alias("x"), F.struct("n", "id").alias("y")))


def neighbours(shared: DataFrame) -> DataFrame:
    """Candidates (a, b), a < b: on each prefix shingle every set and that before it in size. They chain up groups whose least
    set is unlike; sets of one shingle may lie in several ranges, between which no neighbours are sought."""
    ranges = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared.repartitionByRange(ranges, "h", "n", "id").withColumn("range", F.spark_partition_id())
    before = F.lag(F.struct("n", "id")).over(Window.partitionBy("h", "range").orderBy("n", "id"))
    return _sized(dealt.select(before.alias("x"), F.struct("n", "id").alias("y")).where("x is not null"))


def _differ(x: str, y: str) -> str:
    """The bits in which two signatures differ, a lower bound of the shingles in which the sets do; the longer has at most twice the length."""
    halved = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (u, v) -> u ^ v), {0})"
    return f"aggregate(zip_with({halved.format(x, y)}, {halved.format(y, x)}, (u, v) -> bit_count(u ^ v)), 0, (s, c) -> s + c)"


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates (a, b) that signatures don't prove unlike: sets of similarity 4/5 differ in a ninth of their shingles together at most."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("sig").alias("p")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("sig").alias("q")), "b")
    return both.where(f"5 * an >= 4 * bn and 5 * bn >= 4 * an and 9 * {_differ('p', 'q')} <= an + bn").select("a", "b")


def ball_pairs(sets: DataFrame) -> DataFrame:
    """Candidates (a, b), a < b, by SimHash: sets of one fingerprint with the first of them, and the first of linked fingerprints."""
    first = sets.groupBy("fp").agg(F.min("id").alias("first"))
    same = sets.join(first, "fp").where("id <> first").select("first", F.col("id").alias("other"))
    near = simhash.links(first.select("fp"))
    met = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("p")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("q")), "b").select("p", "q")
    return same.union(met).select(F.least("first", "other").alias("a"), F.greatest("first", "other").alias("b"))


def apart(sets: DataFrame, shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates (a, b), a < b, of different components that share a prefix shingle.

    Sets of similarity 4/5 differ in a ninth of their shingles together at most; where the signatures already differ in more
    the pair leaves the join at once, so a group of near misses gives no rows. They share four ninths of both their numbers,
    and all of these from the first one that they share on."""
    of = sets.select("id", "name", "sig").join(roots, sets.name == roots.node, "left").select("id", "sig", F.coalesce("root", F.encode(F.col("id").cast("string"), "UTF-8")).alias("root"))
    # the least set of a shingle has met all others there
    rooted = shared.where("id <> first.id").select("h", "id", "n", "pos").join(of.select("id", "root"), "id")
    same = [F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"l{seed}") for seed in (1, 2)]]
    mixed = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("pos").alias("at"), *same).where("low <> high")
    # shingles of the same sets (by their number and 128 bits of hashes) would give the same pairs
    mixed = mixed.groupBy("c", "l1", "l2").agg(F.min_by("h", "at").alias("h")).select("h")
    left = rooted.join(mixed, "h").join(of.select("id", "sig"), "id").select("h", F.struct("n", "id").alias("s"), F.expr("n - pos").alias("rest"), "root", "sig")
    one, other = left.select("h", F.col("s").alias("x"), F.col("rest").alias("xl"), F.col("root").alias("xr"), F.col("sig").alias("xs")), left.select(F.col("h").alias("_h"), F.col("s").alias("y"), F.col("rest").alias("yl"), F.col("root").alias("yr"), F.col("sig").alias("ys"))
    fits = F.expr(f"h = _h and x < y and xr <> yr and 5 * x.n >= 4 * y.n and 9 * least(xl, yl) >= 4 * (x.n + y.n) and 9 * {_differ('xs', 'ys')} <= x.n + y.n")
    return _sized(one.join(other, fits).select("x", "y"))


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, tables: Scratch, name: str) -> DataFrame:
    """The candidates whose whole sets have similarity 4/5 or more, as links (a, b) between names."""
    pairs = tables.keep(pairs.distinct(), f"{name}-pairs")
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    # of documents with one set only that of its row key is hashed again
    whole = tables.keep(_whole(docs, sets.join(asked, "id", "left_semi").select("_k")), f"{name}-whole")
    left = pairs.join(whole.select(F.col("id").alias("a"), F.col("name").alias("p"), F.col("whole").alias("x")), "a")
    both = left.join(whole.select(F.col("id").alias("b"), F.col("name").alias("q"), F.col("whole").alias("y")), "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    links = tables.keep(both.where("5 * shared >= 4 * (size(x) + size(y) - shared)").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")), f"{name}-links")
    tables.drop(f"{name}-pairs", f"{name}-whole")
    return links


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, _k and root (the least set name of the component, which names it) of every document."""
    tables = Scratch(docs.sparkSession, "near-copies")
    per_doc = tables.keep(shingle_sets(docs), "documents")
    sets = tables.keep(per_doc.groupBy("name").agg(F.first("id").alias("id"), F.min("_k").alias("_k"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("fp").alias("fp"), F.first("sig").alias("sig")), "sets")
    of = tables.keep(per_doc.select("doc_id", "_k", "name"), "names")
    tables.drop("documents")
    shared = prefix_rows(docs, sets, tables)
    met = ball_pairs(sets).union(starred(shared)).union(neighbours(shared)).distinct()
    first = verified(docs, sets, alike(met, sets), tables, "first")
    rest = verified(docs, sets, apart(sets, shared, simhash.components(first)), tables, "rest")
    roots = simhash.components(first.union(rest))
    tables.drop("shared", "sets")
    return of.join(roots, of.name == roots.node, "left").select("doc_id", "_k", F.coalesce("root", "name").alias("root"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with one kept of each component."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_k")
    keep = classes(docs).groupBy("root").agg(F.min(order)["_k"].alias("_k"))
    key = free_name(docs, "_k")
    kept = with_row_key(docs, key).join(keep.select(F.col("_k").alias(key)), key, "left_semi")
    return kept.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
