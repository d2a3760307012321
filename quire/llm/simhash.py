"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within RADIUS bits of each other have a value within RADIUS/2 bits of both. Every
distinct fingerprint emits all its variants within half the radius (itself and its 64 one-bit flips); the
variants are shuffled, and fingerprints that meet on one are linked after their distance is verified. At
most 65 distinct fingerprints can meet on a variant, whatever the data, and copies of a text share one
fingerprint, so no group grows with the input. On a variant each fingerprint is linked to the smallest one:
all of them lie within the radius of each other, so components stay whole with a star of links.

Components: alternating large-star and small-star rounds on the links, each round written to the shared
folder, until nothing changes.

Results: a null or word-less text has fingerprint zero and is linked like any other. Shorter texts than the
shingle are one shingle. Ties of a bit (exactly half) give 0. Repeated rows share fingerprint and component.
A null doc_id takes part but names no component: the smallest non-null id does, null if there is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import column, free_name, map_batches, texts_of, with_row_key
from quire.session import Scratch, materialise

SHINGLE, RADIUS = 3, 2
_SLAB = 1 << 15
_WEIGHT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """The XXH64 of each shingle, repeats included; fewer words are one shingle, none give none."""
    words = raw.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero without any."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLAB):
        slab = hashes[at : at + _SLAB].astype("<u8")
        counts += np.unpackbits(slab.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHT[2 * counts > len(hashes)].sum(dtype=np.uint64))


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return majority(shingle_hashes(raw, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, _k (row key) and fp (the fingerprint as a signed long)."""

    def work(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in texts_of(batch)], dtype=np.uint64)
        return {"doc_id": column(batch, "doc_id"), "_k": column(batch, "_k"), "fp": pa.array(fps.view(np.int64))}

    return map_batches(with_row_key(docs.select("doc_id", "text")), work, "doc_id long, _k binary, fp long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints; fps has one row for each. Radius 2 at most."""
    if radius not in (1, 2):
        raise ValueError("the variants are those within one bit, so the radius is 1 or 2")
    # 65 variants of one value, emitted by a native generator
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    # each row becomes 65, so the few small partitions that they have fit into would be few long tasks; dealt by a hash of
    # the value, as dealing by the value itself is taken for done and merged again
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    met = spread.select("fp", F.explode(flips).alias("variant"))
    star = met.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_list("fp").alias("members")).where("a < z")
    pairs = star.select("a", F.explode("members").alias("b")).where("a < b").distinct()
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    if radius == 2:
        return pairs.where(near)
    # within one bit, members of a star need not be near its smallest: link by the variant itself
    return met.where("fp > variant").join(fps.select(F.col("fp").alias("variant")), "variant", "left_semi").select(F.col("variant").alias("a"), F.col("fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of the links that reaches a smaller one, with the smallest that it reaches.

    Every round is written to the shared folder, so lineage stays short and a lost executor costs one round; a
    round's table goes when the next is written.
    """
    tables, round_ = Scratch(edges.sparkSession, "components"), 0
    edges = tables.keep(edges.select("a", "b").where("a <> b"), "links-0")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large-star: greater neighbours hang on the smallest neighbour
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = tables.keep(large, f"large-{round_}")
        # small-star: smaller neighbours, and the node, hang on the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("p"), "a", "b")
        small = small.select("p", F.col("a").alias("q")).union(small.select("p", F.col("b").alias("q"))).where("p < q").distinct().select(F.col("p").alias("a"), F.col("q").alias("b"))
        edges = tables.keep(small, f"links-{round_ + 1}")
        tables.drop(f"large-{round_}", f"links-{round_}")
        round_ += 1
        # settled when each node hangs on one root and no root hangs on another
        several = edges.groupBy("b").count().where("count > 1").limit(1).count()
        nested = several or edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        if not nested:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, _k, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable), root (the
    smallest fingerprint reachable, which names the component even without ids)."""
    per_doc = materialise(fingerprints(docs, shingle), "fingerprints")
    per_fp = per_doc.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(per_fp.select("fp"), radius))
    named = per_fp.join(roots, per_fp.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "root", "component_id")
    out = per_doc.join(by_fp, "fp")
    return out.select("doc_id", "_k", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents with one kept of each component: the one with the smallest doc_id (of rows with equal id,
    that with the smallest row key; of rows equal in id and text, one)."""
    found = near_duplicates(docs, shingle, radius)
    keep = found.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "_k"))["_k"].alias("_k"))
    key = free_name(docs, "_k")
    kept = with_row_key(docs, key).join(keep.select(F.col("_k").alias(key)), key, "left_semi")
    return kept.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
