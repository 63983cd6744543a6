"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all its variants within half the radius. Two
fingerprints within the radius share a variant, and as fingerprints are distinct a
variant can only ever meet the fingerprints of its own small ball (65 at radius 2),
so no group grows with the data, however many copies there are. Inside a group the
fingerprints are chained in order and each link is verified; components come from
alternating large-star and small-star steps.

A null or empty text has the fingerprint zero, linked like any other. Repeated rows
share a fingerprint, are returned one by one, and weigh nothing in the search.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscope.llm._common import discard, materialize, table, words_of

SHINGLE, SEED, RADIUS = 3, 42, 2
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash as a signed number; a bit is set if set in over half the hashes."""
    ws = words_of(text)
    if not ws:
        return 0
    n = max(1, len(ws) - shingle + 1)
    parts = map(b" ".join, zip(*(ws[i:] for i in range(shingle)), strict=False)) if len(ws) >= shingle else iter([b" ".join(ws)])
    ones, left, hashes = np.zeros(64, np.int64), n, map(xxhash.xxh64_intdigest, parts, repeat(seed))
    while left:
        k = min(left, _BLOCK)
        h = np.fromiter(hashes, np.uint64, k).astype("<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        left -= k
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_udf(shingle: int = SHINGLE, seed: int = SEED):
    return F.pandas_udf("long")(lambda s: pd.Series([fingerprint(t, shingle, seed) for t in s], dtype="int64"))


def masks(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits, as signed numbers."""
    found = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(64), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a > b) between distinct fingerprints, enough to connect each component.

    ``fps``: one column ``fp``, distinct. ``radius`` is even: two fingerprints that
    share a variant are then within the radius, so a chain through each group joins
    all of it and loses no link between components.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    variants = fps.select("fp", F.explode(F.lit(masks(radius // 2))).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("variant"), "fp")
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.withColumn("b", before).where("b is not null").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star until each node points at a root that points
    nowhere; a few rounds for any shape of component. A hub's rows only ever take part
    in sums that are combined before the shuffle and in joins that Spark can split.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select("b", "m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        then = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # done when every node has one link, and none leads to a node that links on
        n, nodes = then.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
        done = n == nodes and then.join(then.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        discard(large)
        discard(now)
        now = then
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) for every fingerprint of ``prints`` (doc_id, fp)."""
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps")
    of = components(links(fps.select("fp"), radius))
    rooted = fps.join(of, fps["fp"] == of["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(roots, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id of the component)."""
    prints = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(shingle, seed)(text_col).alias("fp")), "prints")
    return prints.join(classes(prints, radius), "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
