"""Near copies for the pipeline: texts whose sets of five-word shingles have Jaccard 0.8 or more.

Every distinct text (by its lower-cased words) gets several independent short SimHashes of
its set of shingles and emits, for each, all variants within one bit; two texts meet if one
of their short hashes differs in two bits at most. Length and number of the hashes follow
the number of documents, so that unrelated texts seldom meet and at least RECALL of the
pairs at exactly 0.8 do (``plan``); closer pairs meet more surely. In a cell a text is
paired with its next NEAR neighbours in fingerprint order, so no group is paired whole.
Pairs within FAR bits of a 64-bit SimHash are verified by exact Jaccard. First each text's
closest neighbour, and the least of those within CLOSE bits, which draws groups together; then
the closest pair of every two components that a second search brings together; last all pairs
that a third one finds to lead from one component to another still. Only the texts that have any
neighbour are searched again, only those that met another component a third time, and the many
pairs inside a component, which could join nothing, are never made; in both a text meets WIDE
neighbours. FAR holds 99.5 % of the pairs at exactly 0.8, CLOSE about six in ten.

Where a cell holds more than a text and its neighbours, pairs may be crowded out of it. Texts of
cells too full for one search take part in the next; those of cells too full for the last
as well (pages of one template), of several components, are held against each other once more,
exactly (``by_rare_shingles``): two sets so similar share one of their rarest shingles, near the
front of both in the order of rarity. What such texts have in common is not rare among them, so
this makes few pairs, and none inside a component. As it is exact, the pairs that the third
search finds in such cells are left to it. No pair is verified twice.

Texts are long, and joins would send all of them over the network to find a few. So the keys that
are looked for are first marked in a bitmap of fixed size (``marked``), which is broadcast: only the
rows that it lets through go into the join, which decides.

A null or empty text has no shingles and is a copy of its like only; under five words all
words are one shingle. Repeated rows share a text and weigh nothing in the search.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat
from math import acos, ceil, comb, log2, pi

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm._common import discard, materialize, words_of
from panelscope.llm.simhash import SEED, components

SHINGLE, JACCARD, RECALL, NEAR, WIDE, FAR, CLOSE = 5, 0.8, 0.95, 3, 8, 17, 10
_BLOCK = 1 << 13
#: Bits of the bitmap that is broadcast (at most 8 MB), in pieces of 2^15.
MARKS = 1 << 26


def plan(n: int) -> tuple[int, int]:
    """(hashes, bits of each) for ``n`` documents."""
    bits = max(24, ceil(log2(max(n, 2))) + 6)
    p = acos(2 * JACCARD / (1 + JACCARD)) / pi  # chance that a bit differs, sets of one size
    meet = sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return ceil(np.log(1 - RECALL) / np.log(1 - meet)), bits


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    ws = words_of(text)
    parts = map(b" ".join, zip(*(ws[i:] for i in range(SHINGLE)), strict=False)) if len(ws) >= SHINGLE else iter([b" ".join(ws)] if ws else [])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64))


def text_key(text: str | None) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words_of(text)), SEED) - (1 << 63)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a hash's independent 64-bit successors (splitmix64)."""
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def prints(text: str | None, hashes: int, bits: int) -> tuple[int, list[int]]:
    """A text's 64-bit SimHash, signed, and its short ones."""
    h, words = shingles(text), 1 + ceil(hashes * bits / 64)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), _BLOCK):
        part = h[at : at + _BLOCK]
        rows = np.stack([_mixed(part, k) for k in range(words)], axis=1).astype("<u8")
        ones += np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    on = 2 * ones > len(h)
    short = on[64 : 64 + hashes * bits].reshape(hashes, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return int(np.packbits(on[:64], bitorder="little").view("<i8")[0]), short.tolist()


def _prints_udf(hashes: int, bits: int):
    def run(s: pd.Series) -> pd.DataFrame:
        found = [(text_key(t), *prints(t, hashes, bits)) for t in s]
        return pd.DataFrame(found, columns=["key", "fp", "short"])

    return F.pandas_udf(run, "key long, fp long, short array<long>")


def key_udf():
    return F.pandas_udf("long")(lambda s: pd.Series([text_key(t) for t in s], dtype="int64"))


def marked(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """``df`` and ``_ps_marked``: true wherever ``column`` is among ``keys``, and for a few others."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    bit, piece = (lambda c, f=f: f(place(c) + 1) for f in (F.bitmap_bit_position, F.bitmap_bucket_number))
    bits = keys.groupBy(piece(F.col(key)).alias("_ps_piece")).agg(F.bitmap_construct_agg(bit(F.col(key))).alias("_ps_bits"))
    byte = F.conv(F.hex(F.substring("_ps_bits", F.expr("cast(_ps_bit div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.expr("(_ps_byte >> cast(_ps_bit % 8 as int)) & 1") == 1, F.lit(False))
    met = df.withColumns({"_ps_piece": piece(F.col(column)), "_ps_bit": bit(F.col(column))}).join(F.broadcast(bits), "_ps_piece", "left")
    return met.withColumn("_ps_byte", byte).withColumn("_ps_marked", on).select(*df.columns, "_ps_marked")


def candidates(texts: DataFrame, bits: int, known: DataFrame | None = None) -> DataFrame:
    """(key, o, crowded): for a text in a cell the neighbours (key, d) it is paired with, ``d`` bits
    of the fingerprint away, and whether the cell holds more than that; repeats included. With
    ``known`` (key, root), only pairs of two components, and only cells that hold several; then
    a row has its root, too, and so have the neighbours."""
    masks = [sum(1 << i for i in c) for k in range(2) for c in combinations(range(bits), k)]
    if known is not None:
        texts = texts.join(known, "key", "left").select("key", "fp", "short", F.coalesce("root", "key").alias("root"))
    own = [c for c in texts.columns if c != "short"]
    rows = texts.select(*own, F.posexplode("short").alias("band", "value")).select("*", F.explode(F.lit(masks).cast("array<long>")).alias("m")).select("band", F.col("value").bitwiseXOR(F.col("m")).alias("cell"), *own)
    whole = Window.partitionBy("band", "cell")
    w, steps = whole.orderBy("fp", "key"), range(1, (NEAR if known is None else WIDE) + 1)
    crowded = F.count(F.lit(1)).over(whole) > len(steps) + 1
    if known is not None:
        crowded &= F.min("root").over(whole) != F.max("root").over(whole)
    rows = rows.withColumn("crowded", crowded)
    for i in steps:
        rows = rows.withColumns({f"{c}{i}": F.lag(c, i).over(w) for c in own})
    d = {i: F.bit_count(F.col("fp").bitwiseXOR(F.col(f"fp{i}"))) for i in steps}
    if known is not None:
        d = {i: F.when(F.col("root") != F.col(f"root{i}"), x) for i, x in d.items()}
    kept = [c for c in own if c != "fp"]
    of = F.array(*[F.struct(*(F.col(f"{c}{i}").alias(c) for c in kept), d[i].alias("d")) for i in steps])
    # nulls are passed over
    return rows.where((F.least(*d.values()) <= FAR) | F.col("crowded")).select(*kept, F.filter(of, lambda o: o["d"] <= FAR).alias("o"), "crowded")


def by_rare_shingles(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of two roots among ``sets`` (key, root, set) that can reach JACCARD, all that do
    among them. Shingles are ordered by how many of the sets hold them; a pair of enough overlap
    meets at its first common shingles. After the last at which it meets as many more can be
    common as either set still has; with those before, they must be enough."""
    least = lambda share, n: F.ceil(share * n - 1e-9)
    each = sets.select("key", F.explode("set").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = each.join(often, "shingle")
    text = Window.partitionBy("key")
    numbered = shared.select("key", "shingle", F.count(F.lit(1)).over(text).alias("of"), F.row_number().over(text.orderBy("c", "shingle")).alias("at"))
    sized = numbered.join(sets.select("key", "root", F.size("set").alias("n")), "key")
    front = sized.withColumn("at", F.col("n") - F.col("of") + F.col("at")).where(F.col("at") <= F.col("n") - least(JACCARD, F.col("n")) + 1)
    short = front.where(F.col("at") <= F.col("n") - least(2 * JACCARD / (1 + JACCARD), F.col("n")) + 1)
    x, y = (df.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "root", "n", "at"))) for df, s in ((front, "x"), (short, "y")))
    order = F.struct(F.col("n_y"), F.col("key_y")) < F.struct(F.col("n_x"), F.col("key_x"))
    need = least(JACCARD / (1 + JACCARD), F.col("n_x") + F.col("n_y"))
    room = 1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= need  # holds at the first and those that count
    met = x.join(y, "shingle").where((F.col("root_x") != F.col("root_y")) & order & (F.col("n_y") >= least(JACCARD, F.col("n_x"))) & room)
    after = F.least(F.min(F.col("n_x") - F.col("at_x")), F.min(F.col("n_y") - F.col("at_y")))
    enough = met.groupBy("key_x", "key_y").agg((F.count(F.lit(1)) + after >= F.first(need)).alias("enough")).where("enough")
    return enough.select(F.greatest("key_x", "key_y").alias("a"), F.least("key_x", "key_y").alias("b"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough. Only the sets of ``pairs`` travel."""
    of = lambda side: marked(sets, "key", pairs, side).where("_ps_marked").select(F.col("key").alias(side), F.col("set").alias(f"{side}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    alike = both >= JACCARD * (F.size("a_set") + F.size("b_set") - both)
    return pairs.join(of("a"), "a").join(of("b"), "b").where(alike).select("a", "b")


def joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (key, root) after the components that ``links`` (a, b) lead between have become one:
    only their roots take part, so what was joined before is not gone through again."""
    end = lambda side: known.select(F.col("key").alias(side), F.col("root").alias(f"{side}_root"))
    of = components(links.join(end("a"), "a").join(end("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    then = known.join(of.withColumnRenamed("root", "to"), F.col("root") == F.col("node"), "left").select("key", F.coalesce("to", "root").alias("root"))
    return materialize(then, "known")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, root) for every row: documents of one root are copies or near copies."""
    hashes, bits = plan(docs.count())
    every = materialize(docs.select("doc_id", _prints_udf(hashes, bits)("text").alias("p")).select("doc_id", "p.*"), "prints")
    texts = materialize(every.groupBy("key").agg(F.first("fp").alias("fp"), F.first("short").alias("short")), "texts")
    met = candidates(texts, bits)
    pair = F.struct(F.col("key").alias("a"), F.col("x.key").alias("b"), F.col("x.d").alias("d"))
    ways = F.explode(F.array(F.struct("a", "b", "d"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "d")))
    close = F.when(F.col("w.d") <= CLOSE, F.col("w.b"))
    both = met.select("key", F.explode_outer("o").alias("x")).select(pair.alias("p")).select("p.*")
    # a text of a crowded cell counts as having neighbours even if those beside it are too far
    near = both.select(ways.alias("w")).where("w.a is not null").groupBy(F.col("w.a").alias("key")).agg(F.min_by("w.b", F.when(F.col("w.b").isNotNull(), F.struct("w.d", "w.b"))).alias("other"), F.min(close).alias("least"))
    near = materialize(near, "near")
    keyed = docs.select(key_udf()("text").alias("key"), "text")
    had = marked(keyed, "key", near, "key").where("_ps_marked").join(near.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = materialize(had.select("key", F.pandas_udf("array<long>")(lambda s: s.map(lambda t: shingles(t).view(np.int64)))("text").alias("set")), "sets")
    to = F.explode(F.array_compact(F.array("other", "least")))
    closest = near.select("key", to.alias("other")).select(F.greatest("key", "other").alias("a"), F.least("key", "other").alias("b")).distinct()
    tested = [materialize(closest, "tested")]  # no pair is verified twice

    def untested(pairs: DataFrame) -> DataFrame:
        rows = reduce(DataFrame.unionByName, (t.withColumn("old", F.lit(True)) for t in tested), pairs.withColumn("old", F.lit(False)))
        tested.append(materialize(rows.groupBy("a", "b").agg(F.bool_or("old").alias("old")).where("not old").drop("old"), "tested"))
        return tested[-1]

    known = [near.select("key", F.col("key").alias("root"))]
    known.append(joined(known[-1], verified(tested[0], sets)))
    pair = [F.greatest("key", "x.key").alias("a"), F.least("key", "x.key").alias("b")]
    again = materialize(candidates(texts.join(near.select("key"), "key", "left_semi"), bits, known[-1]).distinct(), "again")
    between = again.select("key", "root", F.explode("o").alias("x")).groupBy(F.greatest("root", "x.root"), F.least("root", "x.root"))
    nearest = untested(between.agg(F.min(F.struct("x.d", *pair)).alias("p")).select("p.a", "p.b"))
    known.append(joined(known[-1], verified(nearest, sets)))
    still = again.select("key").distinct()
    last = materialize(candidates(texts.join(still, "key", "left_semi"), bits, known[-1]).distinct(), "last")
    # what meets in a crowded cell is held against each other below
    crossing = untested(last.where("not crowded").select("key", F.explode("o").alias("x")).select(*pair))
    known.append(joined(known[-1], verified(crossing, sets)))
    crowd = last.where("crowded").select("key").distinct()
    if not crowd.isEmpty():
        held = marked(sets, "key", crowd, "key").where("_ps_marked").drop("_ps_marked")
        ranked = materialize(crowd.join(held, "key").join(known[-1], "key"), "crowd")
        known.append(joined(known[-1], verified(untested(by_rare_shingles(ranked)), sets)))
        discard(ranked)
    for table in (texts, near, again, sets, last, *tested, *known[:-1]):
        discard(table)
    return every.select("doc_id", "key").join(known[-1], "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class stays: the one with the smallest id, once.

    Classes are told apart by their root text, never by ids: rows of one id with other texts
    stay each, as do other texts without an id; a null id comes after all others.
    """
    found = materialize(classes(docs), "classes")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("r")).select("r.doc_id", "r.key")
    rows, ids = found.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if rows == ids:
        # most documents are alone in their class: they stay without a join
        several = found.join(found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "root", "left_semi")
        of = marked(docs, "doc_id", several, "doc_id")
        alone = of.where("not _ps_marked").drop("_ps_marked")
        return alone.unionByName(of.where("_ps_marked").drop("_ps_marked").join(first, "doc_id", "left_semi").select(*docs.columns))
    keyed = docs.withColumn("_ps_key", key_udf()("text"))
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(first["doc_id"]) & (keyed["_ps_key"] == first["key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_ps_key"]).drop("_ps_key")
