"""SimHash near-duplicates (operator 10) by pigeonhole blocks.

Fingerprints of 64 bits are cut into blocks. Two fingerprints that differ in at most ``distance`` bits agree on all but
``distance`` blocks, so joining on every choice of the other blocks finds each close pair; the join itself verifies the
Hamming distance. Only distinct fingerprints are joined, so copies never meet each other.

A block shared by more than ``hot_block`` distinct fingerprints is not joined pairwise. Its members are linked exactly
through ball points instead: two fingerprints are within two bits of each other if and only if some point lies within
one bit of both, so every member names the 65 points around it and members that name the same point are linked to the
smallest of them. That is linear in the members and loses no link; it serves distances up to two, and greater ones are
refused. Components come from contraction rounds over written tables.

Defined cases: a null text counts as an empty one; a text without words has fingerprint zero and is linked like any
other; a null doc_id belongs to its component but never names it (a component of null ids alone has a null id);
repeated rows are answered row by row; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparklex.llm._text import map_rows
from sparklex.plans.components import connected_components
from sparklex.plans.scratch import Scratch, tidy
from sparklex.plans.skew import join_counted

_BLOCK = 1 << 14


def fingerprint_text(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint: a bit is set if over half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        some = words[at : min(at + _BLOCK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(some[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter((xxh64_intdigest(g, seed) for g in grams), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed 64-bit integer, a row for each row."""
    def make():
        def one(value):
            x = fingerprint_text(value, shingle, seed)
            return (x - (1 << 64) if x >= 1 << 63 else x,)

        return one

    return map_rows(df, [key], [text], make, StructType([StructField("fp", LongType())]))


def _masks(blocks: int, distance: int) -> list[int]:
    """A signed 64-bit mask for each choice of ``blocks - distance`` of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    whole = [sum(c) for c in combinations(each, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in whole]


def close_pairs(fps: DataFrame, distance: int = 2, blocks: int = 4, hot_block: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """``(a, b)``: links between distinct values of ``fp`` whose closure is that of all pairs within ``distance``."""
    if not 0 < distance <= 2 or blocks <= distance:
        raise ValueError("fingerprints are linked at one or two differing bits, over more blocks than that")
    scratch = scratch or Scratch(fps.sparkSession, "simhash")
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(_masks(blocks, distance))]))
    keyed = fps.select("fp", named.alias("k")).select("fp", "k.m", "k.v")
    sizes = scratch.save(keyed.groupBy("m", "v").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = scratch.save(join_counted(keyed, sizes, ["m", "v"], "n", fps.count() * len(_masks(blocks, distance))), "blocks")
    cool = shared.where(F.col("n") <= hot_block)
    other = cool.select("m", "v", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    pairs = cool.select("m", "v", F.col("fp").alias("a")).join(other, (cool["m"] == other["m"]) & (cool["v"] == other["v"]) & near)
    pairs = pairs.select("a", "b")
    bits = [(1 << i) - (1 << 64) * (i == 63) for i in range(64)] if distance == 2 else []
    around = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(x)) for x in bits]))
    points = shared.where(F.col("n") > hot_block).select("fp").distinct()
    if distance == 1:  # a shared point would reach two bits; neighbours at one bit are members themselves
        points = points.select("fp", F.explode(F.array(*[F.least(F.col("fp"), F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63)))) for i in range(64)])).alias("p"), F.lit(0).alias("z"))
        points = points.groupBy("p").agg(F.collect_set("fp").alias("s"))
    else:
        points = points.select("fp", around.alias("p")).groupBy("p").agg(F.collect_set("fp").alias("s"))
    # a ball holds at most 65 fingerprints, whatever the input
    hot = points.where(F.size("s") > 1).select(F.array_min("s").alias("a"), F.explode("s").alias("b")).where("a <> b")
    return pairs.unionByName(hot)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, distance: int = 2, blocks: int = 4, hot_block: int = 256) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (the smallest key reachable over links), a row for each row."""
    scratch = Scratch(df.sparkSession, "simhash")
    each = scratch.save(fingerprints(df, key, text, shingle, seed).withColumnRenamed(key, "_key"), "fingerprints")
    fps = scratch.save(each.groupBy("fp").agg(F.min("_key").alias("least"), F.count("*").alias("n")), "distinct")
    with tidy(df.sparkSession):
        links = close_pairs(fps.select("fp"), distance, blocks, hot_block)
        roots = connected_components(links).select(F.col("node").alias("fp"), "root")
        classes = fps.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
        classes = Scratch(df.sparkSession, "simhash").save(classes, "classes")
        heads = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = scratch.save(classes.join(heads, "root").select("fp", "n", "component_id"), "heads")
    scratch.drop(fps)
    total = classes.agg(F.sum("n")).first()[0] or 0
    return join_counted(each, classes, ["fp"], "n", total).select(F.col("_key").alias(key), "fp", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, shingle: int = 5, seed: int = 42, distance: int = 2, hot: int = 64) -> DataFrame:
    """``df`` with one row of each component of near copies, that of the smallest key; all columns as they are.

    Texts are linked if their sets of ``shingle``-word shingles have a Jaccard similarity of ``percent`` hundredths.
    Fingerprints of these shingles that pigeonhole blocks find within ``distance`` bits give the first links, each
    verified on the sets. At that similarity fingerprints differ in some ten bits, and up to twenty, where no choice of
    blocks is selective; ``near_copies`` therefore completes the links exactly, between components only.
    """
    from sparklex.llm import near_copies

    return near_copies.keep_one(df, key, text, percent=percent, shingle=shingle, seed=seed, distance=distance, hot=hot)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
