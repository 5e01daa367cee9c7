"""SimHash links verified and completed to all near copies of a Jaccard similarity (operator 10 in the pipeline).

Two texts are linked if the sets of their shingles (``shingle`` words, ASCII letters in lower case) have a Jaccard
similarity of ``percent`` hundredths at least. First come the links that SimHash finds: texts whose fingerprints, over
the same shingles, are equal or share pigeonhole blocks and lie within ``distance`` bits, verified on the sets. Such
fingerprints differ in some ten bits at a similarity of 0.8, which no radius that blocks can serve covers, so a search
that is exact follows, for pairs that those links leave in different components. It goes by prefixes: in any fixed order of the shingles, two
such sets share one among the first n - ceil(percent n / 100) + 1 of each. The order puts shingles that are frequent in
a sample of the documents last, which keeps the groups behind a shingle small; whatever the sample holds, no pair is lost.

Groups of up to ``hot`` texts are joined pairwise. In a greater one every text first meets a few pivots, and then only
texts of different components meet. Before any text is fetched, the sizes and parity bits of the sets rule pairs out:
the parities of two sets differ in at most as many bits as the sets do in members. There are 256 bits for a first look
and then one at least for each member, as 256 are all used up by the sets of long texts.

What is left is verified on the sets. Texts are shuffled for that, not sets, which take more bytes, and once for all
pairs of a group: pairs meet at the least text that the first of them is paired with, so near copies of one another meet
in one place. A group of over ``GROUP`` members of sets is split.

Defined cases: a text of fewer words than a shingle is one shingle, so null texts and texts without words are equal;
texts of the same 64-bit hash count as one; a row goes if its component has another keeper, decided by key and text, so
a key that stands for several texts loses only those that are copies; rows with a null key stay; of repeated rows one
stays; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sparklex.llm._text import SLICE_ROWS, fresh, map_rows
from sparklex.llm.simhash import close_pairs
from sparklex.plans.components import connected_components
from sparklex.plans.scratch import Scratch, setting, swept, tidy
from sparklex.plans.skew import join_counted

#: Documents of the sample, the frequent shingles taken from it at most, and the count that makes one frequent.
SAMPLE, MAX_FREQUENT, FREQUENT = 20_000, 100_000, 4
#: Pivots of a hot group.
PIVOTS = 4
#: Shared shingles of a text that tell where a pair is made.
FIRST = 16
#: Texts that travel to Python at a time; they lie outside the heap, once in the JVM and once in Python.
BATCH_ROWS = 4 * SLICE_ROWS
#: Members of the sets, counted for each pair, that one group of pairs may hold.
GROUP = 1 << 22
#: A bitmap that rules out texts no pair holds: maps of 2^15 bits, and how many of them at most (8 MB are broadcast).
MAP_BITS, MAPS = 15, 1 << 11
_PARITY = [f"m{i}" for i in range(4)]
_SET = StructType([StructField("s", ArrayType(LongType()))])
_SIGNATURE = StructType([*[StructField(c, LongType()) for c in ("n", "fp", *_PARITY)], StructField("wide", ArrayType(LongType())), StructField("prefix", ArrayType(LongType()))])


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; at least one."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(g, seed) for g in grams), dtype="<u8").view("<i8"))


def _parity(h: np.ndarray, bits: int = 256) -> list[int]:
    odd = np.bincount(h & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _fingerprint(h: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _width(n: int) -> int:
    """Bits of the wide parities of a set: a power of two, one bit for each member at least."""
    return max(256, 1 << (n - 1).bit_length())


def _apart(x: str, y: str):
    """The bits in which two wide parities differ, the longer one folded to the length of the other."""
    least = F.least(F.size(x), F.size(y))

    def folded(w: str):
        halves = F.sequence(F.lit(0), F.floor(F.size(w) / least).cast("int") - 1)
        return F.aggregate(halves, F.array_repeat(F.lit(0).cast("bigint"), least), lambda acc, i: F.zip_with(acc, F.slice(w, i * least + 1, least), lambda p, q: p.bitwiseXOR(q)))

    return F.aggregate(F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, b: acc + b)


def _among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``u`` is in ``wanted``, and a few others: those that share their bits in a map of
    bounded size with one of them."""
    where, place = F.shiftright("u", MAP_BITS).bitwiseAND(F.lit(MAPS - 1)), F.col("u").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    maps = wanted.select(where.alias("at"), place.alias("place")).groupBy("at").agg(F.bitmap_construct_agg("place").alias("map"))
    byte = F.conv(F.hex(F.substring("map", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return docs.withColumn("at", where).join(F.broadcast(maps), "at").where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*docs.columns)


def _meet(rows: DataFrame, percent: int, shingle: int, seed: int) -> DataFrame:
    """``(a, b)``: the pairs that are similar enough, of rows of a group (``home``, ``part``), a text ``u`` of it and the
    texts ``others`` that it is paired with there. Only the sets of one group are held."""
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, paired, found = None, {}, [], []

        def close() -> None:
            for a, others in paired:
                for b in others:
                    x, y = sets[a], sets[b]
                    if len(np.intersect1d(x, y, assume_unique=True)) * (100 + percent) >= percent * (len(x) + len(y)):
                        found.append((a, b))
            sets.clear()
            paired.clear()

        def links() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=pa.int64()) for i in range(2)], schema=fields)
            found.clear()
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                for home, piece, u, others, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (home, piece) != at:
                        close()
                        at = (home, piece)
                    sets[u] = shingle_set(text, shingle, seed)
                    if others:
                        paired.append((u, others))
            yield links()
        close()
        yield links()

    dealt = rows.repartition("home", "part").sortWithinPartitions("home", "part")
    return dealt.select("home", "part", "u", "others", "text").mapInArrow(run, "a bigint, b bigint")


def _signatures(docs: DataFrame, frequent: dict[int, int], percent: int, shingle: int, seed: int) -> DataFrame:
    """``u``, the size of the set, its fingerprint, its parities, short and wide, and its prefix, a row for each row."""
    known = np.array(sorted(frequent), dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((known, np.array([frequent[int(x)] for x in known], dtype=np.int64)))

    def make():
        known, counts = shared.value

        def one(text):
            h = shingle_set(text, shingle, seed)
            n = len(h)
            order = np.arange(n)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                order = np.lexsort((h, np.where(known[at] == h, counts[at], 0)))
            return (n, _fingerprint(h), *_parity(h), _parity(h, _width(n)), h[order[: n - -(-percent * n // 100) + 1]].tolist())

        return one

    return map_rows(docs, ["u"], ["text"], make, _SIGNATURE)


def close_texts(docs: DataFrame, percent: int = 80, shingle: int = 5, seed: int = 42, distance: int = 2, hot: int = 64) -> DataFrame:
    """``(a, b)``: links between distinct values of ``u`` (the hash of ``text``) whose closure is that of all pairs of
    texts that are similar enough."""
    if not 0 < percent <= 100:
        raise ValueError("percent must lie above 0 and not above 100")
    scratch = Scratch(docs.sparkSession, "copies")

    def sets(some: DataFrame) -> DataFrame:
        return map_rows(some, ["u"], ["text"], lambda: lambda t: (shingle_set(t, shingle, seed).tolist(),), _SET)

    step = max(1, docs.count() // SAMPLE)
    seen = sets(docs.where(F.pmod("u", F.lit(step)) == 0)).select(F.explode("s").alias("t")).groupBy("t").count()
    frequent = {r["t"]: r["count"] for r in seen.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "t").limit(MAX_FREQUENT).collect()}
    rows = scratch.save(_signatures(docs, frequent, percent, shingle, seed), "signatures")
    tokens = rows.select("u", "n", F.explode("prefix").alias("t")).repartition("t").distinct()
    shared = scratch.save(tokens.withColumn("c", F.count("*").over(Window.partitionBy("t"))).where("c > 1"), "shared")
    members = rows.select("u", "n", *_PARITY, "wide").join(shared.select("u").distinct(), "u", "left_semi").dropDuplicates(["u"])
    members = scratch.save(members, "members")
    info, wide = members.select("u", "n", *_PARITY, F.col("u").alias("r")), members.select("u", "n", "wide")

    def sizes(x, y):
        return (100 * x >= percent * y) & (100 * y >= percent * x)

    def alike(x: str, y: str):
        apart = sum((F.bit_count(F.col(f"{x}{m}").bitwiseXOR(F.col(f"{y}{m}"))) for m in _PARITY), F.lit(0))
        both = F.col(f"{x}n") + F.col(f"{y}n")
        return sizes(F.col(f"{x}n"), F.col(f"{y}n")) & (apart * (100 + percent) <= both * (100 - percent))

    def side(of: DataFrame, x: str, *more: str) -> DataFrame:
        return of.select(F.col("u").alias(x), *[F.col(c).alias(f"{x}{c}") for c in ("n", *_PARITY)], *[F.col(c).alias(f"{x}{c}") for c in more])

    def verified(pairs: DataFrame) -> DataFrame:
        for x in ("a", "b"):
            pairs = pairs.join(wide.select(F.col("u").alias(x), F.col("n").alias(f"{x}n"), F.col("wide").alias(f"{x}w")), x)
        both = F.col("an") + F.col("bn")
        pairs = scratch.save(pairs.where(_apart("aw", "bw") * (100 + percent) <= both * (100 - percent)).select("a", "b", both.alias("w")), "pairs")
        if pairs.isEmpty():
            return pairs.select("a", "b")
        ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        homes = ends.groupBy("a").agg(F.least("a", F.min("b")).alias("home"))
        at = scratch.save(pairs.join(homes, "a"), "homes")
        great = at.groupBy("home").agg(F.ceil(F.sum("w") / GROUP).alias("parts")).where("parts > 1")
        part = F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1).cast("bigint")))
        at = at.join(great, "home", "left").select("home", part.alias("part"), "a", "b")
        sides = at.select("home", "part", F.col("a").alias("u"), "b").unionByName(at.select("home", "part", F.col("b").alias("u"), F.lit(None).cast("bigint").alias("b")))
        needs = scratch.save(sides.groupBy("home", "part", "u").agg(F.collect_list("b").alias("others")), "needs")
        texts = _among(docs.select("u", "text"), needs).dropDuplicates(["u"])
        return scratch.save(_meet(needs.join(texts, "u"), percent, shingle, seed), "links")

    def worth(pairs: DataFrame) -> DataFrame:
        return pairs.distinct().join(side(info, "a", "r"), "a").join(side(info, "b", "r"), "b").where((F.col("ar") != F.col("br")) & alike("a", "b")).select("a", "b")

    marks = scratch.save(rows.groupBy("fp").agg(F.min("u").alias("head")), "marks")
    alike_marks = close_pairs(marks.select("fp"), distance, distance + 2, scratch=scratch)
    of = lambda x: marks.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}"))
    both = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = rows.select("fp", "u").distinct().join(marks, "fp").where("u <> head").select(*both("u", "head"))
    first = verified(worth(first.unionByName(alike_marks.join(of("a"), "a").join(of("b"), "b").select(*both("ha", "hb")))))
    scratch.drop(rows)
    roots = scratch.save(connected_components(first).select(F.col("node").alias("u"), "root"), "first-roots")
    info = scratch.save(info.join(roots, "u", "left").select("u", "n", *_PARITY, F.coalesce("root", "u").alias("r")), "rooted")

    cool, warm = shared.where(F.col("c") <= hot), shared.where(F.col("c") > hot)
    x, y = cool.select("t", F.col("u").alias("a"), F.col("n").alias("an")), cool.select("t", F.col("u").alias("b"), F.col("n").alias("bn"))
    pairs = x.join(y, (x["t"] == y["t"]) & (x["a"] < y["b"]) & sizes(x["an"], y["bn"])).select("a", "b")
    if warm.isEmpty():
        return first.unionByName(verified(worth(pairs)))
    pivots = warm.groupBy("t").agg(F.array(*[F.min_by("u", F.xxhash64("u", F.lit(i))) for i in range(PIVOTS)]).alias("p")).select("t", F.explode("p").alias("p"))
    stars = warm.join(pivots, "t").where("u <> p").select(F.least("u", "p").alias("a"), F.greatest("u", "p").alias("b"))
    links = first.unionByName(verified(worth(pairs.unionByName(stars))))
    roots = connected_components(links).select(F.col("node").alias("u"), "root")
    open_ = warm.select("t", "u").join(roots, "u", "left").select("t", "u", F.coalesce("root", "u").alias("r"))
    several = open_.groupBy("t").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select("t")
    open_ = scratch.save(open_.join(several, "t", "left_semi").join(info.drop("r"), "u"), "open")
    # a pair that shares many shingles is made at the least of them, or at few: none beyond the least one that is among
    # the ``FIRST`` least of both texts
    firsts = open_.groupBy("u").agg(F.slice(F.sort_array(F.collect_set("t")), 1, FIRST).alias("f"))
    open_ = scratch.save(open_.join(firsts, "u"), "firsts")
    x, y = side(open_, "a", "t", "r", "f"), side(open_, "b", "t", "r", "f")
    least = F.coalesce(F.col("at") <= F.array_min(F.array_intersect("af", "bf")), F.lit(True))
    rest = x.join(y, (x["at"] == y["bt"]) & (x["a"] < y["b"]) & (x["ar"] != y["br"]) & alike("a", "b") & least).select("a", "b").distinct()
    return links.unionByName(verified(rest))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``df`` with one row of each component, that of the smallest key; all columns as they are.

    Rows are removed by an anti-join on the keys and hashes that go: a shuffled hash join at every size, since those
    grow with the input and must not be broadcast.
    """
    scratch = Scratch(df.sparkSession, "kept")
    with tidy(df.sparkSession), swept(df.sparkSession), setting(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
        rows = scratch.save(_heads(df, key, text, settings), "rows")
    stays = (F.col("k") == F.col("hk")) & (F.col("u") == F.col("hu"))
    gk, gu, hashed = fresh(df, "_gone"), fresh(df, "_gone_text"), fresh(df, "_hash")
    named = lambda t: t.select(F.col("k").alias(gk), F.col("u").alias(gu))
    on = (F.col(f"`{key}`") == F.col(gk)) & (F.col(hashed) == F.col(gu))
    out = df.withColumn(hashed, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))).join(named(rows.where(~stays)).hint("shuffle_hash"), on, "left_anti")
    twice = scratch.save(named(rows.where(stays & (F.col("count") > 1))), "repeated")
    if not twice.isEmpty():
        out = out.join(twice, on, "left_anti").unionByName(out.join(twice, on, "left_semi").dropDuplicates([key, hashed]))
    return out.drop(hashed)


def _heads(df: DataFrame, key: str, text: str, settings: dict) -> DataFrame:
    """``k``, ``u`` and ``count`` of every key and text that is a copy or has one, with the ``hk`` and ``hu`` that stay."""
    scratch = Scratch(df.sparkSession, "copies")
    docs = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("u"))
    roots = connected_components(close_texts(docs.select("u", "text"), **settings)).select(F.col("node").alias("u"), "root")
    each = docs.where("k is not null").select("k", "u")
    texts = each.groupBy("u").agg(F.min("k").alias("least"), F.count("*").alias("c")).join(roots, "u", "left").where("c > 1 or root is not null")
    texts = scratch.save(texts.select("u", "least", "c", F.coalesce("root", "u").alias("root")), "texts")
    heads = texts.groupBy("root").agg(F.min(F.struct("least", "u")).alias("head")).select("root", F.col("head.least").alias("hk"), F.col("head.u").alias("hu"))
    headed = scratch.save(texts.join(heads, "root").select("u", "c", "hk", "hu"), "heads")
    return join_counted(each, headed, ["u"], "c", docs.count()).groupBy("k", "u", "hk", "hu").count()
