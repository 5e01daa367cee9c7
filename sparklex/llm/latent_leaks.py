"""Benchmark decontamination (operator 3) by latent semantic retrieval.

Passages are windows of words. Terms are words of the benchmark, without those in over ``MAX_DF`` of all documents and ``MIN_FREQUENT`` of them (an
item always keeps its ``KEEP`` rarest ones, so an item that leaked everywhere is still found); other words have no
direction of their own but count in a passage's length. Three passes over all documents, none of which shuffles text:

1. document frequencies of the words give idf weights;
2. a randomised sketch: every task multiplies its TF-IDF passages A with a Gaussian test matrix and adds up A'(A W);
   partial sums meet in a tree of grouped additions. The benchmark's passages join with as much weight as the corpus
   has, so that the leading directions tell its items apart, and the Nystroem form of A'A gives the right singular
   vectors on the driver, whose matrices are terms x rank;
3. every window of every document with ``LEAST_TERMS`` terms is folded into the latent space and compared with all
   benchmark passages by cosine; one above ``least_cosine`` is a candidate, and the words around it are compared with
   the whole item by longest common subsequence (bit-parallel). An item leaks if the subsequence covers ``copied`` of it, or, as a paraphrase,
   ``rephrased`` of it while the item's answer, its last sentence, stands there word by word;
4. besides, and without the latent space, an item leaks wherever ``RUN`` consecutive words of it stand, or all of its
   words where it has fewer. Hashes of these runs are looked up for every position and hits are compared word by word;
   the share is then that of the subsequence around the run, and the cosine is null.

The benchmark is read in order, partition by partition, and searched for in blocks of ``MAX_ITEMS`` items and
``MAX_WORDS`` words (or one longer item), so that what the driver, a broadcast and a task hold is bounded however large
it is. Each block takes its own passes; what several blocks find is joined by the texts' hashes. The cosines compare
every window with all passages of a block: the benchmark is the stated set of queries, and the work is linear in the
documents.

In scripts without spaces every character is a word, and ``RUN`` is twice as long for items that are mostly such ones.

Defined cases: null texts count as empty ones; an item with fewer than ``MIN_ITEM_WORDS`` words is too short for the
latent space and is found by all its words in a row only, one without words never; an item with a null id is searched
like any other; an empty benchmark leaks nowhere; repeated rows and null keys are answered row by row;
an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sparklex.plans.scratch import Scratch

MAX_ITEMS, MAX_WORDS, MIN_ITEM_WORDS = 5_000, 250_000, 8
#: Words of a block, blocks of a window.
BLOCK, SPAN = 12, 4
#: Share and number of documents beyond which a word is no term, the terms that each item keeps, those of a window.
MAX_DF, MIN_FREQUENT, KEEP, LEAST_TERMS = 0.05, 50, 12, 3
#: What a word is instead of a term: outside the benchmark, padding, too frequent.
OUTSIDE, PADDING, FREQUENT = -1, -2, -3
#: Consecutive words of an item that are a leak whatever share of it they are.
RUN = 13
_ROWS = 64
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Characters of scripts without spaces: Thai to Tibetan, Myanmar, Khmer, CJK punctuation, kana and Han with its extensions.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uff0f\uff66-\uff9f\U00020000-\U000323af]")


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case; non-ASCII characters belong to words, and in scripts without
    spaces each is one."""
    text = text or ""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.encode().translate(_WORD_BYTES).split()


def run_length(words: list[bytes]) -> int:
    """How many consecutive words of an item are a leak."""
    single = sum(len(w) > 2 and _UNSPACED.fullmatch(w.decode()) is not None for w in words)
    return min(len(words), RUN * (1 + (2 * single > len(words))))


def run_hashes(ids: np.ndarray, lengths: list[int]):
    """For each of the ascending ``lengths`` it and the hashes of all runs of so many ids, by a rolling polynomial."""
    x = (ids.astype(np.int64) + 7).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    h = np.zeros(len(ids) + 1, dtype=np.uint64)
    for m in range(1, lengths[-1] + 1):
        if m > len(ids):
            return
        h = h[:-1] * np.uint64(0x94D049BB133111EB) + x[m - 1 :]
        if m in lengths:
            yield m, h


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one big integer for a row."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = at.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def holds(b: list, a: list) -> bool:
    """Whether the words ``a`` stand consecutively in ``b``."""
    return bool(a) and any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1) if b[i] == a[0])


@dataclass
class Items:
    """The benchmark on the driver: ids, words, answers and the term numbers."""

    ids: list
    words: list[list[bytes]]
    answers: list[list[bytes]]
    terms: dict[bytes, int] = field(default_factory=dict)

    def numbered(self) -> Items:
        self.terms = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        return self


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", most_items: int = MAX_ITEMS, most_words: int = MAX_WORDS) -> Iterator[Items]:
    """The items with words, in blocks, by id and text."""
    items, n = Items([], [], []), 0
    for r in benchmark.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).orderBy("k", "t").toLocalIterator():
        w = words_of(r["t"])
        if not w:
            continue
        if items.ids and (len(items.ids) == most_items or n + len(w) > most_words):
            yield items.numbered()
            items, n = Items([], [], []), 0
        sentences = [words_of(s) for s in re.split(r"[.?!\n]+", r["t"])]
        items.ids.append(r["k"])
        items.words.append(w)
        items.answers.append(next((s for s in reversed(sentences) if len(s) >= 2), []))
        n += len(w)
    if items.ids:
        yield items.numbered()


def term_ids(words: list[bytes], terms: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(terms.get, words, repeat(OUTSIDE)), dtype=np.int32, count=len(words))


def segment_sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``table[rows]`` over the runs that begin at ``starts``. Short runs are added up side by side, one place
    after the other, which is many times faster than a reduction along wide rows."""
    lengths = np.diff(np.append(starts, len(rows)))
    out = table[rows[starts]]
    short = lengths <= 16
    for k in range(1, 16):
        some = np.flatnonzero(short & (lengths > k))
        if not len(some):
            break
        out[some] += table[rows[starts[some] + k]]
    for i in np.flatnonzero(~short):
        out[i] = table[rows[starts[i] : starts[i] + lengths[i]]].sum(axis=0)
    return out


def blocks_of(ids: np.ndarray, table: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """The sums of the rows of ``table`` over blocks of ``size`` words; only terms add."""
    n = -(-len(ids) // size)
    out = np.zeros((n, table.shape[1]), dtype=np.float32)
    at = np.flatnonzero(ids >= 0)
    if len(at):
        block = at // size
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        out[block[starts]] = segment_sums(table, ids[at], starts)
    return out


#: Words that are handled as one numpy batch.
_BATCH_WORDS = 60_000


def _texts(batches, column: int = 0):
    for batch in batches:
        col = batch.column(column)
        for at in range(0, batch.num_rows, 256):
            yield from col.slice(at, 256).to_pylist()


def document_frequencies(docs: DataFrame, text: str, shared) -> tuple[np.ndarray, int]:
    """For each term the number of documents with it, and the number of documents."""
    def run(batches):
        terms = shared.value
        df, n = np.zeros(len(terms), dtype=np.int64), 0
        for t in _texts(batches):
            n += 1
            ids = term_ids(list(set(words_of(t))), terms)
            df[ids[ids >= 0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([n, *df[at].tolist()], pa.int64())], names=["term", "n"])

    rows = docs.select(F.col(f"`{text}`")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(len(shared.value), dtype=np.int64), 0
    for r in rows:
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, n


def choose_terms(items: Items, df: np.ndarray, n: int) -> tuple[dict[bytes, int], np.ndarray]:
    """The terms with their numbers (``FREQUENT`` for benchmark words that are none) and their idf weights."""
    old = items.terms
    kept = {w for w, i in old.items() if df[i] <= max(MAX_DF * n, MIN_FREQUENT)}
    for words in items.words:
        kept.update(sorted(set(words), key=lambda w: (df[old[w]], w))[:KEEP])
    order = sorted(kept)
    terms = {w: FREQUENT for w in old} | {w: i for i, w in enumerate(order)}
    counts = np.array([df[old[w]] for w in order])
    return terms, np.log((n + 1) / (counts + 1)) + 1


def sketch(docs: DataFrame, text: str, shared, idf: np.ndarray, width: int, seed: int, fan: int = 16) -> tuple[np.ndarray, float]:
    """A'(A W) over all passages of all documents, for a Gaussian W of ``width`` columns, and the number of passages.

    A task's partial sum is as large as the result, so up to ``fan`` input partitions share a task where there are
    more partitions than cores.
    """
    spark, m = docs.sparkSession, len(idf)
    weights = spark.sparkContext.broadcast(idf.astype(np.float32))
    size = BLOCK * SPAN

    def run(batches):
        from pyspark import TaskContext

        terms, w = shared.value, weights.value
        test = w[:, None] * np.random.default_rng(seed).standard_normal((m, width)).astype(np.float32)
        total, seen, passages = np.zeros((m, width), dtype=np.float64), np.zeros(m, dtype=bool), 0

        def add(ids: np.ndarray) -> None:
            at = np.flatnonzero(ids >= 0)
            if not len(at):
                return
            y = blocks_of(ids, test, size)
            order = at[np.argsort(ids[at], kind="stable")]
            starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
            which = ids[order[starts]]
            total[which] += segment_sums(y, order // size, starts)
            seen[which] = True

        held, n = [], 0
        for t in _texts(batches):
            ids = term_ids(words_of(t), terms)
            passages += -(-len(ids) // size)
            held += [ids, np.full(-len(ids) % size, PADDING, dtype=np.int32)]
            n += len(ids)
            if n > _BATCH_WORDS:
                add(np.concatenate(held))
                held, n = [], 0
        if held:
            add(np.concatenate(held))
        total *= w[:, None]
        part = TaskContext.get().partitionId()
        rows = [(-1, np.array([passages], dtype=np.float32))]
        rows += [(b, total[b : b + _ROWS].astype(np.float32)) for b in range(0, m, _ROWS) if seen[b : b + _ROWS].any()]
        for b, z in rows:
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([part], pa.int64()), pa.array([z.tobytes()], pa.binary())], names=["b", "part", "z"])

    def added(frame):
        import pandas as pd

        z = np.sum([np.frombuffer(x, dtype=np.float32) for x in frame["z"]], axis=0, dtype=np.float64).astype(np.float32)
        return pd.DataFrame({"b": [frame["b"].iloc[0]], "part": [frame["part"].iloc[0] // fan], "z": [z.tobytes()]})

    source = docs.select(F.col(f"`{text}`"))
    n = source.rdd.getNumPartitions()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-n // fan))
    parts = source.coalesce(tasks).mapInArrow(run, "b long, part long, z binary")
    scratch, top = Scratch(spark, "sketch"), tasks - 1
    while top > 0:
        parts = parts.groupBy("b", F.floor(F.col("part") / fan).alias("up")).applyInPandas(added, "b long, part long, z binary")
        top //= fan
        if top:
            parts = scratch.save(parts, "sum")
    out, passages = np.zeros((m, width)), 0.0
    for r in parts.collect():
        z = np.frombuffer(r["z"], dtype=np.float32)
        if r["b"] < 0:
            passages += float(z[0])
        else:
            out[r["b"] : r["b"] + len(z) // width] += z.reshape(-1, width)
    return out, passages


def singular_vectors(z: np.ndarray, passages: float, idf: np.ndarray, items: Items, width: int, rank: int, seed: int) -> tuple[np.ndarray, float]:
    """The leading right singular vectors of the passages, the benchmark's own included, from the sketch; and the share
    of an item's squared length that they keep, on average."""
    w = idf.astype(np.float32)
    test = np.random.default_rng(seed).standard_normal((len(idf), width)).astype(np.float32)
    own, n, bags = np.zeros_like(z), 0, []
    for words in items.words:
        ids = term_ids(words, items.terms)
        bags.append(ids[ids >= 0])
        for at in range(0, len(ids), BLOCK * SPAN):
            some = ids[at : at + BLOCK * SPAN]
            some = some[some >= 0]
            np.add.at(own, some, w[some, None] * (w[some, None] * test[some]).sum(axis=0))
            n += 1
    z = z + own * (max(passages, 1.0) / n)
    core = test.T.astype(np.float64) @ z
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    good = values > max(values.max(initial=0.0), 0.0) * 1e-9
    u, _, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    v = u[:, :rank].astype(np.float32)
    shares = []
    for ids in bags:
        which, counts = np.unique(ids, return_counts=True)
        x = counts * w[which]
        shares.append(float(np.sum((x @ v[which]) ** 2) / max(np.sum(x * x), 1e-9)))
    return v, float(np.mean(shares))


def window_sums(blocks: np.ndarray, at: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each block number in ``at`` the sum of that block and the next ``span - 1`` ones, as far as there are any."""
    out = blocks[at].copy()
    for i in range(1, span):
        inside = at + i < len(blocks)
        out[inside] += blocks[at[inside] + i]
    return out


@dataclass
class Index:
    """What a worker needs: the folded terms, the benchmark's passages in the latent space and its words."""

    items: Items
    folded: np.ndarray  # idf x singular vectors
    passages: np.ndarray  # one unit vector a column
    owner: np.ndarray  # the item of each passage
    outside: float  # what a word outside the benchmark adds to a window's squared length
    runs: dict[int, tuple]  # by length the hashes of the runs that are leaks, their items and places


def build_index(items: Items, idf: np.ndarray, vectors: np.ndarray, share: float) -> Index:
    folded = (idf[:, None] * vectors).astype(np.float32)
    rows, owner = [], []
    for i, words in enumerate(items.words):
        blocks = blocks_of(term_ids(words, items.terms), folded)
        starts = np.arange(max(1, len(blocks) - SPAN + 1))
        rows.append(window_sums(blocks, starts))
        owner += [i] * len(starts)
    owner = np.array(owner)
    p = np.vstack(rows)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    long = np.array([len(w) >= MIN_ITEM_WORDS for w in items.words])[owner]
    return Index(items, folded, np.ascontiguousarray(p[long].T), owner[long], share * float(np.mean(idf**2)), build_runs(items))


def build_runs(items: Items) -> dict[int, tuple]:
    """By length the runs that are leaks: their hashes, ascending, and the item and place of each."""
    needs, found = [run_length(w) for w in items.words], {}
    for i, (words, need) in enumerate(zip(items.words, needs)):
        for _, h in run_hashes(term_ids(words, items.terms), [need]):
            found.setdefault(need, []).append((h, np.full(len(h), i, dtype=np.int32), np.arange(len(h), dtype=np.int32)))
    out = {}
    for need, parts in sorted(found.items()):
        h, item, place = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        out[need] = h[order], item[order], place[order]
    return out


class Searcher:
    def __init__(self, index: Index, least_cosine: float, copied: float, rephrased: float):
        self.ix, self.least_cosine, self.copied, self.rephrased = index, least_cosine, copied, rephrased
        self.bags = [Counter(w) for w in index.items.words]

    def candidates(self, ids: np.ndarray):
        """(block, item, cosine) wherever the cosine reaches the bound. A window's length is that of its latent image
        and of its words outside the benchmark."""
        ix = self.ix
        starts = np.arange(0, len(ids), BLOCK)
        ones = np.ones(SPAN, dtype=np.int64)
        tail = lambda x: np.convolve(x, ones)[SPAN - 1 :][: len(x)]  # noqa: E731  sums over a block and those behind it
        terms = tail(np.add.reduceat((ids >= 0).astype(np.int64), starts))
        outside = tail(np.add.reduceat((ids == OUTSIDE).astype(np.int64), starts))
        at = np.flatnonzero(terms >= LEAST_TERMS)
        if not len(at):
            return
        blocks = blocks_of(ids, ix.folded)
        for lo in range(0, len(at), 2048):
            some = at[lo : lo + 2048]
            y = window_sums(blocks, some)
            length = np.sqrt(np.einsum("ij,ij->i", y, y) + outside[some] * ix.outside)
            cos = y @ ix.passages
            cos /= np.maximum(length, 1e-9)[:, None]
            b, p = np.nonzero(cos >= self.least_cosine)
            yield from zip(some[b].tolist(), ix.owner[p].tolist(), cos[b, p].tolist())

    def runs(self, ids: np.ndarray):
        """(position, length, item, place in the item) wherever the hash of a run of an item stands."""
        lengths = list(self.ix.runs)
        known = np.concatenate([[0], np.cumsum((ids != OUTSIDE) & (ids != PADDING))])
        for m, h in run_hashes(ids, lengths):
            hashes, item, place = self.ix.runs[m]
            at = np.flatnonzero(known[m:] - known[:-m] == m)
            lo, hi = (np.searchsorted(hashes, h[at], side=x) for x in ("left", "right"))
            for k in np.flatnonzero(hi > lo):
                for j in range(lo[k], hi[k]):
                    yield int(at[k]), m, int(item[j]), int(place[j])

    def verify(self, words: list[bytes], block: int, item: int) -> tuple[float, bool]:
        """The item's share in the longest common subsequence with the words around a block, and whether its answer
        stands there."""
        target = self.ix.items.words[item]
        near = words[max(0, block * BLOCK - len(target)) : (block + SPAN) * BLOCK + len(target)]
        bag = self.bags[item]
        shared = sum(min(n, bag[w]) for w, n in Counter(w for w in near if w in bag).items())
        if shared < self.rephrased * len(target):
            return 0.0, False
        best = common_subsequence(target, near) / len(target)
        return best, best >= self.rephrased and holds(near, self.ix.items.answers[item])

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its leaks (item, share, cosine), by item."""
        words = [words_of(t) for t in texts]
        ids, first = [], [0]
        for w in words:  # padding fills a text's last block and keeps windows from reaching into the next text
            pad = -len(w) % BLOCK + BLOCK * (SPAN - 1)
            ids += [term_ids(w, self.ix.items.terms), np.full(pad, PADDING, dtype=np.int32)]
            first.append(first[-1] + (len(w) + pad) // BLOCK)
        out: list[dict] = [{} for _ in texts]
        near: dict = defaultdict(list)
        at = np.array(first)
        ids = np.concatenate(ids)
        for block, item, cos in self.candidates(ids):
            d = int(np.searchsorted(at, block, side="right")) - 1
            block -= first[d]
            if block * BLOCK < len(words[d]):
                near[d, item, block // SPAN].append((-cos, block))
        for (d, item, _), windows in near.items():  # of overlapping windows those with the greatest cosines first
            for cos, block in sorted(windows):
                share, answered = self.verify(words[d], block, item)
                if share >= self.copied or answered:
                    if share > out[d].get(item, (0.0,))[0]:
                        out[d][item] = (share, -cos)
                    break
        for i, m, item, place in self.runs(ids):
            d = int(np.searchsorted(at, i // BLOCK, side="right")) - 1
            i -= first[d] * BLOCK
            target = self.ix.items.words[item]
            if item not in out[d] and words[d][i : i + m] == target[place : place + m]:
                near = words[d][max(0, i - len(target)) : i + m + len(target)]
                out[d][item] = (common_subsequence(target, near) / len(target), None)
        order = lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1])
        return [sorted(((self.ix.items.ids[i], s, c) for i, (s, c) in o.items()), key=order) for o in out]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", item_key: str = "item_id", item_text: str = "text",
    rank: int = 256, extra: int = 16, least_cosine: float = 0.3, copied: float = 0.6, rephrased: float = 0.45, seed: int = 3, most_items: int = MAX_ITEMS, most_words: int = MAX_WORDS,
) -> DataFrame:
    """``keys`` and ``leaks``: the items found in a document with the share that is there and the cosine, by item."""
    leak = StructType([StructField("item", benchmark.schema[item_key].dataType), StructField("share", DoubleType()), StructField("cosine", DoubleType())])
    names = [f"k{i}" for i in range(len(keys))]
    blocks = item_blocks(benchmark, item_key, item_text, most_items, most_words)
    items, more = next(blocks, None), next(blocks, None)
    narrow = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(names, keys)], F.col(f"`{text}`").alias("_text"))
    renamed = dict(zip(names, keys))
    if items is None:
        return narrow.select(*names, F.array().cast(ArrayType(leak)).alias("leaks")).withColumnsRenamed(renamed)
    settings = (leak, rank, extra, least_cosine, copied, rephrased, seed)
    if more is None:
        return search_block(narrow, names, items, *settings).withColumnsRenamed(renamed)
    # a text's leaks depend on the text alone: what each block finds is kept by two hashes of it
    scratch, hashes = Scratch(docs.sparkSession, "leaks"), [F.xxhash64("_text").alias("_u"), F.hash("_text").alias("_v")]
    hashed, parts = narrow.select("_text", *hashes), []
    for some in chain([items, more], blocks):
        found = search_block(hashed, ["_u", "_v"], some, *settings).where(F.size("leaks") > 0)
        parts.append(scratch.save(found.dropDuplicates(["_u", "_v"]), "block"))
    each = reduce(DataFrame.unionByName, parts).select("_u", "_v", F.explode("leaks").alias("l"))
    each = scratch.save(each.groupBy("_u", "_v").agg(F.sort_array(F.collect_list("l")).alias("leaks")), "leaks")
    out = narrow.select(*names, *hashes).join(each, ["_u", "_v"], "left")
    return out.select(*names, F.coalesce("leaks", F.array().cast(ArrayType(leak))).alias("leaks")).withColumnsRenamed(renamed)


def search_block(docs: DataFrame, keys: list[str], items: Items, leak: StructType, rank: int, extra: int, least_cosine: float, copied: float, rephrased: float, seed: int) -> DataFrame:
    """``keys`` and the ``leaks`` of one block of items in the column ``_text``, a row for each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, nk = docs.sparkSession, len(keys)
    out = StructType([*[StructField(c, docs.schema[c].dataType) for c in keys], StructField("leaks", ArrayType(leak))])
    df, n = document_frequencies(docs, "_text", spark.sparkContext.broadcast(items.terms))
    items.terms, idf = choose_terms(items, df, n)
    z, passages = sketch(docs, "_text", spark.sparkContext.broadcast(items.terms), idf, rank + extra, seed)
    vectors, share = singular_vectors(z, passages, idf, items, rank + extra, rank, seed)
    index = spark.sparkContext.broadcast(build_index(items, idf, vectors, share))
    kind = to_arrow_type(ArrayType(leak))
    most = 6 * _BATCH_WORDS

    def run(batches):
        s = Searcher(index.value, least_cosine, copied, rephrased)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                found, some, chars = [], [], 0
                for t in batch.column(nk).slice(at, 128).to_pylist():
                    some.append(t)
                    chars += len(t or "")
                    if chars > most:
                        found += s.search(some)
                        some, chars = [], 0
                if some:
                    found += s.search(some)
                rows = [[{"item": i, "share": a, "cosine": c} for i, a, c in f] for f in found]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(at, 128) for i in range(nk)], pa.array(rows, type=kind)], names=[*keys, "leaks"])

    return docs.select(*keys, "_text").mapInArrow(run, out)


def op3_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n = F.size("leaks")
    return rows.select("doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), F.transform("leaks", lambda x: x["item"]).alias("item_ids"), F.coalesce(F.array_max(F.transform("leaks", lambda x: x["share"])), F.lit(0.0)).alias("share"))


QUERIES = {"op3_latent_leaks": op3_latent_leaks}
ORACLES: dict[str, str] = {}
