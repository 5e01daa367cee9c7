"""Sparse text vectorizers: analysers, counts, tf-idf, hashing. Long form: one row a (document, term).

An analyser is a native expression from a text column to an array of terms. A row's terms are counted in place; only
keys that several rows have are grouped by a shuffle. Fitting is a count combined on the map side and a vocabulary table
with column numbers in ordinal order; its most frequent terms, bounded in number, are broadcast, the rows of the others
are shuffled, and it is never collected. Column numbers come from a two-level count (range partitions, then
offsets), so no task holds the whole vocabulary.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StringType

from sparklex.plans.scratch import Scratch

WORD_PATTERN = r"(?U)\b\w\w+\b"
#: So many terms are broadcast at most.
FREQUENT = 400_000
#: Characters that are cut into n-grams at once.
GRAM_CHARS = 1 << 20


@dataclass(frozen=True)
class Analyzer:
    """``kind`` is word, char or char_wb; ``ngrams`` the least and greatest n."""

    kind: str = "word"
    ngrams: tuple[int, int] = (1, 1)
    lowercase: bool = True
    strip_accents: bool = False
    pattern: str = WORD_PATTERN
    stop_words: tuple[str, ...] = ()

    def folded(self, text: Column) -> Column:
        t = F.lower(text) if self.lowercase else text
        return unaccent(t) if self.strip_accents else t

    def terms(self, text: Column) -> Column:
        lo, hi = self.ngrams
        if not 1 <= lo <= hi:
            raise ValueError("n-gram sizes must be ordered and at least 1")
        t = self.folded(text)
        if self.kind == "word":
            words = F.regexp_extract_all(t, F.lit(self.pattern), F.lit(0))
            if self.stop_words:
                words = F.filter(words, lambda w: ~w.isin(*self.stop_words))
            return words if (lo, hi) == (1, 1) else _bind(words, lambda w: _grams(w, lo, hi))
        if self.kind == "char":
            return _bind(F.regexp_replace(t, r"(?U)\s+", " "), lambda s: F.flatten(F.array(*[char_grams(s, n) for n in range(lo, hi + 1)])))
        if self.kind == "char_wb":
            words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
            return F.flatten(F.transform(words, lambda w: _bounded(F.concat(F.lit(" "), w, F.lit(" ")), lo, hi)))
        raise ValueError("kind must be word, char or char_wb")


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _strings() -> Column:
    return F.array().cast("array<string>")


def _grams(words: Column, lo: int, hi: int) -> Column:
    one = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, n)))).otherwise(_strings())
    return F.flatten(F.array(*[one(n) for n in range(lo, hi + 1)]))


def char_grams(s: Column, n: int) -> Column:
    """Every run of ``n`` characters; a look-ahead finds them in one pass over the string."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def _bounded(word: Column, lo: int, hi: int) -> Column:
    """n-grams of a padded word; one shorter than n is given once, and no greater n is tried."""
    parts = []
    for n in range(lo, hi + 1):
        short = F.array(word) if n == lo else _strings()
        parts.append(F.when(F.length(word) >= n, char_grams(word, n)).otherwise(short))
    return F.flatten(F.array(*parts))


def _unaccent(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn"))


def unaccent(text: Column) -> Column:
    """NFKD without non-spacing marks; Spark has no normaliser, so this one is an Arrow-batched function."""
    return F.pandas_udf(_unaccent, StringType())(text)


def _given(text: str) -> Column:
    return F.when(F.col(text).isNull(), F.raise_error(F.lit("a text must not be null")).cast("string")).otherwise(F.col(text))


def repeated(df: DataFrame, key: str) -> bool:
    """Whether several rows have one key; nulls are one key."""
    return df.groupBy(key).count().where("count > 1").limit(1).count() > 0


def _runs(terms: Column) -> Column:
    """array<struct(term, tf)> of the distinct terms of an array, from its sorted runs."""
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    one = lambda s, b: F.transform(b, lambda i, at: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, at + 1), F.size(s)) - i).cast("double").alias("tf")))
    return _bind(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, _bind(begins(s), lambda b: one(s, b))).otherwise(F.array().cast("array<struct<term:string,tf:double>>")))


def term_counts(df: DataFrame, key: str, text: str, analyzer: Analyzer = Analyzer(), binary: bool = False, shared: bool | None = None) -> DataFrame:
    """``key``, ``term``, ``tf``; a null text is refused. ``shared``: whether several rows have one key, if that is known."""
    rows = df.select(F.col(key), F.inline(_runs(analyzer.terms(_given(text)))))
    if repeated(df, key) if shared is None else shared:
        rows = rows.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return rows.withColumn("tf", F.lit(1.0)) if binary else rows


def term_totals(df: DataFrame, key: str, text: str, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """``term``, ``n``, ``df``: how often a term stands in all texts, and under how many keys.

    n-grams of characters of one size are counted in blocks of texts and come back once a block.
    """
    lo, hi = analyzer.ngrams
    shared = repeated(df, key)
    if shared or analyzer.kind == "word" or lo != hi or lo < 2:
        counts = term_counts(df, key, text, analyzer, shared=shared)
        return counts.groupBy("term").agg(F.sum("tf").cast("long").alias("n"), F.count("*").alias("df"))
    spaced = df.select(F.regexp_replace(analyzer.folded(_given(text)), r"(?U)\s+", " ").alias("t"))
    rows = spaced.mapInArrow(_gram_totals(lo, analyzer.kind == "char_wb"), "term string, n bigint, df bigint")
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _gram_totals(n: int, bounded: bool):
    """Batches of texts to their n-grams, how often these stand there and in how many texts. ``bounded``: of each word
    with a space on both sides, of which one shorter than ``n`` is given once."""

    def count(texts: list[str]):
        if bounded:
            texts = [f" {t} " for t in (t.strip(" ") for t in texts) if t]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        yield _windows(codes, text, n, bounded, False)
        for short in range(3, n if bounded else 0):
            yield _windows(codes, text, short, True, True)

    def run(batches):
        for batch in batches:
            held, chars = [], 0
            for at in range(0, len(batch), 64):
                for t in batch.column(0).slice(at, 64).to_pylist():
                    held.append(t)
                    chars += len(t)
                if chars >= GRAM_CHARS or at + 64 >= len(batch):
                    for terms, total, df in count(held):
                        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(total, pa.int64()), pa.array(df, pa.int64())], names=["term", "n", "df"])
                    held, chars = [], 0

    return run


def _windows(codes: np.ndarray, text: np.ndarray, size: int, bounded: bool, whole: bool):
    """The distinct windows of ``size`` characters that lie in one text, with their numbers and those of texts. ``bounded``
    ones have spaces at their ends only, ``whole`` ones at both."""
    m = max(0, len(codes) - size + 1)
    keep = text[:m] == text[len(text) - m :]
    space = codes == 32
    for k in range(1, size - 1) if bounded else ():
        keep &= ~space[k : k + m]
    if whole:
        keep &= space[:m] & space[len(space) - m :]
    at = np.flatnonzero(keep)
    if not len(at):
        return [], at, at
    table = np.zeros(0x110000, dtype=np.int64)
    table[codes] = 1
    alphabet = np.flatnonzero(table)
    table[alphabet] = np.arange(len(alphabet))
    bits, low = max(1, (len(alphabet) - 1).bit_length()), max(1, int(text[-1]).bit_length())
    if bits * size + low > 62:  # too many characters for one number
        s = "".join(map(chr, codes))
        pairs = Counter((s[i : i + size], t) for i, t in zip(at.tolist(), text[at].tolist()))
        total, df = Counter(), Counter()
        for (term, _), c in pairs.items():
            total[term] += c
            df[term] += 1
        return list(total), list(total.values()), [df[t] for t in total]
    gram = np.zeros(len(at), dtype=np.int64)
    for k in range(size):
        gram = gram << bits | table[codes[at + k]]
    pair = np.sort(gram << low | text[at])
    new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])  # a window in a text
    gram = pair[new] >> low
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])  # a window
    total, df = np.diff(np.r_[new[first], len(pair)]), np.diff(np.r_[first, len(gram)])
    mask = (1 << bits) - 1
    chars = np.stack([alphabet[gram[first] >> bits * (size - 1 - k) & mask] for k in range(size)], axis=1)
    s = chars.astype("<u4").tobytes().decode("utf-32-le")
    return [s[i : i + size] for i in range(0, len(s), size)], total, df


def vocabulary(counts: DataFrame, key: str, n_docs: int, min_df: float = 1, max_df: float = 1.0) -> DataFrame:
    """``term``, ``df``, ``col``: terms within the document frequencies, numbered in ordinal order.

    ``min_df`` below 1 and ``max_df`` up to 1.0 are shares of the documents, else counts.
    """
    low = min_df * n_docs if 0 < min_df < 1 else min_df
    high = max_df * n_docs if max_df <= 1.0 else max_df
    kept = counts.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= low) & (F.col("df") <= high))
    scratch = Scratch(counts.sparkSession, "vocabulary")
    ranged = scratch.save(kept.repartitionByRange("term").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))  # one row a partition
    local = F.row_number().over(Window.partitionBy("part").orderBy("term"))
    return ranged.join(F.broadcast(offsets), "part").select("term", "df", (local + F.col("before") - 1).cast("int").alias("col"))


def _join_vocabulary(counts: DataFrame, vocab: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of at most ``FREQUENT`` terms, those of the greatest ``df``, stay where they are; the others are shuffled."""
    if "df" not in vocab.columns:
        return counts.join(vocab, "term")
    kept, least = 0, None
    for r in vocab.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.col("df").desc()).toLocalIterator():  # few distinct frequencies
        if kept + r["n"] > FREQUENT:
            break
        kept, least = kept + r["n"], r["df"]
    else:
        return counts.join(F.broadcast(vocab), "term")
    if least is None:
        return counts.join(vocab, "term")
    frequent = vocab.where(F.col("df") >= least)
    rare = counts.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(vocab.where(F.col("df") < least), "term")
    return counts.join(F.broadcast(frequent), "term").unionByName(rare.repartition(key) if key else rare)


def count_vectorize(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """``key``, ``term``, ``col``, ``value``; unseen terms drop out."""
    return _join_vocabulary(counts, vocab).select(key, "term", "col", F.col("tf").alias("value"))


def with_idf(vocab: DataFrame, n_docs: int, smooth: bool = True) -> DataFrame:
    s = 1 if smooth else 0
    return vocab.withColumn("idf", F.log((F.lit(n_docs) + s) / (F.col("df") + s)) + 1)


def tfidf(counts: DataFrame, vocab: DataFrame, key: str, norm: str | None = "l2", sublinear: bool = False) -> DataFrame:
    """``key``, ``term``, ``col``, ``value`` from counts and a vocabulary with ``idf``."""
    tf = F.log("tf") + 1 if sublinear else F.col("tf")
    if norm:
        counts = counts.repartition(key)  # before the join, as its rows are smaller than those behind it
    rows = _join_vocabulary(counts, vocab, key if norm else None).select(key, "term", "col", (tf * F.col("idf")).alias("value"))
    return normalize(rows, key, norm)


def norms(rows: DataFrame, key: str, norm: str = "l2") -> DataFrame:
    v = F.sum(F.abs("value")) if norm == "l1" else F.sqrt(F.sum(F.col("value") * F.col("value")))
    return rows.groupBy(key).agg(v.alias("norm"))


def normalize(rows: DataFrame, key: str, norm: str | None = "l2") -> DataFrame:
    """Each row divided by its norm; a zero row stays."""
    if norm is None:
        return rows
    if norm not in ("l1", "l2"):
        raise ValueError("norm must be l1, l2 or None")
    w = Window.partitionBy(key)
    n = F.sum(F.abs("value")).over(w) if norm == "l1" else F.sqrt(F.sum(F.col("value") * F.col("value")).over(w))
    return rows.withColumn("value", F.when(n > 0, F.col("value") / n).otherwise(F.col("value")))


def matvec(rows: DataFrame, vector: DataFrame, key: str) -> DataFrame:
    """The product with a table ``(col, x)``."""
    return rows.join(vector, "col").groupBy(key).agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def packed(rows: DataFrame, key: str, width: int) -> DataFrame:
    """``key`` and ``vector``: struct(size, indices, values) with indices ascending."""
    z = F.sort_array(F.collect_list(F.struct("col", "value")))
    return rows.groupBy(key).agg(z.alias("z")).select(key, F.struct(F.lit(width).alias("size"), F.col("z.col").alias("indices"), F.col("z.value").alias("values")).alias("vector"))


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3, 32 bits, signed."""
    c1, c2, mask = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF
    rot = lambda x, r: (x << r | x >> 32 - r) & mask
    mix = lambda k: rot(k * c1 & mask, 15) * c2 & mask
    h, n = seed, len(data) & ~3
    for i in range(0, n, 4):
        h = rot(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64 & mask
    if len(data) > n:
        h ^= mix(int.from_bytes(data[n:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


@lru_cache(1 << 18)
def _hash_of(term: str) -> int:
    return murmur3(term.encode())


def _hash(terms: pa.Array) -> pa.Array:
    found = terms.dictionary_encode()
    return pa.array(map(_hash_of, found.dictionary.to_pylist()), pa.int32()).take(found.indices)


def hashing_vectorize(counts: DataFrame, key: str, n_features: int = 1 << 20, norm: str | None = "l2", alternate_sign: bool = True) -> DataFrame:
    """``key``, ``col``, ``value``: terms hashed to columns with a sign; cells that cancel out drop before the norm.

    The distinct terms of each batch are hashed in place; rows are shuffled once, by their key.
    """
    rows = counts.select(key, "tf", F.arrow_udf(_hash, IntegerType())("term").cast("long").alias("h"))
    sign = F.when(F.col("h") < 0, -1.0).otherwise(1.0) if alternate_sign else F.lit(1.0)
    rows = rows.select(key, (F.abs("h") % n_features).cast("int").alias("col"), (F.col("tf") * sign).alias("value")).repartition(key)
    return normalize(rows.groupBy(key, "col").agg(F.sum("value").alias("value")).where("value <> 0"), key, norm)


#: The fields that the options of a saved vectorizer may have, and their types.
OPTION_FIELDS = {"kind": str, "ngrams": list, "lowercase": bool, "strip_accents": bool, "pattern": str, "stop_words": list, "min_df": (int, float), "max_df": (int, float), "binary": bool, "norm": (str, type(None)), "sublinear": bool, "smooth": bool, "n_docs": int, "n_features": int, "alternate_sign": bool}


def _checked(options: dict) -> dict:
    for name, value in options.items():
        if name not in OPTION_FIELDS or not isinstance(value, OPTION_FIELDS[name]) or isinstance(value, bool) and OPTION_FIELDS[name] is not bool:
            raise ValueError(f"{name} is no option of a vectorizer, or {value!r} no value of it")
    if options.get("kind", "word") not in ("word", "char", "char_wb") or options.get("norm", "l2") not in ("l1", "l2", None):
        raise ValueError("kind must be word, char or char_wb, and norm l1, l2 or None")
    if "ngrams" in options and not (len(options["ngrams"]) == 2 and all(type(n) is int for n in options["ngrams"]) and 1 <= options["ngrams"][0] <= options["ngrams"][1]):
        raise ValueError("ngrams must be two ordered sizes of at least 1")
    if not all(isinstance(w, str) for w in options.get("stop_words", [])):
        raise ValueError("stop words must be strings")
    return options


def save_vectorizer(vocab: DataFrame | None, options: dict, path: str, spark=None) -> None:
    """The options as JSON with a format name and version, and the vocabulary (with ``idf`` if it has one) as Parquet; a
    hashing vectorizer has none, and needs the session instead."""
    import json

    spark = vocab.sparkSession if vocab is not None else spark
    doc = {"format": "sparklex/vectorizer", "version": 1, "vocabulary": vocab is not None, "options": _checked(json.loads(json.dumps(options)))}
    if vocab is not None:
        vocab.write.parquet(f"{path}/vocabulary")
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/options")


def load_vectorizer(spark, path: str) -> tuple[DataFrame | None, dict]:
    """What ``save_vectorizer`` wrote; an unknown format, version, property or option is refused."""
    import json

    doc = json.loads(spark.read.text(f"{path}/options").first()[0])
    if set(doc) != {"format", "version", "vocabulary", "options"} or doc["format"] != "sparklex/vectorizer" or doc["version"] != 1:
        raise ValueError(f"{path} is no vectorizer of this version")
    return spark.read.parquet(f"{path}/vocabulary") if doc["vocabulary"] else None, _checked(doc["options"])
