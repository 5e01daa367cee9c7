"""Sub-word tokenizers as Arrow-batched Column functions, and batch encoding with templates.

A model is broadcast once; encoding is pure row by row, so it streams without state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sparklex.functions.tokenize.models import AddedToken, Bpe, BpeOptions, Unigram, WordPiece

ENCODED = StructType([StructField("tokens", ArrayType(StringType())), StructField("ids", ArrayType(IntegerType()))])


#: Texts that are Python objects at once; what lies before and behind is in Arrow's form.
SLICE = 256


def _sliced(values: pa.Array, kind: pa.DataType, run) -> pa.Array:
    """``run`` over slices of a batch, whose results are put together in Arrow's form."""
    parts = [run(values.slice(at, SLICE)) for at in range(0, len(values), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def encode(spark: SparkSession, model, text) -> Column:
    """struct(tokens, ids) of a string column; null in, null out."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("tokens", pa.list_(pa.string())), ("ids", pa.list_(pa.int32()))])

    def run(s: pa.Array) -> pa.Array:
        m = shared.value
        row = lambda x: dict(zip(("tokens", "ids"), (None, None) if x is None else m.encode(x)))
        return _sliced(s, kind, lambda part: pa.array(map(row, part.to_pylist()), kind))

    return F.arrow_udf(run, ENCODED)(F.col(text) if isinstance(text, str) else text)


def encode_ids(spark: SparkSession, model, text) -> Column:
    """The ``ids`` of ``encode`` alone, without the cost of the tokens' texts."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.int32())

    def ids(part: pa.Array) -> pa.Array:
        m, texts = shared.value, part.to_pylist()
        given = [x for x in texts if x is not None]
        got = iter(m.packed_many(given) if hasattr(m, "packed_many") else map(m.packed_ids, given))
        found = [None if x is None else next(got) for x in texts]
        ends = np.cumsum([0, *(0 if f is None else len(f) // 4 for f in found)])
        flat = pa.array(np.frombuffer(b"".join(f for f in found if f), dtype=np.int32))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([f is None for f in found]))

    def run(s: pa.Array) -> pa.Array:
        return _sliced(s, kind, ids)

    return F.arrow_udf(run, ArrayType(IntegerType()))(F.col(text) if isinstance(text, str) else text)


def decode(spark: SparkSession, model: Bpe, ids, skip_special: bool = False) -> Column:
    shared = spark.sparkContext.broadcast(model)

    def run(s: pa.Array) -> pa.Array:
        m = shared.value
        return _sliced(s, pa.string(), lambda part: pa.array((None if x is None else m.decode(x, skip_special) for x in part.to_pylist()), pa.string()))

    return F.arrow_udf(run, StringType())(F.col(ids) if isinstance(ids, str) else ids)


@dataclass(frozen=True)
class Template:
    """Special tokens around an encoded text, and the padding token."""

    prefix: tuple[str, ...] = ()
    suffix: tuple[str, ...] = ()
    pad: str | None = None


TEMPLATES = {"bert": Template(("[CLS]",), ("[SEP]",), "[PAD]"), "roberta": Template(("<s>",), ("</s>",), "<pad>"), "t5": Template((), ("</s>",), "<pad>"), "none": Template()}


def batch_encode(df: DataFrame, model, text: str, template: str | Template = "bert", max_length: int | None = None, truncation: str = "longest_first", batch: str | None = None) -> DataFrame:
    """``df`` with ``input_ids`` and ``attention_mask``, padded to the longest row of its ``batch`` column, if any.

    Ids beyond ``max_length`` less the special tokens are cut (``longest_first`` and ``right`` are one for single
    texts) or refused (``none``).
    """
    spark = df.sparkSession
    t = TEMPLATES[template] if isinstance(template, str) else template
    ids_of = {}
    for name in (*t.prefix, *t.suffix, *([t.pad] if t.pad else [])):
        ids_of[name] = model.token_id(name)
        if ids_of[name] is None:
            raise ValueError(f"the vocabulary has no {name}")
    budget = None if max_length is None else max_length - len(t.prefix) - len(t.suffix)
    if budget is not None and budget < 0:
        raise ValueError("max_length has no room for the special tokens")
    ids = F.col("_e")
    if budget is not None:
        over = F.size(ids) > budget
        cut = F.raise_error(F.lit("a text is longer than max_length")).cast("array<int>") if truncation == "none" else F.slice(ids, 1, budget) if budget else F.array().cast("array<int>")
        ids = F.when(over, cut).otherwise(ids)
    lits = lambda names: F.array(*[F.lit(int(ids_of[n])) for n in names]) if names else F.array().cast("array<int>")
    out = df.withColumn("_e", encode_ids(spark, model, text)).withColumn("_i", F.concat(lits(t.prefix), ids, lits(t.suffix))).drop("_e")
    n = F.size("_i")
    width = F.max(n).over(Window.partitionBy(batch)) if batch else n
    out = out.withColumn("_w", width)
    pad = F.array_repeat(F.lit(int(ids_of[t.pad]) if t.pad else 0), (F.col("_w") - n).cast("int"))
    long = lambda c: F.transform(c, lambda x: x.cast(LongType()))
    out = out.withColumn("input_ids", long(F.concat("_i", pad)))
    return out.withColumn("attention_mask", long(F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), (F.col("_w") - n).cast("int"))))).drop("_i", "_w")


__all__ = ["AddedToken", "Bpe", "BpeOptions", "Unigram", "WordPiece", "Template", "TEMPLATES", "encode", "encode_ids", "decode", "batch_encode"]
