"""Queries of the sub-word tokenizers, artifact readers and streams."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklex.functions import tokenize as T
from sparklex.functions.tokenize import models as M
from sparklex.operators.vectorize import Analyzer
from sparklex.plans import sql_text as Q
from sparklex.plans.scratch import Scratch
from sparklex.sources import artifacts as A
from sparklex.streaming import metrics as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _frequent(s: SparkSession, d: str, n: int = 3_000) -> list[tuple[str, int]]:
    """A vocabulary of at most ``n`` words, the most frequent ones."""
    words = _docs(s, d).select(F.explode(Analyzer().terms(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [(r["w"], r["n"]) for r in words.orderBy(F.col("n").desc(), "w").limit(n).collect()]


def _characters(s: SparkSession, d: str) -> list[str]:
    def distinct(batches):
        for batch in batches:
            found: set[str] = set()
            for at in range(0, len(batch), T.SLICE):
                found.update(*batch.column(0).slice(at, T.SLICE).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["c"])

    rows = _docs(s, d).select(F.lower("text")).mapInArrow(distinct, "c string").distinct()
    return sorted(r["c"] for r in rows.collect() if not r["c"].isspace())


def wordpiece(s: SparkSession, d: str) -> M.WordPiece:
    words, chars = [w for w, _ in _frequent(s, d)], _characters(s, d)
    tokens = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *words, *chars, *(f"##{c}" for c in chars), *(f"##{w}" for w in words if len(w) < 5)]
    return A.vocab_txt("\n".join(dict.fromkeys(tokens)).encode(), lowercase=True)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("digest"))


_WORDS = "SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents"
_add("wordpiece_encode", lambda s, d: _counted(_docs(s, d).select("doc_id", T.encode_ids(s, wordpiece(s, d), "text").alias("ids"))),
     f"{Q.wordpiece(_WORDS, 'SELECT doc_id AS key, coalesce(text, chr(32)) AS text FROM documents')} SELECT key AS doc_id, len(ids) AS n_tokens, md5(array_to_string(ids, ',')) AS digest FROM enc")


def unigram(s: SparkSession, d: str) -> M.Unigram:
    words = _frequent(s, d)
    total = sum(n for _, n in words)
    pieces = [["<unk>", 0.0]] + [[f"▁{w}", math.log(n / total)] for w, n in words] + [[c, -14.0] for c in ["▁", *_characters(s, d)]]
    return A.tokenizer_json(json.dumps({"pre_tokenizer": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True}, "model": {"type": "Unigram", "unk_id": 0, "vocab": pieces}}).encode())


_add("unigram_encode", lambda s, d: _counted(_docs(s, d).select("doc_id", T.encode_ids(s, unigram(s, d), F.lower("text")).alias("ids"))))


def byte_bpe() -> M.Bpe:
    """The public byte-level vocabulary through the tokenizer.json reader."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        doc = json.loads(f.read())
    return A.tokenizer_json(json.dumps(doc | {"post_processor": None, "truncation": None, "padding": None}).encode())


_add("bpe_encode", lambda s, d: _counted(_docs(s, d).select("doc_id", T.encode_ids(s, byte_bpe(), "text").alias("ids"))))


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    model = byte_bpe()
    return _docs(s, d).select("doc_id", F.md5(T.decode(s, model, T.encode_ids(s, model, "text"))).alias("digest"))


_add("bpe_decode", _round_trip, "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")


def _batched(s: SparkSession, d: str) -> DataFrame:
    turns = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    out = T.batch_encode(turns, wordpiece(s, d), "text", "bert", 64, "longest_first", "conv_id")
    return out.select("conv_id", "turn", F.size("input_ids").cast("long").alias("width"), F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"))


_TURNS = "SELECT {'c': conv_id, 't': turn} AS key, coalesce(text, '') AS text FROM conversations"
_add("batch_encode", _batched, f"{Q.wordpiece(_WORDS, _TURNS)}, n AS (SELECT key.c AS conv_id, key.t AS turn, least(len(ids) + 2, 64) AS n_tokens FROM enc) SELECT conv_id, turn, max(n_tokens) OVER (PARTITION BY conv_id) AS width, n_tokens FROM n")


def stream_confusion(s: SparkSession, d: str) -> DataFrame:
    """Hourly confusion of an event's type and a guess from its value, read as a stream."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    scratch = Scratch(s, "stream")
    source = f"{scratch.base}/source"
    s.read.parquet(f"{d}/events.parquet").write.parquet(source)
    stream = s.readStream.schema(schema).parquet(source)
    guess = F.when(F.col("value") < 20, "view").when(F.col("value") < 60, "click").otherwise("purchase")
    result = S.windowed_confusion(stream, "ts", F.col("event_type"), guess)
    name = "confusion_" + scratch.base.rsplit("-", 1)[-1]
    S.run_to_table(result, name, f"{scratch.base}/checkpoint")
    return s.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "y_true", "y_pred", "w")


_add("stream_confusion", stream_confusion, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS y_true, CASE WHEN value < 20 THEN 'view' WHEN value < 60 THEN 'click' ELSE 'purchase' END AS y_pred, count(*) AS w FROM events GROUP BY ALL")
