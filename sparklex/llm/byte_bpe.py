"""Byte-level BPE encoding and decoding (operator 9) with the tiktoken library and a local rank file.

The driver reads the rank file once and broadcasts its bytes, whose size is checked; each Python worker builds one
encoder from them. Texts are split before the library sees them, only at safe boundaries: between a character that is
no white space and a white-space character. No match of the pattern spans such a place and no look-ahead crosses it,
so the parts' ids, joined, are the whole text's ids, while the library holds a bounded piece at a time. Runs of white
space beyond ``RUN_CHARS``, on which the library's regular expression overflows its stack, are matched with the
``regex`` package by the same pattern and handed over match by match.

Defined cases: a null text counts as an empty one (no ids, empty bytes); repeated rows and null keys are answered row
by row; an empty table gives an empty table; other columns of the input play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from sparklex.llm._text import map_rows

#: Characters handed to the library at once, about.
PART_CHARS = 100_000
#: White space in excess of one character a word from which the careful path is taken.
RUN_CHARS = 2_000
#: A rank file beyond this is refused, as it is broadcast.
MAX_RANK_BYTES = 64_000_000

_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])")
_ENCODERS: dict = {}


class RankFile:
    """A rank file on the driver's disk, broadcast as bytes, with the pattern that splits text before the merges."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            data = f.read(MAX_RANK_BYTES + 1)
        if len(data) > MAX_RANK_BYTES:
            raise ValueError(f"{path}: rank files of over {MAX_RANK_BYTES} bytes are not broadcast")
        self.pattern, self.digest = pattern, hashlib.sha256(data).hexdigest()
        self.data = spark.sparkContext.broadcast(data)

    def __getstate__(self):
        return {"pattern": self.pattern, "digest": self.digest, "data": self.data}

    def encoder(self):
        """This worker's tiktoken encoder and the pattern compiled by ``regex``; built once a process."""
        key = (self.digest, self.pattern)
        if key not in _ENCODERS:
            import regex
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.value.splitlines()) if a}
            enc = tiktoken.Encoding("local", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            _ENCODERS[key] = enc, regex.compile(self.pattern)
        return _ENCODERS[key]


def parts(text: str, size: int = PART_CHARS):
    """``text`` cut at the first safe boundary after each ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc, rx, text: str) -> list[int]:
    """The ids that ``enc.encode_ordinary`` gives, whatever the length of the text and of its runs."""
    ids: list[int] = []
    for part in parts(text):
        words = part.split()
        if len(part) - sum(map(len, words)) - len(words) < RUN_CHARS:
            ids += enc.encode_ordinary(part)
        else:
            for m in rx.finditer(part):
                ids += enc._encode_single_piece(m[0].encode())
    return ids


def encode(df: DataFrame, ranks: RankFile, key: str = "doc_id", text: str = "text", packed: bool = False) -> DataFrame:
    """``key`` and ``ids``: an array of int, or with ``packed`` the ids as little-endian unsigned 32-bit integers."""
    kind = BinaryType() if packed else ArrayType(IntegerType(), False)

    def make():
        enc, rx = ranks.encoder()

        def one(value):
            ids = encode_text(enc, rx, value or "")
            return (np.asarray(ids, dtype="<u4").tobytes() if packed else ids,)

        return one

    return map_rows(df, [key], [text], make, StructType([StructField("ids", kind)]))


def decode(df: DataFrame, ranks: RankFile, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``decoded``: the raw bytes of the ids, packed or as an array. Null ids give empty bytes."""
    def make():
        enc, _ = ranks.encoder()

        def one(value):
            if isinstance(value, (bytes, bytearray)):
                value = np.frombuffer(value, dtype="<u4").tolist()
            return (enc.decode_bytes(value or []),)

        return one

    return map_rows(df, list(keys), [ids], make, StructType([StructField("decoded", BinaryType())]))


def public_ranks(spark: SparkSession) -> RankFile:
    import public_tokenizers

    return RankFile(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(docs: DataFrame, ranks: RankFile, with_ids: bool = False) -> DataFrame:
    """Per document the number of ids and the SHA-256 of the packed ids and of the decoded bytes; ``ids`` too if asked."""
    ids = encode(docs.select("doc_id", "text"), ranks, packed=True)
    both = decode(ids, ranks, keys=("doc_id", "ids"))
    return both.select("doc_id", *["ids"] * with_ids, (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_ranks(spark))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
