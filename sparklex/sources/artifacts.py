"""Readers of tokenizer artifacts: vocab.txt, vocab.json with merges.txt, tokenizer.json, SentencePiece models.

Artifacts are read on the driver through Spark's file systems, checked against limits, and refused, with a reason,
where they ask for something that the models here would not reproduce.
"""

from __future__ import annotations

import base64
import json
import math
import struct
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from sparklex.functions.tokenize import models as M


@dataclass(frozen=True)
class Limits:
    """What an artifact may hold."""

    vocabulary: int = 1_000_000
    token_chars: int = 1_024
    depth: int = 32
    total_bytes: int = 256 * 1024 * 1024


class ArtifactError(ValueError):
    """An artifact is damaged, too large, or asks for what is not supported."""


def read_bytes(spark: SparkSession, path: str, limits: Limits = Limits()) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("length", "content")
    if sum(r["length"] for r in rows.select("length").collect()) > limits.total_bytes:
        raise ArtifactError(f"{path} is larger than {limits.total_bytes} bytes")
    return b"".join(bytes(r["content"]) for r in rows.collect())


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ArtifactError(why)


def _check_vocab(vocab: dict[str, int], limits: Limits) -> dict[str, int]:
    _need(len(vocab) <= limits.vocabulary, "the vocabulary is too large")
    _need(all(len(t) <= limits.token_chars for t in vocab), "a token is too long")
    _need(all(isinstance(i, int) and not isinstance(i, bool) and i >= 0 for i in vocab.values()), "token ids must be non-negative integers")
    return vocab


def vocab_txt(data: bytes, limits: Limits = Limits(), **options) -> M.WordPiece:
    """One token a line, its id the line's number; a blank line is the empty token, a repeated token has the later id."""
    text = data.decode("utf-8-sig")
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    return M.WordPiece(_check_vocab({t.removesuffix("\r"): i for i, t in enumerate(lines)}, limits), **options)


def _json(data: bytes, limits: Limits):
    def deep(x, n=0):
        _need(n <= limits.depth, "the JSON is nested too deeply")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            if isinstance(y, (dict, list)):
                deep(y, n + 1)

    try:
        doc = json.loads(data)
    except ValueError as e:
        raise ArtifactError(f"no JSON: {e}") from None
    deep(doc)
    return doc


def merges_txt(data: bytes) -> list[tuple[str, str]]:
    out = []
    for i, line in enumerate(data.decode().split("\n")):
        line = line.removesuffix("\r")
        if not line or i == 0 and line.startswith("#version"):
            continue
        pair = line.split(" ")
        _need(len(pair) == 2 and all(pair), f"merge {i + 1} is no pair")
        out.append((pair[0], pair[1]))
    return out


def bpe_files(vocab: bytes, merges: bytes, options: M.BpeOptions, limits: Limits = Limits()) -> M.Bpe:
    """A model from vocab.json and merges.txt; the caller states the pipeline."""
    doc = _json(vocab, limits)
    _need(isinstance(doc, dict), "vocab.json must be an object")
    return M.Bpe(_check_vocab(doc, limits), merges_txt(merges), options)


def _added(doc: dict) -> tuple[M.AddedToken, ...]:
    flags = ("special", "normalized", "lstrip", "rstrip", "single_word")
    out = []
    for t in doc.get("added_tokens") or []:
        _need(isinstance(t.get("content"), str) and t["content"] != "" and isinstance(t.get("id"), int), "an added token needs content and an id")
        out.append(M.AddedToken(t["content"], t["id"], **{f: bool(t.get(f, f == "normalized" and not t.get("special"))) for f in flags}))
    return tuple(out)


def tokenizer_json(data: bytes, limits: Limits = Limits()):
    """A WordPiece, unigram or BPE model from a tokenizer.json; pipelines that would differ are refused."""
    doc = _json(data, limits)
    _need(isinstance(doc, dict) and isinstance(doc.get("model"), dict), "tokenizer.json must hold a model")
    for part in ("truncation", "padding", "post_processor"):
        _need(doc.get(part) is None, f"{part} is not supported")
    model = doc["model"]
    kind = model.get("type") or ("BPE" if "merges" in model else None)
    build = {"WordPiece": _wordpiece, "Unigram": _unigram, "BPE": _bpe}.get(kind)
    _need(build is not None, f"models of type {kind} are not supported")
    return build(doc, model, limits)


def _steps(part) -> list[dict]:
    if part is None:
        return []
    if part.get("type") == "Sequence":
        inner = part.get("normalizers", part.get("pretokenizers"))
        return [s for p in inner or [] for s in _steps(p)]
    return [part]


def _wordpiece(doc: dict, model: dict, limits: Limits) -> M.WordPiece:
    pre = doc.get("pre_tokenizer") or {}
    _need(pre.get("type") == "Whitespace", "WordPiece needs the Whitespace pre-tokenizer")
    lower = False
    for n in _steps(doc.get("normalizer")):
        if n["type"] == "Lowercase":
            lower = True
        elif n["type"] == "BertNormalizer":
            _need(not n.get("clean_text") and not n.get("handle_chinese_chars") and not n.get("strip_accents"), "BertNormalizer may only lower-case")
            lower |= bool(n.get("lowercase"))
        else:
            raise ArtifactError(f"normalizer {n['type']} is not supported")
    _need(model.get("max_input_chars_per_word", 100) == 100, "max_input_chars_per_word must be 100")
    return M.WordPiece(_check_vocab(model["vocab"], limits), model.get("unk_token", "[UNK]"), model.get("continuing_subword_prefix", "##"), 100, lower, _added(doc))


def _unigram(doc: dict, model: dict, limits: Limits) -> M.Unigram:
    pre = doc.get("pre_tokenizer") or {}
    _need(pre.get("type") == "Metaspace" and pre.get("replacement", "▁") == "▁" and pre.get("prepend_scheme", "always") == "always" and pre.get("add_prefix_space", True) and pre.get("split", True), "unigram needs the Metaspace pre-tokenizer with a prefix always")
    _need(not model.get("byte_fallback"), "byte fallback is not supported")
    charsmap = b""
    for n in _steps(doc.get("normalizer")):
        _need(n["type"] == "Precompiled", f"normalizer {n['type']} is not supported")
        charsmap = base64.b64decode(n["precompiled_charsmap"] or "")
    vocab, unk = model["vocab"], model.get("unk_id")
    _need(len(vocab) <= limits.vocabulary, "the vocabulary is too large")
    _need(isinstance(unk, int) and 0 <= unk < len(vocab), "unk_id is out of range")
    _need(all(math.isfinite(s) for _, s in vocab), "scores must be finite")
    special = {t.id: t.special for t in _added(doc)}
    kinds = [M.UNKNOWN if i == unk else (M.CONTROL if special[i] else M.USER_DEFINED) if i in special else M.NORMAL for i in range(len(vocab))]
    return M.Unigram([(p, float(s), k) for (p, s), k in zip(vocab, kinds)], unk, charsmap)


_BEHAVIORS = {"Removed": "removed", "Isolated": "isolated", "MergedWithPrevious": "merged_with_previous", "MergedWithNext": "merged_with_next", "Contiguous": "contiguous"}


def _bpe(doc: dict, model: dict, limits: Limits) -> M.Bpe:
    import regex

    _need(not model.get("dropout"), "dropout is not supported")
    _need(not model.get("byte_fallback"), "byte fallback is not supported")
    forms = []
    for n in _steps(doc.get("normalizer")):
        _need(n["type"] in ("NFC", "NFD", "NFKC", "NFKD"), f"normalizer {n['type']} is not supported")
        forms.append(n["type"])
    splits, byte_level, prefix, after = [], False, False, 0
    pre = _steps(doc.get("pre_tokenizer"))
    kinds = [p["type"] for p in pre]
    _need(kinds in ([], ["Whitespace"], ["ByteLevel"], ["Split", "ByteLevel"]), f"pre-tokenizers {kinds} are not supported")
    for p in pre:
        if p["type"] == "Whitespace":
            splits.append((M.PATTERNS["whitespace"], "removed", True))
        elif p["type"] == "Split":
            pattern = p["pattern"]
            _need(len(pattern) == 1 and ("Regex" in pattern or "String" in pattern) and "behavior" in p and "invert" in p, "Split needs one pattern, a behavior and invert")
            text = pattern["Regex"] if "Regex" in pattern else regex.escape(pattern["String"])
            splits.append((text, _BEHAVIORS[p["behavior"]], bool(p["invert"])))
        else:
            _need("add_prefix_space" in p, "ByteLevel needs add_prefix_space")
            byte_level, prefix, after = True, bool(p["add_prefix_space"]), len(splits)
            if p.get("use_regex", True):
                splits.append((M.PATTERNS["gpt2"], "isolated", False))
    decoder = doc.get("decoder")
    _need(decoder is None or (decoder["type"] == "ByteLevel") == byte_level, "the decoder does not fit the pre-tokenizer")
    continuing = model.get("continuing_subword_prefix") or ""
    _need(not (byte_level and continuing), "a byte-level model has no continuing prefix")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    _need(all(len(m) == 2 for m in merges), "a merge is no pair")
    options = M.BpeOptions(byte_level, prefix, bool(model.get("ignore_merges")), bool(model.get("fuse_unk")), model.get("end_of_word_suffix") or "", continuing, model.get("unk_token"), tuple(splits), tuple(forms), _added(doc), prefix_after=after)
    return M.Bpe(_check_vocab(model["vocab"], limits), merges, options)


def protobuf_fields(data: bytes):
    """(number, value) of a message: integers, 4 or 8 raw bytes, or the bytes of a length-delimited field."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            _need(at < len(data) and shift < 64, "the message is cut short")
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
            continue
        _need(wire in (1, 2, 5), "an unknown wire type")
        n = {1: 8, 5: 4}.get(wire) or (varint() if wire == 2 else 0)
        _need(at + n <= len(data), "the message is cut short")
        yield number, data[at : at + n]
        at += n


def sentencepiece_model(data: bytes, limits: Limits = Limits()) -> M.Unigram:
    """A unigram .model file. Byte fallback, kept white space and a missing dummy prefix are refused."""
    pieces, unk, charsmap, collapse = [], 0, b"", True
    for number, value in protobuf_fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, M.NORMAL
            for n, v in protobuf_fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in protobuf_fields(value):
                _need(n != 3 or v == 1, "only unigram models are supported")
                _need(n != 35 or not v, "byte fallback is not supported")
                if n == 40:
                    unk = v
        elif number == 3:
            for n, v in protobuf_fields(value):
                if n == 2:
                    charsmap = v
                _need(n not in (3, 5) or bool(v), "a model without dummy prefix or escaping is not supported")
                if n == 4:
                    _need(bool(v), "kept white space is not supported")
    _need(bool(pieces) and len(pieces) <= limits.vocabulary, "there are no pieces, or too many")
    unk = next((i for i, p in enumerate(pieces) if p[2] == M.UNKNOWN), unk)
    return M.Unigram(pieces, unk, charsmap, collapse)


def with_added(model: M.Bpe, added: tuple[M.AddedToken, ...]) -> M.Bpe:
    return M.Bpe(model.vocab, sorted(model.ranks, key=model.ranks.get), replace(model.options, added=added))
