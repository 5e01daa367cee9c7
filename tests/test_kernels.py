"""Kernels, stemmers, encoders, tokenizers and readers against definitions, other libraries and hand-made values."""

import base64
import json
import struct

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparklex.functions import kernels as K, phonetics as P
from sparklex.functions.stemming import STEMMERS
from sparklex.functions.tokenize import TEMPLATES, batch_encode, models as M
from sparklex.sources import artifacts as A

words = st.text(alphabet="abcé日😀 ", max_size=9)


@settings(max_examples=150, deadline=None)
@given(words, words, words)
def test_metric_axioms(a, b, c):
    for d in (K.levenshtein, K.damerau, K.indel, K.hamming):
        assert d(a, a) == 0 and d(a, b) == d(b, a) and (d(a, b) > 0) == (a != b)
        assert d(a, c) <= d(a, b) + d(b, c)
    assert K.damerau(a, b) <= K.osa(a, b) <= K.levenshtein(a, b) <= K.indel(a, b)
    assert abs(len(a) - len(b)) <= K.levenshtein(a, b) <= max(len(a), len(b))
    assert K.indel(a, b) == len(a) + len(b) - 2 * K.lcs_length(a, b) and K.common_substring(a, b) <= K.lcs_length(a, b)
    assert 0 <= K.jaro(a, b) <= K.jaro_winkler(a, b) <= 1 + 1e-12


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_ratcliff_is_difflib(a, b):
    from difflib import SequenceMatcher

    assert K.ratcliff(a, b) == pytest.approx(SequenceMatcher(None, a, b, autojunk=False).ratio())


def test_hand_values():
    assert (K.osa("CA", "ABC"), K.damerau("CA", "ABC")) == (3, 2)
    assert K.jaro("", "") == 0 and K.ratcliff("", "") == 1 and K.ratio("", "") == 100 and K.weighted_ratio("", "") == 0
    assert K.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6) and K.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert K.token_set_ratio(" ", "") == 0 and K.token_set_ratio(" ", "a") == 100
    assert len(K.utf16("😀")) == 2 and K.levenshtein("😀", "a") == 1 and K.levenshtein(K.utf16("😀"), K.utf16("a")) == 2


def test_phonetics(spark):
    assert [P.metaphone_of(w) for w in ("Thomas", "Knight", "Wright", "")] == ["0MS", "NT", "RT", ""]
    assert P.nysiis_of("") == "" and P.nysiis_of("Knight")[0] == "N"
    df = spark.createDataFrame([("Robert",), ("1abc",), ("",), (None,)], "w string")
    assert [r[0] for r in df.select(P.soundex("w")).collect()] == ["R163", "A120", "", None]


@pytest.mark.parametrize(("lang", "word", "stem"), [
    ("porter", "relational", "relat"), ("porter", "hopping", "hop"), ("en", "generously", "generous"), ("en", "skies", "sky"), ("fr", "rapidement", "rapid"), ("fr", "majestueusement", "majestu"),
    ("de", "aufeinanderfolgenden", "aufeinanderfolg"), ("es", "chicharrones", "chicharron"), ("it", "abbandonata", "abbandon"), ("pt", "boataria", "boat"),
])
def test_stems(lang, word, stem):
    assert STEMMERS[lang](word) == stem == STEMMERS[lang](word.upper())


def test_murmur():
    from sparklex.operators.vectorize import murmur3

    assert [murmur3(x) & 0xFFFFFFFF for x in (b"", b"hello", b"hello, world")] == [0, 0x248BFA47, 0x149BBB7F]


def test_wordpiece_and_added_tokens():
    w = A.vocab_txt(b"[UNK]\nthe\ncat\n##s\nplay\n##ing\n")
    assert w.encode("the cats playing xyz") == (["the", "cat", "##s", "play", "##ing", "[UNK]"], [1, 2, 3, 4, 5, 0])
    s = M.Scanner([M.AddedToken("<a>", 1, lstrip=True), M.AddedToken("<a><b>", 2), M.AddedToken("ab", 3, single_word=True)])
    assert [p if isinstance(p, str) else p.id for p in s.split("x  <a>y<a><b>cab ab")] == ["x", 1, "y", 2, "cab ", 3]


@pytest.fixture(scope="module")
def public():
    P_ = pytest.importorskip("public_tokenizers")
    with open(P_.path("byte_bpe_50k.json"), "rb") as f:
        return P_.path("byte_bpe_50k.json"), json.loads(f.read())


def test_byte_level_bpe_equals_the_library(public):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(public[0])
    model = A.tokenizer_json(json.dumps(public[1] | {"post_processor": None}).encode())
    for text in ("Hello world, it's  1234!\n\n ok", "", "日本語 😀 naïve", "   lead", "a" * 300):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert model.encode(text)[1] == ids and model.decode(ids) == text
    with pytest.raises(ValueError):
        model.decode([10**7])


def test_split_behaviors():
    got = {b: M.split_text("the-final--countdown", "-", b, False) for b in ("removed", "isolated", "merged_with_previous", "merged_with_next", "contiguous")}
    assert got == {
        "removed": ["the", "final", "countdown"], "isolated": ["the", "-", "final", "-", "-", "countdown"], "merged_with_previous": ["the-", "final-", "-", "countdown"],
        "merged_with_next": ["the", "-final", "-", "-countdown"], "contiguous": ["the", "-", "final", "--", "countdown"],
    }


def test_classic_bpe():
    vocab = {c: i for i, c in enumerate(["<unk>", "a", "b", "b</w>", "ab</w>", "a</w>", "ab"])}
    m = M.Bpe(vocab, [("a", "b</w>"), ("a", "b")], M.BpeOptions(end_of_word="</w>", unk="<unk>", fuse_unk=True, splits=((M.PATTERNS["whitespace"], "removed", True),)))
    assert m.encode("ab aab zz") == (["ab</w>", "a", "ab</w>", "<unk>"], [4, 1, 4, 0]) and m.decode([4, 1, 4]) == "ab aab"


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def message(*fields):
    out = b""
    for number, v in fields:
        if isinstance(v, int):
            out += varint(number << 3) + varint(v)
        elif isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        else:
            out += varint(number << 3 | 2) + varint(len(v)) + v
    return out


def test_sentencepiece_model():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -1.5, 1)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces) + message((2, message((3, 1))))
    m = A.sentencepiece_model(data)
    assert m.encode("ab  a xyb") == (["▁ab", "▁a", "▁", "xy", "b"], [4, 2, 1, 0, 3]) and m.encode("") == ([], [])
    for bad in (message((2, message((3, 2)))), message((2, message((35, 1)))), message((3, message((3, 0))))):
        with pytest.raises(A.ArtifactError):
            A.sentencepiece_model(data + bad)
    with pytest.raises(A.ArtifactError):
        A.sentencepiece_model(data[:-1])


def test_readers_refuse():
    base = {"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}}
    assert A.tokenizer_json(json.dumps(base).encode()).encode("a") == (["a"], [0])
    for change in ({"padding": {}}, {"truncation": {}}, {"normalizer": {"type": "Replace"}}, {"pre_tokenizer": {"type": "Digits"}}, {"decoder": {"type": "ByteLevel"}}, {"model": {"type": "WordLevel"}}, {"model": {"type": "BPE", "vocab": {"a": 0}, "merges": [], "dropout": 0.1}}):
        with pytest.raises(A.ArtifactError):
            A.tokenizer_json(json.dumps(base | change).encode())
    with pytest.raises(A.ArtifactError):
        A.tokenizer_json(b"[" * 50 + b"]" * 50)
    with pytest.raises(A.ArtifactError):
        A.vocab_txt(b"[UNK]\n" + b"x" * 2000)
    assert A.merges_txt(b"#version: 0.2\na b\nc d\n") == [("a", "b"), ("c", "d")]
    assert base64.b64encode(b"") == b""


def test_batch_encode(spark):
    w = M.WordPiece({t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b"])})
    df = spark.createDataFrame([(1, "a b a b", 0), (2, "a", 0), (3, "", 1)], "i int, t string, g int")
    rows = {r["i"]: r for r in batch_encode(df, w, "t", "bert", 5, batch="g").collect()}
    assert rows[1]["input_ids"] == [2, 4, 5, 4, 3] and rows[2]["input_ids"] == [2, 4, 3, 0, 0] and rows[2]["attention_mask"] == [1, 1, 1, 0, 0] and rows[3]["input_ids"] == [2, 3]
    with pytest.raises(Exception, match="longer than max_length"):
        batch_encode(df, w, "t", "bert", 3, "none").collect()
    with pytest.raises(ValueError):
        batch_encode(df, w, "t", TEMPLATES["roberta"])


def test_files_through_spark(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("[UNK]\na\n")
    assert A.vocab_txt(A.read_bytes(spark, str(tmp_path / "vocab.txt"))).encode("a b") == (["a", "[UNK]"], [1, 0])
    with pytest.raises(A.ArtifactError):
        A.read_bytes(spark, str(tmp_path / "vocab.txt"), A.Limits(total_bytes=3))


def test_onnx_pooling():
    import numpy as np

    from sparklex.operators import onnx

    class Named:
        def __init__(self, name):
            self.name = name

    class Session:
        def get_inputs(self):
            return [Named("input_ids"), Named("attention_mask")]

        def get_outputs(self):
            return [Named("last_hidden_state")]

        def run(self, names, feed):
            return [np.stack([feed["input_ids"], np.ones_like(feed["input_ids"])], axis=-1).astype(np.float32)]

    got = onnx.run_session(Session(), [[3, 5], [1], [2, 2, 2]], batch=2)
    for v, mean in zip(got, (4, 1, 2)):
        assert v == pytest.approx(np.array([mean, 1]) / np.hypot(mean, 1), abs=1e-6)


def test_components(spark):
    from sparklex.plans.components import connected_components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (200, 200), (None, 3)]
    rows = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    roots = {}
    for r in rows:
        roots.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, roots.values())) == [list(range(61)), [100, 101, 102]]
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_undefined_policies(spark):
    from sparklex.operators import classification as C, curves, regression as R

    df = spark.createDataFrame([(1, 0, 0.5), (1, 0, 0.5)], "t int, p int, s double")
    classes = C.per_class(C.confusion(df, "t", "p"))
    assert [r["value"] for r in C.score(classes, "precision", "binary", zero_division="one").collect()] == [1.0]
    with pytest.raises(Exception, match="undefined"):
        C.score(classes, "precision", "binary", zero_division="throw").collect()
    with pytest.raises(Exception, match="both classes"):
        curves.roc_auc(df, "t", "s").collect()
    with pytest.raises(Exception, match="finite"):
        R.mse(df.withColumn("s", F.lit(float("inf"))), "t", "s").collect()
    assert "accuracy" in C.report_text(C.report(C.confusion(df, "t", "p")))


def test_bpe_prefix_space_goes_to_every_piece_behind_a_split():
    vocab = {c: i for i, c in enumerate("abcd|\u0120")}
    split = ("\\|", "isolated", False)
    model = lambda after: M.Bpe(vocab, [], M.BpeOptions(byte_level=True, prefix_space=True, splits=(split,), prefix_after=after))
    assert model(1).encode("ab|cd")[0] == list("\u0120ab\u0120|\u0120cd")
    assert model(0).encode("ab|cd")[0] == list("\u0120ab|cd") and model(1).encode(" ab")[0] == list("\u0120ab") and model(1).encode("")[0] == []


def test_bpe_fuses_substitutes_only():
    vocab = {"q": 0, "a": 1}
    model = M.Bpe(vocab, [], M.BpeOptions(fuse_unk=True, unk="q"))
    assert [model.encode(t)[0] for t in ("qZ", "ZZ", "Zq", "ZaZZ", "qZZq")] == [["q", "q"], ["q"], ["q", "q"], ["q", "a", "q"], ["q", "q", "q"]]


def test_packed_ids_are_those_of_encode():
    from array import array

    from sparklex.functions.tokenize import models as M

    added = (M.AddedToken("<x>", 90, True, False), M.AddedToken("ab", 91, single_word=True))
    texts = ["", " ", "the cat  sat\n\ton the mat", "<x>the ab<x> cab", "ünknown ▁ mark", "the" * 40, "x'll 12 !?", "\x1c a\x85b c"]
    vocab = {t: i for i, t in enumerate(["[UNK]", "the", "c", "##at", "s", "##a", "##t", "!", "?"])}
    byte = {c: i for i, c in enumerate(M.byte_alphabet().values())}
    merges = [("t", "h"), ("th", "e"), ("Ġ", "the"), ("a", "t"), ("a", "b")]
    split = ((M.PATTERNS["gpt2"], "isolated", False),)
    models = [
        M.WordPiece(vocab, added=added), M.WordPiece(vocab, lowercase=True),
        M.Bpe(byte | {a + b: 300 + i for i, (a, b) in enumerate(merges)}, merges, M.BpeOptions(byte_level=True, splits=split, added=added)),
        M.Bpe({"u": 0, "t": 1, "h": 2, "th": 3}, [("t", "h")], M.BpeOptions(unk="u", fuse_unk=True)),
    ]
    pieces = [("<unk>", 0.0, M.UNKNOWN), ("▁the", -1.0, M.NORMAL), ("▁", -3.0, M.NORMAL), ("ca", -2.0, M.NORMAL), ("a", -4.0, M.NORMAL), ("t", -4.0, M.NORMAL), ("▁ca", -9.0, M.NORMAL)]
    models += [M.Unigram(pieces, 0), M.Unigram(pieces, 0, collapse=False), M.Unigram([*pieces, ("e▁c", -1.0, M.NORMAL)], 0), M.Unigram(pieces[:2], 0)]
    assert [m.by_word for m in models[4:]] == [True, True, False, False]
    for m in models:
        for t in texts * 2:
            assert list(array("i", m.packed_ids(t))) == m.encode(t)[1]
    bpe = models[2]
    assert all(bpe.decode(bpe.encode(t)[1]) == t for t in texts)
    long = list("abthe" * 40)
    assert bpe._merge_few(list(long)) == bpe._merge(list(long))
    with pytest.raises(ValueError):
        bpe.decode([10**6])


def test_batches_are_encoded_in_slices(spark, monkeypatch):
    import pyarrow as pa

    from sparklex.functions import tokenize as T
    from sparklex.functions.tokenize import models as M

    sizes = []
    got = T._sliced(pa.array(["a"] * 1000), pa.string(), lambda part: sizes.append(len(part)) or part)
    assert len(got) == 1000 and max(sizes) <= T.SLICE
    monkeypatch.setattr(M.Memo, "SIZE", 3)
    memo = M.Memo(lambda k: k.encode())
    assert [memo[str(i % 7)] for i in range(50)] == [str(i % 7).encode() for i in range(50)] and len(memo) <= 3 and len(memo.before) <= 3
    rows = spark.createDataFrame([(0, "the cat"), (1, None), (2, "")], "k int, t string")
    m = M.WordPiece({"[UNK]": 0, "the": 1, "c": 2, "##at": 3})
    assert [r[0] for r in rows.orderBy("k").select(T.encode_ids(spark, m, "t")).collect()] == [[1, 2, 3], None, []]
    assert [tuple(r[0]) for r in rows.orderBy("k").select(T.encode(spark, m, "t")).collect()] == [(["the", "c", "##at"], [1, 2, 3]), (None, None), ([], [])]


def test_pairs_are_remembered_across_batches(spark):
    from sparklex.functions import strings as T
    from sparklex.plans.queries_text import QUERIES

    calls = spark.sparkContext.accumulator(0)

    def kernel(a, b):
        calls.add(1)
        return K.partial_ratio(a, b)

    rows = spark.range(25_000, numPartitions=1).select(F.lit("steel ring").alias("a"), F.lit("ring of steel").alias("b"))  # three batches
    value = T.kernel_udf(kernel, "double")("a", "b")
    assert [r[0] for r in rows.select(value.alias("v")).distinct().collect()] == [K.partial_ratio("steel ring", "ring of steel")]
    assert calls.value == 1
    for name in ("fuzz_partial_ratio", "fuzz_partial_token_sort_ratio", "fuzz_partial_token_set_ratio", "damerau_normalized_similarity"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan  # one file is one task otherwise


@given(st.text("abc", max_size=9), st.text("abcd", max_size=9))
def test_partial_ratio_is_the_best_window(a, b):
    def slide(p, t):
        return max((K.ratio(p, t[max(0, i) : i + len(p)]) for i in range(1 - len(p), len(t))), default=0.0)

    want = slide(a, b) if len(a) < len(b) else slide(b, a) if len(a) > len(b) else max(slide(a, b), slide(b, a))
    assert K.partial_ratio(a, b) == pytest.approx(want if a and b else 100.0 if not a and not b else 0.0)


def test_new_pieces_are_merged_together():
    import random
    from array import array

    symbols = list(M.byte_alphabet().values())
    merges = [("t", "h"), ("th", "e"), ("Ġ", "the"), ("a", "a"), ("aa", "a"), ("a", "aa"), ("e", "a"), ("t", "h"), ("Ġ", "t"), ("he", "a"), ("h", "e")]
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*symbols[::-1], *(a + b for a, b in merges)]))}
    bpe = M.Bpe(vocab, merges, M.BpeOptions(byte_level=True, splits=((M.PATTERNS["gpt2"], "isolated", False),)))
    random.seed(4)
    texts = ["".join(random.choices("athe  ü", k=random.randrange(80))) for _ in range(300)]
    assert M.PairMerger.of(bpe)
    assert [list(array("i", b)) for b in bpe.packed_many(texts)] == [bpe.encode(t)[1] for t in texts]
    pieces = sorted({p for t in texts for p in bpe.pieces(t)})
    assert [list(array("i", b)) for b in M.PairMerger.of(bpe).merge([p.encode() for p in pieces] + [b""])] == [bpe._piece(p)[1] for p in pieces] + [[]]
    assert M.PairMerger.of(M.Bpe(vocab, [*merges, ("x", "y")], bpe.options)) is None  # a merged pair without an id
