"""License scans (operator 7): Aho-Corasick finds tags and notices, a shunting-yard parser evaluates expressions.

A text is lower-cased in A-Z and cut into words; one automaton over all notice phrases and the identifier tag runs once
over the words, so a phrase is found wherever its words stand consecutively. Where the tag occurs, the expressions that
follow it in the text are parsed: ``with`` binds tighter than ``and``, ``and`` tighter than ``or``.

``score`` is the permissiveness of the terms found, from 0 (none found, or proprietary) to 1: a phrase or identifier has
the value of its label, ``or`` takes the greater side, ``and`` and the coexistence of several notices the lesser one,
and an exception behind ``with`` adds a tenth.

Defined cases: a null text counts as an empty one; an expression that does not parse yields the identifiers in it,
joined by ``and``; repeated rows and null keys are answered row by row; an empty table gives an empty table; other
columns play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from sparklex.llm._text import map_rows

BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit", "isc license": "isc", "boost software license": "bsl", "unlicense": "unlicense",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by 4 0": "cc-by", "cc by 3 0": "cc-by", "cc0": "cc0",
    "dedicated to the public domain": "public-domain", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Permissiveness by label; other identifiers count as half.
PERMISSIVE = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "bsl": 1.0, "apache": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6,
    "lgpl": 0.5, "cc-by-sa": 0.4, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0,
}

_FAMILY = re.compile(r"(agpl|lgpl|gpl|apache|bsd|mit|mpl|epl|isc|bsl|cc-by-nc|cc-by-sa|cc-by-nd|cc-by|cc0|unlicense)(?=$|[-0-9.+])")
_TAGGED = re.compile(r"spdx-license-identifier[^\S\n]*:[^\S\n]*([^\n]*)")
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """The family label of an identifier in lower case; an unknown identifier is its own label."""
    m = _FAMILY.match(identifier)
    return m[1] if m else identifier


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: infix tokens in postfix order; None if they are no well-formed expression."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for t in tokens:
        if t == "(":
            if not operand_next:
                return None
            held.append(t)
        elif t == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif t in _RANK:
            if operand_next:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[t]:
                out.append(held.pop())
            held.append(t)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(t)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """The labels of an expression and its permissiveness. The name behind ``with`` is an exception, no label."""
    stack: list[tuple[set[str], float]] = []
    for t in postfix:
        if t not in _RANK:
            label = label_of(t)
            stack.append(({label}, PERMISSIVE.get(label, 0.5)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        stack.append((a, min(1.0, x + 0.1)) if t == "with" else (a | b, max(x, y) if t == "or" else min(x, y)))
    return stack[0]


def expressions(low: str) -> list[tuple[str, set[str], float]]:
    """The tagged expressions of a lower-cased text with their labels and permissiveness."""
    out = []
    for m in _TAGGED.finditer(low):
        tokens = _TOKEN.findall(m[1])
        postfix = to_postfix(tokens)
        if postfix is None:
            names = [t for t in tokens if t not in _RANK and t not in "()"]
            postfix = names + ["and"] * (len(names) - 1)
        if postfix:
            out.append((" ".join(tokens), *evaluate(postfix)))
    return out


#: Bytes outside words become spaces, A-Z becomes a-z, all else stays; words are what lies between spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Scanner:
    """The automaton over phrases; ``scan`` gives word counts, places and labels of one text."""

    def __init__(self, base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for phrase, label in {**notices, **base}.items():
            self.machine.add_word(f" {phrase} ", (phrase, label, phrase in base, len(phrase)))
        self.machine.add_word(f" {TAG} ", (TAG, None, False, len(TAG)))
        self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple:
        raw = (text or "").encode()
        words = raw.translate(_WORDS).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        places, base, labels, values, found = [], set(), set(), [], []
        word, at, tagged = -1, 0, False
        for end, (phrase, label, is_base, n) in sorted(self.machine.iter(line), key=lambda x: x[0] - x[1][3]):
            start = end - n
            word, at = word + line.count(" ", at, start), start
            tagged |= label is None
            if label is None:
                continue
            found.append((phrase, word, label))
            labels.add(label)
            values.append(PERMISSIVE.get(label, 0.5))
            if is_base:
                places.append(word)
                base.add(label)
        tags = expressions(raw.lower().decode()) if tagged else []
        for _, names, value in tags:
            labels |= names
            values.append(value)
        return len(words), places, sorted(base), sorted(labels), found, [t for t, _, _ in tags], min(values, default=0.0)


SCAN = StructType([
    StructField("n_words", LongType()), StructField("places", ArrayType(LongType())), StructField("base_labels", ArrayType(StringType())), StructField("labels", ArrayType(StringType())),
    StructField("phrases", ArrayType(StructType([StructField("phrase", StringType()), StructField("word", IntegerType()), StructField("label", StringType())]))),
    StructField("expressions", ArrayType(StringType())), StructField("score", DoubleType()),
])


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """``key`` and the fields of ``SCAN``: word count, places and labels of base phrases, all labels, phrases with their
    first word, tagged expressions and the permissiveness, a row for each row."""
    return map_rows(df, [key], [text], lambda: Scanner(base, notices).scan, SCAN)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


QUERIES = {"op7_licenses": op7_licenses}
ORACLES: dict[str, str] = {}
