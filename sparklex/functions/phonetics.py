"""Phonetic encoders: Soundex as a native expression, Metaphone and NYSIIS as Arrow-batched kernels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def soundex(s) -> Column:
    """Four characters, or nothing for a string without A-Z."""
    s = F.col(s) if isinstance(s, str) else s
    return F.soundex(F.regexp_replace(F.translate(s, _az, _AZ), "[^A-Z]", ""))


def _letters(s: str) -> str:
    return "".join(u if len(u := c.upper()) == 1 else c for c in s if c.isalpha())


def metaphone_of(value: str) -> str:
    w = _letters(value)
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    w = "".join(c for i, c in enumerate(w) if not i or c == "C" or w[i - 1] != c)
    vowels, out, skip = set("AEIOU"), [], 0
    for i, c in enumerate(w):
        if skip:
            skip -= 1
            continue
        before, a, b = w[i - 1 : i] if i else "", w[i + 1 : i + 2], w[i + 2 : i + 3]
        if c in vowels:
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if before == "M" and i == len(w) - 1 else "B"
        elif c == "C":
            code = "X" if a == "H" or a + b == "IA" else "S" if a in ("I", "E", "Y") else "K"
        elif c == "D":
            soft = a == "G" and b in ("I", "E", "Y")
            code, skip = ("J", 1) if soft else ("T", 0)
        elif c == "G":
            if a == "H":
                code, skip = ("", 1) if b == "T" else ("K", 0)
            elif a == "N" and not b:
                code, skip = "", 1
            else:
                code = "J" if a in ("I", "E", "Y") else "K"
        elif c == "H":
            silent = before in ("C", "S", "P", "T") or before in vowels and a not in vowels
            code = "" if silent else "H"
        elif c == "K":
            code = "" if before == "C" else "K"
        elif c in ("P", "S", "T"):
            if a == "H":
                code = {"P": "F", "S": "X", "T": "0"}[c]
            else:
                code = "X" if c != "P" and a == "I" and b in ("O", "A") else c
        elif c in ("W", "Y"):
            code = c if a in vowels else ""
        elif c == "X":
            code = "KS" if i else "S"
        else:
            code = {"Q": "K", "V": "F", "Z": "S"}.get(c, c if c in "FJLMNR" else "")
        out.append(code)
    return "".join(out)


_HEADS = (("MAC", "MCC"), ("KN", "N"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS"))
_ENDS = {"EE": "Y", "IE": "Y", "DT": "D", "RT": "D", "RD": "D", "NT": "D", "ND": "D"}


def nysiis_of(value: str) -> str:
    s = _letters(value)
    if not s:
        return ""
    for old, new in _HEADS:
        if s.startswith(old):
            s = new + s[len(old) :]
            break
    if s[-2:] in _ENDS:
        s = s[:-2] + _ENDS[s[-2:]]
    vowels, key, i = set("AEIOU"), s[0], 1
    while i < len(s):
        c, a, before, step = s[i], s[i + 1 : i + 2], s[i - 1], 1
        if c + a == "EV":
            code, step = "AF", 2
        elif c in vowels:
            code = "A"
        elif c == "K":
            code = "N" if a == "N" else "C"
        elif s[i : i + 3] == "SCH":
            code, step = "SSS", 3
        elif c + a == "PH":
            code, step = "FF", 2
        elif c == "H":
            code = before if before not in vowels else "H" if a in vowels else "A"
        elif c == "W":
            code = before if before in vowels else "W"
        else:
            code = {"Q": "G", "Z": "S", "M": "N"}.get(c, c)
        for x in code:
            if x != key[-1]:
                key += x
        i += step
    if len(key) > 1 and key[-1] == "S":
        key = key[:-1]
    if len(key) > 1 and key.endswith("AY"):
        key = key[:-2] + "Y"
    if len(key) > 1 and key[-1] == "A":
        key = key[:-1]
    return key


def word_udf(f):
    """An Arrow-batched string function that remembers values within a batch."""
    def run(s: pd.Series) -> pd.Series:
        seen: dict = {}
        return pd.Series([None if x is None else seen[x] if x in seen else seen.setdefault(x, f(x)) for x in s], dtype="object")

    udf = F.pandas_udf(run, StringType())
    return lambda s: udf(F.col(s) if isinstance(s, str) else s)


metaphone = word_udf(metaphone_of)
nysiis = word_udf(nysiis_of)
