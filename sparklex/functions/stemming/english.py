"""Porter's stemmer of 1980 and the later English Snowball stemmer."""

from __future__ import annotations

from sparklex.functions.stemming.base import Word, after_vowel_consonant, table

_V = "aeiou"


def _kinds(s: str) -> str:
    """``v`` or ``c`` for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, c in enumerate(s):
        out += "v" if c in _V or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(s: str) -> int:
    return _kinds(s).count("vc")


def _cvc(s: str) -> bool:
    return len(s) >= 3 and _kinds(s)[-3:] == "cvc" and s[-1] not in "wxy"


def _double(s: str) -> bool:
    return len(s) >= 2 and s[-1] == s[-2] and _kinds(s)[-1] == "c"


#: Endings with their replacements, the first that fits decides.
_P2 = [x.split(":") for x in table("ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log")]
_P3 = [x.split(":") for x in table("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:")]
_P4 = table("ement ance ence able ible ment ant ent ion ism ate iti ous ive ize al er ic ou")


def porter(word: str) -> str:
    s = word.lower()
    if len(s) <= 2:
        return s
    if s.endswith("sses") or s.endswith("ies"):
        s = s[:-2]
    elif s.endswith("s") and not s.endswith("ss"):
        s = s[:-1]
    if s.endswith("eed"):
        if _measure(s[:-3]):
            s = s[:-1]
    else:
        for e in ("ed", "ing"):
            if s.endswith(e) and "v" in _kinds(s[: -len(e)]):
                s = s[: -len(e)]
                if s.endswith(("at", "bl", "iz")):
                    s += "e"
                elif _double(s) and s[-1] not in "lsz":
                    s = s[:-1]
                elif _measure(s) == 1 and _cvc(s):
                    s += "e"
                break
    if s.endswith("y") and "v" in _kinds(s[:-1]):
        s = s[:-1] + "i"
    for rules in (_P2, _P3):
        for old, new in rules:
            if s.endswith(old):
                if _measure(s[: -len(old)]) > 0:
                    s = s[: -len(old)] + new
                break
    for e in _P4:
        if s.endswith(e):
            stem = s[: -len(e)]
            if _measure(stem) > 1 and (e != "ion" or stem.endswith(("s", "t"))):
                s = stem
            break
    if s.endswith("e"):
        m = _measure(s[:-1])
        if m > 1 or m == 1 and not _cvc(s[:-1]):
            s = s[:-1]
    if s.endswith("ll") and _measure(s) > 1:
        s = s[:-1]
    return s


_VY = "aeiouy"
#: Fixed values of the algorithm's definition.
_WHOLE = dict(x.split(":") for x in table("skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"))
_STOP_1A = set(table("inning outing canning herring earring proceed exceed succeed"))
_DOUBLES = table("bb dd ff gg mm nn pp rr tt")
_E2 = dict(x.split(":") for x in table("tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less ogi:og li:"))
_E3 = dict(x.split(":") for x in table("tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:"))
_E4 = table("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")


def _short(s: str) -> bool:
    """Whether a word ends in a short syllable."""
    v = lambda c: c in _VY
    if len(s) == 2:
        return v(s[0]) and not v(s[1])
    return len(s) > 2 and not v(s[-3]) and v(s[-2]) and not v(s[-1]) and s[-1] not in "wxY"


def english(word: str) -> str:
    s = word.lower()
    for mark in "’‘‛":
        s = s.replace(mark, "'")
    if len(s) <= 2:
        return s
    if s in _WHOLE:
        return _WHOLE[s]
    s = s.removeprefix("'")
    chars = list(s)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in _VY):
            chars[i] = "Y"
    w = Word("".join(chars), _VY)
    for head in ("gener", "commun", "arsen"):
        if w.s.startswith(head):
            w.r1 = len(head)
            w.r2 = after_vowel_consonant(w.s, w.r1, _VY)
    e = w.longest(("'s'", "'s", "'"))
    if e:
        w.cut(e)
    e = w.longest(("sses", "ied", "ies", "us", "ss", "s"))
    if e == "sses":
        w.cut("es")
    elif e in ("ied", "ies"):
        w.cut(e, "i" if len(w.s) > 4 else "ie")
    elif e == "s" and any(c in _VY for c in w.s[:-2]):
        w.cut("s")
    if w.s in _STOP_1A:
        return w.s.lower()
    e = w.longest(("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if e in ("eed", "eedly"):
        w.cut_if(e, w.r1, "ee")
    elif e and any(c in _VY for c in w.s[: -len(e)]):
        w.cut(e)
        if w.s.endswith(("at", "bl", "iz")):
            w.s += "e"
        elif w.s.endswith(tuple(_DOUBLES)):
            w.s = w.s[:-1]
        elif w.r1 >= len(w.s) and _short(w.s):
            w.s += "e"
    if len(w.s) > 2 and w.s[-1] in "yY" and w.s[-2] not in _VY:
        w.s = w.s[:-1] + "i"
    e = w.longest(_E2)
    if e and w.inside(e, w.r1):
        before = w.s[: -len(e)][-1:]
        if e == "li":
            if before in tuple("cdeghkmnrt"):
                w.cut(e)
        elif e != "ogi" or before == "l":
            w.cut(e, _E2[e])
    e = w.longest(_E3)
    if e and w.inside(e, w.r1) and (e != "ative" or w.inside(e, w.r2)):
        w.cut(e, _E3[e])
    e = w.longest(_E4)
    if e and w.inside(e, w.r2) and (e != "ion" or w.s[:-3].endswith(("s", "t"))):
        w.cut(e)
    if w.s.endswith("l") and w.inside("l", w.r2) and w.s[:-1].endswith("l"):
        w.s = w.s[:-1]
    elif w.s.endswith("e") and (w.inside("e", w.r2) or w.inside("e", w.r1) and not _short(w.s[:-1])):
        w.s = w.s[:-1]
    return w.s.lower()
