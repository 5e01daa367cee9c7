"""German Snowball stemmer."""

from __future__ import annotations

from sparklex.functions.stemming.base import Word

_V = "aeiouyäöü"
_S, _ST = "bdfghklmnrt", "bdfghklmnt"


def german(word: str) -> str:
    s = word.lower().replace("ß", "ss")
    chars = list(s)
    for i in range(1, len(chars) - 1):
        if chars[i] in "uy" and chars[i - 1] in _V and chars[i + 1] in _V:
            chars[i] = chars[i].upper()
    w = Word("".join(chars), _V, least_r1=3)
    e = w.longest(("ern", "em", "er", "en", "es", "e", "s"))
    if e and w.inside(e, w.r1):
        if e == "s":
            if w.s[-2:-1] in tuple(_S):
                w.cut(e)
        else:
            w.cut(e)
            if e in ("en", "es", "e") and w.s.endswith("niss"):
                w.cut("s")
    e = w.longest(("est", "en", "er", "st"))
    if e and w.inside(e, w.r1) and (e != "st" or w.s[-3:-2] in tuple(_ST) and len(w.s) >= 6):
        w.cut(e)
    e = w.longest(("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"))
    if e and w.inside(e, w.r2):
        own = lambda x: not w.s[: -len(x)].endswith("e")
        if e in ("end", "ung"):
            w.cut(e)
            if w.s.endswith("ig") and w.inside("ig", w.r2) and own("ig"):
                w.cut("ig")
        elif e in ("ig", "ik", "isch"):
            if own(e):
                w.cut(e)
        elif e in ("lich", "heit"):
            w.cut(e)
            for x in ("er", "en"):
                if w.cut_if(x, w.r1):
                    break
        else:
            w.cut(e)
            for x in ("lich", "ig"):
                if w.cut_if(x, w.r2):
                    break
    return w.s.replace("ä", "a").replace("ö", "o").replace("ü", "u").replace("U", "u").replace("Y", "y")
