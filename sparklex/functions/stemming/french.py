"""French Snowball stemmer. The lists are the fixed values of the algorithm's definition."""

from __future__ import annotations

import unicodedata

from sparklex.functions.stemming.base import Word, table

_V = "aeiouyâàëéêèïîôûù"
_1 = {
    "del": table("ances iqUes ismes ables istes ance iqUe isme able iste eux"), "ic": table("atrices ateurs ations atrice ateur ation"), "log": table("logies logie"), "u": table("usions utions usion ution"), "ent": table("ences ence"),
    "ement": table("ements ement"), "ité": table("ités ité"), "iv": table("ives ive ifs if"), "eaux": ["eaux"], "aux": ["aux"], "euse": table("euses euse"), "issement": table("issements issement"), "amment": ["amment"], "emment": ["emment"], "ment": table("ments ment"),
}
_2I = table("issaIent issantes iraIent issante issants issions irions issais issait issant issent issiez issons irais irait irent iriez irons iront isses issez îmes îtes irai iras irez isse ies ira ît ie ir is it i")
_2E = table("eraIent assions erions assent assiez èrent erais erait eriez erons eront aIent antes asses ions erai eras erez âmes âtes ante ants asse ées era iez ais ait ant ée és er ez ât ai as é a")


def french(word: str) -> str:
    s = unicodedata.normalize("NFC", word.lower())
    chars = list(s)
    for i, c in enumerate(chars):
        before, after = chars[i - 1] if i else "", chars[i + 1] if i + 1 < len(chars) else ""
        if c == "u" and before == "q":
            chars[i] = "U"
        elif c in "ui" and before and before in _V and after and after in _V:
            chars[i] = c.upper()
        elif c == "y" and (before and before in _V or after and after in _V):
            chars[i] = "Y"
    s = "".join(chars)
    if s.startswith(("par", "col", "tap")) or len(s) >= 2 and s[0] in _V and s[1] in _V:
        rv = min(3, len(s))
    else:
        rv = next((i + 1 for i in range(1, len(s)) if s[i] in _V), len(s))
    w = Word(s, _V, rv=rv)
    start = w.s
    e = w.longest([x for xs in _1.values() for x in xs])
    kind = next((k for k, xs in _1.items() if e in xs), None)
    verb = False  # whether the verb steps follow although the word changed
    in2, in1, inv = (bool(e) and w.inside(e, r) for r in (w.r2, w.r1, w.rv))
    if kind == "eaux":
        w.cut(e, "eau")
    elif kind == "aux":
        if in1:
            w.cut(e, "al")
    elif kind == "euse":
        if in2:
            w.cut(e)
        elif in1:
            w.cut(e, "eux")
    elif kind == "ement":
        if inv:
            w.cut(e)
            if w.cut_if("iv", w.r2):
                w.cut_if("at", w.r2)
            elif w.s.endswith("eus"):
                w.cut_if("eus", w.r2) or w.cut_if("eus", w.r1, "eux")
            elif not w.cut_first(("abl", "iqU"), w.r2):
                w.cut_if("ièr", w.rv, "i") or w.cut_if("Ièr", w.rv, "i")
    elif kind == "issement":
        if in1 and w.s[: -len(e)][-1:] not in tuple(_V) and w.s[: -len(e)]:
            w.cut(e)
    elif kind in ("amment", "emment"):
        if inv:
            w.cut(e, kind[0] + "nt")
            verb = True
    elif kind == "ment":
        stem = w.s[: -len(e)]
        if stem[-1:] in tuple(_V) and len(stem) - 1 >= w.rv:
            w.cut(e)
            verb = True
    elif in2:
        w.cut(e, {"log": "log", "u": "u", "ent": "ent"}.get(kind, ""))
        if kind == "ic":
            w.cut_if("ic", w.r2) or w.cut_if("ic", 0, "iqU")
        elif kind == "ité":
            w.cut_if("abil", w.r2) or w.cut_if("abil", 0, "abl") or w.cut_if("ic", w.r2) or w.cut_if("ic", 0, "iqU") or w.cut_if("iv", w.r2)
        elif kind == "iv" and w.cut_if("at", w.r2):
            w.cut_if("ic", w.r2) or w.cut_if("ic", 0, "iqU")
    changed = w.s != start
    if not changed or verb:
        e = w.longest(_2I, w.rv)
        hit = bool(e) and len(w.s) - len(e) - 1 >= w.rv and w.s[: -len(e)][-1] not in _V
        if hit:
            w.cut(e)
        else:
            e = w.longest([*_2E, "ions"], w.rv)
            if e == "ions":
                hit = w.inside(e, w.r2)
                if hit:
                    w.cut(e)
            elif e:
                hit = True
                w.cut(e)
                if e in table("âmes âtes ât a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"):
                    w.cut_if("e", w.rv)
        changed = changed and not verb or hit or (verb and w.s != start)
    if changed:
        if w.s.endswith("Y"):
            w.s = w.s[:-1] + "i"
        elif w.s.endswith("ç"):
            w.s = w.s[:-1] + "c"
    else:
        if w.s.endswith("s") and w.s[-2:-1] not in tuple("aiouès") and len(w.s) > 1:
            w.s = w.s[:-1]
        e = w.longest(("ière", "Ière", "ion", "ier", "Ier", "e", "ë"), w.rv)
        if e == "ion":
            stem = w.s[:-3]
            if w.inside(e, w.r2) and stem[-1:] in ("s", "t") and len(stem) - 1 >= w.rv:
                w.cut(e)
        elif e in ("ier", "ière", "Ier", "Ière"):
            w.cut(e, "i")
        elif e == "e":
            w.cut(e)
        elif e == "ë" and w.s[:-1].endswith("gu") and len(w.s) - 3 >= w.rv:
            w.cut(e)
    if w.s.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.s = w.s[:-1]
    for i in range(len(w.s) - 1, -1, -1):
        if w.s[i] in _V:
            if i != len(w.s) - 1 and w.s[i] in "éè":
                w.s = w.s[:i] + "e" + w.s[i + 1 :]
            break
    return w.s.replace("I", "i").replace("U", "u").replace("Y", "y")
