"""Spanish, Italian and Portuguese Snowball stemmers. The lists are the fixed values of the algorithms' definitions."""

from __future__ import annotations

from sparklex.functions.stemming.base import Word, table


def _amente(w: Word, e: str, heads: list[str]) -> bool:
    """-amente in R1, then -iv (and -at before it) or one of ``heads`` in R2."""
    if not w.inside(e, w.r1):
        return False
    w.cut(e)
    if w.cut_if("iv", w.r2):
        w.cut_if("at", w.r2)
    else:
        w.cut_first(heads, w.r2)
    return True


_ES = "aeiouáéíóúü"
_ES_PRONOUN = table("selas selos sela selo las les los nos me se la le lo")
_ES_GERUND = dict(x.split(":") for x in table("iéndo:iendo ándo:ando ár:ar ér:er ír:ir"))
_ES_1 = {
    "del": table("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"),
    "ic": table("adora ador ación adoras adores aciones ante antes ancia ancias acion"), "log": table("logía logías"), "u": table("ución uciones"), "ente": table("encia encias"),
    "amente": ["amente"], "mente": ["mente"], "idad": table("idad idades"), "iv": table("iva ivo ivas ivos"),
}
_ES_Y = table("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_2 = table("arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos")
_ES_2G = table("en es éis emos")


def spanish(word: str) -> str:
    w = Word(word.lower(), _ES)
    e = w.longest(_ES_PRONOUN)
    if e and w.inside(e, w.rv):
        stem = w.s[: -len(e)]
        head = max((x for x in (*_ES_GERUND, "iendo", "ando", "ar", "er", "ir") if stem.endswith(x) and len(stem) - len(x) >= w.rv), key=len, default=None)
        if head:
            w.s = stem[: -len(head)] + _ES_GERUND.get(head, head)
        elif stem.endswith("uyendo") and len(stem) - len("yendo") >= w.rv:
            w.s = stem
    e = w.longest([x for xs in _ES_1.values() for x in xs])
    kind = next((k for k, xs in _ES_1.items() if e in xs), None)
    done = False
    if kind == "amente":
        done = _amente(w, e, ["os", "ic", "ad"])
    elif e and w.inside(e, w.r2):
        done = True
        w.cut(e, {"log": "log", "u": "u", "ente": "ente"}.get(kind, ""))
        if kind == "ic":
            w.cut_if("ic", w.r2)
        elif kind == "mente":
            w.cut_first(("ante", "able", "ible"), w.r2)
        elif kind == "idad":
            w.cut_first(("abil", "ic", "iv"), w.r2)
        elif kind == "iv":
            w.cut_if("at", w.r2)
    if not done:
        e = w.longest(_ES_Y, w.rv)
        if e and w.s[: -len(e)].endswith("u"):
            w.cut(e)
            done = True
        if not done:
            e = w.longest(_ES_2G + _ES_2, w.rv)
            if e:
                w.cut(e)
                if e in _ES_2G and w.s.endswith("gu") and w.inside("u", w.rv):
                    w.cut("u")
    e = w.longest(table("os a o á í ó e é"), w.rv)
    if e:
        w.cut(e)
        if e in ("e", "é") and w.s.endswith("gu") and w.inside("u", w.rv):
            w.cut("u")
    return w.s.translate(str.maketrans("áéíóú", "aeiou"))


_IT = "aeiouàèìòù"
_IT_PRONOUN = table("gliela gliele glieli glielo gliene sene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene gli ci la le li lo mi ne si ti vi")
_IT_1 = {
    "del": table("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"),
    "ic": table("azione azioni atore atori"), "log": table("logia logie"), "u": table("uzione uzioni usione usioni"), "te": table("enza enze"), "r": table("amento amenti imento imenti"),
    "amente": ["amente"], "ità": ["ità"], "iv": table("ivo ivi iva ive"),
}
_IT_2 = table("erebbero irebbero assero assimo eranno erebbe eremmo ereste eresti essero iranno irebbe iremmo ireste iresti iscano iscono issero arono avamo avano avate eremo erete erono evamo evano evate iremo irete irono ivamo ivano ivate ammo ando asse assi emmo enda ende endi endo erai erei yamo iamo immo irai irei isca isce isci isco ano are ata ate ati ato ava avi avo erà ere erò ete eva evi evo irà ire irò ita ite iti ito iva ivi ivo ono uta ute uti uto ar ir")


def italian(word: str) -> str:
    s = word.lower().translate(str.maketrans("áéíóú", "àèìòù"))
    chars = list(s)
    for i, c in enumerate(chars):
        if c == "u" and i and chars[i - 1] == "q":
            chars[i] = "U"
    for i in range(1, len(chars) - 1):
        if chars[i] in "ui" and chars[i - 1] in _IT and chars[i + 1] in _IT:
            chars[i] = chars[i].upper()
    w = Word("".join(chars), _IT)
    e = w.longest(_IT_PRONOUN)
    if e:
        stem = w.s[: -len(e)]
        room = lambda x: stem.endswith(x) and len(stem) - len(x) >= w.rv
        if room("ando") or room("endo"):
            w.s = stem
        elif room("ar") or room("er") or room("ir"):
            w.s = stem + "e"
    e = w.longest([x for xs in _IT_1.values() for x in xs])
    kind = next((k for k, xs in _IT_1.items() if e in xs), None)
    done = False
    if kind == "amente":
        done = _amente(w, e, ["os", "ic", "abil"])
    elif kind == "r":
        done = w.cut_if(e, w.rv)
    elif e and w.inside(e, w.r2):
        done = True
        w.cut(e, {"log": "log", "u": "u", "te": "te"}.get(kind, ""))
        if kind == "ic":
            w.cut_if("ic", w.r2)
        elif kind == "ità":
            w.cut_first(("abil", "ic", "iv"), w.r2)
        elif kind == "iv" and w.cut_if("at", w.r2):
            w.cut_if("ic", w.r2)
    if not done:
        e = w.longest(_IT_2, w.rv)
        if e:
            w.cut(e)
    if w.s[-1:] in tuple("aeioàèìò") and w.inside("a", w.rv):
        w.s = w.s[:-1]
        w.cut_if("i", w.rv)
    if w.s.endswith(("ch", "gh")) and w.inside("h", w.rv):
        w.s = w.s[:-1]
    return w.s.replace("I", "i").replace("U", "u")


_PT = "aeiouáéíóúâêô"
_PT_1 = {
    "del": table("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância ança anças"),
    "log": table("logia logias"), "u": table("uça~o uço~es"), "ente": table("ência ências"), "amente": ["amente"], "mente": ["mente"], "idade": table("idade idades"), "iv": table("iva ivo ivas ivos"), "ir": table("ira iras"),
}
_PT_2 = table("ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras")


def portuguese(word: str) -> str:
    w = Word(word.lower().replace("ã", "a~").replace("õ", "o~"), _PT)
    e = w.longest([x for xs in _PT_1.values() for x in xs])
    kind = next((k for k, xs in _PT_1.items() if e in xs), None)
    changed = False
    if kind == "amente":
        changed = _amente(w, e, ["os", "ic", "ad"])
    elif kind == "ir":
        if w.inside(e, w.rv) and w.s[: -len(e)].endswith("e"):
            w.cut(e, "ir")
            changed = True
    elif e and w.inside(e, w.r2):
        changed = True
        w.cut(e, {"log": "log", "u": "u", "ente": "ente"}.get(kind, ""))
        if kind == "mente":
            w.cut_first(("ante", "avel", "ível"), w.r2)
        elif kind == "idade":
            w.cut_first(("abil", "ic", "iv"), w.r2)
        elif kind == "iv":
            w.cut_if("at", w.r2)
    if not changed:
        e = w.longest(_PT_2, w.rv)
        if e:
            w.cut(e)
            changed = True
    if changed:
        if w.s.endswith("ci") and w.inside("i", w.rv):
            w.cut("i")
    else:
        e = w.longest(table("os a i o á í ó"), w.rv)
        if e:
            w.cut(e)
    e = w.longest(("e", "é", "ê"), w.rv)
    if e:
        w.cut(e)
        for x in ("gu", "ci"):
            if w.s.endswith(x) and w.inside(x[1], w.rv):
                w.s = w.s[:-1]
                break
    elif w.s.endswith("ç"):
        w.s = w.s[:-1] + "c"
    return w.s.replace("a~", "ã").replace("o~", "õ")
