"""PII surrogates (operator 1): keyed, type-consistent replacements that keep format, distinctness and coreference.

Kinds: e-mail addresses, IPv4 addresses, IBANs, long numbers (cards), social security and telephone numbers, and
personal names: behind a title, behind a given name of ``GIVEN``, and every further mention, in the same text, of a
part of a name found so. Names may hold inner capitals, apostrophes, hyphens, initials and particles, in Latin,
Cyrillic, Greek or Armenian letters. Names in scripts without capitals, and untitled names whose given name is in no
list, are not found.

Surrogates are injective by construction. A structured value moves within the strings of its shape (letters stay letters
of their case, digits digits, separators, address classes and check digits stay true); a given name of ``GIVEN``
moves within the list of its script and gender; any other name is numbered among all strings of its alphabet and the
number, moved, is spelt in syllables. All of them move by a keyed permutation without fixed points (a Feistel network
with cycle walking, and a shift under it), so two values never share a surrogate and none keeps itself. Given name and
family name are apart, so that "Ms Ada Byron", "Dr Byron" and "Ada" agree; a given name's gender is that of the list,
else of its ending, else of all titles that it has anywhere, never of the title at hand.

A collision check over all distinct entities follows. One whose surrogate is a real value of its kind somewhere, or
another one's surrogate, draws again; where a shape is so full of real values that this does not end, the whole shape
keeps its first draw, whose surrogates are distinct. What differs from the first draw is a table, joined by the hash of
the texts concerned, whatever its size. Names of ``GIVEN`` are exempt from the first of the two checks.

Defined cases: a null text stays null and has no entities; repeated rows and null keys are answered row by row; an
empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sparklex.llm._text import map_rows
from sparklex.plans.scratch import Scratch, tidy

#: The key of the registered query; callers of ``pseudonymise`` bring their own.
QUERY_KEY = b"sparklex surrogate key"
#: Draws after which a shape that still collides keeps its first one.
DRAWS = 12

_TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Señor": "m", "Sr": "m", "Monsieur": "m", "Sir": "m", "Господин": "m", "господин": "m", "Κύριος": "m", "κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Госпожа": "f", "госпожа": "f", "Κυρία": "f", "κυρία": "f",
    "Dr": "n", "Prof": "n", "Professor": "n", "Doctor": "n",
}
#: Given names by script and gender: they are found without a title, tell a gender and replace one another.
GIVEN = {
    ("latin", "m"): "Adam Albert Alan Bruno Carl Daniel David Edgar Emil Felix Frank Georg Hugo Jan John James Karl Leo Louis Luis Marco Mark Martin Max Nico Oscar Otto Paul Peter Robert Thomas Victor".split(),
    ("latin", "f"): "Ada Alice Amelie Anna Clara Carmen Diana Elena Elisa Emma Eva Greta Helen Ida Irene Jane Julia Laura Lea Lucia Maria Marta Mary Mia Nina Nora Olga Paula Rosa Sara Sofia Vera".split(),
    ("latin", "n"): "Alex Andrea Chris Dominique Jamie Jean Jo Kai Kim Lou Luca Maxime Noa Robin Sam Sascha Toni Vivian".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Иван Игорь Лев Максим Олег Павел Пётр Роман".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Лидия Мария Нина Ольга Раиса Софья Юлия".split(),
    ("cyrillic", "n"): "Саша Женя Валя Шура".split(),
}
_KNOWN = {n.lower(): (script, gender, i) for (script, gender), names in GIVEN.items() for i, n in enumerate(names)}
#: Lower-case letters that a name is numbered by, without and with accents.
_LETTERS = {
    "latin": ["abcdefghijklmnopqrstuvwxyz'", "abcdefghijklmnopqrstuvwxyz'ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿāăąćčďđēėęěğģīįıķĺļľłńņňōőœŕřśşšţťūůűųźżžșț"],
    "cyrillic": ["абвгдежзийклмнопрстуфхцчшщъыьэюяё'", "абвгдежзийклмнопрстуфхцчшщъыьэюяёђѓєѕіїјљњћќўџґ'"],
    "greek": ["αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ", "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋΐΰ'"],
    "armenian": ["աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆև'"] * 2,
}
#: Syllables are one of the first and one of the second; no end of a second with a first is itself a first, so that a
#: spelling is read in one way only. The last are endings of given names by gender and those of family names, one for
#: each alphabet and one for names with letters of neither.
_ONSETS = {"latin": "b d f g h k l m p s t v w z br dr fr gr kl kr pl tr".split(), "cyrillic": "б в г д ж з к л м п с т ф х ц ч ш".split(), "greek": "β γ δ ζ θ κ λ μ π σ τ φ χ".split(), "armenian": "բ գ դ զ թ կ հ մ պ ս վ տ".split()}
_RIMES = {"latin": "a e i o u an ar en er in on or un".split(), "cyrillic": "а е и о у ан ар ен ер ин он ор ун".split(), "greek": "α ε ι ο αν ερ ιν ον".split(), "armenian": "ա ե ի ո ան եր ին ոն".split()}
_ENDINGS = {
    "latin": {"m": "nus nis nos", "f": "na nia nea", "n": "ny nie ni", "family": "nson nsen nsun"}, "cyrillic": {"m": "нис нус нос", "f": "на ния ная", "n": "ню ней нок", "family": "нов нев нин"},
    "greek": {"m": "νος νας νυς", "f": "να νια νεα", "n": "νι νυ νω", "family": "νης νου νιου"}, "armenian": {"m": "նոս նուս նիս", "f": "նա նիա նեա", "n": "նի նու նե", "family": "նյան նունց նիկ"},
}
_FEMALE, _MALE = {"latin": ("a", "ine", "elle", "ette"), "cyrillic": ("а", "я"), "greek": ("α", "η"), "armenian": ("ուհի",)}, {"latin": ("us", "o"), "cyrillic": ("ий", "слав"), "greek": ("ς",), "armenian": ()}

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŸŹŻŽȘȚЀ-ЯҐΆΈ-ΏΑ-ΫԱ-Ֆ"
_WORD = rf"[{_UP}](?:[^\W\d_]|['’](?=[^\W\d_]{{2}})|-(?=[{_UP}])){{1,63}}"
_INITIAL = rf"[{_UP}]\."
_PARTICLE = r"(?:von|van|de|den|der|del|della|di|da|du|dos|la|le|al|el|bin|ibn|ter|zu)"
_TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(_TITLES, key=len, reverse=True))})\.? ((?:{_INITIAL} ?|{_WORD} |{_PARTICLE} ){{0,4}}{_WORD})(?!\w)")
_LISTED = re.compile(rf"(?<!\w)({'|'.join(sorted((n for ns in GIVEN.values() for n in ns), key=len, reverse=True))}) ((?:{_INITIAL} ?){{0,2}}(?:{_PARTICLE} ){{0,2}}{_WORD})(?!\w)")
_PARTS = re.compile(rf"{_INITIAL}(?!\w)|{_WORD}")
_PATTERNS = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"), "@"),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"), "."),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), None),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "-"),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"), None),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?|\(\d{2,4}\) ?|\d{3}[.-])\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-])"), None),
]
_HAS_DIGIT = bytes(57 if 48 <= c <= 57 else 32 for c in range(256))
_NAME_GATE = re.compile("|".join(sorted({*_TITLES, *(n for ns in GIVEN.values() for n in ns)})))
#: A further mention of a name part has so many letters at least.
_LEAST = 3


def _digest(key: bytes, *what: str) -> bytes:
    return hashlib.blake2b("\x1f".join(what).encode(), key=key[:64], digest_size=32).digest()


def permute(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The image of ``x`` under a keyed permutation of ``range(n)``, or with ``back`` what has that image."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for i in reversed(range(8)) if back else range(8):
            if back:
                a, b = b ^ (int.from_bytes(_digest(key, tweak, str(i), str(a)), "big") & mask), a
            else:
                a, b = b, a ^ (int.from_bytes(_digest(key, tweak, str(i), str(b)), "big") & mask)
        x = a << half | b
        if x < n:
            return x


def moved(x: int, n: int, key: bytes, tweak: str, draw: int = 0) -> int:
    """The image of ``x`` under a keyed permutation of ``range(n)`` without fixed points (``n`` > 1), another one for
    each of n - 1 draws."""
    if n < 2:
        return x
    return permute((permute(x, n, key, tweak) + 1 + draw % (n - 1)) % n, n, key, tweak, back=True)


_RADIX = [("9", "0123456789"), ("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
_CLASS = {c: (s, alphabet) for s, alphabet in _RADIX for c in alphabet}


def shape_of(value: str, fixed: int = 0) -> str:
    return value[:fixed] + "".join(_CLASS[c][0] if c in _CLASS else c for c in value[fixed:])


def move_shape(value: str, key: bytes, tweak: str, draw: int = 0, fixed: int = 0) -> str:
    """A keyed permutation of the strings of one shape; the first ``fixed`` characters and separators stay."""
    at = [i for i, c in enumerate(value) if i >= fixed and c in _CLASS]
    x, n = 0, 1
    for i in at:
        alphabet = _CLASS[value[i]][1]
        x, n = x * len(alphabet) + alphabet.index(value[i]), n * len(alphabet)
    x = moved(x, n, key, f"{tweak}\x1e{shape_of(value, fixed)}", draw)
    out = list(value)
    for i in reversed(at):
        alphabet = _CLASS[value[i]][1]
        x, d = divmod(x, len(alphabet))
        out[i] = alphabet[d]
    return "".join(out)


def luhn_digit(body: str) -> int:
    """The check digit behind ``body``."""
    d = [int(c) for c in body][::-1]
    return -(sum(sum(divmod(2 * x, 10)) for x in d[::2]) + sum(d[1::2])) % 10


def luhn(digits: str) -> bool:
    d = "".join(c for c in digits if c.isdigit())
    return luhn_digit(d[:-1]) == int(d[-1])


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


#: Address classes as ranges of the 32-bit number; what lies in none of them is public.
_SPECIAL = [("0", 0, 1 << 24), ("10", 10 << 24, 11 << 24), ("127", 127 << 24, 128 << 24), ("172.16", 172 << 24 | 16 << 16, 172 << 24 | 32 << 16), ("192.168", 192 << 24 | 168 << 16, 192 << 24 | 169 << 16), ("224", 224 << 24, 1 << 32)]


def _move_ip(x: int, key: bytes, draw: int) -> tuple[str, int]:
    for name, a, b in _SPECIAL:
        if a <= x < b:
            return name, a + moved(x - a, b - a, key, f"ip\x1e{name}", draw)
    y = x - sum(b - a for _, a, b in _SPECIAL if b <= x)
    y = moved(y, (1 << 32) - sum(b - a for _, a, b in _SPECIAL), key, "ip\x1epublic", draw)
    for _, a, b in _SPECIAL:
        y += (b - a) * (y >= a)
    return "public", y


def script_of(name: str) -> str:
    for script, lo, hi in (("cyrillic", "Ѐ", "ӿ"), ("greek", "Ͱ", "Ͽ"), ("armenian", "԰", "֏")):
        if any(lo <= c <= hi for c in name):
            return script
    return "latin"


def gender_of(canon: str) -> str:
    """What a given name itself says: the gender of the list, else of its ending."""
    if canon in _KNOWN:
        return _KNOWN[canon][1]
    script = script_of(canon)
    return "f" if canon.endswith(_FEMALE[script]) else "m" if canon.endswith(_MALE[script]) else "n"


def _spell(canon: str, ending: str, key: bytes, draw: int) -> tuple[str, str]:
    """The class and the spelling of a name: its number among all strings of its alphabet moves among those that take
    as many syllables. A string with letters of no alphabet takes a keyed number of ten syllables."""
    script = script_of(canon)
    onsets, rimes = _ONSETS[script], _RIMES[script]
    base = len(onsets) * len(rimes)
    fits = next((i for i, a in enumerate(_LETTERS[script]) if set(canon) <= set(a)), 2)
    ending = _ENDINGS[script][ending].split()[fits]
    if fits < 2:
        alphabet = _LETTERS[script][fits]
        x = 0
        for c in canon:
            x = x * len(alphabet) + alphabet.index(c) + 1
        n, size = 1, base
        while x >= size:
            x, n, size = x - size, n + 1, size * base
        kind = f"{script}{n}{ending}"
        x = moved(x, size, key, f"name\x1e{kind}", draw)
    else:
        n, kind = 10, f"{script}{ending}"
        x = int.from_bytes(_digest(key, "name", canon, str(draw)), "big") % base**n
    parts = []
    for _ in range(n):
        x, d = divmod(x, base)
        parts.append(onsets[d // len(rimes)] + rimes[d % len(rimes)])
    return kind, "".join(reversed(parts)) + ending


def _prefix(canon: str) -> str:
    """What a name keeps: "o'", "d'", "mc"."""
    m = re.match(r"\w{1,2}['’](?=\w{2})|mc(?=\w{3})", canon)
    return m[0] if m else ""


def _name(canon: str, ending: str, key: bytes, draw: int) -> tuple[str, str]:
    """Class and surrogate of a name part, hyphens kept, in lower case."""
    each = []
    for part in canon.split("-"):
        kept = _prefix(part)
        kind, new = _spell(part[len(kept) :], ending, key, draw)
        each.append((f"{kept}{kind}", kept + new))
    return "-".join(k for k, _ in each), "-".join(s for _, s in each)


def canonical(kind: str, value: str) -> str:
    """What two mentions of one entity share: e-mail addresses and names regardless of case, numbers without separators."""
    if kind in ("email", "given", "family"):
        return value.lower().replace("’", "'")
    if kind in ("card", "phone", "ssn", "iban"):
        return "".join(c for c in value if c.isalnum())
    return value


def drawn(kind: str, canon: str, key: bytes, draw: int = 0, gender: str | None = None) -> tuple[str, str]:
    """The class of a canonical value and its surrogate at one draw, canonical too. Classes do not share surrogates
    (but for names with letters of no alphabet) and within one all surrogates of one draw are distinct."""
    if kind == "email":
        head, _, tld = canon.rpartition(".")
        return f"{shape_of(head)}.{tld}", f"{move_shape(head, key, kind, draw)}.{tld}"
    if kind == "ip":
        x = 0
        for part in canon.split("."):
            x = x << 8 | int(part)
        name, y = _move_ip(x, key, draw)
        return name, ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        body = move_shape(canon[:-1], key, kind, draw)
        off = (int(canon[-1]) - luhn_digit(canon[:-1])) % 10
        return f"{len(canon)}:{off}", body + str((luhn_digit(body) + off) % 10)
    if kind == "iban":
        rest = move_shape(canon[4:], key, f"{kind}{canon[:2]}", draw)
        right = _iban_check(canon[:2], canon[4:]) == canon[2:4]
        return shape_of(canon, 2 if right else 4), canon[:2] + (_iban_check(canon[:2], rest) if right else canon[2:4]) + rest
    if kind in ("ssn", "phone"):
        fixed = 1 if kind == "phone" else 0
        return shape_of(canon, fixed), move_shape(canon, key, kind, draw, fixed)
    if kind == "initial":
        up = next((u for u in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ") if canon in u), canon)
        return f"{kind}{up[0]}", up[moved(up.index(canon), len(up), key, kind, draw)]
    if kind == "given":
        gender = gender or gender_of(canon)
        if canon in _KNOWN and draw == 0:
            script, g, i = _KNOWN[canon]
            pool = GIVEN[script, g]
            return f"list {script} {g}", pool[moved(i, len(pool), key, f"list{script}{g}")].lower()
        return _name(canon, gender, key, draw)
    return _name(canon, "family", key, draw)


def _said_as(new: str, mention: str) -> str:
    """A name in lower case written as the mention is."""
    if mention.isupper() and len(mention) > 1:
        return new.upper()
    return "-".join(w[: len(_prefix(w))].capitalize() + w[len(_prefix(w)) :].capitalize() for w in new.split("-"))


def _edges(text: str, a: int, b: int) -> bool:
    """Whether no word goes on at either end."""
    return not any(c.isalnum() or c == "_" for c in text[max(0, a - 1) : a] + text[b : b + 1])


def mentions(text: str | None) -> list[tuple[str, int, int]]:
    """Entities ``(kind, start, end)`` of a whole text, none overlapping; of a name each part is one."""
    return [m[:3] for m in titled_mentions(text)]


def titled_mentions(text: str | None) -> list[tuple[str, int, int, str]]:
    """``mentions`` with the gender of a given name's title, or an empty one."""
    if not text:
        return []
    raw = text.encode()
    digits = b"9" in raw.translate(_HAS_DIGIT)
    out: list[tuple[int, int, str, str]] = []

    def free(a: int, b: int) -> bool:
        i = bisect_left(out, (b,))
        return i == 0 or out[i - 1][1] <= a

    for kind, pattern, gate in _PATTERNS:
        if gate == "@" and b"@" not in raw or kind != "email" and not digits:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "email":
                a += len(m[0]) - len(m[0].lstrip("._%+-"))
            if text[a] != "@" and free(a, b):
                insort(out, (a, b, kind, ""))
    if _NAME_GATE.search(text):
        found: dict[str, str] = {}

        def named(start: int, end: int, gender: str) -> None:
            parts = [m.span() for m in _PARTS.finditer(text, start, end)]
            for n, (a, b) in enumerate(parts):
                kind = "initial" if text[b - 1] == "." else "family" if n == len(parts) - 1 else "given"
                b -= kind == "initial"
                if free(a, b):
                    insort(out, (a, b, kind, gender if kind == "given" else ""))
                    if kind != "initial":
                        canon = canonical(kind, text[a:b])
                        for part in {canon, *canon.split("-")}:
                            found.setdefault(part, kind)

        for m in _TITLED.finditer(text):
            named(*m.span(2), _TITLES[m[1]])
        for m in _LISTED.finditer(text):
            if free(*m.span()):
                named(*m.span(), "")
        if found:
            for m in _PARTS.finditer(text):
                a, b = m.span()
                kind = found.get(canonical("family", m[0]))
                if kind and b - a >= _LEAST and _edges(text, a, b) and free(a, b):
                    insort(out, (a, b, kind, ""))
    return [(kind, a, b, g) for a, b, kind, g in out]


def _spread(value: str, model: str) -> str:
    """The characters of ``value`` over the separators of ``model``."""
    it = iter(value)
    return "".join(next(it, "") if c.isalnum() else c for c in model) + "".join(it)


def written(kind: str, new: str, mention: str) -> str:
    """A canonical surrogate in the format of a mention."""
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, mention))
    if kind in ("card", "phone", "ssn", "iban"):
        return _spread(new, mention)
    return _said_as(new, mention) if kind in ("given", "family") else new


def replacement(kind: str, mention: str, key: bytes, redrawn: dict) -> str:
    """What a mention becomes; ``redrawn`` holds the surrogates by ``(kind, canonical value)`` that differ."""
    canon = canonical(kind, mention)
    return written(kind, redrawn.get((kind, canon)) or drawn(kind, canon, key)[1], mention)


_ENTITY = StructType([StructField("kind", StringType()), StructField("value", StringType()), StructField("gender", StringType())])


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """``u`` (the text's hash) and ``e``, the distinct ``(kind, value, gender)`` of a text; rows without any left out."""
    some = df.select(F.xxhash64(f"`{text}`").alias("u"), F.col(f"`{text}`").alias("t"))
    make = lambda: lambda t: (sorted({(k, canonical(k, t[a:b]), g) for k, a, b, g in titled_mentions(t)}),)
    return map_rows(some, ["u"], ["t"], make, StructType([StructField("e", ArrayType(_ENTITY))])).where(F.size("e") > 0)


def redraws(found: DataFrame, secret: bytes, draws: int = DRAWS) -> DataFrame:
    """The collision check over distinct ``(kind, value, gender)``, where an empty gender is no title's: the ``kind``,
    ``value`` and ``surrogate`` of all those whose surrogate is not that of ``drawn`` at its first draw."""
    scratch = Scratch(found.sparkSession, "surrogates")
    votes = F.when(F.col("kind") == "given", F.when(F.col("gender").isin("m", "f"), F.col("gender")))
    each = found.groupBy("kind", "value").agg(F.min(votes).alias("lo"), F.max(votes).alias("hi")).select("kind", "value", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("vote"))
    fields = StructType([StructField("class", StringType()), StructField("surrogate", StringType()), StructField("first", StringType())])

    def make():
        def one(kind, value, vote, draw):
            gender = (gender_of(value) if gender_of(value) != "n" or value in _KNOWN else vote or "n") if kind == "given" else None
            return (*drawn(kind, value, secret, draw, gender), drawn(kind, value, secret)[1])

        return one

    draw = lambda t: map_rows(t, ["kind", "value", "vote", "draw"], ["kind", "value", "vote", "draw"], make, fields)
    table = scratch.save(draw(each.withColumn("draw", F.lit(0))), "drawn")
    real = scratch.save(table.select("kind", F.col("value").alias("surrogate")), "real")
    columns = table.columns

    def bad(t: DataFrame) -> DataFrame:
        """``t`` and whether a row has to draw again: its surrogate is real, or a smaller row of its kind has it."""
        t = t.join(real.withColumn("real", F.lit(True)), ["kind", "surrogate"], "left")
        t = t.withColumn("real", F.coalesce("real", F.lit(False)) & ~F.col("class").startswith("list ") & (F.col("kind") != "initial"))
        heads = t.groupBy("kind", "surrogate").agg(F.min(F.struct("real", "draw", "value")).alias("head"), F.count("*").alias("n")).where("n > 1")
        t = t.join(heads.select("kind", "surrogate", F.col("head.value").alias("head")), ["kind", "surrogate"], "left")
        return t.select(*columns, (F.col("real") | (F.col("head") != F.col("value"))).alias("bad")).withColumn("bad", F.coalesce("bad", F.lit(False)))

    for n in range(draws + 1):
        marked = scratch.save(bad(table), "marked")
        again = marked.where("bad")
        if again.isEmpty():
            break
        if n < draws:
            new = draw(again.select("kind", "value", "vote", (F.col("draw") + 1).alias("draw"))).select(*columns)
            nxt = scratch.save(marked.where("not bad").select(*columns).unionByName(new), "drawn")
        else:
            full = scratch.save(again.select("kind", "class").distinct(), "full")
            first = draw(marked.join(full, ["kind", "class"], "left_semi").select("kind", "value", "vote", F.lit(0).alias("draw"))).select(*columns)
            nxt = scratch.save(marked.join(full, ["kind", "class"], "left_anti").select(*columns).unionByName(first), "drawn")
        scratch.drop(table)
        scratch.drop(marked)
        table = nxt
    return table.where(F.col("surrogate") != F.col("first")).select("kind", "value", "surrogate")


_FOUND = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("surrogate", StringType())])
REWRITTEN = StructType([StructField("text", StringType()), StructField("entities", ArrayType(_FOUND))])


def pseudonymise(df: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text`` with every entity replaced, and ``entities`` (kind, its span in the old text, the surrogate)."""
    scratch = Scratch(df.sparkSession, "surrogates")
    with tidy(df.sparkSession):
        held = Scratch(df.sparkSession, "mentions").save(entities(df, text))
        each = held.select("u", F.explode("e").alias("e")).select("u", "e.kind", "e.value", "e.gender")
        other = scratch.save(redraws(each.select("kind", "value", "gender").distinct(), secret), "redrawn")
        some = each.select("u", "kind", "value").distinct().join(other, ["kind", "value"])
        some = scratch.save(some.groupBy("u").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("o")), "exceptions")
    docs = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("u"))
    if other.isEmpty():
        docs = docs.withColumn("o", F.lit(None).cast("array<struct<kind:string,value:string,surrogate:string>>"))
    else:
        docs = docs.join(some, "u", "left")

    def make():
        cache: dict = {}

        def one(t, others):
            own = {(o["kind"], o["value"]): o["surrogate"] for o in others or ()}
            out, at, found = [], 0, []
            for kind, a, b in mentions(t):
                k = kind, t[a:b]
                if own:
                    new = replacement(*k, secret, own)
                else:
                    if k not in cache:
                        if len(cache) > 100_000:
                            cache.clear()
                        cache[k] = replacement(*k, secret, own)
                    new = cache[k]
                out += [t[at:a], new]
                found.append((kind, a, b, new))
                at = b
            return ("".join([*out, t[at:]]) if t is not None else None), found

        return one

    return map_rows(docs, ["key"], ["text", "o"], make, REWRITTEN).withColumnRenamed("key", key)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_KEY)
    kinds = F.array_join(F.array_sort(F.transform("entities", lambda e: e["kind"])), ",")
    return rows.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"))


QUERIES = {"op1_pii_surrogates": op1_pii_surrogates}
ORACLES: dict[str, str] = {}
