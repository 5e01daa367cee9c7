"""Secret scans (operator 5) by grammar inference.

One pass over the texts finds the base spans (three fixed kinds) and the candidates: maximal runs of credential
characters that hold letters and digits, without what base spans cover. Labelled credentials, namely distinct values of
base spans (at most ``MAX_LABELLED`` a kind, those with the smallest hashes over all documents) and generated examples
of public formats, are then learned: their characters are mapped to symbols, the prefix tree of the symbol strings is
built and states whose outgoing frequencies pass Hoeffding's test are merged (the red-blue order of ALERGIA), which
leaves a probabilistic automaton for each format. Ordinary strings (paths, identifiers, dates, versions) give a
background model in the same way of counting, of pairs of symbols.

Every candidate of every document, base spans included, is scored by its mean log-likelihood a symbol under each
automaton, and the best format and its likelihood are returned. A base span stays whatever its score. Of another
candidate every part between separators that is typical of some automaton becomes a span of kind ``format``: its
likelihood is within the range of all but a few of the automaton's own training strings (dull strings are likelier than
typical, so the range has two ends), its length is none beyond theirs, and the background model thinks it less likely.

Defined cases: a null text counts as an empty one; a value that every automaton rejects has no format and no
likelihood; repeated rows and null keys are answered row by row; an empty table gives an empty table; other columns
play no part.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from sparklex.llm._text import map_rows
from sparklex.plans.scratch import Scratch

KINDS = ("assign", "access", "hex", "format")
#: Labelled credentials a kind that a fit reads at most, and the longest one that is learned.
MAX_LABELLED, MAX_LENGTH = 2_000, 256
#: The shortest candidate.
LEAST_LENGTH = 16

_ASSIGN = re.compile("(?:%s)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")
_CANDIDATE = re.compile("[A-Za-z0-9+/_=.-]{16,}")
_SEPARATOR = re.compile("[+/_=.-]")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_MAP = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_LONG_MAP = bytes(104 if chr(c) in string.ascii_letters + string.digits + "+/_=.-" else 32 for c in range(256))
_SYMBOL = str.maketrans({**{c: "9" for c in string.digits}, **{c: "f" for c in "abcdef"}, **{c: "z" for c in "ghijklmnopqrstuvwxyz"}, **{c: "F" for c in "ABCDEF"}, **{c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"}})


def symbols(value: str) -> str:
    return value.translate(_SYMBOL)


def _mixed(v: str) -> bool:
    return any(c.isdigit() for c in v) and any(c.isalpha() for c in v)


def find(text: str | None) -> tuple[list, list]:
    """Base spans ``(kind, start, end, value)`` and candidates ``(start, end, value)`` of one whole text."""
    text = text or ""
    raw = text.encode()
    base = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        base += [("assign", m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if b"AKIA" in raw:
        base += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in raw.translate(_HEX_MAP):
        base += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    base.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    loose, first, reach = [], 0, list(accumulate((b[2] for b in base), max))
    if b"h" * LEAST_LENGTH in raw.translate(_LONG_MAP):
        for m in _CANDIDATE.finditer(text):
            at, end = m.span()
            pieces = []
            while first < len(base) and reach[first] <= at:
                first += 1
            for _, a, b, _ in base[first:]:
                if a >= end:
                    break
                pieces.append((at, a))
                at = max(at, b)
            pieces.append((at, end))
            loose += [(a, b, text[a:b]) for a, b in pieces if b - a >= LEAST_LENGTH and _mixed(text[a:b])]
    return base, loose


_SPAN = [StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("value", StringType())]
FOUND = StructType([StructField("base", ArrayType(StructType([StructField("kind", StringType()), *_SPAN]))), StructField("loose", ArrayType(StructType(_SPAN)))])


class Automaton:
    """A probabilistic deterministic automaton: transition counts, end counts and visits for each state."""

    def __init__(self):
        self.next: list[dict[str, list[int]]] = [{}]
        self.ends, self.visits = [0], [0]
        self.level, self.ceiling, self.longest = -math.inf, math.inf, 0

    def add(self, word: str) -> None:
        s = 0
        self.visits[0] += 1
        for c in word:
            if c not in self.next[s]:
                self.next.append({})
                self.ends.append(0)
                self.visits.append(0)
                self.next[s][c] = [len(self.next) - 1, 0]
            edge = self.next[s][c]
            edge[1] += 1
            s = edge[0]
            self.visits[s] += 1
        self.ends[s] += 1

    def _alike(self, a: int, b: int, bound: float, least: int) -> bool:
        """Whether every frequency below two states agrees within Hoeffding's bound."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            if min(na, nb) < least:
                continue
            slack = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > slack:
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if abs((x[1] if x else 0) / na - (y[1] if y else 0) / nb) > slack:
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, (to, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    todo.append((self.next[a][c][0], to))
                else:
                    self.next[a][c] = [to, n]

    def merge(self, alpha: float = 0.05, least: int = 12) -> None:
        """Merge compatible states, nearest to the root first; each blue state joins the first red one like it."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while True:
            known = set(red)
            blue = sorted({(-self.visits[to], to, s, c) for s in red for c, (to, _) in self.next[s].items() if to not in known})
            if not blue:
                return
            _, state, parent, c = blue[0]
            for r in red:
                if self._alike(r, state, bound, least):
                    self.next[parent][c][0] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)

    def compact(self) -> None:
        """Renumber the states that the start reaches and drop the others."""
        order = [0]
        for s in order:
            order += [to for to in sorted({e[0] for e in self.next[s].values()} - set(order))]
        at = {s: i for i, s in enumerate(order)}
        self.next = [{c: [at[to], n] for c, (to, n) in self.next[s].items()} for s in order]
        self.ends, self.visits = [self.ends[s] for s in order], [self.visits[s] for s in order]

    def typical_ends(self, word: str, start: int, ends: list[int], plain: list[float]) -> list[tuple[int, float]]:
        """Those of the ascending ``ends`` at which the part of ``word`` from ``start`` is typical, with its score;
        ``plain`` holds the background's log-likelihood up to each place."""
        s, total, at, out = 0, 0.0, start, []
        for end in ends:
            if end - start > self.longest:
                break
            for c in word[at:end]:
                edge = self.next[s].get(c)
                if not edge:
                    return out
                total += math.log2(edge[1] / self.visits[s])
                s = edge[0]
            at = end
            if self.ends[s]:
                whole = total + math.log2(self.ends[s] / self.visits[s])
                if self.level <= whole / (end - start + 1) <= self.ceiling and whole > plain[end] - plain[start]:
                    out.append((end, whole / (end - start + 1)))
        return out

    def score(self, word: str) -> float:
        """Mean log2-probability of a symbol, the end included; minus infinity for a string the automaton rejects."""
        s, total = 0, 0.0
        for c in word:
            edge = self.next[s].get(c)
            if not edge:
                return -math.inf
            total += math.log2(edge[1] / self.visits[s])
            s = edge[0]
        if not self.ends[s]:
            return -math.inf
        return (total + math.log2(self.ends[s] / self.visits[s])) / (len(word) + 1)


def infer(words: list[str], alpha: float = 0.05, keep: float = 0.02) -> Automaton:
    """The automaton of symbol strings; ``keep`` of them score below its level and as many above its ceiling."""
    a = Automaton()
    for w in words:
        a.add(w)
    a.merge(alpha)
    a.compact()
    got = sorted(a.score(w) for w in words)
    cut = int(keep * (len(got) - 1))
    a.longest = max(map(len, words), default=0)
    a.level, a.ceiling = (got[cut] - 1e-9, got[-1 - cut] + 1e-9) if got else (math.inf, -math.inf)
    return a


def public_examples(n: int = 300, seed: int = 5) -> dict[str, list[str]]:
    """Generated credentials of public formats by kind."""
    rng = random.Random(seed)
    of = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    upper, mixed = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    return {
        "access": ["AKIA" + of(upper, 16) for _ in range(n)],
        "hex": [of("0123456789abcdef", rng.choice((32, 40, 64))) for _ in range(n)],
        "hex-upper": [of("0123456789ABCDEF", rng.choice((32, 40, 64))) for _ in range(n)],
        "personal": ["ghp_" + of(mixed, 36) for _ in range(n)],
        "live": [rng.choice(("sk_live_", "rk_live_")) + of(mixed, 24) for _ in range(n)],
        "base64": [of(mixed + "+/", 40) for _ in range(n)],
        "google": ["AIza" + of(mixed + "_-", 35) for _ in range(n)],
        "group": ["glpat-" + of(mixed + "_-", 20) for _ in range(n)],
        "chat": [rng.choice(("xoxb-", "xoxp-")) + of(string.digits, 12) + "-" + of(string.digits, 12) + "-" + of(mixed, 24) for _ in range(n)],
        "mail": ["SG." + of(mixed + "_-", 22) + "." + of(mixed + "_-", 43) for _ in range(n)],
        "uuid": ["-".join(of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)) for _ in range(n)],
    }


def ordinary_examples(n: int = 4_000, seed: int = 6) -> list[str]:
    """Generated strings that look like candidates and are no credentials: paths, names, dates and versions."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(("", "n", "r", "s", "t")) for _ in range(rng.randint(1, 4)))
    number = lambda: str(rng.randrange(10 ** rng.randint(1, 6)))
    date = lambda: f"{rng.randint(1990, 2030)}{rng.choice(('-', '', '/', '_'))}{rng.randint(1, 12):02d}{rng.choice(('-', '', '/', '_'))}{rng.randint(1, 28):02d}"
    piece = lambda: rng.choice((word, word, word, lambda: word().capitalize(), lambda: word().upper(), lambda: word().capitalize() + word().capitalize(), number, date, lambda: word() + number(), lambda: "v" + number()))()
    return [rng.choice("-_/.=").join(piece() for _ in range(rng.randint(2, 7))) for _ in range(n)]


_ALPHABET = "9fzFZ+/_=.-"


def background(words: list[str]) -> dict[str, float]:
    """log2-probability of a symbol behind another one, by the pair; every pair counts once at least."""
    counts = {a + b: 1 for a in _ALPHABET for b in _ALPHABET}
    for w in words:
        for pair in map("".join, zip(w, w[1:])):
            counts[pair] += 1
    whole = {a: sum(counts[a + b] for b in _ALPHABET) for a in _ALPHABET}
    return {p: math.log2(c / whole[p[0]]) for p, c in counts.items()}


@dataclass(frozen=True)
class Formats:
    """What the scan has learned: an automaton for each format and the background model."""

    automata: dict[str, Automaton]
    plain: dict[str, float]

    def best(self, value: str) -> tuple[str | None, float | None]:
        """The format under which a whole value is likeliest and its mean log2-likelihood a symbol."""
        word = symbols(value)
        score, name = max(((a.score(word), k) for k, a in self.automata.items()), default=(-math.inf, None))
        return (name, score) if score > -math.inf else (None, None)


def learn_formats(labelled: dict[str, list[str]]) -> Formats:
    """From values by kind, which join the public examples."""
    words = {k: [symbols(v) for v in vs] for k, vs in public_examples().items()}
    for kind, values in labelled.items():
        words[kind] = words.get(kind, []) + [symbols(v) for v in values]
    return Formats({k: infer(sorted(v)) for k, v in sorted(words.items()) if v}, background([symbols(w) for w in ordinary_examples()]))


def learn(found: DataFrame, limit: int = MAX_LABELLED) -> Formats:
    """The formats of the labelled values of ``found`` and the public examples."""
    values = found.select(F.explode("base").alias("s")).select("s.kind", "s.value").where(F.length("value") <= MAX_LENGTH).distinct()
    scratch = Scratch(found.sparkSession, "secrets")
    values = scratch.save(values, "values")
    order = lambda kind: values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(limit).collect()
    out = learn_formats({kind: [r["value"] for r in order(kind)] for kind in KINDS[:3]})
    scratch.drop(values)
    return out


def typical_parts(value: str, formats: Formats) -> list[tuple[int, int, str, float]]:
    """The typical parts of a candidate between separators, leftmost and then longest first, none overlapping, each with
    its likeliest format and its score."""
    word, out, free = symbols(value), [], 0
    cuts = [m.start() for m in _SEPARATOR.finditer(value)]
    ends = [*cuts, len(value)]
    plain = list(accumulate((formats.plain.get(p, 0.0) for p in map("".join, zip(word, word[1:]))), initial=0.0))
    plain = [0.0, *plain]
    digits = list(accumulate((c == "9" for c in word), initial=0))
    letters = list(accumulate((c in "fzFZ" for c in word), initial=0))
    for start in [0, *(c + 1 for c in cuts)]:
        if start < free:
            continue
        some = [e for e in ends[bisect_left(ends, start + LEAST_LENGTH) : bisect_right(ends, start + MAX_LENGTH)] if digits[e] > digits[start] and letters[e] > letters[start]]
        hits = [(e, score, name) for name, a in formats.automata.items() for e, score in a.typical_ends(word, start, some, plain)] if some else []
        if hits:
            end, score, name = max(hits)
            out.append((start, end, name, score))
            free = end
    return out


def spans_of(base: list, loose: list, formats: Formats) -> list[tuple[str, int, int, str | None, float | None]]:
    """The base spans and the typical parts of the candidates, by start, kind and end, each with its format and score."""
    spans = [(*b[:3], *formats.best(b[3])) for b in base]
    for start, _, value in loose:
        spans += [("format", start + a, start + b, name, score) for a, b, name, score in typical_parts(value, formats)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_FOUND = StructType([StructField("kind", StringType()), *_SPAN[:2], StructField("format", StringType()), StructField("likelihood", DoubleType())])
SECRETS = StructType([StructField("spans", ArrayType(_FOUND)), StructField("scored", IntegerType())])


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_LABELLED) -> DataFrame:
    """``key``, ``spans`` (kind, start, end in code points, likeliest format and its mean log2-likelihood a symbol, by
    start and kind) and ``scored``, the number of candidates that were scored, base spans included; a row for each row."""
    scratch = Scratch(df.sparkSession, "secrets")
    found = scratch.save(map_rows(df, [key], [text], lambda: find, FOUND).withColumnRenamed(key, "_key"), "found")
    formats = learn(found, limit)

    def make():
        def one(base, loose):
            return spans_of([(b["kind"], b["start"], b["end"], b["value"]) for b in base], [(c["start"], c["end"], c["value"]) for c in loose], formats), len(base) + len(loose)

        return one

    return map_rows(found, ["_key"], ["base", "loose"], make, SECRETS).withColumnRenamed("_key", key)


def redact(text: str, spans: list[tuple]) -> str:
    """``text`` with every span replaced by its kind in brackets; spans that overlap are replaced together."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text: str = "text", length: str = "n_chars", limit: int = MAX_LABELLED) -> DataFrame:
    """``df`` with every secret in ``text`` replaced by its kind in brackets and ``length``, where there is such a
    column, counted anew; other columns as they are. A null text stays null."""
    formats = learn(map_rows(df, [], [text], lambda: find, FOUND), limit)

    def make():
        def one(value):
            spans = spans_of(*find(value), formats)
            return (redact(value, spans) if spans else value,)

        return one

    others = [c for c in df.columns if c != text]
    out = map_rows(df, others, [text], make, StructType([StructField("_redacted", StringType())]))
    counted = {length: F.length("_redacted").cast(df.schema[length].dataType)} if length in df.columns else {}
    return out.select(*[F.col("_redacted").alias(text) if c == text else counted[c].alias(c) if c in counted else F.col(f"`{c}`") for c in df.columns])


def _join(spans, kinds):
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    top = F.array_max(F.transform(F.filter("spans", lambda s: s["likelihood"].isNotNull()), lambda s: F.struct(s["likelihood"], s["format"])))
    more = (n("format").alias("n_format"), F.col("scored").cast("long").alias("n_scored"), top["format"].alias("best_format"), top["likelihood"].alias("best_likelihood"))
    return rows.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_join("spans", KINDS[:3]), 256).alias("base_sha256"), _join("spans", KINDS).alias("spans"), *more)


QUERIES = {"op5_secrets": op5_secrets}
ORACLES: dict[str, str] = {}
