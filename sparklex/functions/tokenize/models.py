"""Sub-word models in pure Python: WordPiece, unigram (SentencePiece) and byte-pair encoding, with added tokens.

``encode`` gives (tokens, ids); ``token_id`` looks one token up. All are plain data and travel to workers by broadcast.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from array import array
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

Encoded = tuple[list[str], list[int]]
#: The pre-tokenisation patterns of public models.
PATTERNS = {
    "whitespace": r"\w+|[^\w\s]+",
    "gpt2": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "llama3": r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    "qwen2": r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
}


@dataclass(frozen=True)
class AddedToken:
    content: str
    id: int
    special: bool = False
    normalized: bool = True
    lstrip: bool = False
    rstrip: bool = False
    single_word: bool = False


class Memo(dict):
    """What ``make`` gives for a text, remembered for at least the last ``SIZE`` distinct ones and twice as many at most."""

    SIZE, LONGEST = 300_000, 64

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.LONGEST:
                return value
        self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self) >= self.SIZE:
            self.before = dict(self)
            self.clear()
        self[key] = value


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit integers in the machine's order."""
    return array("i", ids).tobytes()


class Scanner:
    """Splits a text at added tokens: the earliest one, of those the longest."""

    def __init__(self, tokens: list[AddedToken]):
        self.tokens = sorted(tokens, key=lambda t: -len(t.content))
        self.pattern = regex.compile("|".join(regex.escape(t.content) for t in self.tokens)) if tokens else None
        self.by_text = {t.content: t for t in self.tokens}

    def split(self, text: str) -> list[str | AddedToken]:
        if not self.pattern:
            return [text] if text else []
        out: list[str | AddedToken] = []
        at = look = 0
        wordy = lambda c: c == "_" or c.isalnum()
        while m := self.pattern.search(text, look):
            a, b = m.span()
            t = self.by_text[m[0]]
            look = b
            if t.single_word and (a and wordy(text[a - 1]) or b < len(text) and wordy(text[b])):
                look = a + 1
                continue
            while t.lstrip and a > at and text[a - 1].isspace():
                a -= 1
            while t.rstrip and b < len(text) and text[b].isspace():
                b += 1
            if a > at:
                out.append(text[at:a])
            out.append(t)
            at = look = b
        if at < len(text):
            out.append(text[at:])
        return out


class WordPiece:
    """Greedy longest pieces; a word that has no split, or is too long, is one unknown token."""

    def __init__(self, vocab: dict[str, int], unk: str = "[UNK]", prefix: str = "##", max_chars: int = 100, lowercase: bool = False, added: tuple[AddedToken, ...] = ()):
        if unk not in vocab:
            raise ValueError(f"the vocabulary has no {unk}")
        self.vocab, self.unk, self.prefix, self.max_chars, self.lowercase, self.added = vocab, unk, prefix, max_chars, lowercase, added

    def _scan(self) -> tuple[Scanner, Scanner]:
        if not hasattr(self, "_scanners"):
            lower = [AddedToken(t.content.lower() if self.lowercase else t.content, t.id, t.special, True, t.lstrip, t.rstrip, t.single_word) for t in self.added if t.normalized]
            self._scanners = Scanner([t for t in self.added if not t.normalized]), Scanner(lower)
            self._names = {(t.content.lower() if self.lowercase and t.normalized else t.content): t.content for t in self.added}
        return self._scanners

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def token_id(self, token: str) -> int | None:
        return next((t.id for t in self.added if t.content == token), self.vocab.get(token))

    def _word(self, w: str) -> list[str]:
        if len(w) > self.max_chars:
            return [self.unk]
        out, at = [], 0
        while at < len(w):
            for end in range(len(w), at, -1):
                piece = (self.prefix if at else "") + w[at:end]
                if piece in self.vocab:
                    break
            else:
                return [self.unk]
            out.append(piece)
            at = end
        return out

    def encode(self, text: str) -> Encoded:
        raw, normal = self._scan()
        tokens, ids = [], []
        for part in raw.split(text):
            if isinstance(part, AddedToken):
                tokens.append(part.content)
                ids.append(part.id)
                continue
            for piece in normal.split(part.lower() if self.lowercase else part):
                if isinstance(piece, AddedToken):
                    tokens.append(self._names[piece.content])
                    ids.append(piece.id)
                    continue
                for w in regex.findall(PATTERNS["whitespace"], piece):
                    got = self._word(w)
                    tokens += got
                    ids += [self.vocab[t] for t in got]
        return tokens, ids

    def packed_ids(self, text: str) -> bytes:
        """The ids of ``encode``, packed; words are remembered."""
        raw, normal = self._scan()
        if not hasattr(self, "_memo"):
            self._memo = Memo(lambda w: packed([self.vocab[t] for t in self._word(w)]))
            self._words = regex.compile(PATTERNS["whitespace"])
        out = []
        for part in raw.split(text):
            if isinstance(part, AddedToken):
                out.append(packed([part.id]))
                continue
            for piece in normal.split(part.lower() if self.lowercase else part):
                out += [packed([piece.id])] if isinstance(piece, AddedToken) else map(self._memo.__getitem__, self._words.findall(piece))
        return b"".join(out)


def darts_units(blob: bytes) -> tuple[list[int], bytes]:
    """The double array and the replacement text of a precompiled character map."""
    n = int.from_bytes(blob[:4], "little")
    return [int.from_bytes(blob[4 + i : 8 + i], "little") for i in range(0, n, 4)], blob[4 + n :]


class CharsMap:
    """Longest-match replacement of byte sequences by a precompiled double-array trie."""

    def __init__(self, blob: bytes):
        self.units, self.text = darts_units(blob)

    def _match(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        u = self.units
        node, best = (u[0] >> 10) << ((u[0] & 0x200) >> 6), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(u) or (u[node] & 0x800000FF) != data[i]:
                break
            unit = u[node]
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100 and node < len(u):
                start = u[node] & 0x7FFFFFFF
                best = i + 1, self.text[start : self.text.index(b"\0", start)]
        return best

    def apply(self, text: str) -> str:
        data, out, at = text.encode(), bytearray(), 0
        while at < len(data):
            hit = self._match(data, at)
            if hit:
                at = hit[0]
                out += hit[1]
            else:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                out += data[at : at + size]
                at += size
        return out.decode()


NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Unigram:
    """The segmentation of greatest total score; neighbouring unknown characters are one piece."""

    def __init__(self, pieces: list[tuple[str, float, int]], unk_id: int, charsmap: bytes = b"", collapse: bool = True):
        self.pieces, self.unk_id, self.charsmap, self.collapse = pieces, unk_id, charsmap, collapse
        normal = [s for _, s, t in pieces if t in (NORMAL, USER_DEFINED)]
        self.unk_score = min(0.0, min(normal, default=0.0)) - 10
        self.table = {p: (i, s) for i, (p, s, t) in reversed(list(enumerate(pieces))) if t in (NORMAL, USER_DEFINED)}
        self.longest = max(map(len, self.table), default=1)
        #: All beginnings of pieces: no piece goes on where a run of characters is none.
        self.starts = {p[:n] for p in self.table for n in range(1, len(p) + 1)}
        #: Whether each word stands for itself: no piece reaches over its mark, and a mark is never unknown.
        self.by_word = "▁" in self.table and not any("▁" in p[1:] or i == unk_id for p, (i, _) in self.table.items())

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def token_id(self, token: str) -> int | None:
        return next((i for i, (p, _, _) in enumerate(self.pieces) if p == token), None)

    def words(self, text: str) -> list[str]:
        if self.charsmap:
            text = CharsMap(self.charsmap).apply(text)
        return [w for w in text.split(" ") if w] if self.collapse else text.split(" ")

    def normalize(self, text: str) -> str:
        return "".join("▁" + w for w in self.words(text))

    def encode(self, text: str) -> Encoded:
        return self._segment(self.normalize(text))

    def packed_ids(self, text: str) -> bytes:
        """The ids of ``encode``, packed; words are remembered where each stands for itself."""
        if not self.by_word:
            return packed(self.encode(text)[1])
        if not hasattr(self, "_memo"):
            self._memo = Memo(lambda w: packed(self._segment("▁" + w)[1]))
        return b"".join(map(self._memo.__getitem__, self.words(text)))

    def _segment(self, s: str) -> Encoded:
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(-math.inf, 0, -1)] * len(s)
        for i in range(len(s)):
            score = best[i][0]
            for j in range(i + 1, min(len(s), i + self.longest) + 1):
                piece = s[i:j]
                if piece not in self.starts:
                    break
                hit = self.table.get(piece)
                if hit and score + hit[1] > best[j][0]:
                    best[j] = (score + hit[1], i, hit[0])
            if s[i] not in self.table and score + self.unk_score > best[i + 1][0]:
                best[i + 1] = (score + self.unk_score, i, self.unk_id)
        tokens, ids, at = [], [], len(s)
        while at:
            _, start, i = best[at]
            if i == self.unk_id and ids and ids[-1] == self.unk_id:
                tokens[-1] = s[start:at] + tokens[-1]
            else:
                tokens.append(s[start:at])
                ids.append(i)
            at = start
        return tokens[::-1], ids[::-1]


@lru_cache(1)
def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for all bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class BpeOptions:
    byte_level: bool = False
    prefix_space: bool = False
    #: How many of the splits come before the step that puts a space in front of each piece.
    prefix_after: int = field(default=0, kw_only=True)
    ignore_merges: bool = False
    fuse_unk: bool = False
    end_of_word: str = ""
    continuing: str = ""
    unk: str | None = None
    #: (pattern, behaviour, invert) steps; behaviours: isolated, removed, merged_with_previous, merged_with_next, contiguous
    splits: tuple[tuple[str, str, bool], ...] = ()
    normal_forms: tuple[str, ...] = ()
    added: tuple[AddedToken, ...] = field(default=())


@lru_cache(64)
def _whole(pattern: str) -> bool:
    """Whether ``findall`` gives whole matches, which it does without groups."""
    return regex.compile(pattern).groups == 0


def split_text(text: str, pattern: str, behavior: str, invert: bool) -> list[str]:
    """The pieces of a text under a pattern, by the five usual behaviours; ``invert`` swaps matches and gaps."""
    if behavior == "isolated" and not invert and _whole(pattern):
        found = regex.findall(pattern, text)
        if sum(map(len, found)) == len(text):  # no gaps
            return found
    spans, at = [], 0
    for m in regex.finditer(pattern, text):
        if m.end() == m.start():
            continue
        if m.start() > at:
            spans.append((at, m.start(), False))
        spans.append((m.start(), m.end(), True))
        at = m.end()
    if at < len(text):
        spans.append((at, len(text), False))
    spans = [(a, b, hit != invert) for a, b, hit in spans]
    if behavior == "removed":
        return [text[a:b] for a, b, hit in spans if not hit]
    if behavior == "isolated":
        return [text[a:b] for a, b, _ in spans]
    out: list[list] = []
    if behavior == "merged_with_next":
        spans = spans[::-1]
    for a, b, hit in spans:
        if behavior == "contiguous":
            join = bool(out) and out[-1][2] == hit
        else:
            join = hit and bool(out) and not out[-1][2]
        if join:
            out[-1] = [min(a, out[-1][0]), max(b, out[-1][1]), hit if behavior == "contiguous" else True]
        else:
            out.append([a, b, hit])
    if behavior == "merged_with_next":
        out = out[::-1]
    return [text[a:b] for a, b, _ in out]


class PairMerger:
    """Merges many byte-level pieces at once: a step finds and merges the best pair of every piece, as ``Bpe`` does of one."""

    LONGEST, NONE = 32, np.iinfo(np.int32).max

    def __init__(self, byte_ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.bytes, self.keys = np.array(byte_ids, dtype=np.int64), keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()], dtype=np.int32)[order]
        self.made = np.zeros(max((r for r, _ in pairs.values()), default=0) + 1, dtype=np.int64)
        for r, i in pairs.values():
            self.made[r] = i

    @classmethod
    def of(cls, model: Bpe) -> PairMerger | None:
        """Of a byte-level model whose every symbol and merged pair has an id of its own; else nothing."""
        o, vocab = model.options, model.vocab
        symbols = [byte_alphabet()[b] for b in range(256)]
        if not o.byte_level or o.continuing or o.end_of_word or o.ignore_merges or not model.ranks or len(set(vocab.values())) < len(vocab) or not 0 <= min(vocab.values()) <= max(vocab.values()) < 1 << 31:
            return None
        if any(c not in vocab for c in symbols) or any(a + b not in vocab for a, b in model.ranks):
            return None
        return cls([vocab[c] for c in symbols], {(vocab[a], vocab[b]): (r, vocab[a + b]) for (a, b), r in model.ranks.items() if a in vocab and b in vocab})

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece."""
        out = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(len(p), []).append(i)
        for size, rows in by_size.items():
            if not size:
                continue
            s = self.bytes[np.frombuffer(b"".join([pieces[i] for i in rows]), dtype=np.uint8)].reshape(-1, size)
            rank, row = np.full(s.shape, self.NONE, dtype=np.int32), np.array(rows)
            rank[:, :-1] = self._rank(s[:, :-1], s[:, 1:])
            while len(row):  # all rows have one length, as each step merges one pair of each
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(row)), at]
                done = best == self.NONE
                if done.any():
                    raw, step = s[done].astype(np.int32).tobytes(), 4 * s.shape[1]
                    for n, i in enumerate(row[done].tolist()):
                        out[i] = raw[n * step : n * step + step]
                    s, rank, row, at, best = s[~done], rank[~done], row[~done], at[~done], best[~done]
                    if not len(row):
                        break
                here, last = np.arange(len(row)), s.shape[1] - 1
                s[here, at] = self.made[best]
                keep = np.ones(s.shape, dtype=bool)
                keep[here, at + 1] = False
                s = s[keep].reshape(len(row), last)
                keep[here, at + 1], keep[here, at] = True, False  # the rank of a pair is at its left symbol
                rank = rank[keep].reshape(len(row), last)
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < last - 1)
                i, j = at[left], at[right]
                rank[left, i - 1] = self._rank(s[left, i - 1], s[left, i])
                rank[right, j] = self._rank(s[right, j], s[right, j + 1])
        return out


class Bpe:
    """Byte-pair encoding: the pair of lowest rank first, of those the leftmost; of a repeated pair the last rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], options: BpeOptions | None = None):
        self.vocab, self.options = vocab, options or BpeOptions()
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.names = {i: t for t, i in vocab.items()} | {t.id: t.content for t in self.options.added}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def token_id(self, token: str) -> int | None:
        return next((t.id for t in self.options.added if t.content == token), self.vocab.get(token))

    def _merged(self, left: str, right: str) -> str:
        c = self.options.continuing
        return left + (right[len(c) :] if c and right.startswith(c) else right)

    def _merge(self, parts: list[str]) -> list[str]:
        n = len(parts)
        if n <= 48:
            return self._merge_few(parts)
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i] = self._merged(*pair)
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for a, b in ((prev[i], i), (i, nxt[i])):
                if a >= 0 and b < n and (p := (parts[a], parts[b])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p], a, p))
        return [p for p, a in zip(parts, alive) if a]

    def _merge_few(self, parts: list[str]) -> list[str]:
        """As ``_merge``, with a list of ranks instead of a heap, which is faster for few symbols."""
        ranks, none = self.ranks.get, math.inf
        found = [ranks(p, none) for p in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            parts[i : i + 2] = [self._merged(parts[i], parts[i + 1])]
            del found[i]
            if i:
                found[i - 1] = ranks((parts[i - 1], parts[i]), none)
            if i < len(found):
                found[i] = ranks((parts[i], parts[i + 1]), none)
        return parts

    def _piece(self, piece: str) -> Encoded:
        o = self.options
        if o.byte_level:
            piece = "".join(map(byte_alphabet().__getitem__, piece.encode()))
        if o.ignore_merges and piece in self.vocab:
            return [piece], [self.vocab[piece]]
        symbols = list(piece)
        if o.continuing or o.end_of_word:
            symbols = [(o.continuing if i else "") + c + (o.end_of_word if i == len(piece) - 1 else "") for i, c in enumerate(piece)]
        parts: list[str] = []
        unknown = False  # whether the symbol before was substituted; a covered one may be spelt like the substitute
        for s in symbols:
            if s in self.vocab:
                parts.append(s)
            elif o.unk is not None and not (o.fuse_unk and unknown):
                parts.append(o.unk)
            unknown = s not in self.vocab
        got = self._merge(parts)
        return got, [self.vocab[t] for t in got]

    def pieces(self, text: str, first: bool = True) -> list[str]:
        o = self.options
        out = [text] if text else []
        for i in range(len(o.splits) + 1):
            if i == o.prefix_after and o.prefix_space:
                out = [p if p.startswith(" ") else " " + p for p in out]
            if i < len(o.splits):
                out = [q for p in out for q in split_text(p, *o.splits[i]) if q]
        return out

    def _parts(self, text: str):
        """Added tokens and, normalised, the texts between them."""
        o = self.options
        if not hasattr(self, "_raw"):
            self._raw, self._normal = Scanner([t for t in o.added if not t.normalized]), Scanner([t for t in o.added if t.normalized])
        for part in self._raw.split(text):
            if isinstance(part, AddedToken):
                yield part
                continue
            for form in o.normal_forms:
                part = unicodedata.normalize(form, part)
            yield from self._normal.split(part)

    def encode(self, text: str) -> Encoded:
        if not hasattr(self, "_seen"):
            self._seen = Memo(self._piece)
        tokens, ids = [], []
        for part in self._parts(text):
            if isinstance(part, AddedToken):
                tokens.append(part.content)
                ids.append(part.id)
                continue
            for p in self.pieces(part):
                t, i = self._seen[p]
                tokens += t
                ids += i
        return tokens, ids

    def packed_ids(self, text: str) -> bytes:
        """The ids of ``encode``, packed; pieces are remembered."""
        return self.packed_many([text])[0]

    def packed_many(self, texts: list[str]) -> list[bytes]:
        """``packed_ids`` of each text; pieces that are new and not long are merged together."""
        if not hasattr(self, "_memo"):
            self._memo, self._together = Memo(lambda p: packed(self._piece(p)[1])), PairMerger.of(self)
        memo = self._memo
        split = [[p if isinstance(p, AddedToken) else self.pieces(p) for p in self._parts(t)] for t in texts]
        table = dict.fromkeys(chain.from_iterable(p for parts in split for p in parts if not isinstance(p, AddedToken)))
        new = []  # the table of these texts is small, so it is faster to look up than the memo
        for p in table:
            table[p] = ids = memo.get(p) or memo.before.get(p)
            if ids is None:
                new.append(p)
        few = [p for p in new if len(p) <= PairMerger.LONGEST] if self._together else []
        for p, ids in zip(few, self._together.merge([p.encode() for p in few]) if few else ()):
            table[p] = ids
            memo.put(p, ids)
        for p in new:
            if table[p] is None:
                table[p] = memo[p]
        ids_of = lambda p: packed([p.id]) if isinstance(p, AddedToken) else b"".join(map(table.__getitem__, p))
        return [b"".join(map(ids_of, parts)) for parts in split]

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        """Byte-level ids decode together, damaged sequences as replacement characters; an unknown id is refused."""
        o = self.options
        if not hasattr(self, "_texts"):
            back = {c: b for b, c in byte_alphabet().items()}
            added = {t.id for t in o.added}
            spelt = lambda i, t: t.encode() if i in added or any(c not in back for c in t) else bytes(back[c] for c in t)
            self._texts = {i: spelt(i, t) for i, t in self.names.items()} if o.byte_level else dict(self.names)
            self._special = {t.id for t in o.added if t.special}
        kept = [i for i in ids if i not in self._special] if skip_special else ids
        try:
            parts = list(map(self._texts.__getitem__, kept))
        except KeyError:
            raise ValueError("an id is not in the vocabulary") from None
        if o.byte_level:
            return b"".join(parts).decode("utf-8", "replace")
        text = "".join(parts)
        if o.end_of_word:
            return text.replace(o.end_of_word, " ").rstrip()
        return text
