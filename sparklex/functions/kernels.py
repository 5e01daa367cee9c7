"""Pure-Python sequence kernels. They take strings or any sequences of hashable symbols and know nothing of Spark."""

from __future__ import annotations

from collections.abc import Sequence


def trim(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence, int]:
    """Both sequences without their common ends, and the length of those."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return a[i : len(a) - j], b[i : len(b) - j], i + j


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Longest common subsequence; one integer holds a whole row of the table."""
    a, b, same = trim(a, b)
    if not a or not b:
        return same
    if len(a) > len(b):
        a, b = b, a
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = (row + hit | row - hit) & full
    return same + len(a) - row.bit_count()


def indel(a: Sequence, b: Sequence) -> int:
    return len(a) + len(b) - 2 * lcs_length(a, b)


def common_substring(a: Sequence, b: Sequence) -> int:
    """Length of the longest contiguous run that both hold."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


def levenshtein(a: Sequence, b: Sequence) -> int:
    a, b, _ = trim(a, b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def osa(a: Sequence, b: Sequence) -> int:
    """Optimal string alignment: no substring is edited twice."""
    a, b, _ = trim(a, b)
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, new[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            new.append(d)
        two, one = one, new
    return one[-1]


def damerau(a: Sequence, b: Sequence) -> int:
    """Edits and transpositions without restriction."""
    a, b, _ = trim(a, b)
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    last: dict = {}
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            k = last.get(y, 0)
            swap = table[k][match] + (i - k - 1) + 1 + (j - match - 1)
            row.append(min(table[i][j] + (x != y), row[j] + 1, table[i][j + 1] + 1, swap))
            if x == y:
                match = j
        last[x] = i
        table.append(row)
    return table[-1][-1]


def hamming(a: Sequence, b: Sequence) -> int:
    return sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))


def jaro(a: Sequence, b: Sequence) -> float:
    """0 where either is empty."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: Sequence, b: Sequence, weight: float = 0.1) -> float:
    """The boost for a common beginning, of four symbols at most, applies above 0.7."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    n = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        n += 1
    return s + n * weight * (1 - s)


def ratcliff(a: Sequence, b: Sequence) -> float:
    """Twice the matched symbols over all; the longest block first, of equal ones the first found, then both sides."""
    if not a and not b:
        return 1.0
    todo, matched = [(0, len(a), 0, len(b))], 0
    places: dict = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        best = (0, 0, 0)
        runs: dict[int, int] = {}
        for i in range(alo, ahi):
            new = {}
            for j in places.get(a[i], ()):
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = new[j] = runs.get(j - 1, 0) + 1
                if k > best[0]:
                    best = (k, i - k + 1, j - k + 1)
            runs = new
        k, i, j = best
        if k:
            matched += k
            todo += [(alo, i, blo, j), (i + k, ahi, j + k, bhi)]
    return 2 * matched / (len(a) + len(b))


def utf16(s: str) -> tuple[int, ...]:
    """UTF-16 code units, for results in that unit."""
    raw = s.encode("utf-16-le", "surrogatepass")
    return tuple(int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2))


def ratio(a: str, b: str) -> float:
    """Indel similarity in per cent."""
    n = len(a) + len(b)
    return 100.0 if n == 0 else 100.0 * (1 - indel(a, b) / n)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string and a window of the longer one, windows clipped at its ends."""
    if not a or not b:
        return 100.0 if not a and not b else 0.0

    def slide(p: str, t: str) -> float:
        best, where = 0.0, {}
        for i, x in enumerate(p):
            where[x] = where.get(x, 0) | 1 << i
        full = (1 << len(p)) - 1
        hits = [where.get(y, 0) for y in t]  # the places in p of each symbol of t
        for at in range(1 - len(p), len(t)):
            part = hits[max(0, at) : at + len(p)]
            n = len(p) + len(part)
            if 200.0 * min(len(p), sum(map(bool, part))) / n > best:
                row = full
                for y in part:  # as in lcs_length
                    hit = row & y
                    row = (row + hit | row - hit) & full
                best = max(best, 100.0 * (1 - (n - 2 * (len(p) - row.bit_count())) / n))
            if best >= 100:
                break
        return best

    if len(a) == len(b):
        return max(slide(a, b), slide(b, a))
    return slide(a, b) if len(a) < len(b) else slide(b, a)


def _sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str, score=ratio) -> float:
    return score(_sorted_tokens(a), _sorted_tokens(b))


def token_set_ratio(a: str, b: str, score=ratio) -> float:
    """Two texts without tokens score 0; one such side leaves the empty intersection equal to it, which scores 100."""
    x, y = set(a.split()), set(b.split())
    if not x and not y:
        return 0.0
    both = sorted(x & y)
    left, right = " ".join(both + sorted(x - y)), " ".join(both + sorted(y - x))
    core = " ".join(both)
    return max(score(core, left), score(core, right), score(left, right))


def partial_token_sort_ratio(a: str, b: str) -> float:
    return token_sort_ratio(a, b, partial_ratio)


def partial_token_set_ratio(a: str, b: str) -> float:
    return token_set_ratio(a, b, partial_ratio)


def weighted_ratio(a: str, b: str) -> float:
    """The best of the scorers, scaled by how much they forgive; partial ones where lengths differ by half or more."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(ratio(a, b), 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    scale = 0.6 if spread > 8 else 0.9
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_sort_ratio(a, b), 0.95 * scale * partial_token_set_ratio(a, b))


SCORERS = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, partial_token_sort_ratio, partial_token_set_ratio, weighted_ratio)}
