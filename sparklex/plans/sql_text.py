"""SQL texts that prove the kernels of strings, phonetic codes and hashed terms.

Every text is a query over a relation given as text; long ones go step by step through named subqueries.
"""

from __future__ import annotations


def partial_scores(pairs: str) -> str:
    """``p_partkey``, ``k``, ``score`` of ``pairs`` (p_partkey, k, x, y): the best ratio of the shorter string and a window.

    The common subsequence of a window is a fold over its characters whose state is one row of the table as bits, so the
    shorter string may hold up to 120 characters.
    """
    return f"""SELECT p_partkey, k, max(CASE WHEN m = 0 THEN CASE WHEN n = 0 THEN 100.0 ELSE 0.0 END
  ELSE 200.0::DOUBLE * (m - bit_count(list_reduce(list_prepend(f, part), lambda r, y: ((r + (r & y)) | (r - (r & y))) & f))) / (m + len(part)) END) AS score
FROM (SELECT *, hits[greatest(pos, 0) + 1:least(pos + m, n)] AS part, ((1::HUGEINT << m::HUGEINT) - 1::HUGEINT)::HUGEINT AS f
  FROM (SELECT *, unnest(CASE WHEN m = 0 THEN [0] ELSE range(1 - m, n) END) AS pos
    FROM (SELECT p_partkey, k, length(p) AS m, length(t) AS n,
        [coalesce(list_sum([(1::HUGEINT << (i - 1)::HUGEINT) FOR i IN range(1, length(p) + 1) IF p[i] = c]), 0)::HUGEINT FOR c IN string_split(t, '')] AS hits
      FROM (SELECT p_partkey, k, x AS p, y AS t FROM ({pairs}) WHERE length(x) <= length(y)
        UNION ALL SELECT p_partkey, k, y, x FROM ({pairs}) WHERE length(y) <= length(x)))))
GROUP BY p_partkey, k"""


def ratcliff(pairs: str) -> str:
    """``p_partkey``, ``matched`` of ``pairs`` (p_partkey, a, b): the longest block, leftmost of equal ones, then both sides."""
    return f"""WITH RECURSIVE r AS (SELECT p_partkey, a AS x, b AS y, 0::BIGINT AS k FROM ({pairs})
  UNION ALL SELECT p_partkey, unnest([x[:i - 1], x[i + k:], '']), unnest([y[:j - 1], y[j + k:], '']), unnest([0, 0, k])
  FROM (SELECT *, instr(y, x[i:i + k - 1]) AS j
    FROM (SELECT p_partkey, x, y, list_max(ks) AS k, list_position(ks, list_max(ks)) AS i
      FROM (SELECT p_partkey, x, y, [len([n FOR n IN range(1, length(x) - i + 2) IF contains(y, x[i:i + n - 1])]) FOR i IN range(1, length(x) + 1)] AS ks
        FROM r WHERE x <> '' AND y <> '')) WHERE k > 0))
SELECT p_partkey, sum(k) AS matched FROM r GROUP BY p_partkey"""


_M = "4294967295"


def _rot(x: str, r: int) -> str:
    return f"(((({x}) << {r}) | (({x}) >> {32 - r})) & {_M})"


def murmur3(terms: str) -> str:
    """``term``, ``h`` (signed) of ``terms`` (term): MurmurHash3 of 32 bits by integer operations on the bytes."""
    block = "list_reduce([(('0x' || x[i + 2 * j:i + 2 * j + 1])::UBIGINT << (8 * j)) FOR j IN range(0, {n})], lambda p, q: p | q)"
    mix = lambda blocks: f"[({_rot('y', 15)} * 461845907::UBIGINT) & {_M} FOR y IN [(b * 3432918353::UBIGINT) & {_M} FOR b IN {blocks}]]"
    step = f"({_rot('xor(h, b)', 13)} * 5 + 3864292196::UBIGINT) & {_M}"
    return f"""SELECT term, CASE WHEN h >= 2147483648 THEN h::BIGINT - 4294967296 ELSE h::BIGINT END AS h
FROM (SELECT term, xor(h, h >> 16) AS h FROM (SELECT term, (xor(h, h >> 13) * 3266489909::UBIGINT) & {_M} AS h
FROM (SELECT term, (xor(h, h >> 16) * 2246822507::UBIGINT) & {_M} AS h
FROM (SELECT term, xor(xor(list_reduce(list_prepend(0::UBIGINT, body), lambda h, b: {step}), coalesce(tail[1], 0::UBIGINT)), n::UBIGINT) AS h
FROM (SELECT term, n, {mix("f")} AS body, {mix("t")} AS tail
FROM (SELECT term, n, [{block.format(n=4)} FOR i IN range(1, 8 * (n // 4) + 1, 8)] AS f, CASE WHEN n % 4 = 0 THEN []::UBIGINT[] ELSE [{block.format(n="n % 4")} FOR i IN [8 * (n // 4) + 1]] END AS t
FROM (SELECT term, hex(encode(term)) AS x, (length(hex(encode(term))) // 2)::BIGINT AS n FROM ({terms}))))))))"""


def _letters(word: str) -> str:
    return f"array_to_string([CASE WHEN c = 'ß' THEN c ELSE upper(c) END FOR c IN regexp_extract_all({word}, '\\p{{L}}')], '')"


def metaphone(words: str) -> str:
    """``word``, ``code`` of ``words`` (word): each letter's code from its neighbours, letters that another one swallows give nothing."""
    code = """CASE
 WHEN c = 'G' AND p = 'D' AND a IN ('I', 'E', 'Y') THEN ''
 WHEN c = 'H' AND p = 'G' AND a = 'T' THEN ''
 WHEN c = 'N' AND p = 'G' AND a = '' THEN ''
 WHEN c IN ('A', 'E', 'I', 'O', 'U') THEN CASE WHEN p = '' THEN c ELSE '' END
 WHEN c = 'B' THEN CASE WHEN p = 'M' AND a = '' THEN '' ELSE 'B' END
 WHEN c = 'C' THEN CASE WHEN a = 'H' OR (a = 'I' AND b = 'A') THEN 'X' WHEN a IN ('I', 'E', 'Y') THEN 'S' ELSE 'K' END
 WHEN c = 'D' THEN CASE WHEN a = 'G' AND b IN ('I', 'E', 'Y') THEN 'J' ELSE 'T' END
 WHEN c = 'G' THEN CASE WHEN a = 'H' THEN CASE WHEN b = 'T' THEN '' ELSE 'K' END WHEN a = 'N' AND b = '' THEN '' WHEN a IN ('I', 'E', 'Y') THEN 'J' ELSE 'K' END
 WHEN c = 'H' THEN CASE WHEN p IN ('C', 'S', 'P', 'T') OR (p IN ('A', 'E', 'I', 'O', 'U') AND a NOT IN ('A', 'E', 'I', 'O', 'U')) THEN '' ELSE 'H' END
 WHEN c = 'K' THEN CASE WHEN p = 'C' THEN '' ELSE 'K' END
 WHEN c = 'P' THEN CASE WHEN a = 'H' THEN 'F' ELSE 'P' END
 WHEN c = 'S' THEN CASE WHEN a = 'H' OR (a = 'I' AND b IN ('O', 'A')) THEN 'X' ELSE 'S' END
 WHEN c = 'T' THEN CASE WHEN a = 'H' THEN '0' WHEN a = 'I' AND b IN ('O', 'A') THEN 'X' ELSE 'T' END
 WHEN c IN ('W', 'Y') THEN CASE WHEN a IN ('A', 'E', 'I', 'O', 'U') THEN c ELSE '' END
 WHEN c = 'X' THEN CASE WHEN p = '' THEN 'S' ELSE 'KS' END
 WHEN c = 'Q' THEN 'K' WHEN c = 'V' THEN 'F' WHEN c = 'Z' THEN 'S'
 WHEN c IN ('F', 'J', 'L', 'M', 'N', 'R') THEN c ELSE '' END"""
    return f"""SELECT word, coalesce(string_agg(code, '' ORDER BY i), '') AS code
FROM (SELECT word, i, {code} AS code
FROM (SELECT word, i, w[i] AS c, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS p, w[i + 1] AS a, w[i + 2] AS b
FROM (SELECT word, w, unnest(range(1, greatest(length(w), 1) + 1)) AS i
FROM (SELECT word, array_to_string([w[i] FOR i IN range(1, length(w) + 1) IF i = 1 OR w[i] = 'C' OR w[i - 1] <> w[i]], '') AS w
FROM (SELECT word, CASE WHEN w[:2] IN ('AE', 'GN', 'KN', 'PN', 'WR') THEN w[2:] WHEN w[:2] = 'WH' THEN 'W' || w[3:] ELSE w END AS w
FROM (SELECT word, {_letters('word')} AS w FROM ({words})))))))
GROUP BY word"""


def nysiis(words: str) -> str:
    """``word``, ``code`` of ``words`` (word): heads and ends replaced, each further letter's code, runs joined, ends dropped."""
    code = """CASE
 WHEN i > 2 AND c = 'V' AND p = 'E' THEN ''
 WHEN i > 2 AND c = 'C' AND p = 'S' AND a = 'H' THEN ''
 WHEN i > 3 AND c = 'H' AND p = 'C' AND s[i - 2] = 'S' THEN ''
 WHEN i > 2 AND c = 'H' AND p = 'P' THEN ''
 WHEN i = 1 THEN c
 WHEN c = 'E' AND a = 'V' THEN 'AF'
 WHEN c IN ('A', 'E', 'I', 'O', 'U') THEN 'A'
 WHEN c = 'K' THEN CASE WHEN a = 'N' THEN 'N' ELSE 'C' END
 WHEN c = 'S' AND a = 'C' AND b = 'H' THEN 'SSS'
 WHEN c = 'P' AND a = 'H' THEN 'FF'
 WHEN c = 'H' THEN CASE WHEN p NOT IN ('A', 'E', 'I', 'O', 'U') THEN p WHEN a IN ('A', 'E', 'I', 'O', 'U') THEN 'H' ELSE 'A' END
 WHEN c = 'W' THEN CASE WHEN p IN ('A', 'E', 'I', 'O', 'U') THEN p ELSE 'W' END
 WHEN c = 'Q' THEN 'G' WHEN c = 'Z' THEN 'S' WHEN c = 'M' THEN 'N' ELSE c END"""
    heads = "CASE " + " ".join(f"WHEN starts_with(s, '{old}') THEN '{new}' || s[{len(old) + 1}:]" for old, new in (("MAC", "MCC"), ("KN", "N"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS"))) + " ELSE s END"
    ends = "CASE WHEN right(s, 2) IN ('EE', 'IE') THEN left(s, length(s) - 2) || 'Y' WHEN right(s, 2) IN ('DT', 'RT', 'RD', 'NT', 'ND') THEN left(s, length(s) - 2) || 'D' ELSE s END"
    cut = lambda what, new: f"CASE WHEN length(k) > 1 AND ends_with(k, '{what}') THEN left(k, length(k) - {len(what)}) || '{new}' ELSE k END"
    return f"""SELECT word, {cut('A', '')} AS code FROM (SELECT word, {cut('AY', 'Y')} AS k FROM (SELECT word, {cut('S', '')} AS k
FROM (SELECT word, array_to_string([k[i] FOR i IN range(1, length(k) + 1) IF i = 1 OR k[i - 1] <> k[i]], '') AS k
FROM (SELECT word, coalesce(string_agg(code, '' ORDER BY i), '') AS k
FROM (SELECT word, i, {code} AS code
FROM (SELECT word, s, i, s[i] AS c, CASE WHEN i = 1 THEN '' ELSE s[i - 1] END AS p, s[i + 1] AS a, s[i + 2] AS b
FROM (SELECT word, s, unnest(range(1, greatest(length(s), 1) + 1)) AS i
FROM (SELECT word, {ends} AS s FROM (SELECT word, {heads} AS s FROM (SELECT word, {_letters('word')} AS s FROM ({words}))))))) GROUP BY word))))"""


def wordpiece(words: str, texts: str, size: int = 3_000) -> str:
    """Common table expressions up to ``enc`` (``key``, ``ids``) of ``texts`` (key, text): the vocabulary of the ``size``
    most frequent of ``words`` (term), all characters and short continuations; greedy longest pieces of each distinct word."""
    return f"""WITH RECURSIVE f AS (SELECT term, length(term) AS l, row_number() OVER (ORDER BY count(*) DESC, term) AS o FROM ({words}) GROUP BY term QUALIFY o <= {size}),
ch AS (SELECT c, row_number() OVER (ORDER BY c) AS o FROM (SELECT DISTINCT unnest(string_split(lower(text), '')) AS c FROM documents WHERE text <> '') WHERE NOT regexp_matches(c, '^[\\s\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]$')),
v AS (SELECT t, row_number() OVER (ORDER BY min(g * 1000000 + o)) - 1 AS id FROM (
  SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]']) AS t, 0 AS g, unnest([1, 2, 3, 4]) AS o UNION ALL SELECT term, 1, o FROM f UNION ALL SELECT c, 2, o FROM ch
  UNION ALL SELECT '##' || c, 3, o FROM ch UNION ALL SELECT '##' || term, 4, o FROM f WHERE l < 5) GROUP BY t),
p AS (SELECT key, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT key, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\p{{Z}}]+') AS w FROM ({texts}))),
r AS (SELECT DISTINCT w, 1::BIGINT AS pos, []::BIGINT[] AS ids FROM p WHERE length(w) <= 100
  UNION ALL SELECT w, pos + max(n), list_append(any_value(ids), arg_max(id, n)) FROM (SELECT w, pos, ids, n, CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(w, pos, n) AS t FROM (SELECT w, pos, ids, unnest(range(1, length(w) - pos + 2)) AS n FROM r)) JOIN v USING (t) GROUP BY w, pos),
d AS (SELECT w, ids FROM r WHERE pos > length(w)),
enc AS (SELECT key, flatten(coalesce(list(coalesce(ids, [1]) ORDER BY pos) FILTER (pos IS NOT NULL), [])) AS ids FROM (SELECT key FROM ({texts})) LEFT JOIN p USING (key) LEFT JOIN d USING (w) GROUP BY key)"""
