"""Quality rules (operator 8): a threshold table compiled into one Spark projection, no user functions.

Statistics are named column expressions over one text column; a rule keeps a statistic within bounds. ``compile_rules``
turns a table of rules into a boolean column and a column that lists the rules a text fails. Words are maximal runs of
characters other than the six ASCII white-space characters.

Defined cases: a null text has no words; every ratio with a zero denominator is 0; repeated rows, null keys and empty
tables are answered row by row; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparklex.llm._text import let

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by at or an this "
    "le la les de des du et un une est que qui pour dans sur pas au aux en "
    "der die das und ist nicht ein eine zu den dem mit von auf im es "
    "el los las y del que en un una por con para se lo como más"
).split()
#: statistic, least, most (None: no bound)
THRESHOLDS = (
    ("n_words", 50, None),
    ("repeat_ratio", None, 0.5),
    ("mean_word_chars", 2.0, 15.0),
    ("longest_word", None, 1000),
    ("symbol_word_ratio", None, 0.2),
    ("exclaim_word_ratio", None, 0.2),
    ("upper_ratio", None, 0.5),
    ("dup_line_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
)


def without(text: Column, chars: str) -> Column:
    """``text`` without ASCII ``chars``, one plain search for each, which costs a fraction of a character-wise map."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


#: Bits of a window's place beside its hash in one long; texts with more words take the windows themselves.
_PLACE_BITS = 24


def _repeated(words: Column, n: int = 3) -> Column:
    """Words inside windows of ``n`` words whose words stand together twice or more in the text.

    Windows are hashed; where all hashes differ there is no repeat. Else hashes and places, in one long each, are
    sorted, and equal neighbours are repeats if their words are equal; each repeated place covers ``n`` words, or as
    many as lie before the next repeated place. A text in which two different windows share a hash, or with too many
    words for the places, has its windows compared as strings instead, with the same result.
    """
    size, low = F.size(words), (1 << _PLACE_BITS) - 1
    window = lambda i: [F.get(words, i + k) for k in range(n)]
    hashes = F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*window(i))))
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    same = lambda x, y: F.coalesce(F.shiftright(x.bitwiseXOR(y), _PLACE_BITS) == 0, F.lit(False))
    equal = lambda p, q: F.array(*window(p)) == F.array(*window(q))

    def by_hash(s: Column) -> Column:
        clash = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: same(F.get(s, i), F.get(s, i - 1)) & ~equal(place(F.get(s, i)), place(F.get(s, i - 1))))
        marked = F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), place(x)))
        return F.when(~clash, F.sort_array(F.filter(marked, lambda p: p.isNotNull())))

    def by_string(_: Column) -> Column:
        windows = F.sort_array(F.transform(F.sequence(F.lit(0), size - n), lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("g"), i.alias("p"))))

        def places(s: Column) -> Column:
            alike = lambda x, i, d: F.coalesce(F.get(s, i + d)["g"] == x["g"], F.lit(False))
            return F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(alike(x, i, -1) | alike(x, i, 1), x["p"])), lambda p: p.isNotNull()))

        return let(windows, places)

    def covered(p: Column) -> Column:
        steps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(n)))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(n), lambda acc, x: acc + x))

    def count(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        found = F.when(size <= low, let(packed, by_hash))
        places = let(found, lambda p: F.coalesce(p, by_string(p)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places, covered))

    return F.coalesce(let(hashes, lambda h: F.when(h.isNotNull(), count(h))), F.lit(0)).cast("long")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text column; those of the second group build on columns named as in the first."""
    text = F.coalesce(text, F.lit(""))
    return {
        "_words": F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != ""),
        "n_symbols": (F.length(text) - F.length(without(text, _SYMBOLS))).cast("long"),
        "_n_upper": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")),
        "_n_letters": F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", "")),
    }


def _counts() -> dict[str, Column]:
    words, lines = F.col("_words"), F.col("_lines")
    tail = lambda w: F.right(w, F.lit(1))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated(words),
        "_n_lines": F.size(lines),
        "longest_word": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)),
        "_symbol_words": F.size(F.filter(words, lambda w: tail(w).isin(*_SYMBOLS))),
        "_exclaim_words": F.size(F.filter(words, lambda w: tail(w) == "!")),
        "_stop_words": F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?*$%&#"))).isin(*sorted(set(STOP_WORDS))))),
    }


def _ratios() -> dict[str, Column]:
    c = F.col
    return {
        "repeat_ratio": _ratio(c("n_repeat_words"), c("n_words")),
        "mean_word_chars": _ratio(c("word_chars"), c("n_words")),
        "symbol_word_ratio": _ratio(c("_symbol_words"), c("n_words")),
        "exclaim_word_ratio": _ratio(c("_exclaim_words"), c("n_words")),
        "upper_ratio": _ratio(c("_n_upper"), c("_n_letters")),
        "dup_line_ratio": _ratio(c("n_dup_lines"), c("_n_lines")),
        "stop_word_ratio": _ratio(c("_stop_words"), c("n_words")),
    }


def compile_rules(table=THRESHOLDS) -> tuple[Column, Column]:
    """The verdict and the failed rules' names, as columns over the statistics."""
    failed = []
    for name, least, most in table:
        out = F.lit(False)
        if least is not None:
            out = out | (F.col(name) < least)
        if most is not None:
            out = out | (F.col(name) > most)
        failed.append(F.when(out, F.lit(name)))
    names = F.filter(F.array(*failed), lambda x: x.isNotNull()) if failed else F.array().cast("array<string>")
    return F.size(names) == 0, names


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", table=THRESHOLDS) -> DataFrame:
    """``key``, every statistic of the table's namespace, ``failed_rules`` and ``passes``, a row for each row."""
    passes, names = compile_rules(table)
    out = df.select(F.col(f"`{key}`").alias("_key"), *[v.alias(k) for k, v in statistics(F.col(f"`{text}`")).items()])
    out = out.select("_key", "n_symbols", "_n_upper", "_n_letters", *[v.alias(k) for k, v in _counts().items()])
    out = out.select("*", *[v.alias(k) for k, v in _ratios().items()])
    out = out.select("*", names.alias("failed_rules"), passes.alias("passes"))
    return out.select(F.col("_key").alias(key), *[c for c in out.columns if not c.startswith("_")])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("passes")).alias("kept"),
        F.array_join("failed_rules", ",").alias("failed_rules"), *[F.round(c, 6).alias(c) for c in _ratios()],
    )


def _oracle() -> str:
    sp = "[ \\t\\n\\x0b\\x0c\\r]+"
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"
    fails = []
    for name, least, most in THRESHOLDS:
        cond = " OR ".join([f"{name} < {least}"] * (least is not None) + [f"{name} > {most}"] * (most is not None))
        fails.append(f"CASE WHEN {cond} THEN '{name}' END")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{sp}'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{sp}', '', 'g') <> '') AS lines FROM t),
g AS (SELECT rid, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS g,
  unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3),
d AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, p + o AS q FROM d, (VALUES (0), (1), (2)) AS v(o)) GROUP BY rid),
s AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{sp}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{_SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest_word,
  len(list_filter(words, lambda x: contains('{_SYMBOLS}', right(x, 1)))) AS symbol_words, len(list_filter(words, lambda x: right(x, 1) = '!')) AS exclaim_words,
  len(list_filter(words, lambda x: lower(rtrim(x, '.,;:!?*$%&#')) IN ({stops}))) AS stop_words,
  length(text) - length(regexp_replace(text, '\\p{{Lu}}+', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '\\p{{L}}+', '', 'g')) AS n_letters
  FROM w LEFT JOIN r USING (rid)),
q AS (SELECT *, {ratio("n_repeat_words", "n_words")} AS repeat_ratio, {ratio("word_chars", "n_words")} AS mean_word_chars,
  {ratio("symbol_words", "n_words")} AS symbol_word_ratio, {ratio("exclaim_words", "n_words")} AS exclaim_word_ratio, {ratio("n_upper", "n_letters")} AS upper_ratio,
  {ratio("n_dup_lines", "n_lines")} AS dup_line_ratio, {ratio("stop_words", "n_words")} AS stop_word_ratio FROM s),
v AS (SELECT *, concat_ws(',', {", ".join(fails)}) AS failed_rules, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules,
  {", ".join(f"round({c}, 6) AS {c}" for c in ("repeat_ratio", "mean_word_chars", "symbol_word_ratio", "exclaim_word_ratio", "upper_ratio", "dup_line_ratio", "stop_word_ratio"))} FROM v"""


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": _oracle()}
