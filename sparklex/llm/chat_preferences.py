"""Preference formatting (operator 6): shared prompts and paired masked completions, without user functions.

A pair holds a chosen and a rejected conversation, arrays of (role, text) turns. Their longest common turn prefix is
rendered once as the prompt; what follows in each is a completion, a list of segments with a mask: 1 for what the
assistant says, its end mark included, 0 for role headers and the turns of others.

``stale_pairs`` derives pairs from a table of conversations: the chosen one is the conversation up to its last
assistant turn; in the rejected one every assistant turn from the middle one on says what the assistant said before it
(nothing, at the first one). A conversation without an assistant turn is its own rejected one.

Defined cases: null roles and texts count as empty strings; turns with one number are ordered by role, then text; each
turn with a null conversation id is a conversation of its own; equal conversations give empty completions; an empty table gives an empty
table; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns two arrays share."""
    n = F.least(F.size(a), F.size(b))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(acc))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(_OPEN), t["role"], F.lit("\n"), t["text"], F.lit(f"{_CLOSE}\n"))), "")


def segments(turns: Column) -> Column:
    """(text, mask) pieces of a completion in order."""
    piece = lambda x, m: F.struct(x.alias("text"), F.lit(m).alias("mask"))
    head = lambda t: F.concat(F.lit(_OPEN), t["role"], F.lit("\n"))
    said = lambda t: F.concat(t["text"], F.lit(_CLOSE))
    return F.flatten(F.transform(turns, lambda t: F.when(t["role"] == "assistant", F.array(piece(head(t), 0), piece(said(t), 1), piece(F.lit("\n"), 0))).otherwise(F.array(piece(F.concat(head(t), said(t), F.lit("\n")), 0)))))


def format_preferences(pairs: DataFrame, key: str = "conv_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``key``, ``n_prompt_turns``, ``prompt`` and for either side its ``*_segments``; a row for each pair."""
    a, b = F.col("_a"), F.col("_b")
    out = pairs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{chosen}`").alias("_a"), F.col(f"`{rejected}`").alias("_b"))
    out = out.select("*", common_prefix(a, b).alias("_n"))
    n = F.col("_n")
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    return out.select(F.col("_key").alias(key), n.alias("n_prompt_turns"), render(F.slice(a, F.lit(1), n)).alias("prompt"), segments(rest(a)).alias("chosen_segments"), segments(rest(b)).alias("rejected_segments"))


def conversations_of(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key`` and ``turns``, the (role, text) turns in order. A turn without a conversation id is a conversation of its
    own, so such rows, however many, never meet in one group."""
    said = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    t = turns.select(F.col(f"`{key}`").alias("_key"), F.struct(F.col(f"`{turn}`").alias("turn"), said(role).alias("role"), said(text).alias("text")).alias("_t"))
    plain = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    grouped = t.where("_key is not null").groupBy("_key").agg(F.transform(F.sort_array(F.collect_list("_t")), plain).alias("_turns"))
    alone = t.where("_key is null").select("_key", F.array(plain(F.col("_t"))).alias("_turns"))
    return grouped.unionByName(alone).select(F.col("_key").alias(key), F.col("_turns").alias("turns"))


def stale_pairs(convs: DataFrame, key: str = "conv_id", turns: str = "turns") -> DataFrame:
    """``key``, ``chosen``, ``rejected`` and ``n_trailing``, the turns behind the last of the assistant's, which neither
    side has, as the module says. Every turn is copied once, so long conversations cost what they hold."""
    t, at = F.col("_turns"), F.col("_at")
    marked = F.transform(t, lambda x, i: F.when(x["role"] == "assistant", i))
    out = convs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{turns}`").alias("_turns"), F.filter(marked, lambda i: i.isNotNull()).alias("_at"))
    n = F.size(at)
    kept = F.when(n > 0, F.slice(t, F.lit(1), F.get(at, n - 1) + 1)).otherwise(t)

    def part(i: Column, k: Column) -> Column:
        """The turns since the assistant's turn before, and the ``k``-th of the assistant's, stale from the middle on."""
        before = F.when(k > 0, F.get(at, k - 1)).otherwise(F.lit(-1))
        old = F.when(k > 0, F.get(t, F.greatest(before, F.lit(0)))["text"]).otherwise(F.lit(""))
        own = F.get(t, i)
        return F.concat(F.slice(t, before + 2, i - before - 1), F.array(F.struct(own["role"].alias("role"), F.when(k >= F.floor(n / 2), old).otherwise(own["text"]).alias("text"))))

    stale = F.when(n > 0, F.flatten(F.transform(at, part))).otherwise(t)
    return out.select(F.col("_key").alias(key), kept.alias("chosen"), stale.alias("rejected"), F.when(n > 0, F.size(t) - F.get(at, n - 1) - 1).otherwise(F.lit(0)).alias("n_trailing"))


def op6_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stale_pairs(conversations_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    pairs = pairs.withColumn("conv_id", F.struct("conv_id", "n_trailing"))
    said = lambda c: F.array_join(F.transform(c, lambda s: s["text"]), "")
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["mask"], F.length(s["text"]))), ",")
    return format_preferences(pairs).select(
        "conv_id.conv_id", F.col("conv_id.n_trailing").cast("long").alias("n_trailing_turns"), F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", said("chosen_segments").alias("chosen"), mask("chosen_segments").alias("chosen_mask"),
        said("rejected_segments").alias("rejected"), mask("rejected_segments").alias("rejected_mask"),
    )


_SQL = f"""
WITH s AS (SELECT *, CASE WHEN conv_id IS NULL THEN -row_number() OVER () END AS own FROM conversations),
t AS (SELECT struct_pack(id := conv_id, own := own) AS conv_id, row_number() OVER w - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM s
  WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))),
a AS (SELECT conv_id, i, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS k, lag(text) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM t WHERE role = 'assistant'),
n AS (SELECT conv_id, max(i) AS last, min(i) FILTER (k >= c // 2) AS mid FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c FROM a) GROUP BY conv_id),
e AS (SELECT t.conv_id, CAST(CASE WHEN any_value(n.last) IS NULL THEN 0 ELSE max(t.i) - any_value(n.last) END AS BIGINT) AS n_after
  FROM t LEFT JOIN n ON t.conv_id IS NOT DISTINCT FROM n.conv_id GROUP BY t.conv_id),
p AS (SELECT t.*, n.mid, CASE WHEN t.role = 'assistant' AND t.i >= n.mid THEN coalesce(a.prev, '') ELSE t.text END AS other
  FROM t LEFT JOIN n ON t.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN a ON t.conv_id IS NOT DISTINCT FROM a.conv_id AND t.i = a.i WHERE n.last IS NULL OR t.i <= n.last),
f AS (SELECT conv_id, min(i) FILTER (text <> other) AS cut, count(*) AS n FROM p GROUP BY conv_id),
r AS (SELECT p.*, coalesce(f.cut, f.n) AS cut, '{_OPEN}' || role || chr(10) AS head FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id),
m AS (SELECT *, CASE WHEN role = 'assistant' THEN '0:' || length(head) || ',1:' || (length(text) + {len(_CLOSE)}) || ',0:1' ELSE '0:' || (length(head) + length(text) + {len(_CLOSE) + 1}) END AS mc,
  CASE WHEN role = 'assistant' THEN '0:' || length(head) || ',1:' || (length(other) + {len(_CLOSE)}) || ',0:1' ELSE '0:' || (length(head) + length(other) + {len(_CLOSE) + 1}) END AS mr FROM r)
SELECT m.conv_id.id AS conv_id, any_value(n_after) AS n_trailing_turns, CAST(min(cut) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(head || text || '{_CLOSE}' || chr(10), '' ORDER BY i) FILTER (i < cut), '') AS prompt,
  coalesce(string_agg(head || text || '{_CLOSE}' || chr(10), '' ORDER BY i) FILTER (i >= cut), '') AS chosen, coalesce(string_agg(mc, ',' ORDER BY i) FILTER (i >= cut), '') AS chosen_mask,
  coalesce(string_agg(head || other || '{_CLOSE}' || chr(10), '' ORDER BY i) FILTER (i >= cut), '') AS rejected, coalesce(string_agg(mr, ',' ORDER BY i) FILTER (i >= cut), '') AS rejected_mask
FROM m JOIN e ON m.conv_id IS NOT DISTINCT FROM e.conv_id GROUP BY m.conv_id"""

QUERIES = {"op6_chat_preferences": op6_chat_preferences}
ORACLES = {"op6_chat_preferences": _SQL}
