"""Preference pairs: the turns that two conversations share are the prompt, the rest two completions.

The chosen and the rejected conversation of a pair are compared turn by turn
(role and text). The longest common prefix is rendered once as ``prompt``;
what follows is rendered for each side, with the spans (code points, end
exclusive) of the text to learn from, which is that of assistant turns.

``format_preferences`` takes pairs as they are stored. Where a table has single
conversations only, ``swapped_replies`` makes the rejected side: the same
conversation up to its last reply, and in that reply's place the last reply of
the conversation beside it (2k and 2k + 1), which answers something else. The
place of the fork is left to the prefix search.

Cases: turns are ordered by number (those without one first), then role, then
text, and exact repeats count once; a null role is the user's and a null text is empty; a pair with
one side only keeps its row (no prefix, the other completion empty, ``paired``
false), and so does a conversation without a reply to swap; equal sides give
two empty completions; rows without a conversation id belong to no
conversation, so each distinct one is a row of its own, with a null id and
unpaired; very long turns and conversations are rendered whole; an empty table
gives no rows; other columns, of any name, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the chat template.
OPEN, MID, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MID), turn["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    """The text of an array of turns (turn, role, text)."""
    return F.array_join(F.transform(turns, _rendered), "")


def mask(turns: Column) -> Column:
    """``start:end`` of the learned texts inside ``render(turns)``, comma-joined."""

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["role"]) + len(OPEN) + len(MID)
        end = start + F.length(turn["text"])
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        spans = F.when(turn["role"] == LEARNED, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda s: F.array_join(s["spans"], ","))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns have the same role and text."""
    least = F.least(F.size(a), F.size(b))
    same = F.transform(
        F.sequence(F.lit(0), least - 1),
        lambda i: (F.get(a, i)["role"] == F.get(b, i)["role"]) & (F.get(a, i)["text"] == F.get(b, i)["text"]),
    )
    stop = F.array_position(same, F.lit(False)).cast("int")
    return F.when(least == 0, 0).when(stop == 0, least).otherwise(stop - 1)


def _turn() -> Column:
    """A row's turn, with its blanks filled."""
    return F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _alone(key: Column) -> Column:
    """What tells rows with a null key apart, so that they never meet in one group: the row's own hash."""
    return F.when(key.isNull(), F.xxhash64("turn", "role", "text"))


def formatted(sides: DataFrame) -> DataFrame:
    """``sides`` (pair_id, and sorted arrays of turns ``a``, chosen, and ``b``, rejected) as prompt and completions."""
    cut = sides.withColumn("n_prefix", common_prefix(F.col("a"), F.col("b")))
    rest = lambda x: F.slice(x, F.col("n_prefix") + 1, F.size(x))
    return cut.select(
        "pair_id",
        ((F.size("a") > 0) & (F.size("b") > 0)).alias("paired"),
        F.col("n_prefix").cast("long").alias("n_prefix"),
        render(F.slice("a", 1, F.col("n_prefix"))).alias("prompt"),
        render(rest(F.col("a"))).alias("chosen"),
        mask(rest(F.col("a"))).alias("chosen_mask"),
        render(rest(F.col("b"))).alias("rejected"),
        mask(rest(F.col("b"))).alias("rejected_mask"),
    )


def _both_sides(turns: DataFrame, pair: Column, first: Column) -> DataFrame:
    """(pair_id, a, b): the sorted distinct turns of either side of each pair. One shuffle, by pair."""
    rows = turns.select(pair.alias("pair_id"), _alone(pair).alias("alone"), F.coalesce(first, F.lit(True)).alias("first"), _turn().alias("x"))
    return rows.groupBy("pair_id", "alone").agg(
        F.array_sort(F.collect_set(F.when(F.col("first"), F.col("x")))).alias("a"),
        F.array_sort(F.collect_set(F.when(~F.col("first"), F.col("x")))).alias("b"),
    )


def format_preferences(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row per pair of ``turns`` (conv_id, turn, role, text).

    ``pair`` names the pair of a row and ``chosen`` tells its side; each side is
    one conversation.
    """
    return formatted(_both_sides(turns, pair, chosen))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as pair k."""
    conv = F.col("conv_id")
    return format_preferences(conversations, F.shiftright(conv, 1), conv.bitwiseAND(F.lit(1)) == 0)


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """One row per conversation, ``pair_id`` its id: its own last reply chosen, that of the conversation beside it rejected."""
    conv = F.col("conv_id")
    met = _both_sides(conversations, F.shiftright(conv, 1), conv.bitwiseAND(F.lit(1)) == 0)

    def last_reply(x: str) -> str:
        return f"cast(size({x}) - array_position(transform(reverse({x}), t -> t.role = '{LEARNED}'), true) AS int)"

    def side(own: str, other: str, low: int) -> str:
        at, theirs = last_reply(own), last_reply(other)
        fork = f"transform(slice({own}, 1, {at} + 1), (t, i) -> if(i = {at}, named_struct('turn', t.turn, 'role', t.role, 'text', get({other}, {theirs}).text), t))"
        swap = f"array_contains(transform({own}, t -> t.role), '{LEARNED}') AND array_contains(transform({other}, t -> t.role), '{LEARNED}')"
        return f"if(size({own}) > 0, named_struct('pair_id', shiftleft(pair_id, 1) + {low}, 'a', {own}, 'b', if({swap}, {fork}, slice({own}, 1, 0))), NULL)"

    each = met.select(F.explode(F.expr(f"array_compact(array({side('a', 'b', 0)}, {side('b', 'a', 1)}))")).alias("s"))
    return formatted(each.select("s.pair_id", "s.a", "s.b"))


def sql() -> str:
    """``swapped_replies`` as DuckDB SQL over ``conversations``."""
    return f"""
WITH x AS (
  SELECT DISTINCT conv_id AS c, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM x),
r AS (SELECT c, max(i) AS at, arg_max(text, i) AS reply FROM n WHERE role = '{LEARNED}' GROUP BY c),
two AS (
  SELECT c, 0 AS side, i, role, text FROM n
  UNION ALL
  SELECT n.c, 1, i, role, CASE WHEN i = own.at THEN other.reply ELSE text END FROM n JOIN r own ON own.c = n.c JOIN r other ON other.c = xor(n.c, 1) WHERE i <= own.at),
k AS (
  SELECT a.c, a.i FROM two a JOIN two b ON a.c = b.c AND a.side = 0 AND b.side = 1 AND a.i = b.i AND a.role = b.role AND a.text = b.text),
p AS (SELECT c, count(*) AS n_prefix FROM (SELECT c, i, row_number() OVER (PARTITION BY c ORDER BY i) AS q FROM k) WHERE i = q GROUP BY c),
m AS (SELECT two.*, coalesce(n_prefix, 0) AS n_prefix, '{OPEN}' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM two LEFT JOIN p USING (c)),
o AS (SELECT *, coalesce(sum(length(s)) FILTER (i > n_prefix) OVER (PARTITION BY c, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint
  + length(role) + {len(OPEN) + len(MID)} AS a FROM m)
SELECT c AS pair_id, count(DISTINCT side) = 2 AS paired, min(n_prefix)::bigint AS n_prefix,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i <= n_prefix), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i > n_prefix), '') AS chosen,
  coalesce(string_agg(a || ':' || (a + length(text)), ',' ORDER BY i) FILTER (side = 0 AND i > n_prefix AND role = '{LEARNED}'), '') AS chosen_mask,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 1 AND i > n_prefix), '') AS rejected,
  coalesce(string_agg(a || ':' || (a + length(text)), ',' ORDER BY i) FILTER (side = 1 AND i > n_prefix AND role = '{LEARNED}'), '') AS rejected_mask
FROM o GROUP BY c
UNION ALL
SELECT NULL, false, 0, '', '{OPEN}' || role || '|>' || chr(10) || text || '<|end|>' || chr(10),
  CASE WHEN role = '{LEARNED}' THEN (length(role) + {len(OPEN) + len(MID)}) || ':' || (length(role) + {len(OPEN) + len(MID)} + length(text)) ELSE '' END, '', ''
FROM (SELECT DISTINCT turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NULL)
"""
