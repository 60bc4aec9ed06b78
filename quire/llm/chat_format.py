"""Preference formatting of conversations.

A pair of conversations, chosen and rejected, shares its longest common prefix of turns. The prefix is rendered once as
the prompt; what follows in each becomes a completion, with a mask of the characters that a loss may count: the text and
the end mark of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: a turn is OPEN, its role, AFTER_ROLE, its text, CLOSE.
OPEN, AFTER_ROLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"
LEARNT_ROLE = "assistant"


def rendered(turns: Column) -> Column:
    """Turns as text; null roles and texts are empty."""
    one = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(AFTER_ROLE), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def learnt_spans(turns: Column) -> Column:
    """Characters [start, stop) of the rendered turns that the mask leaves in: text and end mark of the assistant's turns."""
    before = lambda t: len(OPEN) + len(AFTER_ROLE) + F.length(F.coalesce(t["role"], F.lit("")))
    kept = lambda t: F.length(F.coalesce(t["text"], F.lit(""))) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        first = state["at"] + before(t)
        stop = first + kept(t)
        span = F.array(F.struct(first.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(t["role"] == LEARNT_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns at the start of two arrays are equal in role and text; nulls are equal to nulls."""
    equal = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(equal, False)
    return F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with prompt, prompt_turns, chosen_text, chosen_mask, rejected_text and rejected_mask in place of the turns.

    ``chosen`` and ``rejected`` are arrays of (role, text). Null arrays are empty conversations; where one is a prefix of
    the other its completion is empty, with an empty mask. Texts are rendered as they are: lengths, not markers, tell
    where a turn ends. Other columns pass through, but for those with the names above. A conversation is one value of
    its row, however long; rows that repeat are formatted each; an empty table gives no rows.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    own = ("prompt", "prompt_turns", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")
    a, b = (F.coalesce(F.transform(F.col(c), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), empty) for c in (chosen, rejected))
    keep = [c for c in pairs.columns if c not in (*own, chosen, rejected)]
    # the other columns travel as one, so that their names meet none of these
    others = (F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None)).alias("_row")
    split = pairs.select(others, a.alias("_a"), b.alias("_b")).withColumn("_n", common_prefix(F.col("_a"), F.col("_b")))
    tail = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    cut = split.select("_row", F.col("_n").alias("prompt_turns"), F.slice("_a", 1, F.col("_n")).alias("_p"), tail("_a").alias("_c"), tail("_b").alias("_r"))
    return cut.select(*[F.col("_row")[c].alias(c) for c in keep], rendered(F.col("_p")).alias("prompt"), "prompt_turns", rendered(F.col("_c")).alias("chosen_text"), learnt_spans(F.col("_c")).alias("chosen_mask"), rendered(F.col("_r")).alias("rejected_text"), learnt_spans(F.col("_r")).alias("rejected_mask"))


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id and turns (array of role and text by turn number) of a table with a row for each turn.

    Rows without a conv_id are a conversation each, so they never meet in one group; a conversation is one value of the
    result, as long as its turns, and must fit a task. Equal turn numbers are ordered by role and text, repeated rows
    are turns each, other columns play no part, an empty table gives no rows.
    """
    rows = turns.select(F.col("conv_id").alias("conv_id"), F.struct("turn", "role", "text").alias("_t"))
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    lone = rows.where("conv_id is null").select("conv_id", F.array("_t").alias("_t"))
    return grouped.unionByName(lone).select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, chosen and rejected: a conversation up to its last reply, and the same with a stale reply there.

    The rejected reply is the assistant's one before, or an empty one if there is none. Turns after the last reply are
    left out of both; without any reply both are the whole conversation, and completions are empty. Null texts and
    roles are turns like others, null and repeated ids pass through, an empty table gives no rows.
    """
    place = F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == LEARNT_ROLE, i))
    replies = F.filter(place, lambda i: i.isNotNull())
    last = F.element_at("_at", -1)
    stale = F.when(F.size("_at") > 1, F.element_at("turns", F.element_at("_at", -2) + 1)["text"]).otherwise(F.lit(""))
    found = conversations.withColumn("_at", replies)
    has = F.size("_at") > 0
    chosen = F.when(has, F.slice("turns", 1, last + 1)).otherwise(F.col("turns"))
    rejected = F.when(has, F.concat(F.slice("turns", 1, last), F.array(F.struct(F.lit(LEARNT_ROLE).alias("role"), stale.alias("text"))))).otherwise(F.col("turns"))
    return found.select("conv_id", chosen.alias("chosen"), rejected.alias("rejected"))


def op9_preference_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = format_preferences(stale_reply_pairs(conversations_of(turns)))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",").alias(c)
    return out.select("conv_id", "prompt", F.col("prompt_turns").cast("long").alias("prompt_turns"), "chosen_text", told("chosen_mask"), "rejected_text", told("rejected_mask"))


SQL = r"""
WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id),
r AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant') AS places FROM c),
s AS (SELECT conv_id, t, len(places) AS k, places[len(places)] AS z, CASE WHEN len(places) > 1 THEN t[places[len(places) - 1]].text ELSE '' END AS stale FROM r),
p AS (SELECT conv_id, CASE WHEN k = 0 THEN t ELSE t[1:z] END AS a, CASE WHEN k = 0 THEN t ELSE list_append(t[1:z - 1], {'role': 'assistant', 'text': stale}) END AS b FROM s),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: i > len(a) OR i > len(b) OR a[i].role IS DISTINCT FROM b[i].role OR a[i].text IS DISTINCT FROM b[i].text)) - 1, len(a)) AS n FROM p),
w AS (
  SELECT *, list_transform(a, lambda x: '<|turn|>' || coalesce(x.role, '') || E'\n' || coalesce(x.text, '') || E'<|end|>\n') AS u,
         list_transform(b, lambda x: '<|turn|>' || coalesce(x.role, '') || E'\n' || coalesce(x.text, '') || E'<|end|>\n') AS v FROM n)
SELECT conv_id, coalesce(array_to_string(u[1:n], ''), '') AS prompt, n::BIGINT AS prompt_turns, coalesce(array_to_string(u[n + 1:], ''), '') AS chosen_text,
       CASE WHEN n < len(a) THEN '18-' || (26 + length(a[n + 1].text)) ELSE '' END AS chosen_mask, coalesce(array_to_string(v[n + 1:], ''), '') AS rejected_text,
       CASE WHEN n < len(b) THEN '18-' || (26 + length(b[n + 1].text)) ELSE '' END AS rejected_mask
FROM w
"""

QUERIES = {"op9_preference_format": op9_preference_format}
ORACLE = {"op9_preference_format": SQL}
