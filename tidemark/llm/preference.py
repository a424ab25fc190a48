"""Preference pairs from conversations, in DataFrame expressions only.

Conversations 2k and 2k + 1 are the chosen and the rejected one of pair k.  Their longest common prefix of turns (equal
role and text) is rendered once as the prompt; what follows it in either is its completion, with the spans of code
points that are learned from: the text and the end mark of assistant turns, never role marks or other roles.

Edge cases: null role or text counts as empty; a null turn comes first; a turn repeated with equal role and text is one
turn, different ones of one number go by role and text; rows with a null conv_id belong to no pair and are left out; a
conversation without its partner gives a row with the missing completion null and an empty prompt; where one is a prefix
of the other a completion is empty, and `usable` is false.  A conversation is one value of the result, so it has to fit
in a row; turns of different pairs never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<|", "|>\n", "<|end|>\n"


def _render(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(MID), t["text"], F.lit(CLOSE))


def _completion(turns: str, n: Column) -> tuple[Column, Column]:
    rest = F.slice(F.col(turns), n + 1, F.greatest(F.lit(0), F.size(turns) - n))
    text = F.array_join(F.transform(rest, _render), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = acc["at"] + F.length(F.concat(F.lit(OPEN), t["role"], F.lit(MID)))
        end = head + F.length(t["text"]) + F.lit(len(CLOSE))
        more = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(head.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), more.alias("spans"))

    return text, F.aggregate(rest, start, step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans, usable; spans are arrays of (start, end)."""
    t = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("c"), t.alias("t"))
    both = rows.groupBy("pair_id").agg(F.collect_list(F.when(F.col("c"), F.col("t"))).alias("a"), F.collect_list(F.when(~F.col("c"), F.col("t"))).alias("b"))
    both = both.select("pair_id", F.array_sort(F.array_distinct("a")).alias("a"), F.array_sort(F.array_distinct("b")).alias("b"))
    k = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", F.lit(1), k), F.slice("b", F.lit(1), k), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(same, False)
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(k).cast("int"))
    (ca, sa), (cb, sb) = _completion("a", F.col("n")), _completion("b", F.col("n"))
    has_a, has_b = F.size("a") > 0, F.size("b") > 0
    df = both.select(
        "pair_id", F.col("n").cast("long").alias("n_common"), F.array_join(F.transform(F.slice("a", F.lit(1), F.col("n")), _render), "").alias("prompt"),
        F.when(has_a, ca).alias("chosen"), F.when(has_a, sa).alias("chosen_spans"), F.when(has_b, cb).alias("rejected"), F.when(has_b, sb).alias("rejected_spans"),
    )
    usable = F.coalesce((F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0), F.lit(False))
    return df.withColumn("usable", usable)


def as_text(spans: str) -> Column:
    """start-end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
