"""Preference formatting of chosen and rejected conversations. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHOSEN, REJECTED = "chosen", "rejected"
TRAINED_ROLE = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def preferences(turns: DataFrame, *, pair: str = "pair_id") -> DataFrame:
    """One row per pair: the prompt once, and a masked completion for each side.

    ``turns`` has the pair, ``side`` (chosen or rejected), ``turn``, ``role`` and ``text``. The longest common
    prefix of turns, equal in role and text, is the prompt. What follows it on a side is that side's
    completion, as an array of segments (text, trained): of a turn of the assistant the text and the end
    mark are trained on, all else is masked. Turns go by number, missing ones first; of several with one
    number, by role, then text; repeated rows count as turns. Missing roles and texts are empty. A side
    without turns has an empty prompt and completion; equal sides have two empty completions. Rows without a
    pair belong to none and give nothing. Other columns are not read.
    """
    blank = F.lit("")
    held = turns.where(F.col(pair).isNotNull() & F.col("side").isin(CHOSEN, REJECTED)).select(
        F.col(pair).alias("_pair"),
        F.struct(
            (F.col("side") == REJECTED).alias("rejected"), F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        ).alias("t"),
    )
    # A conversation is one row of the result, and here one row of one task.
    whole = held.groupBy("_pair").agg(F.array_sort(F.collect_list("t")).alias("t"))
    side = lambda rejected: F.transform(
        F.filter("t", lambda t: t["rejected"] == rejected), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )
    sides = whole.select("_pair", side(False).alias("a"), side(True).alias("b"))
    differs = F.array_position(F.zip_with("a", "b", lambda a, b: ~a.eqNullSafe(b)), True)
    n = F.when(differs == 0, F.size("a")).otherwise(differs - 1).cast("int")
    cut = sides.withColumn("n", n)
    prompt = F.array_join(F.transform(F.slice("a", F.lit(1), F.col("n")), lambda t: rendered(t["role"], t["text"])), "")

    def completion(name: str) -> Column:
        rest = F.slice(name, F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))
        part = lambda text, trained: F.struct(text.alias("text"), trained.alias("trained"))
        return F.flatten(
            F.transform(
                rest,
                lambda t: F.array(
                    part(F.concat(F.lit("<|"), t["role"], F.lit("|>\n")), F.lit(False)),
                    part(F.concat(t["text"], F.lit("<|end|>\n")), t["role"] == TRAINED_ROLE),
                ),
            )
        )

    return cut.select(
        F.col("_pair").alias(pair), F.col("n").cast("long").alias("n_common"), prompt.alias("prompt"),
        completion("a").alias("chosen"), completion("b").alias("rejected"),
    )


def text_of(completion: Column) -> Column:
    return F.array_join(F.transform(completion, lambda s: s["text"]), "")


def trained_length(completion: Column) -> Column:
    """Characters that are trained on."""
    return F.aggregate(completion, F.lit(0).cast("long"), lambda n, s: n + F.when(s["trained"], F.length(s["text"])).otherwise(0))


def echo_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of preference pairs made of ``conversations`` (conv_id, turn, role, text): chosen is a
    conversation up to its last reply of the assistant, rejected the same one with a last reply that only
    repeats the turn before. Conversations without a reply, or without an id, give no pair."""
    reply = F.when(F.col("role") == TRAINED_ROLE, F.col("turn"))
    last = conversations.groupBy(F.col("conv_id").alias("_conv")).agg(F.max(reply).alias("_last"))
    turns = conversations.select("conv_id", "turn", "role", "text").join(last, F.col("conv_id") == F.col("_conv"))
    as_turn = lambda side, turn, role: F.struct(F.lit(side).alias("side"), turn.alias("turn"), role.alias("role"), F.col("text").alias("text"))
    sides = F.array_compact(
        F.array(
            F.when(F.col("turn") <= F.col("_last"), as_turn(CHOSEN, F.col("turn"), F.col("role"))),
            F.when(F.col("turn") < F.col("_last"), as_turn(REJECTED, F.col("turn"), F.col("role"))),
            F.when(F.col("turn") == F.col("_last") - 1, as_turn(REJECTED, F.col("_last"), F.lit(TRAINED_ROLE))),
        )
    )
    return turns.select(F.col("conv_id").alias("pair_id"), F.explode(sides).alias("_s")).select("pair_id", "_s.*")
