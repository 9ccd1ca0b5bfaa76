"""Chat formatting of preference pairs: one prompt, two completions with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowhow.llm.common import positions, saved

START, END = "<|im_start|>", "<|im_end|>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text) in order; null roles are `user`, null texts empty, repeated turns stay."""
    row = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def _safe(text: Column) -> Column:
    """Markers inside a text cannot end its turn: a zero-width joiner parts them, and parts one that is there already."""
    return F.replace(text, F.lit("<|"), F.lit("<‍|"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _safe(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(END + "\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """(start, end) in characters of what is trained on: bodies of assistant turns with their end marker, not heads."""
    pieces = F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.char_length(_head(t)).alias("n"), F.lit(False).alias("on")),
        F.struct((F.char_length(_body(t)) - 1).alias("n"), (t["role"] == "assistant").alias("on")),
        F.struct(F.lit(1).alias("n"), F.lit(False).alias("on")))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(pieces, empty, lambda s, p: F.struct(
        (s["at"] + p["n"]).alias("at"),
        F.when(p["on"], F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), (s["at"] + p["n"]).alias("end"))))).otherwise(s["spans"]).alias("spans"),
    ), lambda s: s["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, usable; one row per pair in both tables.

    chosen and rejected: key (null is a key like others), turns (as turns_of gives them). The longest common prefix of turns (equal role and text)
    is rendered once; what follows on each side is its completion. Masks hold the character spans of a completion
    that count in the loss. A pair is usable if both completions have such a span. If one side is a prefix of the
    other its completion is empty.
    """
    other = rejected.select(F.col(key).alias(f"{key}_"), F.col("turns").alias("r"))
    both = chosen.select(key, F.col("turns").alias("c")).join(other, F.col(key).eqNullSafe(F.col(f"{key}_"))).drop(f"{key}_")
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    shared = F.array_position(same, False)
    both = both.withColumn("n", F.when(shared == 0, F.size(same)).otherwise(shared - 1).cast("int"))
    rest = [F.slice(x, F.col("n") + 1, F.greatest(F.size(x), F.lit(1))) for x in ("c", "r")]
    both = both.select(key, "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest[0].alias("c"), rest[1].alias("r"))
    out = both.select(key, F.col("n").alias("n_common"), _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"),
                      _render(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))
    return out.withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides for conversations that come without labels, one pair per conversation.

    Chosen is the whole conversation. Rejected leaves it at one of its assistant turns, taken by a hash of conv_id, and goes on as the next
    conversation does from its own such turn to its end (by conv_id; the last takes the first's): fluent, but about something
    else. A conversation without an assistant turn is its own rejected side, so its pair is not usable; neither is one
    whose continuations are equal. Null conv_ids form one conversation. Neighbours are found by position, so common
    openings or copies need no group of their own.
    """
    turns = turns_of(conversations)
    spots = F.array_compact(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    leave = F.when(F.size(spots) > 0, F.get(spots, F.pmod(F.xxhash64("conv_id"), F.size(spots)).cast("int")))
    turns = saved(turns.withColumn("leave", leave), "turns")
    with_reply = turns.where("leave IS NOT NULL")
    placed = positions(with_reply.select("conv_id", F.lit(0).alias("_all")), ["_all"], ["conv_id"], "pos").select("conv_id", "pos")
    n = placed.count()
    offer = placed.select(F.pmod(F.col("pos") - 1, F.lit(max(n, 1))).alias("pos"), F.col("conv_id").alias("other_id"))
    after = placed.join(offer, "pos").select(F.col("conv_id").alias("mine"), "other_id")
    tails = with_reply.select(F.col("conv_id").alias("theirs"), F.slice("turns", F.col("leave") + 1, F.size("turns")).alias("tail"))
    swapped = with_reply.join(after, F.col("conv_id").eqNullSafe(F.col("mine"))).join(tails, F.col("other_id").eqNullSafe(F.col("theirs")))
    swapped = swapped.select("conv_id", F.concat(F.slice("turns", F.lit(1), F.col("leave")), "tail").alias("turns"))
    rejected = swapped.unionByName(turns.where("leave IS NULL").select("conv_id", "turns"))
    return tuple(side.select(F.col("conv_id").alias("pair_id"), "turns") for side in (turns, rejected))
