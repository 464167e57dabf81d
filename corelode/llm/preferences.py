"""Preference pairs: the common prompt once, and two completions with their masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "<|end|>\n"
TRAINED = "assistant"


def _conversations(turns: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """(pair_id, turns): the turns of a conversation in order; a conversation is one training example, hence one row."""
    clean = turns.filter(F.col(pair).isNotNull()).select(
        F.col(pair).alias("pair_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    return clean.groupBy("pair_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t["role"]), t["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """Character ranges [begin, end) of what is trained on: the assistant's words and its end mark."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_header(t["role"]))
        end = begin + F.length(t["text"]) + len(END)
        mine = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda acc: acc["spans"])


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per pair that both sides have: prompt, completions, and the spans to train on.

    The prompt is the longest common prefix of turns (equal role and text),
    rendered once; the completions are what follows on either side. Where one
    conversation is a prefix of the other its completion is empty; equal
    conversations have two empty ones.

    A turn with a null text is empty, one with a null role has the role
    ``unknown``. Turns are in the order of their number, null first, then role
    and text; repeated turns count once. Rows without a pair belong to no
    conversation and are left out, as are pairs that one side lacks. Empty
    tables give no rows; other columns are not carried.

    Returns pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.
    """
    sides = _conversations(chosen, pair, turn, role, text).withColumnRenamed("turns", "c").join(
        _conversations(rejected, pair, turn, role, text).withColumnRenamed("turns", "r"), "pair_id")
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), shorter), F.slice("r", F.lit(1), shorter), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    parting = F.array_position(same, F.lit(False))
    split = sides.withColumn("prompt_turns", F.when(parting == 0, shorter).otherwise(parting - 1).cast("int"))
    rest = {s: F.slice(s, F.col("prompt_turns") + 1, F.size(s)) for s in "cr"}
    return split.select(
        "pair_id", "prompt_turns", _rendered(F.slice("c", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        _rendered(rest["c"]).alias("chosen"), _rendered(rest["r"]).alias("rejected"),
        _spans(rest["c"]).alias("chosen_spans"), _spans(rest["r"]).alias("rejected_spans"))


def stale_answers(conversations: DataFrame) -> DataFrame:
    """Rejected counterparts (conv_id, turn, role, text) of conversations.

    The last answer is replaced by an earlier answer of the same conversation or,
    where there is none, by an echo of what the user said last. Conversations
    without an answer have no counterpart.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_answer = F.col("role") == TRAINED
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").distinct()
    marked = turns.withColumns({
        "place": F.row_number().over(order), "answer": F.last(F.when(is_answer, F.col("text")), True).over(before),
        "said": F.last(F.when(F.col("role") == "user", F.col("text")), True).over(before)})
    last = marked.withColumn("last", F.max(F.when(is_answer, F.col("place"))).over(Window.partitionBy("conv_id"))).filter("last IS NOT NULL")
    return last.select("conv_id", "turn", "role", F.when(F.col("place") == F.col("last"), F.coalesce("answer", "said")).otherwise(F.col("text")).alias("text"))
