"""Preference formatting of chosen and rejected conversations; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<turn:bigint,role:string,text:string>"
TARGET_ROLE = "assistant"


def rendered(turn: Column) -> Column:
    """<|role|>, the text and <|end|>, on lines of their own."""
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _side(turns: Column, role: str) -> tuple[Column, Column]:
    """The completion as one string, and the spans that are trained on: text and end mark of the turns of `role`, as start:end in code points."""
    text = F.array_join(F.transform(turns, rendered), "")

    def step(acc: Column, turn: Column) -> Column:
        end = acc["at"] + F.char_length(rendered(turn))
        start = acc["at"] + F.char_length(turn["role"]) + 5  # <| and |> and a line end
        span = F.concat_ws(":", start.cast("string"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(turn["role"] == role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans")), step)["spans"]
    return text, F.concat_ws(",", spans)


def format_preferences(turns: DataFrame, role: str = TARGET_ROLE) -> DataFrame:
    """One row per pair_id of `turns` (pair_id, side, turn, role, text): pair_id, n_prompt, prompt, chosen, chosen_mask, rejected, rejected_mask, n_chosen, n_rejected.

    side is `chosen` or `rejected`; other sides are left out. Turns are ordered by (turn, role, text), null turn numbers
    last; equal rows count each. n_prompt is the number of leading turns whose role and text are equal on both sides; they
    are rendered once, as prompt. What follows is rendered for each side; its mask lists the spans to train on. A null
    role counts as `user`, a null text as empty. A side without turns gives an empty completion; two equal conversations
    give two. Rows without pair_id are left out.
    """
    rows = turns.where("pair_id is not null and side in ('chosen', 'rejected')").select(
        "pair_id", "side", F.struct(F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("t"))))
    pairs = rows.groupBy("pair_id").agg(side("chosen").alias("a"), side("rejected").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    pairs = pairs.withColumn("same", same).withColumn("n_prompt", F.coalesce(F.nullif(F.array_position("same", False), F.lit(0)) - 1, F.size("same").cast("long")))
    rest = lambda c: F.slice(c, (F.col("n_prompt") + 1).cast("int"), F.greatest(F.size(c) - F.col("n_prompt"), F.lit(0)).cast("int"))
    pairs = pairs.select("pair_id", "n_prompt", F.slice("a", 1, F.col("n_prompt").cast("int")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    chosen, chosen_mask = _side(F.col("a"), role)
    rejected, rejected_mask = _side(F.col("b"), role)
    return pairs.select(
        "pair_id", "n_prompt", F.array_join(F.transform("p", rendered), "").alias("prompt"), chosen.alias("chosen"), chosen_mask.alias("chosen_mask"), rejected.alias("rejected"), rejected_mask.alias("rejected_mask"),
        F.size("a").cast("long").alias("n_chosen"), F.size("b").cast("long").alias("n_rejected"),
    )


def against_neighbour(conversations: DataFrame, role: str = TARGET_ROLE) -> DataFrame:
    """Pairs for a table without preferences (conv_id, turn, role, text): each conversation is chosen over itself with the last reply of another.

    The rejected side has, for its last turn of `role`, the text of the last such turn of the conversation whose id differs
    in its lowest bit; where there is none, the two sides are equal. Rows without conv_id are left out.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    of = F.struct(F.col("turn").isNotNull().alias("has"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    last = rows.where(F.col("role") == role).groupBy("pair_id").agg(F.max(of).alias("last"))
    other = last.select(F.col("pair_id").bitwiseXOR(1).alias("o_id"), F.col("last.text").alias("reply"))
    swap = last.join(other, last["pair_id"] == other["o_id"]).select(F.col("pair_id").alias("s_id"), F.col("last.turn").alias("s_turn"), F.col("last.text").alias("s_text"), "reply")
    joined = rows.join(swap, rows["pair_id"] == swap["s_id"], "left")
    here = (F.col("role") == role) & F.col("turn").eqNullSafe(F.col("s_turn")) & (F.coalesce("text", F.lit("")) == F.col("s_text"))
    text = F.when(F.coalesce(here, F.lit(False)), F.col("reply")).otherwise(F.col("text"))
    return rows.withColumn("side", F.lit("chosen")).unionByName(joined.select("pair_id", "turn", "role", text.alias("text"), F.lit("rejected").alias("side")))
