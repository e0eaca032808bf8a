"""Preference pairs: the turns that two conversations share, rendered once as prompt, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER, END = "<|", "|>\n", "<|end|>\n"  # around a role, and after a text


def turn_of(turn: str = "turn", role: str = "role", text: str = "text") -> Column:
    """A row as (turn, role, text). A null role is "user" and a null text is empty."""
    return F.struct(F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def turns(conversations: DataFrame, by: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: `by` and its turns in order as an array of (turn, role, text).

    Repeated rows count once; turns of one number stand in the order of role and text. Rows with a null
    conversation or turn are left out: they belong nowhere.
    """
    rows = conversations.where(F.col(by).isNotNull() & F.col(turn).isNotNull())
    return rows.groupBy(F.col(by).alias("conv_id")).agg(F.array_sort(F.collect_set(turn_of(turn, role, text))).alias("turns"))


def render(turns: Column) -> Column:
    """Each turn as a line with its role, its text and an end mark."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(BEFORE), t["role"], F.lit(AFTER), t["text"], F.lit(END))))


def trained_spans(turns: Column) -> Column:
    """Start and end, in code points of the rendered completion, of what is trained on: the assistant's texts and their end marks."""
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + F.lit(len(BEFORE + AFTER + END))
    start = lambda a, t: a["at"] + F.length(t["role"]) + F.lit(len(BEFORE + AFTER))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a, t):
        span = F.struct(start(a, t).alias("start"), (a["at"] + size(t)).alias("end"))
        return F.struct((a["at"] + size(t)).alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda a: a["spans"])


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns, from the first, are the same in role and text."""
    same = F.transform(F.arrays_zip(chosen.alias("c"), rejected.alias("r")), lambda z: z["c"]["role"].eqNullSafe(z["r"]["role"]) & z["c"]["text"].eqNullSafe(z["r"]["text"]))
    at = F.array_position(same, F.lit(False)).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(same))


def preferences(pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prompt, completions and masks of each pair of turn arrays `chosen` and `rejected`.

    A missing side (null) is an empty conversation, which shares no turn. If one conversation begins the other,
    its completion is empty. Pairs are rows of their own; nothing is gathered.
    """
    none = F.array().cast(pairs.schema["chosen"].dataType)
    pairs = pairs.withColumns({c: F.coalesce(F.col(c), none) for c in ("chosen", "rejected")})
    pairs = pairs.withColumn("n_prompt_turns", shared_turns(F.col("chosen"), F.col("rejected")))
    rest = {c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.lit(0), F.size(c) - F.col("n_prompt_turns"))) for c in ("chosen", "rejected")}
    return pairs.select(
        *keep,
        "n_prompt_turns",
        render(F.slice(F.col("chosen"), F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        *[render(v).alias(c) for c, v in rest.items()],
        *[trained_spans(v).alias(f"{c}_spans") for c, v in rest.items()],
    )


def paired_by_number(conversations: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected), for tables that mark no preference; a side without rows is empty.

    Halves are taken by shifting bits, so ids of any size keep their pair. Repeated rows count once; rows with a null
    conversation or turn are left out. Both sides come out of one aggregation: a pair's turns are what is gathered.
    """
    rows = conversations.where("conv_id is not null and turn is not null").withColumn("conv_id", F.col("conv_id").cast("bigint"))
    even = F.col("conv_id").bitwiseAND(1) == 0
    side = lambda wanted: F.array_sort(F.collect_set(F.when(wanted, turn_of())))
    return rows.groupBy(F.shiftright("conv_id", 1).alias("pair_id")).agg(side(even).alias("chosen"), side(~even).alias("rejected"))
