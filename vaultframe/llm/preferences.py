"""Chat formatting: paired preference examples from conversations, in DataFrame functions only.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the prompt;
what follows in each becomes its completion, with a mask that marks what a model is trained on: the words and
the closing mark of assistant turns. A mask is a run-length list "length:flag,..." over the completion's code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import read

#: Fixed marks of the rendered format.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _plain(column: Column) -> Column:
    """Text that cannot be taken for a mark."""
    return F.replace(F.coalesce(column, F.lit("")), F.lit("<|"), F.lit("< |"))


def _segments(turns: Column) -> Column:
    """(words, flag) of each turn's head and body."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE)).alias("s"), F.lit(0).alias("f")),
                F.struct(F.concat(t["text"], F.lit(CLOSE)).alias("s"), F.when(t["role"] == "assistant", 1).otherwise(0).alias("f")),
            ),
        )
    )


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(_segments(turns), lambda s: s["s"]), "")


def _mask(turns: Column) -> Column:
    return F.array_join(F.transform(_segments(turns), lambda s: F.concat_ws(":", F.length(s["s"]), s["f"])), ",")


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order. Equal rows count once; null roles and texts are empty; null conv_ids form one conversation."""
    one = turns.select("conv_id", "turn", _plain(F.col("role")).alias("role"), _plain(F.col("text")).alias("text")).distinct()
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return one.groupBy("conv_id").agg(ordered.alias("turns"))


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per row of pairs (chosen_id, rejected_id); a side that is null or unknown is a conversation without turns.

    Columns: the ids, n_common (turns of the common prefix), prompt, and text and mask of either completion.
    """
    c = conversations_of(turns)
    left = c.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    right = c.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    both = pairs.select("chosen_id", "rejected_id").join(left, "chosen_id", "left").join(right, "rejected_id", "left")
    return _formatted(both)


def _formatted(both: DataFrame) -> DataFrame:
    none = F.expr("array()").cast(both.schema["a"].dataType)
    both = both.withColumn("a", F.coalesce("a", none)).withColumn("b", F.coalesce("b", none))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first_other = F.coalesce(F.array_position(same, False), F.lit(0))
    both = both.withColumn("n_common", F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int"))
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side), F.lit(1)))
    return both.select(
        "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"),
        _rendered(F.slice("a", 1, F.greatest("n_common", F.lit(0)))).alias("prompt"),
        _rendered(rest("a")).alias("chosen"), _mask(rest("a")).alias("chosen_mask"),
        _rendered(rest("b")).alias("rejected"), _mask(rest("b")).alias("rejected_mask"),
    )


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations in pairs. The table marks no preference, so conversation 2k is taken as chosen and 2k+1 as rejected."""
    turns = read(spark, sf_dir, "conversations")
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    pairs = turns.where("conv_id is not null").select(pair.alias("k")).distinct().select((F.col("k") * 2).alias("chosen_id"), (F.col("k") * 2 + 1).alias("rejected_id"))
    return preference_pairs(turns, pairs)


SQL = {
    "op8_chat_formatting": """
    with t as (select distinct conv_id, turn, replace(coalesce(role, ''), '<|', '< |') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
    c as (select conv_id, list({'turn': turn, 'role': role, 'text': text} order by turn, role, text) as turns from t group by conv_id),
    p as (select distinct (conv_id // 2) * 2 as chosen_id, (conv_id // 2) * 2 + 1 as rejected_id from t where conv_id is not null),
    b as (select chosen_id, rejected_id, coalesce(x.turns, []) as a, coalesce(y.turns, []) as b from p left join c x on x.conv_id = chosen_id left join c y on y.conv_id = rejected_id),
    n as (select *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: i > len(a) or i > len(b) or a[i].role <> b[i].role or a[i].text <> b[i].text)), greatest(len(a), len(b)) + 1) - 1 as n_common from b)
    select chosen_id, rejected_id, n_common::bigint as n_common,
      coalesce(array_to_string(list_transform(a[1:n_common], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') as prompt,
      coalesce(array_to_string(list_transform(a[n_common+1:], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') as chosen,
      coalesce(array_to_string(list_transform(a[n_common+1:], lambda t: (length(t.role) + 5) || ':0,' || (length(t.text) + 8) || ':' || (t.role = 'assistant')::int), ','), '') as chosen_mask,
      coalesce(array_to_string(list_transform(b[n_common+1:], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') as rejected,
      coalesce(array_to_string(list_transform(b[n_common+1:], lambda t: (length(t.role) + 5) || ':0,' || (length(t.text) + 8) || ':' || (t.role = 'assistant')::int), ','), '') as rejected_mask
    from n"""
}
QUERIES = {"op8_chat_formatting": op8_chat_formatting}
