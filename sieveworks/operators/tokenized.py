"""Token sequences for training: encoding with a pluggable tokenizer, truncation, label masks, length filters.

A tokenizer is a function from a list of texts to a list of lists of ids; it
runs on Arrow batches. Without one, code points stand in for tokens, which
needs no Python at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE = -100
Encoder = Callable[[list[str]], list[list[int]]]


def encoded(df: DataFrame, encoder: Encoder, **columns: str) -> DataFrame:
    """``df`` with an id array for each ``name=text_column``; null texts give no ids."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(encoder([t or "" for t in s]))

    return df.withColumns({name: ids(F.col(text)) for name, text in columns.items()})


def char_ids(c: Column) -> Column:
    """One id per character: its code point."""
    text = F.coalesce(c, F.lit(""))
    return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("int"))


def masked(full: Column, prompt_len: Column, max_length: int, train_on_inputs: bool = False) -> Column:
    """STRUCT of input_ids, attention_mask and labels: cut on the right, labels of the prompt ignored."""
    ids = F.slice(full, 1, max_length)
    hidden = F.least(prompt_len, F.size(ids))
    labels = ids if train_on_inputs else F.concat(F.array_repeat(F.lit(IGNORE), hidden), F.slice(ids, hidden + 1, F.greatest(F.size(ids) - hidden, F.lit(0))))
    return F.struct(ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), labels.alias("labels"))


def prompt_only(prompt_len: Column, full: Column, max_length: int) -> Column:
    """After the cut nothing but prompt is left."""
    return prompt_len >= F.least(F.size(full), F.lit(max_length))


def has_labels(labels: Column) -> Column:
    """Something is left to learn; false for an empty list."""
    return F.exists(labels, lambda x: x != IGNORE)


def token_pair_fits(chosen: Column, rejected: Column, most: int) -> Column:
    return F.size(chosen).between(1, most) & F.size(rejected).between(1, most)


def tail_window(ids: Column, context: int, new: int, spare: int = 8) -> Column:
    """The last tokens that leave room for ``new`` ones."""
    keep = max(context - new - spare, 1)
    return F.when(F.size(ids) <= keep, ids).otherwise(F.slice(ids, -keep, keep))


def dialog_budget(sources: Column, targets: Column, max_length: int, eos: int) -> Column:
    """STRUCT of input_ids and labels of a dialog: each turn's source and target share the budget by their lengths, and turns stop where it is used up."""
    turn = F.arrays_zip(sources.alias("source"), targets.alias("target"))
    zero = F.struct(F.array().cast("array<int>").alias("ids"), F.array().cast("array<int>").alias("labels"), F.lit(False).alias("full"))

    def step(acc: Column, t: Column) -> Column:
        s, o = F.coalesce(t["source"], F.array().cast("array<int>")), F.coalesce(t["target"], F.array().cast("array<int>"))
        both = F.greatest(F.size(s) + F.size(o), F.lit(1)).cast("double")
        max_s, max_t = F.floor(max_length * (F.size(s) / both)).cast("int"), F.floor(max_length * (F.size(o) / both)).cast("int")
        s = F.when(F.size(s) > max_s, F.slice(s, 1, F.greatest(max_s, F.lit(0)))).otherwise(s)
        o = F.when(F.size(o) > max_t - 1, F.slice(o, 1, F.greatest(max_t - 1, F.lit(0)))).otherwise(o)
        over = acc["full"] | (F.size(acc["ids"]) + F.size(s) + F.size(o) + 1 > max_length)
        ids, labels = F.concat(acc["ids"], s, o, F.array(F.lit(eos))), F.concat(acc["labels"], F.array_repeat(F.lit(IGNORE), F.size(s)), o, F.array(F.lit(eos)))
        return F.struct(F.when(over, acc["ids"]).otherwise(ids).alias("ids"), F.when(over, acc["labels"]).otherwise(labels).alias("labels"), over.alias("full"))

    return F.aggregate(turn, zero, step, lambda acc: F.struct(acc["ids"].alias("input_ids"), acc["labels"].alias("labels")))


def flat_ids(tokens) -> list[int]:
    """Token ids as one list, from a list, a list of one list, an array, or a mapping with ``input_ids``; for use in batches of a tokenizer."""
    if hasattr(tokens, "keys"):
        tokens = tokens["input_ids"]
    if hasattr(tokens, "tolist"):
        tokens = tokens.tolist()
    tokens = list(tokens)
    while tokens and isinstance(tokens[0], (list, tuple)):
        tokens = list(tokens[0])
    return [int(x) for x in tokens]
