"""Batch generation with a pluggable generator, judging with memory, and JSON replies.

A generator is a function from a list of prompts to a list of texts. It runs
inside Arrow batches on the executors; what it needs (address, key) comes from
the caller's own configuration.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sieveworks.functions.text import sanitize, shorten
from sieveworks.operators.splits import position

Generator = Callable[[list[str]], list[str]]


def generated(
    df: DataFrame, prompt: str, out: str, generator: Generator, attempts: int = 3, longest_wait: float = 8.0, wait: float = 1.0, accept: Callable[[str | None], bool] | None = None
) -> DataFrame:
    """``df`` with the reply to each prompt. What a batch lacks is tried ``attempts`` times with doubled waits: all of it where the generator fails, else
    the replies that ``accept`` refuses; then the job fails. Batches that were written before stay, and ``unfinished`` goes on from them."""

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            prompts = [t or "" for t in s]
            replies: list[str | None] = [None] * len(prompts)
            todo = list(range(len(prompts)))
            for k in range(attempts):
                try:
                    for i, r in zip(todo, generator([prompts[i] for i in todo]), strict=True):
                        replies[i] = r
                    todo = [i for i in todo if accept is not None and not accept(replies[i])]
                    error = ValueError(f"{len(todo)} replies are not as wanted: {replies[todo[0]]!r}") if todo else None
                except Exception as e:
                    error = e
                if error is None:
                    break
                if k == attempts - 1:
                    raise error
                time.sleep(min(wait * 2**k, longest_wait))
            yield pd.Series(replies)

    return df.withColumn(out, reply(F.col(prompt)))


def is_reasoned(reply: str | None) -> bool:
    """A JSON object with both fields of a generated record."""
    got = json_object(reply) or {}
    return all(str(got.get(k) if got.get(k) is not None else "").strip() for k in ("reasoning", "output_model"))


def reasoned(df: DataFrame, prompt: str, generator: Generator, limit: int = 1000, **how) -> DataFrame:
    """``df`` with reasoning and model output by the generator; a reply that is no JSON or lacks a field is asked for again, and at last fails the job."""
    asked = generated(df, prompt, "__reply", generator, accept=is_reasoned, **how)
    return with_reasoning(asked, F.col("__reply"), limit).drop("__reply", "generation_ok")


def json_object(text: str | None) -> dict | None:
    """A text as one JSON object, else what stands from its first '{' to its last '}'; None if neither is one."""
    if not text:
        return None
    for part in (text.strip(), text[text.find("{") : text.rfind("}") + 1] if 0 <= text.find("{") < text.rfind("}") else ""):
        try:
            got = json.loads(part)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return None


_REPLY = T.StructType([T.StructField("reasoning", T.StringType()), T.StructField("output_model", T.StringType()), T.StructField("ok", T.BooleanType())])


@F.pandas_udf(_REPLY)
def reply_fields(s: pd.Series) -> pd.DataFrame:
    """Both fields of a JSON reply; ``ok`` if it is an object and both have something in them."""
    rows = []
    for t in s:
        got = json_object(t) or {}
        r, o = (str(got[k]).strip() if got.get(k) is not None else "" for k in ("reasoning", "output_model"))
        rows.append((r, o, bool(r and o)))
    return pd.DataFrame(rows, columns=["reasoning", "output_model", "ok"])


def with_reasoning(df: DataFrame, replies: Column, limit: int = 1000) -> DataFrame:
    """Reasoning (shortened) and model output taken from JSON replies; ``generation_ok`` tells the failures."""
    out = df.withColumn("__r", reply_fields(replies))
    return out.withColumns({"reasoning": shorten(F.col("__r.reasoning"), limit), "output_model": F.col("__r.output_model"), "generation_ok": F.col("__r.ok")}).drop("__r")


def unfinished(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that the committed output lacks: resuming goes by key, not by counting lines."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def selected_for_generation(df: DataFrame, order: str, needed: Column, start: int = 0, limit: int | None = None) -> DataFrame:
    """All rows, with ``selected`` for those after the first ``start`` that need generation, at most ``limit`` of them; the others pass through."""
    placed = position(df, order).withColumn("__need", needed & (F.col("position") > start))
    if limit is None:
        return placed.withColumn("selected", F.col("__need")).drop("__need", "position", "total")
    wanted = placed.filter("__need").orderBy(order).limit(limit).agg(F.max(order).alias("last")).first()["last"]
    inside = F.col(order) <= F.lit(wanted) if wanted is not None else F.lit(False)
    return placed.withColumn("selected", F.col("__need") & inside).drop("__need", "position", "total")


#: Line numbers that are ranked together: what one task of a file sorts.
_LINES = 4096


def _running(df: DataFrame, file: str, order: str, tie: Sequence[str], flag: Column, out: str) -> DataFrame:
    """``df`` with ``out``: how many rows of its file have ``flag``, up to and with this one; a long file is counted in ranges of lines."""
    df = df.withColumns({"__bucket": F.coalesce(F.floor(F.col(order) / F.lit(_LINES)), F.lit(-1)), "__flag": F.coalesce(flag, F.lit(False)).cast("long")})
    counts = df.groupBy(file, "__bucket").agg(F.sum("__flag").alias("__n"))
    before = Window.partitionBy(file).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(file).alias("__file"), F.col("__bucket").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(file, "__bucket").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("__local", F.sum("__flag").over(inside)).join(starts, F.col(file).eqNullSafe(F.col("__file")) & (F.col("__bucket") == F.col("__at")))
    return joined.withColumn(out, F.col("__local") + F.col("__start")).drop("__bucket", "__flag", "__file", "__at", "__start", "__local")


def selected_per_file(df: DataFrame, file: str, order: str, needed: Column, start: int = 0, limit: int = 0, tie: Sequence[str] = ()) -> DataFrame:
    """All rows of all files, with ``selected``: in each file, in its ``order``, those after the first ``start`` that need generation, at most ``limit`` (0: all) of them."""
    df = df.withColumn("selected", F.coalesce(needed, F.lit(False)))
    if start > 0:
        df = _running(df, file, order, tie, F.lit(True), "__position").withColumn("selected", F.col("selected") & (F.col("__position") > start)).drop("__position")
    if limit > 0:
        df = _running(df, file, order, tie, F.col("selected"), "__taken").withColumn("selected", F.col("selected") & (F.col("__taken") <= limit)).drop("__taken")
    return df


def judged(df: DataFrame, fields: list[str], reference: str, judge: Callable[[list[str]], list[float]], default: float = 0.0) -> DataFrame:
    """``df`` with ``judge``: each distinct question to the judge is asked once and kept within 0 and 1; an empty reference and a question on which the judge fails give the default."""
    key = F.sha1(F.to_json(F.struct(*[sanitize(F.col(f)).alias(f) for f in [*fields, reference]])))
    keyed = df.withColumn("__key", key)
    asked = keyed.filter(sanitize(F.col(reference)) != "").dropDuplicates(["__key"]).select("__key", F.to_json(F.struct(*fields, reference)).alias("question"))

    @F.pandas_udf("double")
    def ask(s: pd.Series) -> pd.Series:
        def alone(q: str) -> float | None:
            try:
                return float(judge([q])[0])
            except Exception:
                return None

        try:
            return pd.Series([float(x) for x in judge(s.tolist())], index=s.index, dtype="float64")
        except Exception:  # one bad question fails alone
            return pd.Series([alone(q) for q in s], index=s.index, dtype="float64")

    verdict = ask("question")
    answers = asked.select("__key", verdict.alias("verdict")).select("__key", F.when(F.col("verdict").isNotNull() & ~F.isnan("verdict"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("verdict")))).alias("judge"))
    return keyed.join(answers, "__key", "left").withColumn("judge", F.coalesce("judge", F.lit(float(default)))).drop("__key")


def chat_url(address: str) -> str:
    """The completions address of a service: http where no scheme is given, the usual path where there is none."""
    address = (address or "").strip()
    if not address:
        raise ValueError("no address")
    if not address.startswith(("http://", "https://")):
        address = "http://" + address
    return address if urlparse(address).path.rstrip("/") else address.rstrip("/") + "/v1/chat/completions"
