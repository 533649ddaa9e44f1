"""Problem 4: tokens per document under an existing tokenizer, and their totals.

A ledger is a table in a shared folder that holds the token count of each
(content, tokenizer). Only contents the ledger lacks are encoded and appended;
counts are read back from it. Cubes of totals follow the documents by signed
deltas, so that changed and removed documents are taken out again.

Null texts have 0 tokens. A record delivered twice counts once; rows without an
id are left out.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.runtime import checkpoint_dir, cut_lineage

#: Fixed value: the pattern that splits text before the merges of rank files, as the public vocabularies state it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer's file, read on the driver (about a megabyte) and sent to the executors, which needn't have it."""

    kind: str
    content: bytes

    @classmethod
    def read(cls, path: str = DEFAULT_VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(path.rsplit(".", 1)[-1], f.read())

    @property
    def key(self) -> str:
        """Names the tokenizer in a ledger: changes with the file's content."""
        return xxhash.xxh3_128_hexdigest(self.kind.encode() + b"\0" + self.content + PATTERN.encode())

    def counter(self) -> Callable[[list[str]], list[int]]:
        """Token counts of a list of texts; built once in a worker."""
        if (known := _LOADED.get(self.key)) is None:
            known = _LOADED[self.key] = self._build()
        return known

    def _build(self) -> Callable[[list[str]], list[int]]:
        if self.kind == "tiktoken":
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.content.splitlines())}
            encoding = tiktoken.Encoding(self.key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
        if self.kind == "json":
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(self.content.decode())
            tokenizer.encode_special_tokens = True
            return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=self.content)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def content_key(text: Column) -> Column:
    """128 bits of a content, as bytes; null for null."""
    return F.unhex(F.md5(text))


#: Contents that a task remembers, not to encode a copy again; then it forgets them all.
REMEMBERED = 1_000_000


def encode_counts(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(content, text) to (content, n_tokens); a content that a task has just seen is not encoded again."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, seen = held.value.counter(), set()
        for b in batches:
            fresh, texts = [], []
            for key, text in zip(b["content"], b["text"]):
                key = bytes(key)
                if key not in seen:
                    seen.add(key)
                    fresh.append(key)
                    texts.append(text)
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pd.DataFrame({"content": fresh, "n_tokens": count(texts)})

    return df.mapInPandas(run, "content binary, n_tokens long")


#: Unseen contents (16 bytes each) that are named to all tasks at once; more are joined by shuffle.
MAX_NAMED = 1_000_000


class Ledger:
    """Token counts by content and tokenizer, kept as a Parquet table in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @classmethod
    def new(cls, spark: SparkSession) -> Ledger:
        """An empty one in the shared folder of the session."""
        return cls(spark, f"{checkpoint_dir(spark)}/sieveworks_ledger_{uuid.uuid4().hex}")

    def _path(self, vocabulary: Vocabulary) -> str:
        return f"{self.folder}/tokenizer={vocabulary.key}"

    def counts(self, vocabulary: Vocabulary) -> DataFrame | None:
        """(content, n_tokens), one row per content; None before the first ``add``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(vocabulary))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("content binary, n_tokens long").parquet(self._path(vocabulary))

    def add(self, contents: DataFrame, vocabulary: Vocabulary) -> None:
        """Encodes and appends those of (content, text) that the ledger lacks. Of a few unseen contents only the texts are moved; many are found by a shuffle."""
        known = self.counts(vocabulary)
        if known is not None:
            unseen = cut_lineage(contents.select("content").distinct().join(known, "content", "left_anti"))
            n = unseen.count()
            if n == 0:
                return
            contents = contents.join(F.broadcast(unseen) if n <= MAX_NAMED else unseen, "content", "left_semi")
        fresh = encode_counts(contents.select("content", "text"), vocabulary).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        fresh.write.mode("append").parquet(self._path(vocabulary))


def long_form(df: DataFrame, fields: Sequence[str], *keep: Column | str) -> DataFrame:
    """One row per record and non-null field: kept columns, field, content, text."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), content_key(F.col(f)).alias("content"), F.col(f).alias("text")) for f in fields])
    return df.select(*keep, F.inline(F.filter(parts, lambda x: x["text"].isNotNull())))


#: A content of this share of all contents is hot: there are at most so many of them, and they needn't be shuffled.
HOT = 1000


def record_tokens(df: DataFrame, fields: Sequence[str], rid: str, dims: dict[str, Column], vocabulary: Vocabulary, ledger: Ledger) -> DataFrame:
    """One row per record: ``rid``, the dims, and the tokens of each field and in all. What the ledger lacks is encoded and added first; all counts are read from it."""
    df = df.filter(F.col(rid).isNotNull())
    ledger.add(long_form(df, fields).select("content", "text"), vocabulary)
    counts = ledger.counts(vocabulary)
    base = df.select(F.col(rid), *[c.alias(n) for n, c in dims.items()], *[content_key(F.col(f)).alias(f"{f}_key") for f in fields])
    base = cut_lineage(base.dropDuplicates([rid]))  # keys, no texts
    parts = base.select(rid, F.inline(F.filter(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"{f}_key").alias("content")) for i, f in enumerate(fields)]), lambda x: x["content"].isNotNull())))
    least = max(HOT, base.count() * len(fields) // HOT)
    hot = parts.groupBy("content").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= least)  # at most HOT rows
    hot = hot.join(counts, "content").select("content", F.col("n_tokens").alias("hot_tokens"))
    parts = parts.join(F.broadcast(hot), "content", "left")
    # a hot content's rows are spread by keys that the ledger has not
    spread = F.when(F.col("hot_tokens").isNull(), F.col("content")).otherwise(F.concat(F.lit("hot").cast("binary"), F.col(rid).cast("string").cast("binary")))
    met = parts.withColumn("content", spread).join(counts, "content", "left").withColumn("n", F.coalesce("hot_tokens", "n_tokens"))
    per = met.groupBy(rid).agg(*[F.sum(F.when(F.col("field") == i, F.col("n"))).alias(f"{f}_tokens") for i, f in enumerate(fields)])
    counted = base.drop(*[f"{f}_key" for f in fields]).join(per, rid, "left").fillna(0, [f"{f}_tokens" for f in fields])
    total = sum((F.col(f"{f}_tokens") for f in fields), F.lit(0))
    return counted.withColumn("total_tokens", total.cast("long"))


def token_cube(counted: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Totals for every combination of the dims; ``level`` tells which are summed over (as grouping_id)."""
    sums = [F.sum(m).alias(m) for m in measures]
    return counted.cube(*dims).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_records"), *sums)


def cube_deltas(before: DataFrame, after: DataFrame, rid: str, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Signed cube of the change between two states of (rid, dims, measures): unchanged records cancel before anything is summed."""
    columns = [rid, *dims, *measures]
    signed = after.select(*columns, F.lit(1).alias("sign")).unionByName(before.select(*columns, F.lit(-1).alias("sign")))
    changed = signed.groupBy(*columns).agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    weighted = changed.select(*dims, "sign", *[(F.col(m) * F.col("sign")).alias(m) for m in measures])
    return weighted.cube(*dims).agg(F.grouping_id().alias("level"), F.sum("sign").alias("n_records"), *[F.sum(m).alias(m) for m in measures])


def apply_deltas(cube: DataFrame, deltas: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The cube after the change; cells without records are gone."""
    both = cube.unionByName(deltas)
    sums = [F.sum(m).alias(m) for m in ("n_records", *measures)]
    return both.groupBy(*dims, "level").agg(*sums).filter("n_records <> 0")
