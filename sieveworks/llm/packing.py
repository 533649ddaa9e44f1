"""Problem 6: texts of varying length into containers of fixed capacity.

Shortest-pack-first over the histogram of lengths: lengths are placed longest
first, each into the pattern that it fills exactly or else the one with the most
space left, and whole groups of equal patterns are moved at once by updating their
counts. The patterns are then joined back to the documents by their rank among
those of equal length.

A text is split only if it alone exceeds the capacity: into full containers
and a remainder that is packed like any text. Null and empty texts have no
tokens; they go to container 0 as they need no space; rows without a doc_id are
left out. Only the histogram, with
at most ``capacity`` lengths, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveworks.llm.tokens import Vocabulary
from sieveworks.runtime import cut_lineage


@dataclass(frozen=True)
class Pattern:
    """``count`` containers, each with these (length, how many) items, longest first."""

    count: int
    items: tuple[tuple[int, int], ...]

    @property
    def used(self) -> int:
        return sum(n * k for n, k in self.items)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Shortest-pack-first: {length: how many} to patterns that hold each item once."""
    # open patterns by space left: space -> {items: count}; the shortest pack has the most space
    space: dict[int, dict[tuple[int, ...], int]] = {}
    top = -1  # no pattern has more space than this

    def add(left: int, items: tuple[int, ...], count: int) -> None:
        nonlocal top
        row = space.setdefault(left, {})
        row[items] = row.get(items, 0) + count
        top = max(top, left)

    for length in sorted((n for n, c in histogram.items() if n > 0 and c > 0), reverse=True):
        todo = histogram[length]
        while todo:
            while top >= 0 and not space.get(top):
                top -= 1
            if top >= length:
                left = length if space.get(length) else top  # a pack that this length fills comes before the shortest
                row = space[left]
                items, count = next(iter(row.items()))
                times = min(left // length, max(1, -(-todo // count)))  # as many as each pack takes, if there are enough
                packs = min(count, max(1, todo // times))
                if packs * times > todo:
                    times = 1
                    packs = min(count, todo)
                del row[items]
                if packs < count:
                    row[items] = count - packs
                add(left - times * length, (*items, *[length] * times), packs)
                todo -= packs * times
            else:
                times = min(capacity // length, todo)
                packs = max(1, todo // times)
                add(capacity - times * length, (length,) * times, packs)
                todo -= packs * times
    out: dict[tuple[tuple[int, int], ...], int] = {}
    for row in space.values():
        for items, count in row.items():
            runs: dict[int, int] = {}
            for n in items:
                runs[n] = runs.get(n, 0) + 1
            key = tuple(sorted(runs.items(), reverse=True))
            out[key] = out.get(key, 0) + count
    return [Pattern(c, k) for k, c in sorted(out.items(), reverse=True)]


@dataclass(frozen=True)
class Slots:
    """Where the r-th item of each length goes: sorted by (length, first rank)."""

    capacity: int
    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    container: np.ndarray
    offset: np.ndarray
    n_containers: int

    @classmethod
    def of(cls, patterns: list[Pattern], capacity: int) -> Slots:
        rows, used, at = [], {}, 1  # container 0 holds what needs no space
        for p in patterns:
            offset = 0
            for n, k in p.items:
                rows.append((n, used.get(n, 0), k, at, offset))
                used[n] = used.get(n, 0) + k * p.count
                offset += n * k
            at += p.count
        rows.sort()
        columns = [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.empty(0, np.int64)] * 5
        return cls(capacity, *columns, n_containers=at - 1)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Container and offset of items by length and rank (from 0) among those of equal length."""
        big = int(self.first.max(initial=0)) + int(rank.max(initial=0)) + 2
        slot = np.searchsorted(self.length * big + self.first, length * big + rank, "right") - 1
        within = rank - self.first[slot]
        return self.container[slot] + within // self.per[slot], self.offset[slot] + within % self.per[slot] * length


def document_lengths(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens), one row per document."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = held.value.counter()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": count([t or "" for t in b["text"]])})

    return df.select("doc_id", "text").filter("doc_id is not null").mapInPandas(run, "doc_id long, n_tokens long").dropDuplicates(["doc_id"])


def _ranked(items: DataFrame, bucket_rows: int) -> DataFrame:
    """``items`` with ``rank`` from 0 within (capacity_id, item), in buckets so that a hot length is no single task."""
    sizes = items.groupBy("capacity_id", "item").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.select("capacity_id", "item", F.ceil(F.col("n") / bucket_rows).cast("int").alias("buckets"))
    spread = items.join(F.broadcast(buckets), ["capacity_id", "item"])  # at most one row per capacity and length up to it
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    counts = spread.groupBy("capacity_id", "item", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("capacity_id", "item").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("capacity_id", "item", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("capacity_id", "item", "bucket").orderBy("doc_id")
    ranked = spread.withColumn("place", F.row_number().over(inside) - 1).join(starts, ["capacity_id", "item", "bucket"])
    return ranked.withColumn("rank", F.col("place") + F.col("start")).drop("place", "start", "bucket", "buckets")


def pack_documents(lengths: DataFrame, capacities: DataFrame, bucket_rows: int = 200_000) -> DataFrame:
    """(capacity_id, container_id, doc_id, piece, n_tokens, start): each piece of each document in its container.

    ``piece`` counts from 0; ``start`` is the piece's first token within the
    container. Duplicate or non-positive capacities are no containers and raise.
    """
    spark = lengths.sparkSession
    caps = {r["capacity_id"]: r["capacity_tokens"] for r in capacities.select("capacity_id", "capacity_tokens").distinct().collect()}  # the containers' kinds: a handful
    if any(c is None or c <= 0 for c in caps.values()):
        raise ValueError("capacities must be positive")
    if not caps:
        return spark.createDataFrame([], _PACKED)
    lengths = cut_lineage(lengths)
    kinds = F.array(*[F.struct(F.lit(i).cast("long").alias("capacity_id"), F.lit(c).cast("long").alias("capacity")) for i, c in sorted(caps.items())])
    each = lengths.select("doc_id", "n_tokens", F.inline(kinds))
    each = each.withColumn("whole", F.floor(F.col("n_tokens") / F.col("capacity"))).withColumn("item", F.col("n_tokens") % F.col("capacity"))
    # a text of just the capacity is an item of its own, not a piece
    exact = (F.col("item") == 0) & (F.col("whole") > 0)
    each = each.withColumns({"item": F.when(exact, F.col("capacity")).otherwise(F.col("item")), "whole": F.when(exact, F.col("whole") - 1).otherwise(F.col("whole"))})
    histogram: dict[int, dict[int, int]] = {i: {} for i in caps}
    for r in each.filter("item > 0").groupBy("capacity_id", "item").count().collect():  # at most `capacity` rows for each capacity
        histogram[r["capacity_id"]][r["item"]] = r["count"]
    slots = {i: Slots.of(pack_histogram(h, caps[i]), caps[i]) for i, h in histogram.items()}
    held = spark.sparkContext.broadcast(slots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, g in b.groupby("capacity_id"):
                container, start = held.value[int(i)].place(g["item"].to_numpy(), g["rank"].to_numpy())
                yield pd.DataFrame(
                    {"capacity_id": g["capacity_id"], "container_id": container, "doc_id": g["doc_id"], "piece": g["whole"], "n_tokens": g["item"], "start": start}
                )

    items = _ranked(each.filter("item > 0").select("capacity_id", "item", "doc_id", "whole"), bucket_rows).mapInPandas(place, _PACKED)
    # full containers of texts that exceed the capacity: numbered after the packed ones, in buckets of documents
    buckets = max(1024, lengths.count() // bucket_rows)
    over = each.filter("whole > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = over.groupBy("capacity_id", "bucket").agg(F.sum("whole").alias("n"))
    before = Window.partitionBy("capacity_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("capacity_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("capacity_id", "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    packed = F.create_map(*[x for i, s in slots.items() for x in (F.lit(i).cast("long"), F.lit(s.n_containers).cast("long"))])
    full = (
        over.withColumn("own", F.coalesce(F.sum("whole").over(inside), F.lit(0)))
        .join(starts, ["capacity_id", "bucket"])
        .select("capacity_id", "doc_id", "capacity", (packed[F.col("capacity_id")] + F.col("base") + F.col("own") + 1).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"))
        .select("capacity_id", (F.col("first") + F.col("piece")).alias("container_id"), "doc_id", "piece", F.col("capacity").alias("n_tokens"), F.lit(0).cast("long").alias("start"))
    )
    none = each.filter("item = 0").select(
        "capacity_id", F.lit(0).cast("long").alias("container_id"), "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("start")
    )
    return items.unionByName(full).unionByName(none)


_PACKED = "capacity_id long, container_id long, doc_id long, piece long, n_tokens long, start long"


def container_fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers with something in them, tokens, and the share of the space that is used."""
    per = packed.filter("n_tokens > 0").groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    out = per.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return out.join(capacities.select("capacity_id", "capacity_tokens").distinct(), "capacity_id").withColumn(
        "filled", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))
    )
