"""MinHash bands and first-wins near-duplicate removal in the order of the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.runtime import cut_lineage

#: The prime of the permutations and the multipliers of an n-gram's code points.
PRIME = (1 << 31) - 1
GRAM_BASE = 1_048_583


def band_shape(threshold: float, permutations: int = 128) -> tuple[int, int]:
    """Bands and rows whose chances of a false and of a missed candidate, summed over all similarities, are least."""
    x = (np.arange(1000) + 0.5) / 1000
    low = x < threshold
    best = (np.inf, 1, 1)
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            met = 1 - (1 - x**r) ** b
            error = float(np.where(low, met, 1 - met).sum())
            if error < best[0]:
                best = (error, b, r)
    return best[1], best[2]


@cache
def _permutations(seed: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, k, dtype=np.int64), rng.integers(0, PRIME, k, dtype=np.int64)


@dataclass(frozen=True)
class MinHash:
    """Bands of minima of permuted n-gram hashes; a text shorter than n is its own gram."""

    n: int = 3
    bands: int = 37
    rows: int = 3
    seed: int = 1

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        return _permutations(self.seed, self.bands * self.rows)

    def gram_hashes(self, text: str) -> np.ndarray:
        """Each n-gram's code points as digits to the base GRAM_BASE, modulo PRIME."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = min(self.n, len(c))
        h = np.zeros(len(c) - n + 1, np.int64)
        for i in range(n):
            h = (h * GRAM_BASE + c[i : i + len(h)]) % PRIME
        return np.unique(h)

    def signature(self, text: str) -> np.ndarray:
        a, b = self.permutations()
        h = self.gram_hashes(text)
        least = np.full(len(a), PRIME, np.int64)
        for at in range(0, len(h), 1024):
            np.minimum(least, ((a[:, None] * h[None, at : at + 1024] + b[:, None]) % PRIME).min(axis=1), out=least)
        return least

    def band_keys(self, text: str) -> np.ndarray:
        s = self.signature(text).reshape(self.bands, self.rows)
        out = np.zeros(self.bands, np.int64)
        for i in range(self.rows):
            out = (out * GRAM_BASE + s[:, i]) % PRIME
        return out


def banded(df: DataFrame, key: str, text: str, shape: MinHash = MinHash()) -> DataFrame:
    """(key, band, bucket) for each band of each non-blank text; null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, parts = [], []
            for k, t in zip(b["key"], b["text"]):
                if t and t.strip():
                    ids.append(k)
                    parts.append(shape.band_keys(t))
            n = len(ids)
            yield pd.DataFrame(
                {"key": np.repeat(np.array(ids, np.int64), shape.bands), "band": np.tile(np.arange(shape.bands, dtype=np.int32), n), "bucket": np.concatenate(parts) if n else np.empty(0, np.int64)}
            )

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, band int, bucket long")


#: Band rows (20 bytes each) that are scanned in order by one task.
SCANNED = 2_000_000


def _scan(met: DataFrame) -> DataFrame:
    """The keys that a scan in their order keeps, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set[tuple[int, int]] = set()
        key, own, kept = None, [], []

        def decide() -> None:
            if own and taken.isdisjoint(own):
                kept.append(key)
                taken.update(own)

        for b in batches:
            for k, band, bucket in zip(b["key"].tolist(), b["band"].tolist(), b["bucket"].tolist()):
                if k != key:
                    decide()
                    key, own = k, []
                own.append((band, bucket))
        decide()
        yield pd.DataFrame({"key": np.array(kept, np.int64)})

    return met.select("key", "band", "bucket").repartition(1).sortWithinPartitions("key").mapInPandas(run, "key long")


def first_wins(df: DataFrame, key: str, text: str, shape: MinHash = MinHash(), scanned: int = SCANNED) -> DataFrame:
    """The keys that a scan in the order of a unique number ``key`` would keep: each row that meets no row kept before it in any band.

    Rounds over the band table, without pairs: an undecided row that is the
    least undecided of all its buckets is kept; then rows that share a bucket
    with a kept one are dropped. Once at most ``scanned`` band rows are
    undecided, one task scans them in order. Buckets are reduced to their least
    key before anything is joined. Null and blank texts are skipped, as they
    were never candidates. Rows with equal text are first reduced to the least.
    """
    texts = df.filter(F.trim(F.col(text)) != "").groupBy(F.sha2(F.col(text), 256).alias("content")).agg(F.min(key).alias(key)).select(key)  # later copies meet the first in every band
    rows = banded(df.join(texts, key, "left_semi"), key, text, shape)
    crowded = rows.groupBy("band", "bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("band", "bucket")
    met = cut_lineage(rows.join(crowded, ["band", "bucket"], "left_semi"))
    kept = texts.withColumnRenamed(key, "key").join(met.select("key").distinct(), "key", "left_anti")
    while met.count() > scanned:
        least = met.groupBy("band", "bucket").agg(F.min("key").alias("least"))
        state = met.join(least, ["band", "bucket"])
        wins = state.groupBy("key").agg(F.bool_and(F.col("key") == F.col("least")).alias("first")).filter("first").select("key")
        wins = cut_lineage(wins)  # never empty: the least key of all is in it
        kept = kept.unionByName(wins)
        taken = met.join(wins, "key", "left_semi").select("band", "bucket").distinct()
        gone = met.join(taken, ["band", "bucket"], "left_semi").select("key").distinct()  # the winners and all that meet them
        met = cut_lineage(met.join(gone, "key", "left_anti"))
    return kept.unionByName(_scan(met)).withColumnRenamed("key", key)
