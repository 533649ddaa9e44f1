"""Problem 7: passages of held-out items inside training texts.

Winnowing: of each window of w consecutive k-gram hashes the least is kept, so
every shared run of at least w + k - 1 characters leaves a kept hash in the
training text. All k-grams of the (smaller) held-out side are indexed, hits are
extended to the whole shared run, and runs of the required length count.

The index of held-out passages is broadcast only where its size is checked to
be below ``max_index_chars``; beyond that, fingerprints are joined by shuffle.
Both ways give the same result. Null and empty texts match nothing; an item
shorter than its required run can't leak. Rows without an id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm.plain import code_points, kgram_hashes, plain_form
from sieveworks.runtime import cut_lineage, table

#: Share of the required run that a k-gram takes; the window takes the rest.
GRAM_SHARE = 0.7
#: Held-out characters up to which the index is sent to all executors: about 20 bytes each.
MAX_INDEX_CHARS = 8_000_000
#: Most bits of the first, coarse look-up.
_COARSE = 22


def gram_and_window(run: int) -> tuple[int, int]:
    """k and w with k + w - 1 = ``run``: shared runs of ``run`` characters can't be missed."""
    k = max(1, min(run, int(run * GRAM_SHARE)))
    return k, run - k + 1


def _sliding(h: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """``f`` (minimum or maximum) over all windows of ``w``, by doubling."""
    n, width = len(h) - w + 1, 1
    while width * 2 <= w:
        h = f(h[:-width], h[width:])
        width *= 2
    return f(h[:n], h[w - width : w - width + n]) if width < w else h[:n]


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the hashes that are the least of some window; all of them if there is no whole window."""
    if len(h) <= w:
        return np.arange(len(h)) if len(h) < w else np.flatnonzero(h == h.min())
    low = _sliding(h, w, np.minimum)
    top = np.iinfo(np.uint64).max
    edge = np.zeros(w - 1, np.uint64)
    highest = _sliding(np.concatenate([edge, low, edge]), w, np.maximum)
    return np.flatnonzero((h == highest) & (h < top))


@dataclass
class Index:
    """Held-out passages of one required run: sorted k-gram hashes with item and position."""

    run: int
    k: int
    w: int
    items: np.ndarray
    plains: list[str]
    hashes: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    coarse: np.ndarray

    @classmethod
    def of(cls, passages: list[tuple[int, str]], run: int) -> Index:
        k, w = gram_and_window(run)
        kept = [(i, p) for i, p in passages if len(p) >= run]
        hs = [kgram_hashes(code_points(p), k) for _, p in kept]
        sizes = [len(h) for h in hs]
        hashes = np.concatenate(hs) if hs else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(kept), dtype=np.int32), sizes)
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if hs else np.empty(0, np.int32)
        order = np.argsort(hashes, kind="stable")
        bits = min(_COARSE, len(hashes).bit_length() + 4)
        coarse = np.zeros(1 << bits, bool)
        coarse[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
        return cls(run, k, w, np.array([i for i, _ in kept], np.int64), [p for _, p in kept], hashes[order], owner[order], at[order], coarse)

    def leaked(self, plain: str) -> set[int]:
        """Items that share a run of the required length with ``plain``."""
        if len(plain) < self.run or not len(self.hashes):
            return set()
        h = kgram_hashes(code_points(plain), self.k)
        where = winnow(h, self.w)
        bits = len(self.coarse).bit_length() - 1
        where = where[self.coarse[(h[where] >> np.uint64(64 - bits)).astype(np.int64)]]
        if not len(where):
            return set()
        start = np.searchsorted(self.hashes, h[where], "left")
        stop = np.searchsorted(self.hashes, h[where], "right")
        found: set[int] = set()
        tried: dict[tuple[int, int], int] = {}
        open_: dict[int, list[int]] = {}  # occurrences of a k-gram in items that aren't found yet
        for p, a, b in zip(where.tolist(), start.tolist(), stop.tolist()):
            if a == b:
                continue
            occurrences = open_.get(a)
            if occurrences is None:
                occurrences = list(range(a, b))
            before = len(found)
            for x in occurrences:
                owner, q = int(self.owner[x]), int(self.at[x])
                item = int(self.items[owner])
                if item in found or tried.get((owner, p - q), -1) >= p:
                    continue
                length, end = extend(plain, p, self.plains[owner], q, self.run)
                tried[owner, p - q] = end
                if length >= self.run:
                    found.add(item)
            if len(found) > before or a not in open_:
                open_[a] = [x for x in occurrences if int(self.items[self.owner[x]]) not in found]
        return found


def extend(a: str, i: int, b: str, j: int, enough: int) -> tuple[int, int]:
    """Length of the shared run through ``a[i]`` and ``b[j]``, at least up to ``enough``, and its end in ``a``; 0 if they differ there."""
    right = 0
    limit = min(len(a) - i, len(b) - j)
    while right < limit and a[i + right] == b[j + right]:
        right += 1
    left = 0
    limit = min(i, j)
    while left < limit and right + left < enough and a[i - left - 1] == b[j - left - 1]:
        left += 1
    return left + right, i + right


def _leaks_by_broadcast(docs: DataFrame, indexes: list[Index]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(indexes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                plain = plain_form(text)
                for index in held.value:
                    out.extend((doc, item) for item in index.leaked(plain))
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, item_id long").distinct()


#: Parts into which the documents of each fingerprint are split; items of a document that are compared in one block.
_PARTS, _BLOCK = 16, 256


def _leaks_by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Fingerprint join for held-out sides of any size; texts move only for documents and items that share a fingerprint: a document's once for each
    block of its items, a passage once for each document. A fingerprint of many documents is met in parts."""
    runs = [r["run"] for r in items.select("run").distinct().collect()]  # the required lengths: a handful

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, run, text in b[["item_id", "run", "passage"]].itertuples(index=False, name=None):
                plain = plain_form(text)
                if len(plain) >= run:
                    h = np.unique(kgram_hashes(code_points(plain), gram_and_window(run)[0]))
                    yield pd.DataFrame({"run": run, "fingerprint": h.astype(np.int64), "item_id": item})

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                plain = plain_form(text)
                for run in runs:
                    k, w = gram_and_window(run)
                    if len(plain) >= run:
                        h = kgram_hashes(code_points(plain), k)
                        yield pd.DataFrame({"run": run, "fingerprint": np.unique(h[winnow(h, w)]).astype(np.int64), "doc_id": doc})

    parts = F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part")
    index = items.mapInPandas(grams, "run int, fingerprint long, item_id long").distinct().select("*", parts)
    marks = docs.select("doc_id", "text").mapInPandas(prints, "run int, fingerprint long, doc_id long")
    marks = marks.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)).cast("int"))
    pairs = cut_lineage(marks.join(index, ["run", "fingerprint", "part"]).select("run", "doc_id", "item_id").distinct())
    blocks = pairs.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    own = docs.join(blocks, "doc_id").select("doc_id", each, F.lit(True).alias("own"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("run"), "text")
    placed = pairs.join(blocks, "doc_id").withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("blocks")))
    held = placed.join(items.select("run", "item_id", "passage"), ["run", "item_id"]).select("doc_id", "block", F.lit(False).alias("own"), "item_id", "run", F.col("passage").alias("text"))
    met = own.unionAll(held).repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", F.desc("own"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc_plains: list[str] = []
        before, in_own = None, False
        for b in batches:
            out = []
            for doc, block, is_own, item, run, text in b[["doc_id", "block", "own", "item_id", "run", "text"]].itertuples(index=False, name=None):
                if is_own:  # a reused id may have several texts
                    if not in_own or before != (doc, block):
                        doc_plains = []
                    doc_plains.append(plain_form(text))
                elif doc_plains:
                    index = Index.of([(item, plain_form(text))], run)
                    if any(index.leaked(t) for t in doc_plains):
                        out.append((doc, item))
                before, in_own = (doc, block), is_own
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return met.mapInPandas(check, "doc_id long, item_id long").distinct()


def leaked_passages(docs: DataFrame, items: DataFrame, max_index_chars: int = MAX_INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id) of documents (doc_id, text) and items (item_id, passage, run) that share a run of ``run`` characters of plain form."""
    items = items.select("item_id", "passage", F.col("run").cast("int").alias("run")).filter("item_id is not null and passage is not null")
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("n")).first()["n"]
    if size > max_index_chars:
        return _leaks_by_join(docs, items)
    rows = items.collect()  # checked to be small just above
    by_run: dict[int, list[tuple[int, str]]] = {}
    for r in rows:
        by_run.setdefault(r["run"], []).append((r["item_id"], plain_form(r["passage"])))
    return _leaks_by_broadcast(docs, [Index.of(ps, run) for run, ps in sorted(by_run.items())])


def held_out(spark: SparkSession, d: str) -> DataFrame:
    """Items of both benchmarks with their passage and the run that counts as a leak: 80 characters, for the shorter items 28."""
    legal = table(spark, d, "legalbench_item").select("item_id", F.coalesce("contract", "text", "policy", "question").alias("passage"), F.lit(80).alias("run"))
    law = table(spark, d, "lawbench_item").select("item_id", F.col("question").alias("passage"), F.lit(28).alias("run"))
    return legal.unionByName(law)
