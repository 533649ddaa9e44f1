"""Problem 5: groups of records whose texts share most of their content.

The texts' character shingles are kept as SetSketch registers: truncated
minima on an exponential scale, mergeable, and equal for two sets with a
probability close to their Jaccard similarity. Bands of registers give the
candidates, the joint likelihood of the registers estimates each candidate's
similarity, and an exact comparison of the shingle sets decides.

Equal plain forms are one class, named by 128 bits of hash, before any pair is
made, so that a hot group of copies costs one representative. The texts are read
once to be sketched; candidates are then told apart by their registers, and only
texts of the pairs left over are read again and moved. Groups that share a band,
classes with many partners and classes of many copies are met in blocks, so that
none of them is one task. Null and short texts (fewer than ``min_chars`` in plain
form) take no part, nor do rows without an id.

The registers come from one 32-bit hash of each shingle by odd multipliers, a
cheap family that is not independent: ``tests`` measure the shares of equal
registers and of met bands against the exact similarity on random text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveworks.llm.plain import code_points, kgram_hashes, kgram_hashes_of, mix64, plain_form
from sieveworks.runtime import cut_lineage


@dataclass(frozen=True)
class SketchParams:
    """``bands`` x ``rows`` registers; ``base`` and ``rate`` are SetSketch's b and a, ``top`` its q + 1."""

    shingle: int = 5
    threshold: float = 0.6
    min_chars: int = 80
    bands: int = 50
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    top: int = 65535
    seed: int = 7
    #: Standard deviations by which an estimate may lie below the threshold.
    slack: float = 4.0
    #: Parities of registers that a band row carries, for a first look at candidates: two words of 64.
    parities: int = 128
    #: Registers kept of each class, by which the likelihood estimates a candidate.
    estimating: int = 64

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def most_unlike(self) -> int:
        """Parities in which a pair at the threshold may differ: those of unequal registers differ half the time."""
        half = (1.0 - self.threshold) / 2
        return int(self.parities * half + self.slack * (self.parities * half * (1 - half)) ** 0.5)


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    h = np.sort(hashes)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_hashes(plain: str, k: int) -> np.ndarray:
    """The distinct shingles of a plain form as sorted 64-bit hashes."""
    return _distinct(kgram_hashes(code_points(plain), k))


def _multipliers(p: SketchParams) -> np.ndarray:
    rng = np.random.default_rng(p.seed)
    return rng.integers(0, 2**32, p.registers, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


#: Shingles that are sketched together.
_SKETCHED_TOGETHER = 1 << 16


def set_sketches(sets: Sequence[np.ndarray], p: SketchParams) -> np.ndarray:
    """Registers of each set of hashes (repeats don't matter): floor(1 - log_b(min over elements of Exp(rate)))), within 0 and ``top``; 0 for an empty set."""
    m = _multipliers(p)
    out = np.zeros((len(sets), len(m)), np.uint16)
    full = [i for i, h in enumerate(sets) if len(h)]
    at = 0
    while at < len(full):
        end, n = at, 0
        while end < len(full) and (end == at or n + len(sets[full[end]]) <= _SKETCHED_TOGETHER):
            n += len(sets[full[end]])
            end += 1
        group = [(sets[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32) for i in full[at:end]]  # mixed already, so that an odd multiplier permutes it well enough
        low, starts = np.concatenate(group), np.concatenate([[0], np.cumsum([len(g) for g in group])[:-1]])
        product, least = np.empty_like(low), np.empty((len(m), len(group)), np.uint32)
        for r, x in enumerate(m):  # long runs, so that both steps go by vectors
            np.multiply(low, x, out=product)
            np.minimum.reduceat(product, starts, out=least[r])
        out[full[at:end]] = _to_registers(least.T, p)
        at = end
    return out


def set_sketch(hashes: np.ndarray, p: SketchParams) -> np.ndarray:
    return set_sketches([hashes], p)[0]


def _to_registers(least: np.ndarray, p: SketchParams) -> np.ndarray:
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    x = -np.log1p(-u) / p.rate
    k = np.floor(1.0 - np.log(x) / np.log(p.base))
    return np.clip(k, 0, p.top).astype(np.uint16)


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def band_hashes(registers: np.ndarray, p: SketchParams) -> np.ndarray:
    """One hash for each band of register values; for one set or a matrix of them."""
    r = registers.reshape(*registers.shape[:-1], p.bands, p.rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), r.shape[:-1])
    with np.errstate(over="ignore"):
        for i in range(p.rows):
            h = (h ^ r[..., i]) * np.uint64(0xD6E8FEB86659FD93)
            h = h ^ (h >> np.uint64(32))
    return mix64(h)


def parity_bits(registers: np.ndarray, p: SketchParams) -> np.ndarray:
    """The last bits of the first registers, 64 to an integer: unequal registers agree in it half the time."""
    bits = (registers[..., : p.parities] & np.uint16(1)).astype(np.uint8)
    return np.packbits(bits, axis=-1, bitorder="little").view(np.int64)


def joint_estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, p: SketchParams, steps: int = 100) -> np.ndarray:
    """For each row of registers the Jaccard similarity that makes them likeliest, given the sizes of both sets."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    j = np.minimum(u / v, v / u) * np.linspace(0.0, 1.0, steps + 1)
    scale = (p.base - 1.0) / p.base

    def prob(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0.0, None) * scale) / np.log(p.base), 1e-12, 1.0)

    up, down = prob(u - v * j), prob(v - u * j)
    level = np.clip(1.0 - up - down, 1e-12, 1.0)
    best = np.argmax(more * np.log(up) + less * np.log(down) + same * np.log(level), axis=1)
    return j[np.arange(len(j)), best]


def exact_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _text_key(plain: str) -> tuple[int, int]:
    """128 bits of a text, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(plain.encode("utf-8", "surrogatepass"))
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


#: Keys of texts that a task remembers, not to sketch a copy again; then it forgets them all.
REMEMBERED = 1_000_000
#: Rows of a group that meet in one block.
BLOCK = 256

#: Band rows (about 15 bytes in a shuffle) of a task.
TASK_ROWS = 500_000

_SKETCHED = "record_id long, c1 long, c2 long, grams int, even long, odd long, registers binary, bands array<int>"


def sketched(df: DataFrame, rid: Column, text: Column, p: SketchParams = SketchParams()) -> DataFrame:
    """One row per row that takes part: record_id, the key (c1, c2) of its class of equal plain forms, and, unless the task
    has just seen that class, the number of its shingles, parities, first registers, and band hashes. The only pass over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            rows, fresh = [], []
            for rid, t in zip(b["record_id"], b["text"]):
                plain = plain_form(t)
                if len(plain) < p.min_chars:
                    continue
                key = _text_key(plain)
                rows.append((rid, *key, -1 if key in seen else len(fresh)))
                if key not in seen:
                    seen.add(key)
                    fresh.append(plain)
            if len(seen) > REMEMBERED:
                seen.clear()
            out = pd.DataFrame(rows, columns=["record_id", "c1", "c2", "at"])
            sets = [_distinct(h) for h in kgram_hashes_of(fresh, p.shingle)]
            matrix = set_sketches(sets, p)
            parity, bands = parity_bits(matrix, p), (band_hashes(matrix, p) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            at = out.pop("at").to_numpy()
            new = at >= 0
            for name, column in (("grams", [len(x) for x in sets]), ("even", parity[:, 0]), ("odd", parity[:, 1])):
                out[name] = pd.array([None] * len(out), "Int64")
                out.loc[new, name] = column
            out["registers"] = [matrix[i, : p.estimating].tobytes() if i >= 0 else None for i in at]
            out["bands"] = [bands[i] if i >= 0 else None for i in at]
            yield out

    picked = df.select(rid.alias("record_id"), text.alias("text")).filter("record_id is not null and text is not null")
    return picked.mapInPandas(run, _SKETCHED)


def candidate_pairs(sketches: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:
    """Distinct pairs a1 < b1 of classes (by their first word) that agree in a band and are not too unlike in their parities.

    A band's key is its number and 32 bits of hash. Band rows are shuffled once;
    keys that only one class has are dropped there, and the rest meets in blocks
    of BLOCK, whatever the size of a key's group.
    """
    rows = sketches.filter("bands is not null").select("c1", F.posexplode("bands").alias("band", "hash"))
    key = F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("hash").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    tasks = max(int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")), sketches.filter("bands is not null").count() * p.bands // TASK_ROWS)
    rows = rows.select(key.alias("key"), "c1").repartition(tasks, "key")
    shared = rows.groupBy("key").agg(F.min("c1").alias("low"), F.max("c1").alias("high")).filter("low <> high").select("key")
    rows = rows.join(shared.hint("shuffle_hash"), "key", "left_semi")
    ordered = Window.partitionBy("key").orderBy("c1")
    rows = rows.withColumn("fresh", F.coalesce(F.lag("c1").over(ordered) != F.col("c1"), F.lit(True)).cast("int"))
    rows = rows.withColumn("rank", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("n", F.max("rank").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = lambda c: F.floor((F.col(c) - 1) / BLOCK).cast("int")
    placed = rows.filter("fresh = 1").select("key", "c1", at("rank").alias("block"), at("n").alias("last"))
    looks = sketches.filter("bands is not null").select("c1", "even", "odd").dropDuplicates(["c1"])
    other = F.explode(F.sequence(F.lit(0), "last"))  # one meeting with each block of the group
    met = placed.join(looks, "c1").select("key", "c1", "even", "odd", "block", other.alias("other"))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c1", "even", "odd").repartition("key", "i", "j")
    a, b = met.alias("a"), met.alias("b")
    together = (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    apart = (F.col("a.c1") < F.col("b.c1")) & (F.col("a.block") == F.col("a.i")) & (F.col("b.block") == F.col("b.j"))
    unlike = F.bit_count(F.col("a.even").bitwiseXOR(F.col("b.even"))) + F.bit_count(F.col("a.odd").bitwiseXOR(F.col("b.odd")))
    return a.join(b, together & apart & (unlike <= p.most_unlike)).select(F.col("a.c1").alias("a1"), F.col("b.c1").alias("b1")).distinct()


#: Classes or texts to be fetched that are named to all tasks at once (8 and about 70 bytes each); more are joined by shuffle.
MAX_NAMED = 1_000_000


def likely_pairs(sketches: DataFrame, pairs: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:
    """(a1, a2, b1, b2): the candidates whose registers don't rule the threshold out, by the joint likelihood."""
    wanted = pairs.select(F.col("a1").alias("c1")).unionAll(pairs.select("b1")).distinct()
    named = F.broadcast(wanted) if 2 * pairs.count() <= MAX_NAMED else wanted  # else registers of all classes are moved
    known = sketches.filter("registers is not null").select("c1", "c2", "grams", "registers").join(named, "c1", "left_semi").dropDuplicates(["c1", "c2"])
    left = known.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("grams").alias("na"), F.col("registers").alias("ra"))
    right = known.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("grams").alias("nb"), F.col("registers").alias("rb"))
    joined = pairs.join(left, "a1").join(right, "b1").select("a1", "a2", "b1", "b2", "na", "nb", "ra", "rb")
    floor = p.threshold - p.slack * float(np.sqrt(p.threshold * (1 - p.threshold) / p.estimating))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ra, rb = (np.frombuffer(b"".join(b[c]), np.uint16).reshape(len(b), p.estimating) for c in ("ra", "rb"))
                na, nb = b["na"].to_numpy(np.float64), b["nb"].to_numpy(np.float64)
                near = np.minimum(na, nb) >= p.threshold * np.maximum(na, nb)
                near[near] = joint_estimates(ra[near], rb[near], na[near], nb[near], p) >= floor
                yield b.loc[near, ["a1", "a2", "b1", "b2"]]

    return joined.mapInPandas(run, "a1 long, a2 long, b1 long, b2 long")


def similar_classes(df: DataFrame, rid: Column, text: Column, sketches: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:
    """(a1, a2, b1, b2, similarity): the pairs of classes that reach the threshold, from the sketches of ``df``.

    Of a class with a likely partner one member's text is read again. A class
    meets its partners in blocks: its text goes once to each block, a partner's
    text once to each pair.
    """
    pairs = cut_lineage(likely_pairs(sketches, cut_lineage(candidate_pairs(sketches, p)), p))
    partners = pairs.groupBy("a1", "a2").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    none = F.lit(0).cast("long")
    own = partners.select("a1", "a2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("own"), none.alias("b1"), none.alias("b2"))
    others = pairs.join(partners, ["a1", "a2"]).select("a1", "a2", F.pmod(F.xxhash64("b1"), F.col("blocks")).alias("block"), F.lit(False).alias("own"), "b1", "b2")
    pick = lambda x: F.when(F.col("own"), F.col(f"a{x}")).otherwise(F.col(f"b{x}")).alias(f"c{x}")
    roles = own.unionAll(others).select("a1", "a2", "block", "own", "b1", "b2", pick(1), pick(2))
    wanted = pairs.select(F.col("a1").alias("c1"), F.col("a2").alias("c2")).unionAll(pairs.select("b1", "b2")).distinct()
    chosen = sketches.select("record_id", "c1", "c2").join(wanted, ["c1", "c2"], "left_semi").groupBy("c1", "c2").agg(F.min("record_id").alias("record_id"))
    roles = cut_lineage(roles.join(chosen, ["c1", "c2"]))
    texts = df.select(rid.alias("record_id"), text.alias("text")).filter("text is not null")
    met = texts.join(F.broadcast(roles) if roles.count() <= MAX_NAMED else roles, "record_id").select("a1", "a2", "block", "own", "b1", "b2", "c1", "c2", "text")

    def plains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plain = {t: plain_form(t) for t in b["text"].unique()}
            keys = {t: _text_key(x) for t, x in plain.items()}
            same = [keys[t] == k for t, k in zip(b["text"], zip(b["c1"], b["c2"]))]  # a reused id may hold another text
            yield b.assign(plain=b["text"].map(plain)).loc[same, ["a1", "a2", "block", "own", "b1", "b2", "plain"]]

    met = met.mapInPandas(plains, "a1 long, a2 long, block long, own boolean, b1 long, b2 long, plain string")
    met = met.repartition("a1", "a2", "block").sortWithinPartitions("a1", "a2", "block", F.desc("own"))

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.empty(0, np.uint64)
        for b in batches:
            out = []
            hashes = map(_distinct, kgram_hashes_of(b["plain"].tolist(), p.shingle))
            for h, (a1, a2, is_own, b1, b2) in zip(hashes, b[["a1", "a2", "own", "b1", "b2"]].itertuples(index=False, name=None)):
                if is_own:
                    own = h
                elif (similarity := exact_jaccard(own, h)) >= p.threshold:
                    out.append((a1, a2, b1, b2, similarity))
            yield pd.DataFrame(out, columns=["a1", "a2", "b1", "b2", "similarity"])

    # a record delivered twice brings its text twice
    return met.mapInPandas(verified, "a1 long, a2 long, b1 long, b2 long, similarity double").dropDuplicates(["a1", "a2", "b1", "b2"])


#: Hash buckets of a class's members; a class is met in at most so many blocks.
_MEMBER_BUCKETS = 1024


def class_members(sketches: DataFrame) -> DataFrame:
    """(record_id, c1, c2, size, blocks, block): the distinct members of each class, in blocks of about BLOCK; a hot class is counted in buckets."""
    mem = sketches.select("record_id", "c1", "c2").distinct().withColumn("bucket", F.pmod(F.xxhash64("record_id"), F.lit(_MEMBER_BUCKETS)))
    counts = mem.groupBy("c1", "c2", "bucket").agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(Window.partitionBy("c1", "c2"))  # at most _MEMBER_BUCKETS rows a class
    sizes = counts.select("c1", "c2", "bucket", size.alias("size"))
    blocks = F.least(F.ceil(F.col("size") / BLOCK), F.lit(_MEMBER_BUCKETS))
    return mem.join(sizes, ["c1", "c2", "bucket"]).withColumn("blocks", blocks).withColumn("block", F.pmod("bucket", "blocks")).drop("bucket")


def similar_records(df: DataFrame, rid: Column, text: Column, p: SketchParams = SketchParams()) -> DataFrame:
    """(record_id_a, record_id_b): all pairs of records at or above the threshold, copies included; classes are multiplied block by block."""
    sketches = cut_lineage(sketched(df, rid, text, p))
    found = similar_classes(df, rid, text, sketches, p)
    mem = cut_lineage(class_members(sketches))
    shapes = mem.select("c1", "c2", "blocks").distinct()
    side = lambda a, x, k: shapes.select(F.col("c1").alias(f"{a}1"), F.col("c2").alias(f"{a}2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias(k))
    own = lambda a, x, k: mem.select(F.col("c1").alias(f"{a}1"), F.col("c2").alias(f"{a}2"), F.col("block").alias(k), F.col("record_id").alias(x))
    spread = found.select("a1", "a2", "b1", "b2").join(side("a", "x", "i"), ["a1", "a2"]).join(side("b", "y", "j"), ["b1", "b2"])
    across = spread.join(own("a", "x", "i"), ["a1", "a2", "i"]).join(own("b", "y", "j"), ["b1", "b2", "j"]).filter("x <> y").select("x", "y")
    copies = mem.filter("size > 1")
    left = copies.select("c1", "c2", F.col("record_id").alias("x"), F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    right = copies.select("c1", "c2", F.col("record_id").alias("y"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("i"))
    within = left.join(right, ["c1", "c2", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).select("x", "y")
    # a reused record_id may hold two texts, so a pair can be met twice
    return across.unionAll(within).select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b")).filter("record_id_a < record_id_b").distinct()


def similarity_classes(df: DataFrame, rid: Column, text: Column, p: SketchParams = SketchParams()) -> DataFrame:
    """One row per record and text that takes part: the least record_id of its class of equal texts, the class's size, and its number of links to other classes."""
    sketches = cut_lineage(sketched(df, rid, text, p))
    found = cut_lineage(similar_classes(df, rid, text, sketches, p))
    links = found.select(F.col("a1").alias("c1"), F.col("a2").alias("c2")).unionAll(found.select("b1", "b2")).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n_links"))
    mem = cut_lineage(class_members(sketches))
    classes = mem.groupBy("c1", "c2").agg(F.min("record_id").alias("class_id")).join(links, ["c1", "c2"], "left")
    joined = mem.join(classes, ["c1", "c2"]).select("record_id", "class_id", F.col("size").alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return joined
