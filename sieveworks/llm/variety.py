"""Problem 3: subsets that cover the variety of the records.

The value of a subset is the sum over features of the square root of the mass
that the subset gives the feature: a second record like one already chosen adds
little. Records are added in rounds of descending thresholds. Records lie in
shards by a hash of their id, as many as their number asks for. In a round each
shard takes, from the largest gain down, those of its records whose gain over
what is chosen (and what it took itself) reaches the threshold, and at most its
share of SENT times what is wanted; the takings are merged by the same rule in a
tree of SHARDS_MERGED branches, so that like records from different shards don't
add up. What a shard or a branch had to leave waits for the next round, at the
same threshold; else the next threshold is a share of the largest gain left.

Order of choice nests the sizes: the subset of size s is the first s chosen. The
choice depends on the records alone, not on how they are partitioned. A merge
holds at most SENT times the size wanted and LEAST_SENT records of each branch.
Rounds end when the size is reached or no record has a gain left: records
without any feature (null or blank texts) add nothing whichever is taken, and
come last, by a hash of their id. A record delivered twice counts once; where
fewer records exist than asked for, all of them come out, numbered by hash.
Null, zero and negative sizes give no rows; rows without an id are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.operators.splits import order_key, ranked
from sieveworks.runtime import cut_lineage

#: Hashed features.
FEATURES = 1 << 18
#: A round's threshold is 1 - STEP of the largest gain left.
STEP = 0.25
#: Records of a shard, which are held together, and branches of a merge.
SHARD_ROWS, SHARDS_MERGED = 4096, 32
#: What a shard or a branch sends at most: its share of so many times the records wanted, and so many at least.
SENT, LEAST_SENT = 4, 8
#: The name under which all records are one group; no task is called so, as task names are trimmed.
EVERYTHING = " all"

_ROUNDING = 1e-12
_UNIT = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+")


def features(text: str) -> np.ndarray:
    """Distinct hashed features, sorted: runs of three CJK characters, words of other scripts and pairs of neighbouring words; no numbers.

    Runs this long are shared by records about the same thing rather than by all
    of a task, so that look-alikes saturate each other's features.
    """
    seen: set[str] = set()
    before = ""
    for run in _UNIT.findall(text.lower()):
        if run[0] >= "㐀" and "㐀" <= run[-1] <= "鿿":
            seen.update(run[i : i + 3] for i in range(max(1, len(run) - 2)))
            before = ""
        else:
            seen.add(run)
            if before:
                seen.add(before + run)
            before = run + " "
    return np.unique(np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) & (FEATURES - 1) for x in seen), np.int64, len(seen)))


_FAR = 0xFFFF


def packed(feats: np.ndarray) -> bytes:
    """Sorted features as 16-bit gaps; _FAR stands for a gap of that size without a feature at its end."""
    gaps = np.diff(feats, prepend=0)
    if (gaps >= _FAR).any():
        gaps = np.concatenate([np.concatenate([np.full(g // _FAR, _FAR), [g % _FAR]]) for g in gaps])
    return gaps.astype(np.uint16).tobytes()


def unpacked(rows: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all rows after one another, number of each row's)."""
    sizes = np.array([len(r) // 2 for r in rows], np.int64)
    gaps = np.frombuffer(b"".join(rows), np.uint16).astype(np.int64)
    if not len(gaps):
        return gaps, sizes
    ends = np.cumsum(gaps)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    base = np.where(first > 0, ends[np.maximum(first, 1) - 1], 0)
    ids, real = ends - np.repeat(base, sizes), gaps != _FAR
    if real.all():
        return ids, sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    return ids[real], np.bincount(row[real], minlength=len(sizes))


def featured(df: DataFrame, rid: str, group: str, fields: Sequence[str]) -> DataFrame:
    """(record_id, task, feats): one row per record; feats are packed features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = ["\n".join(t for t in row if t) for row in b[list(fields)].itertuples(index=False, name=None)]
            yield pd.DataFrame({"record_id": b["record_id"], "task": b["task"], "feats": [packed(features(t)) for t in texts]})

    task = F.coalesce(F.trim(F.col(group)), F.lit(""))
    picked = df.filter(F.col(rid).isNotNull()).select(F.col(rid).alias("record_id"), task.alias("task"), *fields)
    return picked.mapInPandas(run, "record_id long, task string, feats binary").dropDuplicates(["record_id"])


class _Rows:
    """Feature rows as one array, for gains of many records at once."""

    def __init__(self, feats: Sequence[bytes]) -> None:
        self.index, self.sizes = unpacked(feats)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.mass = 1.0 / np.maximum(self.sizes, 1)

    def gains(self, mass: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = np.zeros(len(which))
        full = which[self.sizes[which] > 0]
        if not len(full):
            return out
        if len(full) * 2 > len(self.sizes):
            index, sizes = self.index, self.sizes[self.sizes > 0]
            x = np.repeat(self.mass[self.sizes > 0], sizes)
            each = np.zeros(len(self.sizes))
            each[self.sizes > 0] = np.add.reduceat(np.sqrt((now := mass[index]) + x) - np.sqrt(now), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            return each[which]
        index = np.concatenate([self.index[self.starts[i] : self.starts[i + 1]] for i in full])
        sizes = self.sizes[full]
        x = np.repeat(self.mass[full], sizes)
        got = np.add.reduceat(np.sqrt((now := mass[index]) + x) - np.sqrt(now), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        out[self.sizes[which] > 0] = got
        return out

    def take(self, i: int, mass: np.ndarray, least: float) -> float | None:
        """Adds record ``i`` to ``mass`` if its gain reaches ``least``; its gain."""
        index, x = self.index[self.starts[i] : self.starts[i + 1]], self.mass[i]
        now = mass[index]
        gain = float((np.sqrt(now + x) - np.sqrt(now)).sum())
        if gain < least:
            return None
        mass[index] = now + x
        return gain


_TAKEN = "shard long, grp string, record_id long, feats binary, gain double, top double"


def _sent(want: int, span: int, shards: int) -> int:
    """Records that ``span`` of all shards may send."""
    return min(want, max(LEAST_SENT, -(-SENT * want * span // shards)))


def _local_round(table: DataFrame, held: Broadcast, shards: int) -> DataFrame:
    """What each shard takes, and with record_id null the largest gain that it leaves, per group. Expects whole shards in a partition, one after the other."""

    def of_shard(b: pd.DataFrame, start: dict[str, np.ndarray]) -> pd.DataFrame:
        rows, ids, task = _Rows(b["feats"].tolist()), b["record_id"].to_numpy(), b["task"].to_numpy()
        shard, out = int(b["shard"].iat[0]), []
        for g, (_, least, want, chosen) in held.value.items():
            which = np.arange(len(ids)) if g == EVERYTHING else np.flatnonzero(task == g)
            if len(chosen) and len(which):
                at = np.minimum(np.searchsorted(chosen, ids[which]), len(chosen) - 1)
                which = which[chosen[at] != ids[which]]
            if not len(which):
                continue
            gains = rows.gains(start[g], which)
            fit = gains >= least
            top, took, most, mass = float(gains[~fit].max()) if (~fit).any() else 0.0, 0, _sent(want, 1, shards), None
            order = np.lexsort((ids[which][fit], -gains[fit]))
            for i, was in zip(which[fit][order].tolist(), gains[fit][order].tolist()):
                if took == most:
                    top = max(top, was)
                    break  # the rest gains no more
                mass = start[g].copy() if mass is None else mass
                gain = rows.take(i, mass, least)
                if gain is None:
                    top = max(top, np.nextafter(least, 0.0))  # below it by now
                else:
                    took += 1
                    out.append((shard, g, ids[i], b["feats"].iat[i], gain, 0.0))
            out.append((shard, g, None, None, 0.0, top))
        return pd.DataFrame(out, columns=["shard", "grp", "record_id", "feats", "gain", "top"]).astype({"record_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = {g: s[0].astype(np.float64) for g, s in held.value.items()}
        kept: list[pd.DataFrame] = []
        for b in batches:
            for shard, part in b.groupby("shard", sort=False):
                if kept and kept[0]["shard"].iat[0] != shard:
                    yield of_shard(pd.concat(kept, ignore_index=True), start)
                    kept = []
                kept.append(part)
        if kept:
            yield of_shard(pd.concat(kept, ignore_index=True), start)

    return table.mapInPandas(run, _TAKEN)


def _merge(taken: DataFrame, held: Broadcast, span: int, shards: int) -> DataFrame:
    """The same rule over the takings of ``span`` shards; the last merge also gives the new mass, in a row without record_id."""
    last = span >= shards

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, branch = pdf["grp"].iat[0], int(pdf["branch"].iat[0])
        start, least, want, _ = held.value[g]
        most = want if last else _sent(want, span, shards)
        mass, top = start.astype(np.float64), float(pdf["top"].max())
        pdf = pdf[pdf["record_id"].notna()].sort_values(["gain", "record_id"], ascending=[False, True], kind="stable")
        rows, out = _Rows(pdf["feats"].tolist()), []
        for i, (rid, feats, was) in enumerate(zip(pdf["record_id"].tolist(), pdf["feats"], pdf["gain"].tolist())):
            if len(out) == most:
                top = max(top, was)
                break
            gain = rows.take(i, mass, least)
            if gain is None:
                top = max(top, np.nextafter(least, 0.0))
            else:
                out.append((branch, g, rid, None if last else feats, float(len(out)) if last else gain, 0.0))
        out.append((branch, g, None, mass.astype(np.float32).tobytes() if last else None, 0.0, top))
        return pd.DataFrame(out, columns=["shard", "grp", "record_id", "feats", "gain", "top"]).astype({"record_id": "Int64"})

    branch = F.floor(F.col("shard") / SHARDS_MERGED).cast("long")
    return taken.withColumn("branch", branch).groupBy("grp", "branch").applyInPandas(run, _TAKEN)


def choose_order(table: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(grp, record_id, place): the first ``sizes[grp]`` choices of each group, from a table (record_id, task, feats); fewer where no gain is left."""
    spark = table.sparkSession
    state = {g: np.zeros(FEATURES, np.float32) for g, k in sizes.items() if k > 0}
    chosen: dict[str, list[int]] = {g: [] for g in state}
    # the first threshold: no record gains more than the root of its number of features
    n, biggest = table.agg(F.count(F.lit(1)), F.max(F.length("feats") / 2)).first()
    shards = max(1, -(-n // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("record_id"), F.lit(shards))
    if state:
        table = cut_lineage(table.withColumn("shard", shard).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "record_id"))
    least = dict.fromkeys(state, (1 - STEP) * float(np.sqrt(biggest or 0)))
    open_groups = {g for g in state if least[g] > 0}
    while open_groups:
        now = {g: (state[g], least[g], sizes[g] - len(chosen[g]), np.array(sorted(chosen[g]), np.int64)) for g in open_groups}
        held = spark.sparkContext.broadcast(now)  # per group FEATURES numbers and the ids chosen so far
        merged, span = _local_round(table, held, shards), 1
        while span == 1 or span < shards:
            span *= SHARDS_MERGED
            merged = _merge(merged, held, span, shards)
        rows = merged.collect()  # at most the sizes still wanted, and one row of FEATURES numbers for each group
        held.destroy()
        by: dict[str, list] = {g: [] for g in open_groups}
        top = dict.fromkeys(open_groups, 0.0)
        for r in rows:
            if r["record_id"] is not None:
                by[r["grp"]].append((r["gain"], r["record_id"]))
            else:
                state[r["grp"]], top[r["grp"]] = np.frombuffer(r["feats"], np.float32), r["top"]
        for g in list(open_groups):
            chosen[g] += [rid for _, rid in sorted(by[g])]
            # what had to wait is looked at again at this threshold, unless none of it was worth it
            least[g] = least[g] if top[g] >= least[g] and by[g] else (1 - STEP) * min(top[g], least[g])
            if len(chosen[g]) >= sizes[g] or top[g] <= _ROUNDING:
                open_groups.discard(g)
    out = [(g, rid, i) for g, ids in chosen.items() for i, rid in enumerate(ids)]
    return spark.createDataFrame(pd.DataFrame(out, columns=["grp", "record_id", "place"]) if out else [], "grp string, record_id long, place long")


def varied_subsets(df: DataFrame, targets: DataFrame, rid: str = "record_id", group: str = "task_name", fields: Sequence[str] = ("instruction", "input")) -> DataFrame:
    """(target_id, record_id, place): for each target (target_id, task_name, target_size) a subset of that size; a null task means all records.

    The subset sizes, a request, are held on the driver with the ids chosen for
    them; nothing there grows with the data.
    """
    asked = [(r[0], EVERYTHING if r[1] is None else r[1].strip(), r[2] or 0) for r in targets.select("target_id", group, "target_size").distinct().collect()]
    table = cut_lineage(featured(df, rid, group, fields))
    counts = {r["task"]: r["count"] for r in table.filter(F.col("task").isin([g for _, g, _ in asked])).groupBy("task").count().collect()}
    counts[EVERYTHING] = table.count()
    sizes: dict[str, int] = {}
    for _, g, k in asked:
        sizes[g] = max(sizes.get(g, 0), min(k, counts.get(g, 0)))
    order = choose_order(table, {g: k for g, k in sizes.items() if 0 < k < counts.get(g, 0)})
    # groups asked for whole, and records without gain where no other is left, by hash
    reached = {r["grp"]: r["count"] for r in order.groupBy("grp").count().collect()}
    short = {g: (reached.get(g, 0), k) for g, k in sizes.items() if k > reached.get(g, 0)}
    chosen = order
    if short:
        lacking = df.sparkSession.createDataFrame([(g, n, k) for g, (n, k) in short.items()], "grp string, reached long, size long")
        grouped = table.select("record_id", F.explode(F.array(F.col("task"), F.lit(EVERYTHING))).alias("grp"))
        rest = grouped.join(F.broadcast(lacking), "grp").join(order.select("grp", "record_id"), ["grp", "record_id"], "left_anti")  # one row for each group asked for
        numbered = ranked(rest, ["grp"], order_key(0, F.col("record_id")), ["record_id"]).withColumn("place", F.col("rank") - 1 + F.col("reached"))
        chosen = order.unionByName(numbered.filter(F.col("place") < F.col("size")).select("grp", "record_id", "place"))
    wanted = df.sparkSession.createDataFrame([(t, g, k) for t, g, k in asked] or [], "target_id long, grp string, target_size long")
    return chosen.join(F.broadcast(wanted), "grp").filter(F.col("place") < F.col("target_size")).select("target_id", "record_id", "place")  # the request itself


def coverage(feats: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per target: records and the value of its subset, from (record_id, task, feats) and (target_id, record_id)."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            index, n = unpacked(b["feats"].tolist())
            yield pd.DataFrame({"target_id": np.repeat(b["target_id"].to_numpy(), n), "feature": index.astype(np.int32), "mass": np.repeat(1.0 / np.maximum(n, 1), n)})

    joined = feats.join(chosen.select("target_id", "record_id"), "record_id").select("target_id", "feats")
    mass = joined.mapInPandas(explode, "target_id long, feature int, mass double").groupBy("target_id", "feature").agg(F.sum("mass").alias("mass"))
    sizes = chosen.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_records"))
    return sizes.join(mass.groupBy("target_id").agg(F.sum(F.sqrt("mass")).alias("value")), "target_id", "left")
