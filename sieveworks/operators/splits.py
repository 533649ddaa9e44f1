"""Splits, samples and rebalancing: exact sizes, membership by a hash of seed and key.

The order within a group is md5(seed|key): the same on every engine and for
every partitioning. A group's rows are ranked in hash buckets, so that a group
with a third of all rows is no single task; what is ranked are keys, not rows.
Rows with equal keys are told apart by ``tie`` columns. Null groups are a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: First hex digits of the hash that make a bucket: 256 buckets a group.
_BUCKET_DIGITS = 2


def order_key(seed: int, *key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))


def ranked(df: DataFrame, group: Sequence[str], order: Column, tie: Sequence[str] = (), rank: str = "rank", size: str = "group_size") -> DataFrame:
    """``df`` with each row's rank from 1 in its group by a hex ``order``, and the group's size; a hot group is ranked in 256 tasks."""
    group = list(group)
    df = df.withColumn("__order", order).withColumn("__bucket", F.substring("__order", 1, _BUCKET_DIGITS))
    counts = df.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # at most 256 rows a group
    before = over.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns({"__start": F.coalesce(F.sum("__n").over(before), F.lit(0)), size: F.sum("__n").over(over)}).drop("__n")
    inside = Window.partitionBy(*group, "__bucket").orderBy("__order", *tie)
    local = df.withColumn("__local", F.row_number().over(inside))
    same = F.lit(True)
    for c in (*group, "__bucket"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = local.alias("l").join(starts.alias("s"), same)
    kept = [F.col(f"l.`{c}`") for c in df.columns if not c.startswith("__")]
    return joined.select(*kept, (F.col("__local") + F.col("__start")).cast("long").alias(rank), F.col(f"s.{size}").alias(size))


def validation_size(n: Column, ratio: float) -> Column:
    """Rows of a group of n that are held out: none of one, else at least one and at most n - 1; halves round to even."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.least(F.greatest(F.lit(1), F.bround(n * F.lit(float(ratio))).cast("long")), n - 1)).cast("long")


def split_by_group(df: DataFrame, group: str, key: Sequence[str], ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: validation for the first of each group by hash, train for the rest."""
    out = ranked(df, [group], order_key(seed, *[F.col(k) for k in key]), key)
    return out.withColumn("split", F.when(F.col("rank") <= validation_size(F.col("group_size"), ratio), "validation").otherwise("train")).drop("rank", "group_size")


def rebalance_targets(counts: DataFrame, group: str, n: str, weight: Column, most: float = 3.0) -> DataFrame:
    """Per group its target: the largest group's count times the weight, at least 1 and at most ``most`` times its own count."""
    largest = counts.agg(F.max(n)).first()[0] or 0
    wanted = F.bround(F.lit(largest) * weight).cast("long")
    target = F.least(F.greatest(wanted, F.lit(1)), F.greatest(F.lit(1), F.ceil(F.col(n) * F.lit(float(most)))))
    return counts.withColumn("target", target.cast("long"))


def rebalance(df: DataFrame, group: str, key: Sequence[str], weight: Column, most: float = 3.0, seed: int = 42) -> DataFrame:
    """Each group brought to its target: larger ones sampled without replacement, smaller ones kept whole and topped up with replacement.

    ``replica`` is 0 for a row itself and counts its extra copies from 1. The
    j-th extra row of a group of n is the one of rank 1 + md5(seed|j) mod n.
    """
    out = ranked(df, [group], order_key(seed, *[F.col(k) for k in key]), key)
    counts = out.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    targets = rebalance_targets(counts, group, "n", weight, most)
    base = out.alias("o").join(targets.alias("t"), F.col(f"o.{group}").eqNullSafe(F.col(f"t.{group}")))
    kept = base.filter(F.col("rank") <= F.col("target")).select("o.*", F.lit(0).cast("long").alias("replica"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = targets.filter(F.col("target") > F.col("n")).select(group, "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("target") - F.col("n"))).alias("j"))
    draws = draws.withColumn("rank", F.pmod(number, F.col("n")) + 1).groupBy(group, "rank").agg(F.count(F.lit(1)).alias("copies"))
    hit = out.alias("o").join(draws.alias("d"), F.col(f"o.{group}").eqNullSafe(F.col(f"d.{group}")) & (F.col("o.rank") == F.col("d.rank")))
    extra = hit.select("o.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("d.copies"))).alias("replica"))
    return kept.unionByName(extra).drop("rank", "group_size")


#: First hex digits of the hash by which the end of a sample is found: 65,536 counts.
_SAMPLE_DIGITS = 4


def sample_exact(df: DataFrame, key: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """The ``k`` first rows by hash, all if there are fewer. Counts by the hash's first digits tell where the sample ends:
    rows before that pass a filter, and only those with the same digits (a 65,536th of all) are sorted."""
    order = order_key(seed, *[F.col(c) for c in key])
    digits = F.substring(order, 1, _SAMPLE_DIGITS)
    taken, last = 0, None
    for r in df.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("n")).orderBy("digits").collect():
        if taken + r["n"] >= k:
            last = r["digits"]
            break
        taken += r["n"]
    if last is None:
        return df
    rest = df.filter(digits == last).orderBy(order, *key).limit(max(k - taken, 0))
    return df.filter(digits < last).unionByName(rest)


def sample_ratio(df: DataFrame, key: Sequence[str], ratio: float, seed: int = 42) -> DataFrame:
    """max(1, int(n * ratio)) rows by hash; none of none."""
    return sample_exact(df, key, max(1, int(df.count() * ratio)), seed)


def split_global(df: DataFrame, key: Sequence[str], ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the ceil(n * ratio) first by hash are validation."""
    out = ranked(df, [], order_key(seed, *[F.col(k) for k in key]), key)
    return out.withColumn("split", F.when(F.col("rank") <= F.ceil(F.col("group_size") * F.lit(float(ratio))), "validation").otherwise("train")).drop("rank", "group_size")


def positional_split(df: DataFrame, order: str, percent: int) -> DataFrame:
    """``df`` with ``split``: train for the first ``percent`` of a hundred by a unique number ``order``, in its order; int(n * percent / 100) rows."""
    numbered = position(df, order)
    return numbered.withColumn("split", F.when(F.col("position") <= F.floor(F.col("total") * F.lit(percent) / 100), "train").otherwise("validation")).drop("position", "total")


def position(df: DataFrame, order: str, buckets: int = 256) -> DataFrame:
    """``df`` with ``position`` from 1 by the unique number ``order`` (nulls first) and ``total``: ranked in ranges between quantiles of the number, not in one task."""
    marks = [i / buckets for i in range(1, buckets)]
    bounds, total = df.agg(F.percentile_approx(order, marks, 10_000), F.count(F.lit(1))).first()
    bounds = sorted(set(bounds or []))
    df = df.withColumn("total", F.lit(total).cast("long"))
    below = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x < F.col(order))) if bounds else F.lit(0)
    df = df.withColumn("__bucket", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(below))
    counts = df.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = df.withColumn("__local", F.row_number().over(Window.partitionBy("__bucket").orderBy(order)))
    out = local.join(F.broadcast(starts), "__bucket")  # at most `buckets` + 1 rows
    return out.withColumn("position", (F.col("__local") + F.col("__start")).cast("long")).drop("__bucket", "__local", "__start")


def tail_holdout(df: DataFrame, order: str, k: int = 100) -> DataFrame:
    """``df`` with ``split``: validation for the last ``k`` rows by ``order``."""
    return position(df, order).withColumn("split", F.when(F.col("position") > F.col("total") - k, "validation").otherwise("train")).drop("position", "total")


def pick_split(available: Mapping[str, bool]) -> str:
    """Which evaluation set to use: validation before test before a ratio split."""
    return next((s for s in ("validation", "test") if available.get(s)), "ratio")


def shuffled(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """All rows in the order of the hash: a distributed sort."""
    return df.orderBy(order_key(seed, *[F.col(k) for k in key]), *key)
