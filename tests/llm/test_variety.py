"""Problem 3: value against the greedy choice, sizes, nesting, look-alikes."""

import random

import numpy as np

from sieveworks.llm import variety as v

SCHEMA = "record_id long, task_name string, instruction string, input string, task string, feats string"
TARGETS = "target_id long, task_name string, target_size long"


def _df(spark, rows):
    return spark.createDataFrame([(i, t, a, b, "x", "y") for i, t, a, b in rows], SCHEMA)


def _value(feats, ids):
    mass = np.zeros(v.FEATURES)
    for i in ids:
        mass[feats[i]] += 1 / max(1, len(feats[i]))
    return np.sqrt(mass).sum()


def _words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


def test_value_is_near_greedy(spark):
    rng = random.Random(2)
    pool = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    topic = [rng.sample(pool, 25) for _ in range(12)]
    rows = []
    for i in range(240):  # half of them about one topic
        t = topic[0] if i % 2 else topic[rng.randrange(12)]
        rows.append((i, "a" if i % 3 else "b", "decide", _words(rng, 12, t)))
    df = _df(spark, rows + rows[:5])
    got = v.varied_subsets(df, spark.createDataFrame([(1, None, 20), (2, "a", 10), (3, None, 5), (4, "b", 1000), (5, "none", 3), (6, "a", None)], TARGETS)).collect()
    chosen = {}
    for r in got:
        chosen.setdefault(r["target_id"], {})[r["place"]] = r["record_id"]
    assert {k: len(x) for k, x in chosen.items()} == {1: 20, 2: 10, 3: 5, 4: 80}
    assert [chosen[1][i] for i in range(5)] == [chosen[3][i] for i in range(5)]
    assert all(len(set(x.values())) == len(x) for x in chosen.values())
    assert all(i % 3 for i in chosen[2].values()) and not any(i % 3 for i in chosen[4].values())
    feats = {r[0]: v.features(f"{r[2]}\n{r[3]}") for r in rows}
    greedy = []
    for _ in range(20):
        greedy.append(max((i for i in feats if i not in greedy), key=lambda i: (_value(feats, [*greedy, i]), -i)))
    assert _value(feats, chosen[1].values()) >= 0.95 * _value(feats, greedy)
    assert sum(i % 2 for i in chosen[1].values()) < 10  # the large group doesn't fill it


def test_choice_depends_on_the_records_alone(spark, monkeypatch):
    """The same for any partitioning, also with many shards and branches; and then still near the greedy choice."""
    rng = random.Random(9)
    pool = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    topic = [rng.sample(pool, 30) for _ in range(15)]
    rows = [(i, "a" if i % 4 else "b", "decide", _words(rng, 14, topic[0] if i % 2 else topic[rng.randrange(15)])) for i in range(400)]
    targets = spark.createDataFrame([(1, None, 40), (2, "b", 15)], TARGETS)
    take = lambda n: {tuple(r) for r in v.varied_subsets(_df(spark, rows).repartition(n), targets).collect()}
    one = take(4)
    assert one == take(64)
    monkeypatch.setattr(v, "SHARD_ROWS", 20)
    monkeypatch.setattr(v, "SHARDS_MERGED", 3)
    many = take(5)
    assert many == take(16)
    feats = {r[0]: v.features(f"{r[2]}\n{r[3]}") for r in rows}
    greedy = []
    for _ in range(40):
        greedy.append(max((i for i in feats if i not in greedy), key=lambda i: (_value(feats, [*greedy, i]), -i)))
    for got in (one, many):
        ids = [r for t, r, _ in got if t == 1]
        assert len(set(ids)) == 40 and _value(feats, ids) >= 0.95 * _value(feats, greedy)


def test_ties_blanks_and_empty_tables(spark):
    rows = [(i, "t", "same", "same words here") for i in range(30)] + [(100, "t", None, None), (101, None, "", "  "), (102, " t ", "other", "内容不同的案情"), (None, "t", "a", "b")]
    got = v.varied_subsets(_df(spark, rows), spark.createDataFrame([(1, None, 33), (2, "t", 2), (3, None, 32), (4, None, -1), (5, None, 0)], TARGETS)).collect()
    by = {}
    for r in got:
        by.setdefault(r["target_id"], set()).add(r["record_id"])
    assert {k: len(x) for k, x in by.items()} == {1: 33, 2: 2, 3: 32}
    assert 102 in by[2]
    assert v.varied_subsets(_df(spark, []), spark.createDataFrame([(1, None, 3)], TARGETS)).count() == 0
    assert v.varied_subsets(_df(spark, rows), spark.createDataFrame([], TARGETS)).count() == 0


def test_packing_of_features():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, v.FEATURES, n)) for n in (0, 1, 3, 200, 5, 0)] + [np.array([0, 65535, 65536, 200_000, 262_143])]
    ids, sizes = v.unpacked([v.packed(r) for r in rows])
    assert sizes.tolist() == [len(r) for r in rows] and (ids == np.concatenate(rows)).all()
    assert v.unpacked([])[0].tolist() == [] and v.packed(np.empty(0, np.int64)) == b""
