"""Problem 5 against brute force, and the sketch's own properties."""

import random

import numpy as np
from pyspark.sql import functions as F

from sieveworks.llm.plain import code_points, kgram_hashes, plain_form
from sieveworks.llm import neardup as n

P = n.SketchParams()


def _shingles(t):
    t = plain_form(t)
    return {t[i : i + 5] for i in range(len(t) - 4)}


def _text(rng, words=60):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(words))


def test_kgram_hashes_tell_kgrams_apart():
    t = plain_form("abcabcdabcdeabcdef" * 5)
    for k in (1, 2, 3, 5, 8, 13):
        h = kgram_hashes(code_points(t), k)
        assert len(h) == len(t) - k + 1
        assert len(set(h.tolist())) == len({t[i : i + k] for i in range(len(t) - k + 1)})
    assert len(kgram_hashes(code_points("ab"), 3)) == 0


def test_sketch_merges_and_estimates():
    rng = random.Random(5)
    a = n.shingle_hashes(plain_form(_text(rng, 200)), 5)
    b = np.unique(np.concatenate([a[: len(a) * 3 // 4], n.shingle_hashes(plain_form(_text(rng, 50)), 5)]))
    sa, sb = n.set_sketch(a, P), n.set_sketch(b, P)
    assert (n.merge_sketches(sa, sb) == n.set_sketch(np.union1d(a, b), P)).all()
    estimate = n.joint_estimates(sa[None], sb[None], np.array([float(len(a))]), np.array([float(len(b))]), P)[0]
    assert abs(estimate - n.exact_jaccard(a, b)) < 0.12
    assert (n.set_sketch(np.empty(0, np.uint64), P) == 0).all()


def test_pairs_are_those_of_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = _text(rng).split()
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = _text(rng, 1)
            texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), texts[0].replace(" ", "  "), None, "", "short text", "x" * 200_000]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(0, texts[0], "a", "b"), (None, texts[1], "a", "b")]
    df = spark.createDataFrame(rows, "record_id long, input string, k1 string, plain string")
    shingled = [(i, _shingles(t)) for i, t in enumerate(texts) if t and len(plain_form(t)) >= 80]
    want = {(i, j) for x, (i, a) in enumerate(shingled) for j, b in shingled[x + 1 :] if len(a & b) >= 0.6 * len(a | b)}
    got = {tuple(r) for r in n.similar_records(df, F.col("record_id"), F.col("input")).collect()}
    assert got <= want
    sure = {(i, j) for i, j in want if len(_shingles(texts[i]) & _shingles(texts[j])) >= 0.7 * len(_shingles(texts[i]) | _shingles(texts[j]))}
    assert sure <= got and len(got) >= 0.93 * len(want)
    classes = {r["record_id"]: r for r in n.similarity_classes(df, F.col("record_id"), F.col("input")).collect()}
    assert classes[0]["class_id"] == 0 and classes[0]["class_size"] == 4 and set(classes) == {i for i, _ in shingled}


def test_registers_meet_as_often_as_sets_are_alike():
    """The cheap hash family against independence, on random text of other letters than the planted cases."""
    rng = random.Random(23)
    equal, met, want = [], [], []
    for _ in range(150):
        words = ["".join(rng.choice("bcdfgklmnrstvaeiou") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(20, 150))]
        other = [w if rng.random() > 0.06 else w[::-1] for w in words]
        a, b = (n.shingle_hashes(plain_form(" ".join(x)), 5) for x in (words, other))
        ra, rb = n.set_sketch(a, P), n.set_sketch(b, P)
        j = n.exact_jaccard(a, b)
        want.append((j, 1 - (1 - j**P.rows) ** P.bands))
        equal.append((ra == rb).mean())
        met.append((n.band_hashes(ra, P) == n.band_hashes(rb, P)).any())
    js, chance = map(np.array, zip(*want))
    assert abs(np.mean(equal) - js.mean()) < 0.03
    assert abs(np.corrcoef(equal, js)[0, 1]) > 0.95
    assert abs(np.mean(met) - chance.mean()) < 0.06


def test_many_sets_give_what_each_gives():
    rng = random.Random(2)
    sets = [n.shingle_hashes(plain_form(_text(rng, k)), 5) for k in (1, 30, 60, 2000)] + [np.empty(0, np.uint64)]
    together = n.set_sketches(sets, P)
    assert all((n.set_sketch(x, P) == row).all() for x, row in zip(sets, together))
    h = sets[1]
    m = n._multipliers(P)
    least = ((h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] * m).min(axis=0)
    assert (n._to_registers(least, P) == together[1]).all()


def test_hot_group_of_copies_is_one_class(spark):
    rng = random.Random(3)
    same = _text(rng)
    df = spark.createDataFrame([(i, same if i < 600 else _text(rng)) for i in range(900)], "record_id long, input string").repartition(8)
    sketches = n.sketched(df, F.col("record_id"), F.col("input"))
    assert sketches.count() == 900
    assert sketches.filter("bands is not null").count() <= 300 + 8  # a copy is sketched once in a task
    assert n.candidate_pairs(sketches).count() == 0
    sizes = n.similarity_classes(df, F.col("record_id"), F.col("input")).groupBy("class_size").count().collect()
    assert {r["class_size"]: r["count"] for r in sizes} == {600: 600, 1: 300}


def test_blocks_lose_and_repeat_nothing(spark, monkeypatch):
    """Groups larger than a block: shared bands, partners of one class, copies of one text."""
    monkeypatch.setattr(n, "BLOCK", 4)
    rng = random.Random(8)
    base, other = _text(rng, 80).split(), _text(rng, 80)
    texts = []
    for i in range(18):
        words = list(base)
        words[i] = _text(rng, 1)
        texts.append(" ".join(words))
    texts += [texts[0]] * 11 + [other] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, input string").repartition(4)
    sets = [_shingles(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    rows = [tuple(r) for r in n.similar_records(df, F.col("record_id"), F.col("input")).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    links = {r["record_id"]: r["n_links"] for r in n.similarity_classes(df, F.col("record_id"), F.col("input")).collect()}
    assert links[0] == 17 and links[18] == 17 and links[30] == 0


def test_empty(spark):
    df = spark.createDataFrame([], "record_id long, input string")
    assert n.similar_records(df, F.col("record_id"), F.col("input")).count() == 0
