"""Problems 4 and 6."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveworks.llm import packing as k
from sieveworks.llm import tokens as t
from sieveworks.runtime import cut_lineage

FIELDS = ("input", "output")
SCHEMA = "record_id long, input string, output string, lang string, extra string, content string"


@pytest.fixture(scope="module")
def vocabulary():
    return t.Vocabulary.read()


def test_kinds_of_tokenizers():
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"):
        count = t.Vocabulary.read(f"/opt/tokenizers/{name}").counter()
        assert count(["", "The claim is dismissed.", "驳回上诉<|endoftext|>"])[0] == 0
    a, b = (t.Vocabulary.read(f"/opt/tokenizers/byte_bpe_50k.{x}").counter() for x in ("json", "tiktoken"))
    texts = ["The claim is dismissed.", "驳回上诉，维持原判。", " a  b\n\nc's 12", "é́ 😀"]
    assert a(texts) == b(texts)


def _dims():
    return {"lang": F.col("lang")}


def test_ledger_encodes_only_what_is_new_and_deltas_keep_the_cube(spark, vocabulary):
    count = vocabulary.counter()
    old = [(1, "one two", "three", "en", "x", "y"), (2, "一二三", None, "zh", "x", "y"), (3, "gone soon", "", None, "x", "y")]
    new = [old[0], (2, "一二三四", "five", "zh", "x", "y"), (4, "one two", "three", "en", "x", "y"), (4, "one two", "three", "en", "x", "y"), (None, "no id", "z", "en", "x", "y")]
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (old, new))
    ledger, other = t.Ledger.new(spark), t.Ledger.new(spark)
    stored = lambda: sorted(bytes(r["content"]) for r in ledger.counts(vocabulary).collect())
    before = cut_lineage(t.record_tokens(a, FIELDS, "record_id", _dims(), vocabulary, ledger))
    known = stored()
    after = t.record_tokens(b, FIELDS, "record_id", _dims(), vocabulary, ledger)
    grown = stored()
    assert set(known) < set(grown) and len(grown) == len(set(grown)) == len(known) + 2  # 一二三四 and five
    direct = t.record_tokens(b, FIELDS, "record_id", _dims(), vocabulary, other)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(after.select(direct.columns)) == rows(direct)
    assert {r["record_id"]: r["input_tokens"] for r in direct.collect()} == {1: count(["one two"])[0], 2: count(["一二三四"])[0], 4: count(["one two"])[0]}
    measures = ("input_tokens", "output_tokens", "total_tokens")
    deltas = t.cube_deltas(before, after, "record_id", ["lang"], measures)
    cube = t.apply_deltas(t.token_cube(before, ["lang"], measures), deltas, ["lang"], measures)
    order = ["lang", "level", "n_records", *measures]
    assert rows(cube.select(order)) == rows(t.token_cube(after, ["lang"], measures).select(order))


def test_ledger_is_read_back_and_knows_its_tokenizer(spark, vocabulary, monkeypatch):
    """A second look at the same folder encodes nothing; another tokenizer has counts of its own."""
    df = spark.createDataFrame([(1, "one two", "three", "en", "x", "y")], SCHEMA)
    ledger = t.Ledger.new(spark)
    first = t.record_tokens(df, FIELDS, "record_id", _dims(), vocabulary, ledger).collect()
    monkeypatch.setattr(t, "encode_counts", lambda *_: pytest.fail("encoded again"))
    again = t.Ledger(spark, ledger.folder)
    assert t.record_tokens(df, FIELDS, "record_id", _dims(), vocabulary, again).collect() == first
    assert again.counts(t.Vocabulary.read("/opt/tokenizers/byte_bpe_50k.json")) is None


def test_hot_contents_are_counted_like_others(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(t, "HOT", 4)
    rows = [(i, "the same text", f"text {i}" if i % 3 else None, "en", "x", "y") for i in range(60)]
    got = t.record_tokens(spark.createDataFrame(rows, SCHEMA).repartition(4), FIELDS, "record_id", _dims(), vocabulary, t.Ledger.new(spark)).collect()
    count = vocabulary.counter()
    want = {i: (count([a])[0], count([b])[0] if b else 0) for i, a, b, *_ in rows}
    assert {r["record_id"]: (r["input_tokens"], r["output_tokens"]) for r in got} == want


def test_tokens_of_nothing(spark, vocabulary):
    df = spark.createDataFrame([], SCHEMA)
    assert t.record_tokens(df, FIELDS, "record_id", _dims(), vocabulary, t.Ledger.new(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=12), st.integers(40, 64))
def test_packing_patterns(histogram, capacity):
    patterns = k.pack_histogram(histogram, capacity)
    held: dict[int, int] = {}
    for p in patterns:
        assert 0 < p.used <= capacity and p.count > 0
        for n, times in p.items:
            held[n] = held.get(n, 0) + times * p.count
    assert held == histogram
    total = sum(n * c for n, c in histogram.items())
    packs = sum(p.count for p in patterns)
    assert packs <= 2 * -(-total // capacity) + 1 if total else packs == 0
    slots = k.Slots.of(patterns, capacity)
    used: dict[int, list] = {}
    import numpy as np

    for n, c in histogram.items():
        container, start = slots.place(np.full(c, n), np.arange(c))
        for x, s in zip(container.tolist(), start.tolist()):
            used.setdefault(x, []).append((s, n))
    for spans in used.values():
        spans.sort()
        assert all(s + n <= s2 for (s, n), (s2, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= capacity
    assert len(used) == packs == slots.n_containers


def test_documents_in_containers(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice([0, 1, 5, 5, 5, 5, 17, 63, 64, 65, 128, 300]) for i in range(500)}
    lengths = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    caps = spark.createDataFrame([(1, 64, "x"), (2, 200, "x"), (2, 200, "x")], "capacity_id long, capacity_tokens long, doc_id string")
    got = k.pack_documents(lengths, caps, bucket_rows=20).collect()
    capacity = {1: 64, 2: 200}
    fill, docs = {}, {}
    for r in got:
        assert r["start"] + r["n_tokens"] <= capacity[r["capacity_id"]]
        if r["n_tokens"]:
            fill.setdefault((r["capacity_id"], r["container_id"]), []).append((r["start"], r["n_tokens"]))
        docs.setdefault((r["capacity_id"], r["doc_id"]), []).append((r["piece"], r["n_tokens"]))
    for c in (1, 2):
        for i, n in sizes.items():
            pieces = sorted(docs[c, i])
            assert sum(x for _, x in pieces) == n and [p for p, _ in pieces] == list(range(len(pieces)))
            assert len(pieces) == max(1, -(-n // capacity[c]))  # whole unless it exceeds the capacity
    for spans in fill.values():
        spans.sort()
        assert all(s + n <= s2 for (s, n), (s2, _) in zip(spans, spans[1:]))
    report = {r["capacity_id"]: r for r in k.container_fill(k.pack_documents(lengths, caps), caps).collect()}
    assert report[1]["filled"] > 0.95 and report[1]["n_tokens"] == sum(sizes.values())
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert k.pack_documents(empty, caps).count() == 0 and k.pack_documents(lengths, caps.limit(0)).count() == 0
    with pytest.raises(ValueError):
        k.pack_documents(lengths, spark.createDataFrame([(1, 0)], "capacity_id long, capacity_tokens long"))


def test_lengths_of_nulls_and_long_texts(spark, vocabulary):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 200_000, "x"), (3, "word " * 200_000, "x"), (None, "a", "x")], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in k.document_lengths(df, vocabulary).collect()}
    assert got[1] == got[2] == 0 and got[3] > 100_000 and len(got) == 3
