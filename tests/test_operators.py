"""Operators against brute force, golden cases and properties."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.functions import scoring, text
from sieveworks.operators import curate, dedup, dialog, diverse, generate, reports, splits, tokenized


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


# --- strings -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("s", ["", " a ", "　 a b \n", "\n\t", "a\x1cb\x1c", "法 ", "a\n"])
def test_strip_is_that_of_unicode(spark, s):
    assert one(spark, text.strip(F.col("s")), s=s) == s.strip()
    assert one(spark, text.visible_length(F.col("s")), s=s) == len("".join(s.split()))


@pytest.mark.parametrize("s, limit, want", [("abc。def", 5, "abc。"), ("ab。cdefghij", 10, "ab。cdefghi"), ("abcdef", 0, "abcdef"), ("abcdef", 3, "abc"), ("abcdefg.xyz", 10, "abcdefg."), ("ab  ", 4, "ab  ")])
def test_shorten(spark, s, limit, want):
    got = one(spark, text.shorten(F.col("s"), limit), s=s)
    ref = s
    if limit > 0 and len(s) > limit:
        ref = s[:limit].rstrip()
        cut = max(ref.rfind(p) for p in text.SENTENCE_ENDS)
        ref = ref[: cut + 1] if cut >= int(limit * 0.7) else ref
    assert got == ref == want


@pytest.mark.parametrize(
    "content, think, answer",
    [
        ("<think>a\nb</think><answer> c </answer>", "a\nb", "c"), ("<think>a</think> rest", "a", "rest"), ("<think>a</think>", "a", "<think>a</think>"),
        ("<THINK>x</Think><answer></answer>", "x", ""), ("<think>open", "", "<think>open"), (" plain ", "", "plain"), (None, "", ""), ("", "", ""),
    ],
)
def test_think_and_answer(spark, content, think, answer):
    assert one(spark, text.think_text(F.coalesce("s", F.lit(""))), s=content) == think
    assert one(spark, text.answer_text(F.col("s")), s=content) == answer


def test_stops_and_wrapping(spark):
    assert one(spark, text.trim_stops(F.col("s"), ["\nUser:", " END"]), s="a User: b\nUser: c") == "a "
    assert one(spark, text.trim_stops(F.col("s"), ["\nObservation:"]), s="xObservation: y") == "x"
    assert one(spark, text.trim_stops(F.col("s"), [" END", ""]), s="xENDy") == "xENDy" and one(spark, text.trim_stops(F.col("s"), ["\n\nA", "B"]), s="xAyB") == "x"
    assert one(spark, text.wrap_think(F.col("s")), s=" <think> a </think> ") == "<think>\na\n</think>" == one(spark, text.wrap_think(F.col("s")), s="a")
    assert [one(spark, text.is_cjk(F.col("s")), s=s) for s in ("", "法律", "法a", "法\n")] == [True, True, False, False]


# --- scoring -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n, want", [(0, 0.0), (256, 0.0), (384, -0.5), (512, -1.0), (900, -1.0)])
def test_length_penalty(spark, n, want):
    assert spark.range(1).select(scoring.length_penalty(F.lit(n)).alias("x")).first()["x"] == want


def test_reward(spark):
    r = one(spark, scoring.reward_parts(F.col("s"), think_cap=4, judged=F.lit(0.59)), s="<think>abcdef</think><answer>ok</answer>")
    assert (r["format"], r["think"], r["answer_penalty"], r["judge"]) == (1.0, 0.0, 0.0, 0.59)
    r = one(spark, scoring.reward_parts(F.col("s"), think_cap=4, judged=F.lit(1.7)), s="<think>ab</think>")
    assert (r["format"], r["think"], r["judge"], r["total"]) == (0.0, 0.5, 1.0, 1.5)


@pytest.mark.parametrize(
    "prediction, truth, choice, labels, got, right",
    [
        ("<think>no</think>The answer is Yes.", "yes", False, ["Yes", "No"], "yes", True), ("Not at all", "no", False, ["Yes", "No"], "not at all", True),
        ("Option 2, not b", "c", True, [], "2", True), ("(B)", "b", True, [], "b", True), ("none", "b", True, [], "none", False),
        ("It is breach of contract here", "Breach", False, ["Breach", "Breach of contract"], "Breach of contract", True), ("abreach", "x", False, ["breach"], "abreach", False),
        ("one\nFinal answer: Answer: liable", "liable", False, [], "liable", True), ("", "x", False, [], "", False), (None, "x", False, [], "", False), ("a.b", "a.b", False, ["a.b", "axb"], "a.b", True),
    ],
)
def test_final_answer(spark, prediction, truth, choice, labels, got, right):
    df = spark.createDataFrame([(prediction, truth, labels)], "p string, t string, l array<string>")
    e = scoring.final_answer(F.col("p"), F.col("t"), F.lit(choice), F.col("l"))
    row = df.select(e.alias("e"), scoring.is_correct(e, F.col("t"), F.lit(choice)).alias("ok")).first()
    assert (row["e"], row["ok"]) == (got, right)


def test_label_instruction(spark):
    say = lambda xs: one(spark, scoring.label_instruction(F.col("l")), l=xs)
    assert say(["Yes", " no "]) == "Reply with only Yes or No." and say(["A", "c"]).endswith("letter.") and say(["x", "y"]) == "Reply with only one of: x, y." and say([]).endswith("final answer.")


def test_inferred_labels(spark):
    rows = [("t", i, "Yes" if i % 2 else " yes") for i in range(5)] + [("t", 9, "No")] + [("many", i, str(i)) for i in range(13)] + [("long", 0, "x" * 81), ("fine", 0, "x" * 80), ("nothing", 0, None)]
    got = {r["task"]: list(r["labels"]) for r in reports.inferred_labels(spark.createDataFrame(rows, "task string, item_id long, answer string"), ["item_id"]).collect()}
    assert got["t"] == ["yes", "No"] and got["many"] == [] and got["long"] == [] and got["fine"] == ["x" * 80]


# --- reports ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 10, 101])
def test_nearest_rank(spark, n):
    rng = random.Random(n)
    v = [rng.randint(0, 9) for _ in range(n)]
    got = reports.nearest_rank(spark.createDataFrame([(x,) for x in v], "v long"), F.col("v")).collect()
    if not n:
        assert got == []
        return
    v.sort()
    assert [got[0][k] for k in ("n", "min", "max", "p50", "p90", "p99")] == [n, v[0], v[-1], *(v[int(n * q)] for q in (0.5, 0.9, 0.99))]


def test_rollup_of_rounded_values(spark):
    scores = spark.createDataFrame([("a", "1-1", 0.123456, 0.5), ("a", "1-2", 0.5, 0.0), ("b", "2-1", 0.25, 0.0)], "split string, task string, score double, abstention_rate double")
    sizes = spark.createDataFrame([("a", "1-1", 10)], "split string, task string, n long")
    s = {r["split"]: r for r in reports.split_scores(scores, sizes).collect()}
    assert s["a"]["total_samples"] == 10 and s["a"]["weighted_score_pct"] == 12.3456 and s["a"]["macro_score_pct"] == 31.1728
    assert s["b"]["total_samples"] is None and s["b"]["weighted_score_pct"] == 25.0
    o = reports.overall_scores(reports.split_scores(scores, sizes)).first()
    assert o["n_splits"] == 2 and o["weighted_score_pct"] == 12.3456 and o["macro_score_pct"] == round((31.1728 + 25) / 2, 4)


# --- splits ----------------------------------------------------------------------------------------------------


def test_split_sizes_and_independence_of_partitions(spark):
    rows = [(i, g) for g, n in (("a", 1), ("b", 2), ("c", 10), ("d", 50), ("e", 700), (None, 30)) for i in range(n)]
    rows = [(k, g) for k, (_, g) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k long, g string")
    out = splits.split_by_group(df, "g", ["k"]).collect()
    assert len(out) == len(rows)
    held = {g: sum(r["split"] == "validation" for r in out if r["g"] == g) for g in ("a", "b", "c", "d", "e", None)}
    assert held == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 35, None: 2}
    again = splits.split_by_group(df.repartition(7), "g", ["k"]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert splits.split_by_group(df.limit(0), "g", ["k"]).count() == 0


def test_rebalance(spark):
    rows = [(i, "big" if i < 300 else "mid" if i < 400 else "tiny" if i < 404 else "half") for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, g string")
    weight = curate.lookup({"big": 1.0, "mid": 1.0, "tiny": 1.0, "half": 0.1}, F.col("g"), 1.0)
    n = {r["g"]: (r["n"], r["target"]) for r in splits.rebalance_targets(df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g", "n", weight).collect()}
    assert n == {"big": (300, 596), "mid": (100, 300), "tiny": (4, 12), "half": (596, 60)}
    got = splits.rebalance(df, "g", ["k"], weight).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("d")).collect()
    assert {r["g"]: r["n"] for r in got} == {g: t for g, (_, t) in n.items()}
    assert all(r["d"] == min(n[r["g"]]) for r in got)


def test_positions(spark):
    df = spark.createDataFrame([(x * x * 1000,) for x in range(400)], "o long").repartition(5)
    assert [(r["o"], r["position"]) for r in splits.position(df, "o").orderBy("o").collect()] == [(x * x * 1000, x + 1) for x in range(400)]
    assert splits.position(df.limit(0), "o").count() == 0
    assert splits.pick_split({"test": True}) == "test" and splits.pick_split({}) == "ratio"


# --- near-duplicates ---------------------------------------------------------------------------------------------


def test_band_shape():
    assert dedup.band_shape(0.3) == (37, 3) and dedup.band_shape(0.85) == (8, 16)


def test_first_wins_is_the_sequential_scan(spark):
    rng = random.Random(8)
    texts = {}
    for i in range(150):
        if texts and rng.random() < 0.6:
            t = list(texts[rng.choice(list(texts))] or "x")
            for _ in range(rng.randint(0, 25)):
                t[rng.randrange(len(t))] = rng.choice("abcdefghij")
            texts[i] = "".join(t)
        else:
            texts[i] = "".join(rng.choice("abcdefghij") for _ in range(60))
    texts |= {150: None, 151: "", 152: "  ", 153: "ab", 154: "ab"}
    shape = dedup.MinHash()
    kept, index = [], set()
    for i, t in sorted(texts.items()):
        if not t or not t.strip():
            continue
        keys = set(enumerate(shape.band_keys(t).tolist()))
        if not keys & index:
            kept.append(i)
            index |= keys
    df = spark.createDataFrame(list(texts.items()), "k long, t string").repartition(6)
    assert sorted(r["k"] for r in dedup.first_wins(df, "k", "t", shape).collect()) == kept
    assert sorted(r["k"] for r in dedup.first_wins(df, "k", "t", shape, scanned=0).collect()) == kept  # in rounds to the end
    assert dedup.first_wins(df.limit(0), "k", "t", shape).count() == 0


def test_chain_keeps_both_ends(spark):
    a = "abcdefghijklmnopqrstuvwxyz0123456789"
    b, c = a[:18] + a[:18][::-1], "zyxw" * 9
    df = spark.createDataFrame([(1, a), (2, b), (3, b[18:] + c[:18]), (4, c)], "k long, t string")
    assert 1 in {r["k"] for r in dedup.first_wins(df, "k", "t").collect()}


# --- diverse samples -------------------------------------------------------------------------------------------------


def test_tfidf_weights(spark):
    df = spark.createDataFrame([(1, "abab"), (2, "abc"), (3, "xyz")], "k long, t string")
    grams = diverse.Grams.of(df, "t", min_df=1, max_df=1.0, sizes=(2,))
    ab, ba = (1 + np.log(2)) * (np.log(4 / 3) + 1), np.log(4 / 2) + 1
    want = np.array([ab, ba]) / np.hypot(ab, ba)
    assert np.allclose(sorted(grams.weights("abab")[1]), sorted(want)) and np.isclose(np.linalg.norm(grams.weights("abc")[1]), 1)
    assert len(grams.index) == 5 and len(grams.weights(None)[0]) == 0
    assert set(diverse.Grams.of(df, "t", features=1, min_df=1, max_df=1.0, sizes=(2,)).index) == {"ab"} and set(diverse.Grams.of(df, "t", min_df=2, max_df=1.0, sizes=(2,)).index) == {"ab"}
    rows = {r["k"]: np.array(r["vector"]) for r in diverse.projected(df, "k", "t", grams, 2048).collect()}
    full = {}
    for k, t in ((1, "abab"), (2, "abc"), (3, "xyz")):
        full[k] = np.zeros(5)
        i, w = grams.weights(t)
        full[k][i] = w
    assert all(abs(np.linalg.norm(rows[i] - rows[j]) - np.linalg.norm(full[i] - full[j])) < 0.1 for i in rows for j in rows)


def test_diverse_sample(spark):
    df = spark.createDataFrame([(i, "".join(random.Random(i % 7 * 100 + j).choice("abcd") for j in range(30)) + str(i)) for i in range(70)] + [(99, None)], "k long, t string")
    got = diverse.diverse_sample(df, "k", "t", 9, 200).groupBy("_sampled").count().collect()
    assert {r["_sampled"]: r["count"] for r in got} == {"selected": 9, "remaining": 61}
    assert diverse.exact_size(df.limit(3), df, "k", 5).count() == 5 and diverse.exact_size(df, df, "k", 5).count() == 5 and diverse.exact_size(df, df, "k", 500).count() == 71


def _topics(n, per):
    """Texts of n unlike topics, ``per`` alike ones of each."""
    words = [["".join(random.Random(t * 97 + w).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for w in range(12)] for t in range(n)]
    return [(t * per + j, " ".join(random.Random(t * per + j).sample(words[t], 10))) for t in range(n) for j in range(per)]


def test_diverse_sample_takes_every_topic(spark):
    df = spark.createDataFrame(_topics(12, 25), "k long, t string")
    got = diverse.diverse_sample(df, "k", "t", 24)  # twice the topics: k-means with as many may share one
    picked = {r["k"] // 25 for r in got.filter("_sampled = 'selected'").collect()}
    assert got.count() == 300 and len(picked) == 12
    assert diverse.diverse_sample(df, "k", "t", 12, pool=40).count() == 40
    assert {r["_sampled"] for r in diverse.diverse_sample(df, "k", "t", 400).collect()} == {"selected"}


def test_nearest_centres_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.random((50, 30)).astype(np.float32)
    x[8] = x[7]
    chosen = diverse.spread_rows(x, 9, rng, 4)
    assert len(set(chosen.tolist())) == 9 and len(diverse.spread_rows(x, 80, rng, 1)) == 49
    label, cost = diverse.nearest(x, x[chosen], 7)
    want = ((x[:, None] - x[chosen][None]) ** 2).sum(2)
    assert np.allclose(cost, want.min(1), atol=1e-5) and np.allclose(want[np.arange(50), label], want.min(1), atol=1e-5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, vector array<float>")
    near = {r["cluster"]: r["k"] for r in diverse.nearest_rows(df, "k", x[chosen]).collect()}
    assert near == {i: min(c, 7 if c == 8 else c) for i, c in enumerate(chosen.tolist())}
    # three far groups: each centre is the mean of one
    far = np.concatenate([rng.normal(m, 0.1, (400, 8)) for m in (0.0, 5.0, 9.0)]).astype(np.float32)
    centres = diverse.mini_batch_kmeans(far[rng.permutation(1200)], 3, 7)
    assert sorted(np.round(centres.mean(axis=1)).tolist()) == [0.0, 5.0, 9.0]


def test_diverse_kmeans_is_over_the_records(spark, tmp_path):
    from sieveworks import catalog

    rows = [(i, "s", "f", i, "i", t, "o") for i, t in _topics(4, 20)]
    spark.createDataFrame(rows, "record_id long, source string, _source_file string, _source_line long, instruction string, input string, output string").write.parquet(str(tmp_path / "sft_records.parquet"))
    assert catalog.queries()["diverse_kmeans"](spark, str(tmp_path)).filter("_sampled = 'selected'").count() == 80


# --- dialogs ---------------------------------------------------------------------------------------------------------


def _normalised(items, pop=True):
    """The rules as a plain loop."""
    if items is None or len(items) < 2:
        return None
    if pop and items[0][0] == "system":
        items = items[1:]
    if items and items[0][0] != "human":
        items = items[1:]
    if len(items) < 2:
        return None
    out = []
    for j, (who, value) in enumerate(items):
        if who not in ("human", "gpt"):
            break
        if who == ("human", "gpt")[j % 2]:
            out.append(value or "")
    return out if len(out) % 2 == 0 else None


def test_dialog_rules(spark):
    rng = random.Random(1)
    cases = [[(rng.choice(["human", "gpt", "human", "gpt", "system", "tool"]), str(k)) for k in range(rng.randint(0, 7))] for _ in range(300)] + [None, [("system", "s"), ("human", "q"), ("gpt", None)]]
    df = spark.createDataFrame(list(enumerate(cases)), "i long, d array<struct<from:string,value:string>>")
    for pop in (True, False):
        got = {r["i"]: r["v"] for r in df.select("i", dialog.history_values(F.col("d"), pop).alias("v")).collect()}
        for i, c in enumerate(cases):
            assert got[i] == _normalised(c, pop), c


def test_templates_and_pairs(spark):
    df = spark.createDataFrame([([["q1", "a1"], ["q2", ""]], "sys"), ([], None)], "h array<array<string>>, s string")
    got = [r["x"] for r in df.select(dialog.rendered(F.col("h"), F.col("s"), dialog.TEMPLATES["llama2"]).alias("x")).collect()]
    assert got == ["sys</s>[INST] q1 [/INST]a1</s>[INST] q2 [/INST]", ""]
    assert len(dialog.TEMPLATES) == 29
    got = [r["x"] for r in df.select(dialog.rendered(F.col("h"), F.lit(""), dialog.TEMPLATES["chatml"]).alias("x")).collect()]
    assert got[0].startswith("You are a helpful assistant.<|im_end|>\n<|im_start|>user\nq1<|im_end|>\n<|im_start|>assistant\na1<|im_end|>\n<|im_start|>user\nq2")
    assert "q1" not in df.select(dialog.rendered(F.col("h"), F.col("s"), dialog.TEMPLATES["deepseekcoder"]).alias("x")).first()["x"]
    turns = spark.createDataFrame([(1, 1, "gpt", "lost"), (1, 2, "human", "h"), (1, 3, "gpt", "a"), (1, 4, "gpt", "b"), (2, 5, "gpt", "other file")], "part long, ord long, `from` string, value string")
    assert [(r["human"], r["gpt"]) for r in dialog.human_gpt_pairs(turns, "ord").orderBy("ord").collect()] == [("h", "a"), ("h", "b")]


@pytest.mark.parametrize(
    "reply, content, name, arguments",
    [
        ('Thought: x\nAction: search\nAction Input: {"q": 1}\nObservation: r', "x", "search", '{"q": 1}'),
        ("Thought: x\nAction: search\nAction Input: 1", "x", "search", "1"),  # without an observation
        ("a\nAction: A\nAction Input: 1\nObservation: o\nAction: B\nAction Input: 2", "a", "A", "1"),  # the first call
        ("x\nAction Input: 2\nAction: B", "x\nAction Input: 2\nAction: B", "", ""),  # no call
        ("x\nAction: \nAction Input: 2", "x\nAction: \nAction Input: 2\nObservation:", "", ""),
        ("Thought\nFinal Answer: 42", "42", "", ""), ("Final Answer: 42", "Final Answer: 42", "", ""), ("a\nFinal Answer: 1\nFinal Answer: 2 ", "2 ", "", ""),
        ("o\nObservation: r\nAction: A\nAction Input: 1", "o\nObservation: r", "A", ""), ("", "", "", ""), (None, "", "", ""),
    ],
)
def test_parsed_reply(spark, reply, content, name, arguments):
    r = one(spark, dialog.parsed_reply(F.col("s")), s=reply)
    assert (r["content"], r["name"], r["arguments"], r["finish_reason"]) == (content, name, arguments, "tool_calls" if name else "stop")


def test_chat_requests(spark):
    say = lambda role, content, call=None: (role, content, call)
    schema = "id int, messages array<struct<role string, content string, tool_calls struct<name string, arguments string>>>, tools array<struct<name string, name_for_model string, name_for_human string, description string, description_for_model string, parameters string>>"
    tools = [("find", None, "Finder", "finds", None, "{}"), ("sum", "add", None, None, "adds", None)]
    rows = [
        [say("system", "\ns "), say("user", "q1"), say("assistant", "\na1 "), say("user", "q2")],
        [say("user", "q"), say("assistant", "", ("find", "{}")), say("function", "seen")],
        [say("user", "q"), say("assistant", None, ("find", "{}")), say("function", "seen"), say("assistant", "done"), say("user", "more")],
        [say("user", "q")],
        [say("assistant", "a")], [say("user", "a"), say("user", "b")], [say("user", "a"), say("tool", "b")], [say("user", "q"), say("function", "r")], [say("assistant", "a"), say("user", "b")], [], None,
    ]
    df = spark.createDataFrame([(i, m, None) for i, m in enumerate(rows)] + [(100 + i, m, tools) for i, m in enumerate(rows[:4])], schema)
    got = {r["id"]: r["request"] for r in dialog.chat_requests(df, "messages", "tools").collect()}
    plain = {i: (r["system"], r["history"], r["query"]) for i, r in got.items()}
    assert plain[0] == ("s", [["q1", "a1"]], "q2") and plain[3] == ("", [], "q")
    call = "Thought: \nAction: find\nAction Input: {}\nObservation: seen"
    assert plain[1] == ("", [["q", call + "\nThought:"]], None) and plain[2] == ("", [["q", call + "\ndone"]], "more")
    assert [got[i]["error"] for i in range(4, 11)] == [
        "no user message", "two user messages in a row", "unknown role", "a function without an assistant's call", "something before the first user message", "no user message", "no user message",
    ]
    assert all(plain[i] == (None, None, None) for i in range(4, 11)) and all(got[i]["error"] is None for i in (0, 1, 2, 3, 100, 101, 102, 103))
    intro = got[103]["query"].removesuffix("\n\nQuestion: q")
    assert intro.startswith("Answer the following questions as best you can.") and intro.endswith("Begin!")
    assert "find: Call this tool to interact with the Finder API. What is the Finder API useful for? finds Parameters: {}\n\nadd: Call this tool to interact with the sum API. What is the sum API useful for? adds Parameters: {}" in intro
    assert "should be one of [find, add]" in intro
    assert plain[100] == ("s", [[intro + "\n\nQuestion: q1", dialog.FINAL_THOUGHT + "a1"]], "q2")
    assert plain[102][1] == [[intro + "\n\nQuestion: q", call + "\n" + dialog.FINAL_THOUGHT + "done"]]
    assert dialog.chat_requests(df.drop("tools")).filter("id < 4").count() == 4


def test_small_helpers(spark):
    assert curate.selected_tasks(["a", "b", "c"], "c, a") == ["a", "c"] and curate.selected_tasks(["a", "b"], suite=["b"]) == ["b"] and curate.selected_tasks(["a", "b"], first=1) == ["a"]
    df = spark.createDataFrame([("x/cail2018.jsonl", "r"), ("y/eval_1.jsonl", " "), (None, None)], "_source_file string, ref string")
    assert curate.without_files(df, ["CAIL2018"]).count() == 2
    assert [r["x"] for r in df.select(curate.split_of_file(F.col("_source_file")).alias("x")).collect()] == ["train", "validation", "train"]
    assert curate.require_references(df, "ref").count() == 3
    with pytest.raises(ValueError):
        curate.require_references(df.filter("ref = ' '"), "ref")
    assert one(spark, curate.filled("a {x} b {y}", x=F.col("x"), y=F.col("y")), x=" 1 ", y=None) == "a 1 b "
    with pytest.raises(ValueError):
        curate.filled("{z}", x=F.lit(1))
    assert one(spark, curate.record_key(F.col("x"), F.lit(7)), x=" ") == "7"
    assert curate.all_files(df, spark.createDataFrame([("z",)], "other string")).columns == ["_source_file", "ref", "other"]
    assert sorted(r["ref"] or "" for r in splits.shuffled(df, ["ref"]).collect()) == ["", " ", "r"]


def test_sharegpt_validity(spark):
    cases = [([], True), ([("human", "q")], True), ([("bot", "q")], False), ([("human", None)], False), (None, False), ([("human", "q"), (None, "x")], False)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i long, d array<struct<from:string,value:string>>")
    assert [r["v"] for r in df.orderBy("i").select(curate.sharegpt_valid(F.col("d")).alias("v")).collect()] == [v for _, v in cases]


# --- tokens ------------------------------------------------------------------------------------------------------------


def test_masks(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], 2), ([1, 2], 2), ([], 0)], "ids array<int>, p int")
    got = [r["m"] for r in df.select(tokenized.masked(F.col("ids"), F.col("p"), 4).alias("m")).collect()]
    assert [(list(m["input_ids"]), list(m["labels"])) for m in got] == [([1, 2, 3, 4], [-100, -100, 3, 4]), ([1, 2], [-100, -100]), ([], [])]
    assert [r["x"] for r in df.select(tokenized.has_labels(tokenized.masked(F.col("ids"), F.col("p"), 4)["labels"]).alias("x")).collect()] == [True, False, False]
    assert one(spark, tokenized.char_ids(F.col("s")), s="a法😀") == [ord(c) for c in "a法😀"]
    got = tokenized.encoded(spark.createDataFrame([("a b",), (None,)], "t string"), lambda ts: [[len(w) for w in t.split()] for t in ts], ids="t").collect()
    assert [r["ids"] for r in got] == [[1, 1], []]
    assert spark.range(1).select(tokenized.tail_window(F.sequence(F.lit(1), F.lit(100)), 50, 32).alias("x")).first()["x"] == list(range(91, 101))


def test_dialog_budget(spark):
    df = spark.createDataFrame([([[1, 2], [3]], [[4, 5], [6, 7]])], "s array<array<int>>, t array<array<int>>")
    r = df.select(tokenized.dialog_budget(F.col("s"), F.col("t"), 100, 9).alias("x")).first()["x"]
    assert r["input_ids"] == [1, 2, 4, 5, 9, 3, 6, 7, 9] and r["labels"] == [-100, -100, 4, 5, 9, -100, 6, 7, 9]
    r = df.select(tokenized.dialog_budget(F.col("s"), F.col("t"), 6, 9).alias("x")).first()["x"]
    assert r["input_ids"] == [1, 2, 4, 5, 9]


# --- generation ----------------------------------------------------------------------------------------------------------


def test_generation(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, None)], "k long, p string, output_model string").withColumn("reasoning", F.lit("r"))
    reply = lambda ps: [json.dumps({"reasoning": "because " + p, "output_model": p}) if p else "no json" for p in ps]
    got = generate.with_reasoning(generate.generated(df, "p", "reply", reply), F.col("reply"), 9).orderBy("k").collect()
    assert [(r["reasoning"], r["output_model"], r["generation_ok"]) for r in got] == [("because a", "a", True), ("because b", "b", True), ("", "", False)]
    picked = generate.selected_for_generation(df, "k", curate.needs_generation(), 0, 1).orderBy("k").collect()
    assert [r["selected"] for r in picked] == [True, False, False]
    assert [r["k"] for r in generate.unfinished(df, df.filter("k = 2"), "k").orderBy("k").collect()] == [1, 3]

    def broken(prompts):
        raise RuntimeError("broken")

    with pytest.raises(Exception, match="broken"):
        generate.generated(df, "p", "reply", broken, 1).collect()


def test_generation_per_file(spark):
    r = random.Random(3)
    rows = [(f, n, None if r.random() < 0.5 else "x") for f, size in (("a", 9000), ("b", 30), ("c", 3), (None, 40)) for n in range(1, size + 1)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "f string, n long, output_model string").withColumn("reasoning", F.lit("r"))
    for start, limit in ((0, 0), (10, 0), (0, 12), (10, 5), (4500, 1000)):
        want = set()
        for file in ("a", "b", "c", None):
            lines = sorted((n, o) for f, n, o in ((f, n, o or "") for f, n, o in rows) if f == file)
            needed = [n for place, (n, o) in enumerate(lines, 1) if place > start and not o]
            want |= {(file, n) for n in (needed[:limit] if limit else needed)}
        got = generate.selected_per_file(df, "f", "n", curate.needs_generation(), start, limit)
        assert got.count() == len(rows) and {(x["f"], x["n"]) for x in got.filter("selected").collect()} == want


@pytest.mark.parametrize("s, want", [('{"a": 1}', {"a": 1}), ('say {"a": 1} so', {"a": 1}), ("[1]", None), ("{'a': 1}", None), ("", None), (None, None), ("} {", None)])
def test_json_object(s, want):
    assert generate.json_object(s) == want


def test_chat_url():
    assert generate.chat_url("host") == "http://host/v1/chat/completions" == generate.chat_url("http://host/") == generate.chat_url("http://host/v1/chat/completions")
    assert generate.chat_url("https://host/v1") == "https://host/v1"
    with pytest.raises(ValueError):
        generate.chat_url(" ")


def test_weights():
    assert curate.parse_weights("mcq=2, other=0.1")["mcq"] == 2.0
    with pytest.raises(ValueError):
        curate.parse_weights("mcq")


def test_precheck_with_lengths(spark):
    df = spark.createDataFrame([("i", "x", "o", 3, 3), (None, "x", None, 1, 2), ("i", " ", "o", 1, 2), ("i", "x", "o", 1, 2)], "instruction string, input string, output string, p int, n int")
    got = [r["x"] for r in df.select(curate.precheck_reason(prompt_len=F.col("p"), total_len=F.col("n")).alias("x")).collect()]
    assert got == ["truncated_prompt_only", "missing_fields:instruction,output", "empty_required_field", "ok"]


def test_clashing_names_and_nulls_in_every_column(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(None,) * 12], T.StructType([T.StructField(c, T.StringType()) for c in ("record_id", "instruction", "input", "reasoning", "output", "output_model", "source", "system_prompt", "task_name", "_source_file", "rank", "split")]))
    assert curate.enrich(df).first()["task_name"] == "other"
    assert df.select(curate.chatml(curate.sft_messages(F.col("system_prompt"))).alias("x")).first()["x"].startswith("<|im_start|>user")
    assert curate.known_and_reasoned(df).count() == 1 and curate.consistent(df).count() == 1 and curate.min_length(df).count() == 0


def test_replies_are_asked_for_again(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string").coalesce(1)
    seen: dict[str, int] = {}

    def flaky(prompts):
        out = []
        for p in prompts:
            seen[p] = seen.get(p, 0) + 1
            out.append('{"reasoning": "r", "output_model": "%s"}' % p if p == "a" or seen[p] > 1 else "no JSON")
        return out

    got = {r["k"]: (r["reasoning"], r["output_model"]) for r in generate.reasoned(df, "p", flaky, wait=0.0).collect()}
    assert got == {1: ("r", "a"), 2: ("r", "b")}
    with pytest.raises(Exception, match="not as wanted"):
        generate.reasoned(df, "p", lambda ps: ['{"reasoning": "r"}' for _ in ps], wait=0.0).collect()


def test_judge_errors_give_the_default(spark):
    def judge(questions):
        return [1 / 0 if "bad" in q else 7.0 for q in questions]

    df = spark.createDataFrame([(1, "good", "ref"), (2, "bad", "ref"), (3, "good", " "), (4, None, "ref")], "k long, answer string, ref string")
    got = {r["k"]: r["judge"] for r in generate.judged(df, ["answer"], "ref", judge, 0.3).collect()}
    assert got == {1: 1.0, 2: 0.3, 3: 0.3, 4: 1.0}


def test_token_ids_come_as_one_list():
    assert tokenized.flat_ids({"input_ids": [[1, 2]]}) == tokenized.flat_ids(np.array([1, 2])) == tokenized.flat_ids([1, 2]) == tokenized.flat_ids([[1, 2]]) == [1, 2]
    assert tokenized.flat_ids([]) == []


def test_small_projections(spark):
    df = spark.createDataFrame([(1, [("human", "a")], "x", "")], "k long, items array<struct<`from` string, value string>>, text string, prompt string")
    assert curate.items_as_conversations(df).columns == ["conversations"] and curate.not_empty(df).count() == 0 and curate.not_empty(df, "text").count() == 1
    assert one(spark, scoring.raw_prompt(F.col("p"), F.col("s")), p="q", s=None) == "q" and one(spark, scoring.raw_prompt(F.col("p"), F.col("s")), p=None, s="sys") == "sys\n\n"
