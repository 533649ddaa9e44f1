"""Problems 1 and 2: endings, truncation, defects."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveworks.llm.plain import plain_form
from sieveworks.llm import completeness as c
from sieveworks.llm import pairs as p

SCHEMA = "record_id long, instruction string, input string, reasoning string, output string, source string, _source_file string, extra string, is_cut string, state string"

PROMPT = "The court in Aldford adjourned the case because the clerk refused to sign the register. The claim is stayed."


@pytest.mark.parametrize(
    "value, state",
    [
        ("The claim is dismissed.", c.DONE),
        ("The claim is dismissed. On the second point the", c.OPEN),
        ("驳回上诉，维持原判。争议焦点为", c.OPEN),
        ("驳回上诉，维持原判。争议焦点为�", c.CUT),
        ("The order is void. The claim for the \\u4", c.CUT),
        ("争议焦点为担保责任的</ans", c.CUT),
        ("The order is void. The claim for the [...", c.CUT),
        ("争议焦点为担保责任的范围，结论是…", c.CUT),
        ("The order is void...", c.CUT), ("The order is void. ...", c.DONE),
        ("其余部分另案解决。价值13.", c.OPEN),
        ("盗窃罪，有期徒刑53个月", c.LABEL), ("本案构成诈骗罪，鉴于宋某在共同", c.OPEN), ("黄某乙要求返还73元的", c.OPEN), ("被告应当赔偿", c.LABEL), ("是", c.LABEL),
        ("Unfair dismissal", c.LABEL),
        ("ACD", c.LABEL),
        ("Why Aldford Rail Ltd Loses On Causation Before The Transfer", c.LABEL),
        ("The claim is stayed.\n- a parking ticket\n- the delivery log", c.ENTRY),
        ("The claim is stayed. See file 13, p. 22", c.DONE),
        ("驳回诉讼请求。详见19号卷宗第25页", c.DONE),
        ("The claim is stayed. (end of note)", c.DONE),
        ("<think>\nThe claim is stayed.\n</think>", c.DONE),
        ("<think>\nThe claim for the equipment is stayed and the\n</think>", c.OPEN),
        ("the clerk refused to sign the register", c.DONE),  # quoted; the prompt goes on with a stop
        ("adjourned the case because the clerk refused", c.OPEN),  # quoted, but the prompt's sentence goes on
        # a terminator within something still open is no end; markup that needn't be closed is none
        ("他说：“我不知道。", c.OPENED), ("The court (having heard the parties.", c.OPENED), ("```json\n{\"a\": 1}.", c.OPENED), ("<think>I see the case. It is so.", c.OPENED),
        ('{"answer": "It is so.', c.OPENED), ('He said "yes. And left.', c.OPENED), ('He said "yes". And left.', c.DONE), ('a 5" pipe. Done.', c.DONE), ("<p>The claim is stayed.", c.DONE),
        ('"The claim is stayed. \nWho lost?"', c.DONE), ("The clerk (of Aldford, who refused to sign the register and", c.CUT), ("if a <b then it was so.", c.DONE),
        ('The file <a href="' + "http://a.b/" * 30, c.CUT), ("The claim " + "." * 300, c.CUT), ("The claim is \\u4e", c.CUT), ("The claim is &nb", c.CUT),
        ("", c.NONE), ("  　", c.NONE), (None, c.NONE), ("<answer></answer>", c.NONE), ("**Answer:** ", c.NONE), ("...", c.NONE),
    ],
)
def test_endings(value, state):
    assert c.ending(value, "Answer the question", PROMPT) == state


def test_open_marks():
    assert c.open_marks("(a [b] “c”") == ["("]
    assert c.open_marks("<think>a</think> ```x```") == []
    assert c.open_marks("<think>a ```x") == ["<think", "```"]
    assert c.open_marks("(a [b) c") == [] and c.open_marks("<b>(a</b> c") == [] and c.open_marks("<br>x<li>y") == []


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.text(max_size=50), st.text(max_size=100))
def test_any_text_has_an_ending(value, ins, inp):
    assert c.ending(value, ins, inp) in {c.DONE, c.CUT, c.OPENED, c.OPEN, c.ENTRY, c.LABEL, c.NONE}


def _rows(*rows):
    return [(i, ins, inp, rea, out, src, f"{src}_sft_00001.jsonl", "x", "y", "z") for i, ins, inp, rea, out, src in rows]


def test_truncation(spark):
    stop = "The claim is dismissed and each party bears its own costs."
    rows = [(i, "Summarise", "Facts.", None, stop, "a") for i in range(10)]
    rows += [(100, "Summarise", "Facts.", "I rely on the delivery log, because it was", stop, "a")] * 2  # delivered twice
    rows += [(101, None, None, None, "The claim for the unpaid equipment is dis", "a"), (102, None, None, "", None, "a")]
    # a source that never ends its prose: only its limit tells
    rows += [(200 + i, "Q", "F", None, f"the finding in matter number {i} is one of breach by the second defendant"[: 60 + i % 3], "b") for i in range(10)]
    df = spark.createDataFrame(_rows(*rows), SCHEMA)
    found = {(r[0], r[1]) for r in c.truncated_values(df).collect()}
    assert (100, "reasoning") in found and (101, "output") in found
    assert not {f for f in found if f[0] < 100 or f[0] == 102}
    rates = {(r["source"], r["field"]): r for r in c.truncation_rates(df).collect()}
    assert rates["a", "output"]["n_values"] == 12 and rates["a", "output"]["n_cut"] == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert c.truncated_values(empty).count() == 0 and p.defective_fields(empty).count() == 0


def test_marks_left_open_are_judged_by_the_source(spark):
    """Behind a stop: a cut where the source closes its marks, a habit where it doesn't."""
    stop, odd = "The claim (for the equipment) is dismissed.", "The claim (for the equipment is dismissed."
    rows = [(i, "Q", "F", None, stop, "a") for i in range(20)] + [(50, "Q", "F", None, odd, "a")]
    rows += [(100 + i, "Q", "F", None, odd if i % 2 else stop, "b") for i in range(20)] + [(300, "Q", "F", None, odd, "c")]
    found = {r["record_id"] for r in c.truncated_values(spark.createDataFrame(_rows(*rows), SCHEMA)).collect()}
    assert found == {50, 300}


CASE = "于某军于2015年3月17日到派出所报案，称其在临河的药店柜台附近遭遇他人冒领名牌背包一只，损失约三百元。双方协商未果，遂提起诉讼。"


@pytest.mark.parametrize(
    "field, value, ins, inp, defect",
    [
        ("output", None, "请作答", CASE, "empty"), ("output", " 　", "请作答", CASE, "empty"), ("output", "暂无答案", "请作答", CASE, "empty"), ("output", "<answer></answer>", "请作答", CASE, "empty"),
        ("reasoning", None, "请作答", CASE, None), ("reasoning", "", "请作答", CASE, None),
        ("output", CASE, "请作答", CASE, "copy"), ("output", "### 答案\n" + CASE.replace("，", ", "), "请作答", CASE, "copy"),
        ("output", CASE[: len(CASE) * 2 // 3], "请作答", CASE, "copy"), ("output", CASE[:25], "请作答", CASE, None),
        ("output", "根据案情给出罪名", "根据案情给出罪名", CASE, "copy"),
        ("output", "抱歉，我没有办法回答这类涉案问题。", "请作答", CASE, "refusal"), ("reasoning", "I'm sorry, but I can't help with this matter.", "Answer the question", "The facts.", "refusal"),
        ("output", "Unfortunately, it is not possible for me to assess the case, and a local adviser would serve you better.", "Answer the question", "The facts.", "refusal"),
        ("output", "With respect, providing an answer would go beyond what I may do.", "Answer the question", "The facts.", "refusal"), ("output", "J'ai lu le dossier. Désolé, il m'est impossible d'analyser ce dossier.", "Expliquez la situation au lecteur", "Le dossier.", "refusal"),
        ("reasoning", "The real question for me is mitigation, not the sum of $517. I do not rely on Ms Ossgard, whose memory shifted twice.", "Answer the question", "The facts.", None),
        ("output", "证人梁某甲曾拒绝回答提问，并当庭表示抱歉。", "请作答", CASE, None), ("output", "The witness said he could not help and refused to answer.", "Answer the question", "The facts.", None),
        # the length of an answer, of a sentence, and who is named in it don't matter; whose words they are does
        ("output", "很抱歉，我无法就被告的责任作出判断。", "请作答", CASE, "refusal"), ("output", "很抱歉，我无法就该责任作出判断。", "请作答", CASE, "refusal"),
        ("output", "I can't help with this matter. " + "The register has many pages and each of them is signed. " * 50, "Answer the question", "The facts.", "refusal"),
        ("output", "Having read " + "the long register and " * 40 + "the rest, I am unable to assist with this request.", "Answer the question", "The facts.", "refusal"),
        ("output", 'The witness said: "I can\'t answer that." The court accepts it.', "Answer the question", "The facts.", None), ("output", "证人称我不便作答，随后离开。", "请作答", CASE, None),
        ("output", "The claim fails. " * 9 + "I can not say more.", "Answer the question", "The facts.", None),
        ("output", "The claim is dismissed and the rest is stayed.", "请判断本案罪名", CASE, "other_lang"), ("output", "Le tribunal relève que la demande est rejetée.", "Explain the position to the reader", "The facts of it.", "other_lang"),
        ("output", "The claim is dismissed and the rest is stayed.", "请判断本案罪名（输出语言：英语）", CASE, None), ("output", "本案构成盗窃罪。", "State the outcome and reply in Chinese", "The facts.", None),
        ("output", "ACD", "请完成下列选择题", CASE, None), ("output", "12", "请完成下列选择题", CASE, None), ("output", "盗窃罪", "请判断本案罪名", CASE, None),
    ],
)
def test_defects(field, value, ins, inp, defect):
    assert p.defect_of(field, value, ins, inp, plain_form(ins), plain_form(inp)) == defect


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    assert p.common_subsequence(a, b) == row[-1]
    assert all((p.common_subsequence(a, b, least) >= least) == (row[-1] >= least) for least in range(14))


def test_long_copies_are_decided_by_the_subsequence():
    """Texts beyond any table: half of the prompt, with an edit every few characters."""
    import random

    rng = random.Random(4)
    prompt = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    half = prompt[:16_500]
    edited = "".join(ch if i % 24 else "0" for i, ch in enumerate(half))
    assert p.is_copy(edited, "answer", prompt)
    assert not p.is_copy(edited[:14_000], "answer", prompt)


def test_one_defect_per_field(spark):
    rows = [(1, "请作答", CASE, "抱歉，恕难提供具体结论。", CASE, "a"), (2, "请作答", CASE, "考虑到本案的案情较为复杂，我认为处理幅度应当与损失", None, "a"), (3, None, None, None, "很长" * 50_000 + "。", "a"), (1, "请作答", CASE, "抱歉，恕难提供具体结论。", CASE, "a")]
    got = sorted(tuple(r) for r in p.defective_fields(spark.createDataFrame(_rows(*rows), SCHEMA)).collect())
    assert got == [(1, "output", "copy"), (1, "reasoning", "refusal"), (2, "output", "empty"), (2, "reasoning", "truncated")]
    assert {(r["source"], r["defect"]): r["n_records"] for r in p.defect_rates(spark.createDataFrame(_rows(*rows), SCHEMA)).filter("field = 'output'").collect()} == {("a", "copy"): 1, ("a", "empty"): 1, ("a", "none"): 1}


def test_long_texts_take_no_squared_time():
    for v in ("word" + " " * 400_000 + "word", "<a" * 100_000, "</a>" * 50_000, "." * 200_000 + "x", "(" * 200_000, "\\" * 100_001, "a b " * 100_000 + "the claim"):
        c.ending(v, "x", "y" * 1000)
        p.defect_of("output", v, "Answer", v[: len(v) // 2], "answer", plain_form(v[: len(v) // 2]))
