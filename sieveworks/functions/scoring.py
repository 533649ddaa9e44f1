"""Scoring of model outputs: rewards, answer extraction and matching, as Column builders."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions.text import answer_text, collapse, has_pair, sanitize, strip, think_text, visible_length

# --- rewards -----------------------------------------------------------------------------------------


def length_penalty(length: Column, soft: int = 256, hard: int = 512, most: float = 1.0) -> Column:
    """0 up to ``soft``, -``most`` from ``hard`` on, linear between; negative limits are 0, and ``hard`` is at least ``soft`` + 1."""
    soft, hard = max(soft, 0), max(hard, 0)
    hard = max(hard, soft + 1)
    between = -(length - soft).cast("double") / float(hard - soft) * most
    return F.when(length <= soft, F.lit(0.0)).when(length >= hard, F.lit(-float(most))).otherwise(between)


def reward_parts(
    content: Column, format_reward: float = 1.0, think_cap: int = 2048, think_most: float = 1.0, soft: int = 256, hard: int = 512, penalty: float = 1.0,
    judged: Column | None = None, judge_least: float = 0.6, judge_weight: float = 1.0,
) -> Column:
    """STRUCT of format, think, answer_penalty, judge and total; a judgement below ``judge_least`` takes the think reward away."""
    has_format = has_pair(content, "think") & has_pair(content, "answer")
    fmt = F.when(has_format, F.lit(float(format_reward))).otherwise(F.lit(0.0))
    n_think = visible_length(think_text(content))
    think = F.least(n_think, F.lit(think_cap)).cast("double") / float(max(think_cap, 1)) * think_most
    answer = length_penalty(visible_length(answer_text(content)), soft, hard, penalty)
    if judged is None:
        judge = F.lit(0.0)
    else:
        judge = F.least(F.greatest(judged, F.lit(0.0)), F.lit(1.0))
        think = F.when(judge < judge_least, F.lit(0.0)).otherwise(think)
    total = fmt + think + answer + judge * judge_weight
    return F.struct(fmt.alias("format"), think.alias("think"), answer.alias("answer_penalty"), judge.alias("judge"), total.alias("total"))


def strict_format(content: Column) -> Column:
    """1.0 for think and answer blocks on one line with nothing around them."""
    return F.when(content.rlike(r"\A<think>.*?</think><answer>.*?</answer>\n?\z"), 1.0).otherwise(0.0)


def plain_answer(content: Column) -> Column:
    """Body of the first answer block in lower-case tags, else the text, stripped."""
    return F.when(content.rlike(r"(?s)<answer>.*?</answer>"), strip(F.regexp_extract(content, r"(?s)<answer>(.*?)</answer>", 1))).otherwise(sanitize(content))


def final_number(text: Column) -> Column:
    """What follows the last '####' without commas and blanks; null without one."""
    return F.when(text.contains("####"), F.regexp_replace(F.substring_index(text, "####", -1), r"[,\s]", ""))


# --- labels and answers --------------------------------------------------------------------------------


def normalize_label(c: Column) -> Column:
    return F.lower(collapse(c))


def strip_think_blocks(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?i)</?think>", ""))


def normalize_text(c: Column) -> Column:
    return normalize_label(strip_think_blocks(F.coalesce(c, F.lit(""))))


def choice_letter(c: Column) -> Column:
    """0 to 4 as a to e; other texts as they are."""
    return F.when(c.rlike(r"\A[0-4]\z"), F.translate(c, "01234", "abcde")).otherwise(c)


def matching_label(text: Column, labels: Column) -> Column:
    """The longest label that stands in the normalised text between other than letters and digits; its original spelling, null without one."""
    keyed = F.transform(labels, lambda x, i: F.struct((-F.length(normalize_label(x))).alias("size"), i.alias("at"), x.alias("label"), normalize_label(x).alias("key")))
    ordered = F.array_sort(F.filter(keyed, lambda x: x["key"] != ""))
    quoted = lambda k: F.concat(F.lit(r"(?:\A|[^a-z0-9])\Q"), F.replace(k, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?:[^a-z0-9]|\z)"))
    return F.try_element_at(F.transform(F.filter(ordered, lambda x: F.contains(text, x["key"]) & F.rlike(text, quoted(x["key"]))), lambda x: x["label"]), F.lit(1))


def final_answer(prediction: Column, truth: Column, is_choice: Column, labels: Column) -> Column:
    """The answer that a prediction gives: yes or no, a choice, a label, or its last line without 'final answer:'."""
    text, want = normalize_text(prediction), normalize_text(truth)
    yes_no = F.nullif(F.regexp_extract(text, r"(?U)\b(yes|no)\b", 1), F.lit(""))
    digit = F.nullif(F.regexp_extract(text, r"(?U)\b([0-4])\b", 1), F.lit(""))
    letter = F.nullif(F.regexp_extract(text, r"(?U)\b([a-e])\b", 1), F.lit(""))
    lines = F.filter(F.transform(F.split(strip_think_blocks(F.coalesce(prediction, F.lit(""))), r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != "")
    last = normalize_text(F.try_element_at(lines, F.lit(-1)))
    last = F.when(last.startswith("final answer:"), strip(F.substring(last, 14, 1 << 30))).otherwise(last)
    last = F.when(last.startswith("answer:"), strip(F.substring(last, 8, 1 << 30))).otherwise(last)
    by_line = F.when(F.size(lines) == 0, text).otherwise(F.coalesce(matching_label(last, labels), last))
    return F.coalesce(F.when(want.isin("yes", "no"), yes_no), F.when(is_choice, F.coalesce(digit, letter)), matching_label(text, labels), by_line)


def is_correct(extracted: Column, truth: Column, is_choice: Column) -> Column:
    """Equal; or, unless both are yes/no or the truth is a choice, one within the other. Nothing extracted is wrong."""
    got, want = normalize_text(extracted), normalize_text(truth)
    got, want = F.when(is_choice, choice_letter(got)).otherwise(got), F.when(is_choice, choice_letter(want)).otherwise(want)
    strict = (want.isin("yes", "no") & got.isin("yes", "no")) | (is_choice & want.isin("a", "b", "c", "d", "e"))
    return F.when(got == "", False).when(got == want, True).when(strict, False).otherwise(F.contains(got, want) | F.contains(want, got))


def contains_truth(prediction: Column, truth: Column) -> Column:
    """The older rule: the truth occurs in what follows the last closed think block, without regard to case."""
    return F.contains(F.lower(F.substring_index(F.coalesce(prediction, F.lit("")), "</think>", -1)), F.lower(sanitize(truth)))


# --- prompts for items -----------------------------------------------------------------------------------


def label_instruction(labels: Column) -> Column:
    """How the answer is asked for, by the labels there are. The texts are fixed values."""
    keys = F.transform(labels, normalize_label)
    within = lambda *xs: F.size(F.array_except(keys, F.array(*[F.lit(x) for x in xs]))) == 0
    return (
        F.when(F.size(labels) == 0, F.lit("Reply with only the final answer."))
        .when(within("yes", "no"), F.lit("Reply with only Yes or No."))
        .when(within("a", "b", "c", "d", "e"), F.lit("Reply with only the best answer letter."))
        .otherwise(F.concat(F.lit("Reply with only one of: "), F.array_join(labels, ", "), F.lit(".")))
    )


#: Which columns a task needs for a prompt, tried in this order, and the prompt. {x} stands for a column whole,
#: {x!} cut to the limit, {x!!} cut to at least STATUTE_LIMIT, {x?} where the task has it; {ask} asks for the answer, {amount} for an amount where the question does.
ITEM_PROMPTS: Sequence[tuple[tuple[str, ...], str]] = (
    (("choice_0",), "{question}\n\n{options}\n\nReply with only the best answer choice using either the letter a-e or the index 0-4."),
    (("question", "contract"), "Contract:\n{contract!}\n\nQuestion: {question}\n\n{ask}"),
    (("question", "text"), "Text:\n{text!}\n\nQuestion: {question}\n\n{ask}"),
    (("policy", "claim"), "Policy:\n{policy!}\n\nClaim:\n{claim}\n\n{ask}"),
    (("contract",), "Contract Scenario:\n{contract!}\n\n{ask}"),
    (("text", "citation"), "Legal Statement:\n{text}\n\nCitation: {citation}\n\n{ask}"),
    (("Citation", "Paragraph"), "Citation: {Citation}\n\nParagraph:\n{Paragraph}\n\n{ask}"),
    (("question", "year"), "Year: {year}\n\nQuestion: {question}\n\n{ask}"),
    (("question",), "{question}\n\n{ask}"),
    (("issue", "text"), "Issue: {issue}\n\nFact Pattern:\n{text}\n\n{ask}"),
    (("slice",), "Context: {slice}\nText: {text}\n\n{ask}"),
    (("description", "statute"), "Statute: {statute!!}\nDescription: {description}\nQuestion: {question?}\n\nText: {text!!}\n\n{amount}"),
    (("text", "description"), "Policy Text:\n{text!}\n\nDescription: {description}\n\n{ask}"),
    ((), "{text?}\n\n{ask}"),
)

#: The older prompts.
OLD_ITEM_PROMPTS: Sequence[tuple[tuple[str, ...], str]] = (
    (("choice_0",), "{question}\n\n{options}\n\nSelect the best answer by letter (a-e):"),
    (("question", "contract"), "Contract:\n{contract!}\n\nQuestion: {question}\n\n{ask}"),
    (("question",), "{question}\n\n{ask}"),
    (("slice",), "Context: {slice}\nText: {text}\n\nAnswer Yes or No:"),
    (("description", "statute"), "Statute: {statute}\nDescription: {description}\nQuestion: {question?}\n\nText: {text}\n\n{ask}"),
    ((), "{text?}\n\n{ask}"),
)

#: The least limit of a statute, and how an amount is asked for.
STATUTE_LIMIT = 12_000
AMOUNT_ASKED, ASK_AMOUNT = "how much tax", "Compute the exact final dollar amount. Reply with only a dollar amount like $12345."


def item_prompt(
    present: Column, ask: Column, limit: int = 3000, templates: Sequence[tuple[tuple[str, ...], str]] = ITEM_PROMPTS, indent: str = "", columns: Mapping[str, str | None] | None = None
) -> Column:
    """The prompt of an item by the columns that its task has: ``present`` is the array of their names, by which case they are told apart.
    ``columns`` names the column of ``df`` that holds a name where it isn't called so, None where there is none. Nulls are ''; null choices are left out."""
    columns = columns or {}

    def value(name: str) -> Column:
        held = columns.get(name, name)
        return F.lit("") if held is None else F.coalesce(F.col(held), F.lit(""))

    def has(*names: str) -> Column:
        return reduce(lambda a, n: a & F.array_contains(present, n), names, F.lit(True))

    choices = [F.when(has(f"choice_{i}"), F.concat(F.lit(f"{indent}({chr(97 + i)}) "), F.col(columns.get(f"choice_{i}") or f"choice_{i}"))) for i in range(5) if columns.get(f"choice_{i}", "") is not None]
    options = F.array_join(F.array_compact(F.array(*choices)), "\n") if choices else F.lit("")
    amount = F.when(has("question") & F.contains(F.lower(value("question")), F.lit(AMOUNT_ASKED)), F.lit(ASK_AMOUNT)).otherwise(ask)
    special = {"ask": ask, "options": options, "amount": amount}

    def piece(x: str) -> Column:
        if not x.startswith("{"):
            return F.lit(x)
        name, marks = re.fullmatch(r"\{([A-Za-z_]+)([!?]*)\}", x).groups()
        if name in special:
            return special[name]
        if marks == "?":
            return F.when(has(name), value(name)).otherwise("")
        return F.substring(value(name), 1, {"!": limit, "!!": max(limit, STATUTE_LIMIT)}[marks]) if marks else value(name)

    out: Column | None = None
    for needed, template in templates:
        text = F.concat(*[piece(x) for x in re.split(r"(\{[A-Za-z_]+[!?]*\})", template) if x])
        if not needed:
            return text if out is None else out.otherwise(text)
        out = F.when(has(*needed), text) if out is None else out.when(has(*needed), text)
    return out


def bench_prompt(instruction: Column, question: Column) -> Column:
    """Instruction and question on lines of their own, or whichever is not blank."""
    return F.concat_ws("\n", F.nullif(sanitize(instruction), F.lit("")), F.nullif(sanitize(question), F.lit("")))


def raw_prompt(prompt: Column, system: Column) -> Column:
    """A prompt without a chat template: the system text, if any, and an empty line before it. Null texts are ''."""
    prompt, system = F.coalesce(prompt, F.lit("")), F.coalesce(system, F.lit(""))
    return F.when(system != "", F.concat(system, F.lit("\n\n"), prompt)).otherwise(prompt)
