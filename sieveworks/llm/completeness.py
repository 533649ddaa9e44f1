"""Problem 1: values that were cut off by field limits or in transfer.

Each value is first read by a stack automaton over its structural marks (quotes,
brackets, markup, fences), with half escapes, tags, entities and multibyte
sequences at its end. What is still open at the end without a terminator is cut;
what ends with a terminator but leaves a mark open is cut unless its source
leaves marks open as a habit. A closed value's ending is compared with what its
source usually does: one without a terminator is cut where the source's prose
ends with one, or where the value has just the length at which that source cuts.

Null, empty and blank values are never cut. Repeated rows give one result; rows
without a record_id are left out. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.plain import plain_form
from sieveworks.llm.records import source_key
from sieveworks.runtime import cut_lineage

FIELDS = ("reasoning", "output")

#: States of a value's ending.
DONE, CUT, OPENED, OPEN, ENTRY, LABEL, NONE = "done", "cut", "opened", "open", "entry", "label", "none"

# Marks of structure.
_OPENERS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "《": "》", "“": "”", "{": "}"}
_CLOSERS = {v: k for k, v in _OPENERS.items()}
_STOPS = ".。!！?？"
_WEAK = ";；"
_AFTER_STOP = "\"'”’」』)）]】》»*_`"

_MARKS = re.compile(r"</?[A-Za-z][A-Za-z0-9_]*(?:\s[^<>]*)?/?>|```|\"|[\[\](){}（）【】「」『』《》“”]")
#: Tags that markup needn't close.
_NEVER_CLOSED = frozenset("<p <li <dt <dd <td <th <tr <thead <tbody <tfoot <option <br <hr <img <input <meta <link <col <wbr".split())
_CLOSING_TAG = re.compile(r"</[A-Za-z][^<>]*>")
_LEADING_TAGS = re.compile(r"^\s*(?:<[A-Za-z][^<>]*>\s*)+")
#: A tag up to somewhere in its name or its attributes; of attributes without a value the last only.
_HALF_TAG = re.compile(
    r"</?|<[/!]?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))*(?:\s+(?:[\w:.-]+(?:\s*=\s*(?:\"[^\"]*|'[^']*)?)?)?)?"
)
_HALF_CODE = re.compile(r"(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)$")
_HALF_ENTITY = re.compile(r"&(?:#x?[0-9A-Fa-f]*|[A-Za-z]{2,8})$")
_LIST_ENTRY = re.compile(r"^\s*(?:[-*•·]|\d{1,3}[.)、]|[(（]\d{1,3}[)）]|[A-Za-z][.)、．])\s*\S")
_REFERENCE = re.compile(
    r"(?:\b(?:see|cf\.?|voir)\b[^.]{0,40}\b(?:p|pp|page|pages|para|art)\.?\s*\d+|(?:详见|参见|见)[^。]{0,20}第\s*\d+\s*[页条款号])\s*$", re.IGNORECASE
)
_ANY_TAG = re.compile(r"</?[A-Za-z][^<>]*>|&(?:nbsp|#160);")
#: A clause rather than a label: a speaker or a party, a second part that is no measure, or a word that needs another.
_CLAUSE = re.compile(r"[我某]|[，,](?![^，,]*\d+(?:\.\d+)?[^\d，,]{0,2}$)|[的是于对与予把被将及和或在从向由为之]$")
_INNER_STOP = re.compile(r"[。！？!?]\s*\S|\.\s+\S")
_LETTERS = re.compile(r"[^\W\d_]")
_CJK = re.compile(r"[㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SPACE = " \t\r\n\f\v 　​﻿     "

#: Longest label: CJK characters, or words of another script.
LABEL_CHARS, LABEL_WORDS = 18, 6
#: Characters of a value's ending that are looked up in the prompt.
TAIL, LEAST_TAIL = 24, 8

# What stands where an answer should be, in plain form.
PLACEHOLDERS = frozenset(
    "null none nil na nan tbd todo unknown undefined empty blank pending answer theanswer answerhere noanswer output response result placeholder"
    " réponse néant inconnu sansréponse 答案 回答 答 暂无 暂无答案 无 空 无答案 待补充 待定 待填写 未知 略 参考答案 暂缺 结论 输出".split()
)


def open_marks(text: str) -> list[str]:
    """The stack of marks that are still open at the end of ``text``. A straight quote opens after a space or a mark only, and no quote is open that began in an earlier line."""
    stack: list[str] = []
    place: dict[str, list[int]] = {}  # where the open quotes, fences and tags stand in the stack

    def close(kind: str) -> bool:
        """Closes the last open mark of a kind and all that was opened after it; False if none is open."""
        while at := place.get(kind):
            i = at.pop()
            if i < len(stack) and stack[i] == kind:  # else it went with one that stood before it
                del stack[i:]
                return True
        return False

    def open_(kind: str) -> None:
        place.setdefault(kind, []).append(len(stack))
        stack.append(kind)

    quote = 0  # where the last straight quote was opened
    for m in _MARKS.finditer(text):
        mark = m.group()
        if mark == '"':
            before = text[m.start() - 1 : m.start()]
            if not close(mark) and (not before or before.isspace() or before in "([{（【「『《“:：,，=>"):
                open_(mark)
                quote = m.start()
        elif mark == "```":
            if not close(mark):
                open_(mark)
        elif mark[0] == "<":
            name = "<" + mark.strip("</> ").split()[0].lower()
            if mark[1] == "/":
                close(name)
            elif not mark.endswith("/>") and name not in _NEVER_CLOSED:
                open_(name)
        elif mark in _OPENERS:
            stack.append(mark)
        elif _CLOSERS[mark] in stack[-2:]:  # over one mark that was never closed
            del stack[len(stack) - 1 - stack[: -3 : -1].index(_CLOSERS[mark]) :]
    if "\n" in text[quote:]:
        stack = [x for x in stack if x != '"']
    return stack


def is_half(text: str) -> bool:
    """Whether ``text`` ends within a character, an escape, a tag or an entity."""
    if text[-1] == "�":
        return True
    code = _HALF_CODE.search(text[-4:])
    head = text[: len(text) - len(code.group())] if code else text
    if (len(head) - len(head.rstrip("\\"))) % 2:
        return True
    at = text.rfind("<")
    if at >= 0 and ">" not in text[at:] and _HALF_TAG.fullmatch(text, at):
        return True
    return _HALF_ENTITY.search(text[-10:]) is not None


def _before_ellipsis(text: str) -> str | None:
    """What stands before an ellipsis at the end, with a bracket that encloses it; None without one."""
    if (last := text[-1]) not in ".…。":
        return None
    before = text.rstrip(last)
    if last != "…" and len(text) - len(before) < 3:
        return None
    if before[-1:].isspace():
        before = before[:-1]
    return (before[:-1] if before[-1:] and before[-1] in "[(（【<" else before).rstrip(_SPACE)


def is_heading(line: str) -> bool:
    """A title: nearly all words begin with a capital, and no clause follows."""
    words = _WORD.findall(line)
    return len(words) >= 2 and sum(w[0].isupper() for w in words) >= 0.85 * len(words)


def is_label(text: str) -> bool:
    """Short enough to be a label, a choice or a finding rather than prose; a second sentence is none."""
    if len(text) > 200 or _INNER_STOP.search(text):
        return False
    if _CJK.search(text):
        return len(text) <= LABEL_CHARS and not (len(text) >= 6 and _CLAUSE.search(text))
    return len(text.split()) <= LABEL_WORDS


def is_placeholder(text: str | None) -> bool:
    """Null, blank, a placeholder, or markup with nothing in it."""
    return not (p := plain_form(_ANY_TAG.sub(" ", text or ""))) or p in PLACEHOLDERS


def _stopped(text: str) -> bool:
    t = text.rstrip(_SPACE + _AFTER_STOP)
    if t[-1:] == "." and t[-2:-1].isdigit() and "。" in t:
        return False  # a number that lost its decimals
    return bool(t) and (t[-1] in _STOPS or (t[-1] in _WEAK and text[-1] in _WEAK))


def _quoted(tail: str, *prompts: str) -> bool | None:
    """Whether the prompt goes on after ``tail`` with the end of a sentence; None if it lacks ``tail``."""
    seen = None
    bare = plain_form(tail)
    for prompt in prompts:
        if len(bare) >= LEAST_TAIL and plain_form(prompt).endswith(bare):
            return True  # with other spaces, width or case than the prompt has
        at = prompt.find(tail) if tail else -1
        while at >= 0:
            rest = prompt[at + len(tail) :].lstrip(" 　 ")
            if not rest or rest[0] in _STOPS + _WEAK + "\n":
                return True
            seen = False
            at = prompt.find(tail, at + 1)
    return seen


def _without_tags(text: str) -> str:
    """Without leading and closing tags."""
    while text.endswith(">") and (at := text.rfind("<")) >= 0 and _CLOSING_TAG.fullmatch(text, at):
        text = text[:at].rstrip(_SPACE)
    return _LEADING_TAGS.sub("", text, count=1).strip(_SPACE)


def ending(value: str | None, instruction: str | None = None, prompt: str | None = None) -> str:
    """How ``value`` ends: DONE, CUT, OPENED (terminated, but with a mark still open), OPEN (prose without terminator), ENTRY (of a list), LABEL, or NONE (nothing there)."""
    text = (value or "").strip(_SPACE)
    if not text or not _LETTERS.search(text):
        return CUT if text and text[-1] == "�" else NONE
    stack = open_marks(text)
    if is_half(text):
        return CUT
    inner = _without_tags(text)
    if not inner:
        return NONE
    before = _before_ellipsis(inner)
    if before is not None:
        return NONE if not before else DONE if _stopped(before) else CUT
    last = inner.rsplit("\n", 1)[-1].strip(_SPACE)
    if _stopped(inner):
        return OPENED if stack else DONE
    if inner[-1] in ")）]】」』》”\"'’" and not stack:
        return DONE
    if "\n" in inner and _LIST_ENTRY.match(last) and not stack:
        return ENTRY
    if _REFERENCE.search(last[-120:]):
        return DONE
    if is_heading(last) and not stack:
        return LABEL
    if is_placeholder(inner):
        return NONE
    tail = inner[-TAIL:]
    found = _quoted(tail, instruction or "", prompt or "") if len(tail) >= LEAST_TAIL else None
    if found:
        return DONE
    if stack:
        return CUT
    if found is None and is_label(inner) and not _last_is_comma(inner):
        return LABEL
    return OPEN


def _last_is_comma(text: str) -> bool:
    return text[-1] in ",，、:："


def endings(df: DataFrame, source: Column | None = None) -> DataFrame:
    """(record_id, field, source, n_chars, n_bytes, state, prose) of each value; one pass, nothing but these leaves the task."""
    source = source_key(F.col("source"), F.col("_source_file")) if source is None else source
    picked = df.filter("record_id is not null").select("record_id", source.alias("source"), "instruction", "input", *FIELDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, src, ins, inp, *values in b.itertuples(index=False, name=None):
                for field, value in zip(FIELDS, values):
                    if value is not None:
                        state = ending(value, ins, inp)
                        rows.append((rid, src, field, len(value), len(value.encode("utf-8", "replace")), state))
            yield pd.DataFrame(rows, columns=["record_id", "source", "field", "n_chars", "n_bytes", "state"])

    return picked.mapInPandas(run, "record_id long, source string, field string, n_chars int, n_bytes int, state string")


#: Bytes by which a cut may miss a byte limit: what is left of a multibyte character, or stands in for it.
BYTE_SLACK = 4


def source_baselines(ends: DataFrame, min_cases: int = 5, min_share: float = 0.2) -> DataFrame:
    """Per source and field: ``limit_chars`` and ``limit_bytes``, lengths at which the source cuts; ``stopped_share``, the
    share of prose away from these lengths that ends with a terminator; and ``opened_share``, the share of terminated
    values that leave a mark open. Null where there is none, or too few cases.

    A limit is the commonest length among values cut or open, if it has
    ``min_cases`` of them and ``min_share`` of all; a byte limit with BYTE_SLACK.
    """
    keys = ["source", "field"]
    unended = ends.filter(F.col("state").isin(CUT, OPEN))

    def limit(unit: str, slack: int) -> DataFrame:
        counts = unended.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("n"))
        modes = counts.groupBy(*keys).agg(F.max_by(unit, F.struct("n", unit)).alias(f"limit_{unit[2:]}"), F.sum("n").alias("all"))
        near = counts.join(modes, keys).filter(F.abs(F.col(unit) - F.col(f"limit_{unit[2:]}")) <= slack)
        sums = near.groupBy(*keys, f"limit_{unit[2:]}", "all").agg(F.sum("n").alias("most"))
        return sums.filter((F.col("most") >= min_cases) & (F.col("most") >= min_share * F.col("all"))).select(*keys, f"limit_{unit[2:]}")

    limits = limit("n_chars", 0).join(limit("n_bytes", BYTE_SLACK), keys, "full")
    ended = F.col("state").isin(DONE, OPENED)
    prose = ends.filter(F.col("state").isin(DONE, CUT, OPENED, OPEN)).join(limits, keys, "left").filter(~_at_limit() | ended)
    share = lambda n, of: F.when(of >= min_cases, n / of)
    shares = prose.groupBy(*keys).agg(
        share(F.count_if(ended), F.count(F.lit(1))).alias("stopped_share"), share(F.count_if(F.col("state") == OPENED), F.count_if(ended)).alias("opened_share")
    )
    return limits.join(shares, keys, "full")


def _at_limit() -> Column:
    chars = F.coalesce(F.col("n_chars") == F.col("limit_chars"), F.lit(False))
    return chars | F.coalesce(F.abs(F.col("n_bytes") - F.col("limit_bytes")) <= BYTE_SLACK, F.lit(False))


def judge(ends: DataFrame, baselines: DataFrame, usual: float = 0.5, careless: float = 0.1) -> DataFrame:
    """``ends`` with ``is_cut``: broken structure, a mark left open where the source leaves at most a share ``careless`` so,
    or an open ending where the source's prose is terminated or at the source's limit."""
    usually = F.coalesce(F.col("stopped_share") >= usual, F.lit(True))
    is_cut = (
        F.when(F.col("state") == CUT, True)
        .when(F.col("state") == OPENED, F.coalesce(F.col("opened_share") <= careless, F.lit(True)) | _at_limit())
        .when(F.col("state") == OPEN, usually | _at_limit())
        .when(F.col("state") == ENTRY, F.coalesce(F.col("n_chars") == F.col("limit_chars"), F.lit(False)))
        .otherwise(False)
    )
    return ends.join(baselines, ["source", "field"], "left").withColumn("is_cut", is_cut)


def judged_values(df: DataFrame) -> DataFrame:
    """One row per record and field with ``is_cut``; a record delivered twice counts once."""
    ends = cut_lineage(endings(df).dropDuplicates(["record_id", "field"]))  # read three times below
    return judge(ends, source_baselines(ends))


def truncated_values(df: DataFrame) -> DataFrame:
    """(record_id, field) of the values that were cut inside a word or a sentence."""
    return judged_values(df).filter("is_cut").select("record_id", "field")


def truncation_rates(df: DataFrame) -> DataFrame:
    """Per source and field: values, cut values, their share, and the source's limits (null without one)."""
    return (
        judged_values(df)
        .filter(F.col("state") != NONE)
        .groupBy("source", "field")
        .agg(
            F.count(F.lit(1)).alias("n_values"),
            F.count_if("is_cut").alias("n_cut"),
            (F.count_if("is_cut") / F.count(F.lit(1))).alias("cut_share"),
            F.max("limit_chars").alias("limit_chars"),
            F.max("limit_bytes").alias("limit_bytes"),
        )
    )


__all__ = ["ending", "endings", "judge", "judged_values", "open_marks", "plain_form", "source_baselines", "truncated_values", "truncation_rates"]
