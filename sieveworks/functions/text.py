"""Column builders for strings; each says what it does with null.

White space means what Unicode and the record formats mean by it, not Spark's
``trim``, which takes spaces only. Regular expressions keep to the syntax that
Java and RE2 read alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space, as a class of Java and RE2.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    """Without white space at either end; null stays null."""
    return strip_right(F.regexp_replace(c, rf"\A{WS}+", ""))


def strip_right(c: Column) -> Column:
    """The match may only start where the white space does, else a long run inside a text takes squared time."""
    return F.regexp_replace(c, rf"(?<!{WS}){WS}+\z", "")


def sanitize(c: Column) -> Column:
    """Stripped; null gives ''."""
    return F.coalesce(strip(c), F.lit(""))


#: Anything else.
NOT_WS = "[^" + WS[1:]


def is_blank(c: Column) -> Column:
    """True for null, empty and white space; looks no further than the first other character."""
    return F.coalesce(~c.rlike(NOT_WS), F.lit(True))


def visible_length(c: Column) -> Column:
    """Characters without white space; null gives 0."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{WS}+", ""))


def collapse(c: Column) -> Column:
    """Stripped, with runs of white space as one space."""
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def first_nonempty(*columns: Column) -> Column:
    """The first that has something after stripping, stripped; '' without one."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns], F.lit(""))


def build_text(*columns: Column) -> Column:
    """The non-empty stripped columns, one a line."""
    return F.concat_ws("\n", *[F.nullif(strip(c), F.lit("")) for c in columns])


def last_index(c: Column, mark: str) -> Column:
    """Position from 0 of the last occurrence of one character, -1 without."""
    return F.when(F.instr(c, mark) == 0, F.lit(-1)).otherwise(F.length(c) - F.locate(mark, F.reverse(c)))


#: Where a shortened text may end.
SENTENCE_ENDS = "。.!?；;"


def shorten(c: Column, limit: int, ends: str = SENTENCE_ENDS, least: float = 0.7) -> Column:
    """At most ``limit`` characters, ending with a sentence if one ends after ``least`` of them; 0 or less means no limit."""
    if limit <= 0:
        return c
    head = strip_right(F.substring(c, 1, limit))
    cut = F.greatest(*[last_index(head, e) for e in ends])
    return F.when(F.length(c) <= limit, c).when(cut >= int(limit * least), F.substring(head, F.lit(1), cut + 1)).otherwise(head)


_THINK = r"(?is)<think>(.*?)</think>"
_ANSWER = r"(?is)<answer>(.*?)</answer>"


def has_pair(c: Column, tag: str) -> Column:
    """Whether an opening and a closing tag occur in this order; null gives false."""
    return F.coalesce(c.rlike(rf"(?is)<{tag}>.*?</{tag}>"), F.lit(False))


def think_text(c: Column) -> Column:
    """Body of the first think block, stripped; '' without one."""
    return F.coalesce(strip(F.regexp_extract(c, _THINK, 1)), F.lit(""))


def answer_text(c: Column) -> Column:
    """Body of the first answer block; else what stands outside think blocks; else the text itself, stripped."""
    text = F.coalesce(c, F.lit(""))
    rest = strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    return F.when(has_pair(text, "answer"), strip(F.regexp_extract(text, _ANSWER, 1))).when(rest != "", rest).otherwise(strip(text))


def wrap_think(c: Column, stripped: bool = False) -> Column:
    """In one think block, whether or not it was in one already; ``stripped`` tells that the text has no white space at its ends."""
    t = c if stripped else strip(c)
    inner = F.when(t.startswith("<think>") & t.endswith("</think>"), strip(F.substring(t, F.lit(8), F.length(t) - 15))).otherwise(t)
    return F.concat(F.lit("<think>\n"), inner, F.lit("\n</think>"))


def cut_at_stop(c: Column, stop: str) -> Column:
    """What stands before the first ``stop``, stripped."""
    return strip(F.substring_index(c, stop, 1))


def trim_stops(c: Column, stops: Sequence[str]) -> Column:
    """Cut at each stop word in turn; a stop word also counts without the line ends before it. Empty ones don't count; null stays null."""
    for s in dict.fromkeys([s for s in stops if s] + [s.lstrip("\n") for s in stops if s.lstrip("\n")]):
        c = F.substring_index(c, s, 1)
    return c


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters, in order of first appearance; the text itself if shorter; null for null."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(grams)


def is_cjk(c: Column) -> Column:
    """All characters are CJK ideographs of the basic block; true for ''."""
    return c.rlike(r"\A[\x{4e00}-\x{9fa5}]*\z")


def rounded_share(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole, rounded; 0.0 where there is nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part.cast("double") * 100 / whole.cast("double"), digits))
