"""Problem 8: keyword-stuffed pages and link lists.

A text is cut into lines and sentences. Each is judged by the share of its
commonest word or n-gram, its share of link text, its share of function words,
and whether an earlier line of the page has it; what ends no sentence is judged
as one list, by its separator density (the length of its items) and by the share
of its words or n-grams that recur on the page. A page is spam if more than half
of its characters lie in segments that are no sentences, in repeats where it has
more repeats than is usual, or in such a list. What a sentence must have of
function words, the usual repeats, the usual length between separators and the
usual recurrence are calibrated per language over all documents. Null, empty and
very short texts are no spam; rows without a doc_id are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.runtime import cut_lineage

#: More than this share of the characters makes a page spam.
SPAM_SHARE = 0.5
#: Characters that a page must have to be judged, and segments or list items that must be spam.
LEAST_CHARS, LEAST_ITEMS = 40, 4
#: Thresholds of the function-word share that are tried, as per cent of the words (Latin) or characters (CJK).
GRID = (2, 4, 6, 8, 10, 12, 15)
#: A language's threshold: this part of the median share of its sentences.
CALIBRATED = 0.3
#: A language's usual share of repeats: this quantile of its pages, kept within these bounds.
REPEATS_QUANTILE, REPEATS_LEAST, REPEATS_MOST = 0.95, 0.2, SPAM_SHARE

#: Items that a list has at least. It is one of keywords if its items are at most DENSE of the language's usual length
#: between separators, or at most that length while more recurs in it than in RECURS_QUANTILE of pages' prose, kept within these bounds.
LEAST_LIST, DENSE = 8, 0.5
RECURS_QUANTILE, RECURS_LEAST, RECURS_MOST = 0.9, 0.15, 0.5

# Function words by language.
FUNCTION_WORDS = {
    "en": frozenset(
        "the of and to in a an is are was were be been that this these those it its for on with as by from at or not no but if so than then which who whose when while"
        " he she they we you i his her their our your my had has have did does do will would may might can could shall should any all each both more most such under over after before because since until there".split()
    ),
    "fr": frozenset("le la les l un une des du de d et est sont été à au aux en dans par pour sur avec que qui qu ne pas se s son sa ses ce cette il elle ils a ont avait était plus ou mais comme dont leur y n on".split()),
}
FUNCTION_CHARS = frozenset("的了在于是并为与其由对被及将以和而至或从经已后前称向应未不曾也把这那此该给到就所因但")

_LINE = re.compile(r"[^\n]+")
_SENTENCE_END = re.compile(r"(?<=[。！!？?；;])(?!\s*$)|(?<=[.!?])\s+(?=[\"'“(\[]?[A-ZÀ-Ý0-9#])|(?<=[a-zà-ÿ]{2}[.?!])(?=[A-ZÀ-Ý])")
_LINK = re.compile(r"<a\b[^<>]*+>[^<]*+(?:<(?!/?a\b)[^<]*+)*+</a>|\[[^\[\]\n]*+\]\([^()\s]*+\)|https?://\S+|www\.\S+|\btag:[^\s,;，；|]+|[#＃][^\s#＃,;，；|·/]+(?: (?![#＃])[a-z]+){0,3}", re.IGNORECASE)
_MAYBE_LINK = re.compile(r"[<#＃\[]|[Tt][Tt][Pp]|[Ww]{3}|[Tt][Aa][Gg]:")
_DATE = re.compile(r"\d{4}\s*年\s*\d{1,2}\s*月|\b\d{1,2}(?:er)? [A-Za-zéûôè]{3,9} \d{4}\b|\b\d{4}-\d{2}-\d{2}\b")
_NUMBERED = re.compile(r"^\s*(?:\d{1,4}|[ivxIVX]{1,5}|[A-Za-z])[.)、．]\s*\S|^\s*[（(]\d{1,3}[)）]|^\s*第\s*[\d一二三四五六七八九十百]+\s*[条章节页]")
_FOOTNOTE = re.compile(r"^\s*\[\d{1,3}\]\s*\S+\s*$")
_SEPARATOR = re.compile(r"\s*[|｜/／·•;；,，、>»→]\s*|\]\s*\[|\s{2,}|\t")
_CJK_SPACE = re.compile(r"(?<=[㐀-鿿]) (?=[㐀-鿿])")
_NUMBER_SIGN = re.compile(r"\b[Nn][o°]\.?\s?(?=\d)")
_CJK = re.compile(r"[㐀-鿿]+")
_LATIN_CHARS = re.compile(r"[A-Za-zÀ-ɏ]+")
_WIDE_SPACE = re.compile(r"[ \t　 ]{5,}")
_WIDE = re.compile(r"[Ａ-Ｚａ-ｚ]")
_NARROW = {c: c - 0xFEE0 for a, b in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(a, b + 1)}
_SCRIPT = re.compile(r"[A-Za-zÀ-ɏ㐀-鿿]")
_NO_FUNCTION_CHARS = {ord(ch): None for ch in FUNCTION_CHARS}
_AFTER_STOP = " \t　\"'”’」』)）]"
_STOPS = tuple(".。!！?？:：;；…")
_FULL_STOPS = tuple(".。!！?？…")


def language(text: str) -> str:
    found = _LATIN_CHARS.findall(text.lower())
    if 3 * sum(map(len, _CJK.findall(text))) >= sum(map(len, found)):
        return "zh"
    words = Counter(found)
    fr = sum(words[w] for w in ("le", "la", "les", "du", "des", "et", "un", "une", "l", "d", "que", "est"))
    en = sum(words[w] for w in ("the", "of", "and", "to", "a", "in", "is", "for", "was", "by"))
    return "fr" if fr > en else "en"


def _units(segment: str, lang: str) -> list[str]:
    """The words of a segment; of a Chinese one, its CJK runs."""
    if lang == "zh":
        return _CJK.findall(segment)
    return _LATIN_CHARS.findall((_NUMBER_SIGN.sub(" ", segment) if "o." in segment else segment).lower())


def function_share(units: list[str], lang: str) -> tuple[float, int]:
    """Share of function words in per cent, and the number of words (CJK: characters)."""
    if lang == "zh":
        chars = "".join(units)
        return (100.0 * (len(chars) - len(chars.translate(_NO_FUNCTION_CHARS))) / len(chars), len(chars)) if chars else (0.0, 0)
    return (100.0 * sum(map(FUNCTION_WORDS[lang].__contains__, units)) / len(units), len(units)) if units else (0.0, 0)


def repeated_share(units: list[str], lang: str) -> tuple[int, float]:
    """How often the commonest n-gram of content occurs in a segment, and the share of the segment that it takes."""
    if lang == "zh":
        chars = "".join(units)
        if len(set(chars)) > 0.75 * len(chars):  # a phrase of four that comes twice has this few characters at least
            return 1, 0.0
        grams = Counter(run[i : i + 4] for run in units for i in range(len(run) - 3))
        n = max(grams.values(), default=0)
        return n, 4.0 * n / max(1, len(chars))
    if len(set(units)) > 0.85 * len(units):
        return 1, 0.0
    known, best = FUNCTION_WORDS[lang], (1, 0.0)
    for size in (1, 2, 3):
        grams = Counter(g for g in zip(*(units[i:] for i in range(size))) if any(w not in known and len(w) > 2 for w in g))
        n = max(grams.values(), default=0)
        if n >= 3:
            best = max(best, (n, size * n / len(units)), key=lambda x: x[1])
    return best


def has_link(line: str) -> bool:
    return _MAYBE_LINK.search(line) is not None and _LINK.search(line) is not None


def is_terminated(segment: str) -> bool:
    return segment.rstrip(_AFTER_STOP)[-1:] in _STOPS


def segments(text: str) -> Iterator[tuple[str, bool]]:
    """(segment, whether an earlier line has it too)."""
    first: dict[str, int] = {}
    for m in _LINE.finditer(text):
        line = m.group().strip()
        if not line:
            continue
        if has_link(line):
            yield line, first.setdefault(line, m.start()) < m.start()
            continue
        parts = [p for p in _SENTENCE_END.split(line) if p and p.strip()]
        for p in map(str.strip, parts):
            yield p, first.setdefault(p, m.start()) < m.start()


def _stuffed(units: list[str], lang: str) -> bool:
    """A sentence that only repeats a keyword."""
    n, share = repeated_share(units, lang)
    if lang == "zh":
        return (n >= 3 and share >= 0.25) or (n >= 2 and share >= 0.4)
    return n >= 3 and share >= 0.2


def judge_segment(segment: str, lang: str) -> tuple[float, float | None, list[str] | None]:
    """(share of the segment that is spam for certain, function-word share of the rest, or None where that doesn't matter, and its words; None for links)."""
    if has_link(segment):
        rest = _LINK.sub(" ", segment)
        link = 1.0 - len(rest.replace(" ", "")) / max(1, len(segment.replace(" ", "")))
        if _FOOTNOTE.match(segment):
            return 1.0, None, None
        share, words = function_share(_units(rest, lang), lang)
        if words >= (12 if lang == "zh" else 6) and is_terminated(rest) or words >= (40 if lang == "zh" else 20):
            return link, share, None
        return 1.0, None, None
    units = _units(segment, lang)
    if _stuffed(units, lang):
        return 1.0, None, units
    share, words = function_share(units, lang)
    if lang == "zh" and share > 0 and words >= 12 and is_terminated(segment):
        return 0.0, max(share, GRID[-1]), units  # it ends as a sentence and has a function word; keywords would have been told above
    if share < GRID[-1] and (_DATE.search(segment) or _NUMBERED.match(segment)):
        return 0.0, None, units
    return 0.0, share, units


def recurring_share(parts: list[list[str]], zh: bool) -> float:
    """Per cent of the n-grams (CJK) or words that are content and come three times or more."""
    if zh:
        grams = Counter([run[i : i + 4] for units in parts for run in units for i in range(len(run) - 3)])
    else:
        grams = Counter([w for units in parts for w in units])
    all_ = grams.total()
    often = [(g, n) for g, n in grams.items() if n >= 3]
    return 100.0 * sum(n for g, n in often if zh or (len(g) > 2 and not any(g in words for words in FUNCTION_WORDS.values()))) / max(1, all_)


def list_items(segment: str, zh: bool) -> int:
    """Items between separators; of Chinese also between spaces."""
    return sum(1 for x in _SEPARATOR.split(_CJK_SPACE.sub("|", segment) if zh else segment) if x.strip())


def page_profile(text: str) -> tuple:
    """The columns of _PROFILE after doc_id: language, language of the Latin part, characters; characters that are spam at each threshold of
    GRID in Chinese and in Latin segments; histograms of the function shares of their terminated sentences; spam items at the middle
    threshold; of repeated segments their characters, those of them that are not spam yet, and their number; of the list (loose segments)
    its items, characters, recurring share, and those characters of it that are not spam yet; of the prose its clauses, their
    characters, and its recurring share (-1 without prose)."""
    if "    " in text:
        text = _WIDE_SPACE.sub("    ", text)
    if _WIDE.search(text):
        text = text.translate(_NARROW)
    main = language(text)
    latin = main if main != "zh" else "en"
    total, items, repeated, repeats, loose_items, loose, clauses, prose = 0, 0, 0, 0, 0, 0, 0, 0
    spam, more, listed = ({True: [0.0] * len(GRID), False: [0.0] * len(GRID)} for _ in range(3))
    shares = {True: [0] * 51, False: [0] * 51}
    listing: list[list[str]] = []
    sentences: list[list[str]] = []
    for segment, again in segments(text):
        size = len(segment)
        total += size
        zh = main == "zh" if (m := _SCRIPT.search(segment)) is None else ord(m.group()) >= 0x3400
        if zh != (main == "zh"):  # by its first letter; count where that differs from the page
            zh = 3 * sum(map(len, _CJK.findall(segment))) >= sum(map(len, _LATIN_CHARS.findall(_LINK.sub(" ", segment))))
        certain, share, units = judge_segment(segment, "zh" if zh else latin)
        ended = is_terminated(segment)
        ended_full = ended and segment.rstrip(_AFTER_STOP)[-1:] in _FULL_STOPS
        row = spam[zh]
        open_ = [0.0 if share is not None and share < g else (1.0 - certain) * size for g in GRID] if again or not ended_full else []
        if again:
            repeated, repeats = repeated + size, repeats + 1
            for i, x in enumerate(open_):
                more[zh][i] += x
        elif not ended_full and units is not None and share is not None and not _DATE.search(segment) and not _NUMBERED.match(segment):
            loose, loose_items = loose + size, loose_items + list_items(segment, zh)
            listing.append(units)
            for i, x in enumerate(open_):
                listed[zh][i] += x
        if ended and units is not None and zh == (main == "zh") and not certain:
            sentences.append(units)
            prose += size
            clauses += 1 + sum(map(segment.count, "，、；：" if zh else ",;:"))
        if share is None:
            if certain:
                for i in range(len(GRID)):
                    row[i] += certain * size
        else:
            for i, g in enumerate(GRID if share < GRID[-1] or certain else ()):
                row[i] += size if share < g else certain * size
            if size >= 12 and ended:
                shares[zh][min(50, int(share))] += 1
        if certain > 0.5 or (share is not None and share < GRID[2 if zh else 4]):
            items += max(1, size // 30, list_items(segment, zh), len(_LINK.findall(segment)) if certain else 0)
    whole = lambda row: [int(x) for x in row]
    recurs = recurring_share(listing, main == "zh") if loose_items >= LEAST_LIST else 0.0
    usual = recurring_share(sentences, main == "zh") if len(sentences) > 1 else -1.0
    return (
        main, latin, total, whole(spam[True]), whole(spam[False]), shares[True], shares[False], items, repeated, whole(more[True]), whole(more[False]), repeats,
        loose_items, loose, recurs, whole(listed[True]), whole(listed[False]), clauses, prose, usual,
    )


def page_profiles(df: DataFrame) -> DataFrame:
    """One small row per document; the only pass over the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(doc, *page_profile(text)) for doc, text in zip(b["doc_id"], b["text"]) if text]
            yield pd.DataFrame(out, columns=_PROFILE)

    kinds = "long, string, string, int, array<int>, array<int>, array<int>, array<int>, int, int, array<int>, array<int>, int, int, int, double, array<int>, array<int>, int, int, double".split(", ")
    return df.select("doc_id", "text").filter("doc_id is not null").mapInPandas(run, ", ".join(map(" ".join, zip(_PROFILE, kinds))))


_PROFILE = ["doc_id", "language", "latin", "chars", "spam_zh", "spam_latin", "shares_zh", "shares_latin", "items", "repeated", "more_zh", "more_latin", "repeats"]
_PROFILE += ["loose_items", "loose", "recurs", "listed_zh", "listed_latin", "clauses", "prose", "prose_recurs"]


def thresholds(profiles: DataFrame) -> DataFrame:
    """Per language: the index into GRID of the least function-word share of a sentence."""
    zh = profiles.select(F.lit("zh").alias("language"), F.posexplode("shares_zh").alias("share", "n"))
    latin = profiles.select(F.col("latin").alias("language"), F.posexplode("shares_latin").alias("share", "n"))
    counts = zh.unionAll(latin).filter("n > 0").groupBy("language", "share").agg(F.sum("n").alias("n"))
    per = counts.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("share", "n"))).alias("h"), F.sum("n").alias("all"))  # at most 51 rows each
    running = F.aggregate(
        "h",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("median")),
        lambda acc, x: F.struct(
            (acc["sum"] + x["n"]).alias("sum"),
            F.when((acc["median"] < 0) & ((acc["sum"] + x["n"]) * 2 >= F.col("all")), x["share"]).otherwise(acc["median"]).alias("median"),
        ),
        lambda acc: acc["median"],
    )
    least = F.greatest(running, F.lit(0)) * CALIBRATED
    grid = F.array(*[F.lit(g) for g in GRID])
    at = F.size(F.filter(grid, lambda g: g <= least)) - 1
    return per.select("language", F.greatest(at, F.lit(0)).alias("at"))


def usual_pages(profiles: DataFrame) -> DataFrame:
    """Per language: the share of a page's characters that repeats may have, the usual length between separators, and the share of prose that may recur."""
    within = lambda x, low, high: F.least(F.greatest(F.coalesce(x, F.lit(low)), F.lit(low)), F.lit(high))
    repeats = F.percentile_approx(F.col("repeated") / F.col("chars"), REPEATS_QUANTILE)
    recurs = F.percentile_approx(F.when(F.col("prose_recurs") >= 0, F.col("prose_recurs") / 100), RECURS_QUANTILE)
    return profiles.filter(F.col("chars") >= LEAST_CHARS).groupBy("language").agg(
        within(repeats, REPEATS_LEAST, REPEATS_MOST).alias("repeats"), (F.sum("prose") / F.sum("clauses")).alias("clause"), within(recurs, RECURS_LEAST, RECURS_MOST).alias("recurs")
    )


def spam_pages(df: DataFrame) -> DataFrame:
    """(doc_id, spam_share) of the pages that are spam."""
    profiles = cut_lineage(page_profiles(df))
    at = {r["language"]: r["at"] for r in thresholds(profiles).collect()}  # one row per language: zh, en, fr
    usual = {"zh": 1, "en": 4, "fr": 4}  # where no sentence of a language was seen
    place = F.create_map(*[x for k, v in (usual | at).items() for x in (F.lit(k), F.lit(v))])
    pages = {r["language"]: r for r in usual_pages(profiles).collect()}  # one row per language
    by = lambda name, least: F.create_map(*[x for k in usual for x in (F.lit(k), F.lit(float(pages[k][name] or least) if k in pages else least))])[F.col("language")]
    length = F.col("loose") / F.greatest("loose_items", F.lit(1))
    clause = by("clause", 0.0)
    keywords = (F.col("loose_items") >= LEAST_LIST) & ((length <= clause * DENSE) | ((length <= clause) & (F.col("recurs") / 100 > by("recurs", RECURS_LEAST))))
    judged = profiles.withColumns({"at_zh": place[F.lit("zh")], "at_latin": place[F.col("latin")], "many": F.col("repeated") / F.col("chars") > by("repeats", REPEATS_LEAST), "keywords": keywords})
    added = F.when(F.col("many"), F.col("repeats")).otherwise(0) + F.when(F.col("keywords"), F.col("loose_items")).otherwise(0)
    judged = judged.withColumn("items", F.col("items") + added)

    def spam(kind: str) -> Column:
        at = F.col(f"at_{kind}") + 1
        repeated = F.when(F.col("many"), F.element_at(f"more_{kind}", at)).otherwise(0)
        listed = F.when(F.col("keywords"), F.element_at(f"listed_{kind}", at)).otherwise(0)
        return F.element_at(f"spam_{kind}", at) + repeated + listed

    return (
        judged.withColumn("spam_share", (spam("zh") + spam("latin")) / F.col("chars"))
        .filter((F.col("chars") >= LEAST_CHARS) & (F.col("items") >= LEAST_ITEMS) & (F.col("spam_share") > SPAM_SHARE))
        .select("doc_id", "spam_share")
        .dropDuplicates(["doc_id"])
    )
