"""Problem 2: prompts answered by something that is no proper answer.

Each field gets at most one defect, tested in this order: ``empty`` (output
only), ``copy``, ``refusal``, ``other_lang``, ``truncated``. Copies are found by
shingle containment of the prompt in the answer and, where that is near the
line, by the longest common subsequence, whatever the lengths; refusals by
aligning every sentence with templates; truncation is problem 1's decision. Null
reasoning is no defect; a null instruction or input can't be copied and asks for
no language. Rows without a record_id are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.plain import plain_form
from sieveworks.llm.completeness import FIELDS, NONE, ending, is_placeholder, judge, source_baselines
from sieveworks.llm.records import source_key
from sieveworks.runtime import cut_lineage

#: Shingle length, share of the prompt's shingles that makes a copy, and share of the answer that must then come from the prompt.
SHINGLE, COPIED, OWN = 5, 0.5, 0.7
#: Width around COPIED in which the subsequence decides.
NEAR = 0.1
#: Shortest prompt in plain form of which a copy can be told.
LEAST_PROMPT = 8

# Templates by language. Slots are divided by spaces, the words of a slot by bars; a slot with a star must be met.
# A refusal is the speaker's own; a referral sends the asker elsewhere.
REFUSALS = {
    "en": (
        "i* can|will|could|may|shall not* help|assist|answer|respond|provide|give|offer|comment|discuss|advise|complete|fulfil|comply|share|draft|drafting|write|writing|process|assess|analyse|analyze|handle|take|say|engage|do*",
        "i* am not* able|allowed|permitted|comfortable|authorised|authorized|going* to", "i* am not* in a position* to", "i* am unable* to", "i* do not* feel comfortable*",
        "i* would rather|prefer* not*", "i* prefer|choose|opt* not* to", "i* decline|refuse* to",
        "i* must|have|need|will|would to pass|decline|refuse|abstain|refrain|withhold*", "something* i* must|have|need to decline|refuse*",
        "it is|would be not* possible|appropriate* for* me*", "it is|would be impossible|inappropriate* for* me*",
        "beyond* what* i* may|can|could|am", "beyond|outside* my* scope|remit|abilities|role|competence*", "not* something* i* can|may|am",
    ),
    "fr": (
        "je* ne* peux|puis|saurais|souhaite|suis pas répondre|aider|donner|traiter|analyser|prononcer|mesure|fournir|autorisé*",
        "il m* est impossible* de|d", "je* dois|préfère* décliner|refuser|abstenir|ne*",
    ),
    "zh": (
        "我|本人* 无法|不能|不便|没有办法|难以|拒绝|选择不|不方便|无权|暂不|不予|不宜|不打算* 回答|作答|协助|帮助|提供|完成|判断|处理|看法|评论|分析|讨论|意见|答复*",
        "无法|不能|难以|不便* 协助|帮助|为|向|给* 您*", "恕* 难以|难|不便|不能|不|无法*", "超出* 我* 范围*", "不便* 作答|回答|评论*",
    ),
}
REFERRALS = {
    "en": (
        "speak|talk|turn to a qualified|licensed* lawyer|attorney|professional|adviser*", "consult* a|your qualified|local lawyer|attorney|professional|adviser*", "feel* free* to ask|reach*", "ask* me* something|anything* else",
        "another* topic|question* i* could|can",
    ),
    "fr": ("consulter|consultez* un avocat|juriste*", "autre* sujet|question*"),
    "zh": ("咨询|联系* 律师|专业人士*", "欢迎* 提问|咨询*", "更换* 话题*"),
}
#: Share of a template's slots that must be met, in order, and the most that may stand between two: words, in Chinese characters.
ALIGNED, GAPS = 0.7, {"en": 4, "fr": 4, "zh": 16}
#: Sentences from the start in which a refusal is one whatever follows; further on it must make up half of the answer with its like.
OPENING = 3

# Contractions, and verbs after which a speaker is quoted.
_CONTRACTIONS = (("’", "'"), ("can't", "can not"), ("cannot", "can not"), ("won't", "will not"), ("n't", " not"), ("'m", " am"), ("'d", " would"), ("'ll", " will"))
_QUOTED = re.compile(r"“[^”]*”|「[^」]*」|『[^』]*』|\"[^\"\n]*\"|(?:称|说|表示|陈述|供述|回答道|答)\s*[:：，,]?\s*(?=我|本人)[^。！？!?\n]*")
#: Every template has one of these among the slots it must have.
_SPEAKER = re.compile(r"\b(?:i|me|my|je|m)\b|我|恕|您|不便", re.IGNORECASE)
_FR_WORDS = frozenset("le la les des du un une et est que qui dans pour par sur au aux avec ne pas a été l d qu sa son ses se ce cette il elle en".split())
_EN_WORDS = frozenset("the of and to in a is that for was on with as by not be it this from at or an are were has had which under before after".split())
_FR_ONLY = re.compile(r"[àâçéèêëîïôûùœ]|\b[ldqnsj]['’][a-zàâéèêîôû]", re.IGNORECASE)

_SENTENCE = re.compile(r"[^.。!！?？\n]+[.。!！?？]*")
_ASKED = (
    ("en", re.compile(r"英语|英文|\b(?:in|into|auf)\s+english|en anglais|language\s*[:：]\s*english", re.IGNORECASE)),
    ("zh", re.compile(r"中文|汉语|\bin(?:to)?\s+(?:simplified\s+)?chinese|en chinois|language\s*[:：]\s*chinese", re.IGNORECASE)),
    ("fr", re.compile(r"法语|法文|\bin(?:to)?\s+french|en français|language\s*[:：]\s*french", re.IGNORECASE)),
)
_CJK = re.compile(r"[㐀-鿿]+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")
_ANY_OTHER = re.compile(r"[぀-ヿ가-힯Ѐ-ӿ؀-ۿ]")
_OTHER_SCRIPTS = (("ja", re.compile(r"[぀-ヿ]+")), ("ko", re.compile(r"[가-힯]+")), ("ru", re.compile(r"[Ѐ-ӿ]+")), ("ar", re.compile(r"[؀-ۿ]+")))
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>")
@lru_cache(maxsize=4096)
def language_asked(instruction: str) -> str | None:
    """The language that an instruction names for the answer, else its own."""
    for code, pattern in _ASKED:
        if pattern.search(instruction):
            return code
    own = language_of(instruction)
    return "en" if own == "latin" else own


def _count(pattern: re.Pattern[str], text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def language_of(text: str) -> str | None:
    """zh, en, fr, another script's code, or None for texts without a language (letters, numbers) or of equal claims."""
    if "<" in text:
        text = _TAGS.sub(" ", text)
    cjk, latin = _count(_CJK, text), _count(_LATIN, text)
    if _ANY_OTHER.search(text):
        for code, pattern in _OTHER_SCRIPTS:
            if _count(pattern, text) > 0.3 * max(1, cjk + latin):
                return code
    if cjk * 4 > latin:  # a CJK character says about as much as four letters
        return "zh"
    body = text.strip()
    if not latin or (len(body) <= 24 and _bare(body)):
        return None
    words = re.findall(r"[a-zà-ɏ]+", text.lower())
    fr, en = sum(w in _FR_WORDS for w in words) + len(_FR_ONLY.findall(text)), sum(w in _EN_WORDS for w in words)
    if fr > en:
        return "fr"
    return "en" if en > fr else "latin"


def _bare(text: str) -> bool:
    """Option letters, numbers, and marks; not words."""
    return all(len(w) == 1 or (w.isupper() and set(w) <= set("ABCDEFGH")) for w in re.findall(r"[^\W\d_]+", text))


#: Characters between looks at whether a subsequence is decided.
_LOOK = 512


def common_subsequence(a: str, b: str, least: float | None = None) -> int:
    """Length of the longest common subsequence, by bit vectors: one big-integer step for each character of ``b``. With
    ``least``, what is known once it is clear whether the length reaches it."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    ones = (1 << len(a)) - 1
    row = ones
    for i, ch in enumerate(b):
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & ones
        if least is not None and i % _LOOK == _LOOK - 1:
            so_far = len(a) - row.bit_count()
            if so_far >= least or so_far + len(b) - i - 1 < least:
                return so_far
    return len(a) - row.bit_count()


@lru_cache(maxsize=8)  # a prompt is looked at once for each field
def _shingles(p: str) -> frozenset[str]:
    return frozenset(p[i : i + SHINGLE] for i in range(len(p) - SHINGLE + 1))


def is_copy(value: str, instruction: str, prompt: str) -> bool:
    """Whether ``value`` (all in plain form) gives back the instruction, or at least half of the prompt, as its answer."""
    if len(instruction) >= LEAST_PROMPT - 2 and instruction in value and len(instruction) >= 0.5 * len(value):
        return True
    if len(instruction) >= LEAST_PROMPT and 0.5 * len(value) <= len(instruction) <= 2 * len(value):
        least = 0.9 * max(len(instruction), len(value))
        if common_subsequence(instruction, value, least) >= least:
            return True
    if len(prompt) < LEAST_PROMPT or len(value) < COPIED * (1 - NEAR) * len(prompt):
        return False
    asked, given = _shingles(prompt), _shingles(value)
    both = len(asked & given)
    covered, own = both / len(asked), both / max(1, len(given))
    if own < OWN:
        return False
    if abs(covered - COPIED) <= NEAR:
        return common_subsequence(prompt, value, COPIED * len(prompt)) >= COPIED * len(prompt)
    return covered > COPIED


class Template:
    """Slots of words, those that must be met, and where each word may stand."""

    def __init__(self, text: str) -> None:
        parts = text.split(" ")
        self.slots = [frozenset(x.rstrip("*").split("|")) for x in parts]
        keys = [i for i, x in enumerate(parts) if x.endswith("*")]
        self.keys, self.last = frozenset(keys), keys[-1]
        self.least = ALIGNED * len(parts)
        self.where: dict[str, list[int]] = {}
        for i, words in enumerate(self.slots):
            for w in words:
                self.where.setdefault(w, []).insert(0, i)  # later slots first, so that a word isn't met twice

    def aligns(self, tokens: Sequence[tuple[str, int, int]], gap: int) -> bool:
        """Whether all keys, and ``ALIGNED`` of all slots, are met in order by tokens (word, start, end) with at most ``gap`` between two."""
        met: list[list[tuple[int, int]]] = [[] for _ in self.slots]  # (end of the last token, slots met) by the last slot
        for word, start, end in tokens:
            for s in self.where.get(word, ()):
                best = 0 if s <= min(self.keys) else -1
                for r in range(s - 1, -1, -1):
                    for to, n in reversed(met[r]):
                        if start - to > gap:
                            break
                        best = max(best, n)
                    if r in self.keys:
                        break
                if best >= 0:
                    met[s].append((end, best + 1))
                    if s >= self.last and best + 1 >= self.least:
                        return True
        return False


class Templates:
    """Templates of one language behind an index of their words: only those are aligned whose keys a sentence has all."""

    def __init__(self, code: str, texts: Sequence[str]) -> None:
        self.code, self.gap = code, GAPS[code]
        self.all = [Template(t) for t in texts]
        self.index: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(self.all):
            for k in t.keys:
                for w in t.slots[k]:
                    self.index.setdefault(w, []).append((i, k))
        words = {w for t in self.all for slot in t.slots for w in slot}
        self.phrases = re.compile("|".join(sorted(words, key=lambda w: (-len(w), w)))) if code == "zh" else None

    def tokens(self, sentence: str) -> list[tuple[str, int, int]]:
        if self.phrases is not None:
            return [(m.group(), m.start(), m.end()) for m in self.phrases.finditer(sentence)]
        text = sentence.lower()
        for a, b in _CONTRACTIONS:
            text = text.replace(a, b)
        return [(w, i, i + 1) for i, w in enumerate(re.findall(r"[^\W_]+", text))]

    def align(self, sentence: str) -> bool:
        tokens = self.tokens(sentence)
        keys: dict[int, set[int]] = {}
        for w in {w for w, _, _ in tokens}:
            for i, k in self.index.get(w, ()):
                keys.setdefault(i, set()).add(k)
        return any(len(found) == len(self.all[i].keys) and self.all[i].aligns(tokens, self.gap) for i, found in keys.items())


_REFUSING, _REFERRING = ([Templates(code, texts) for code, texts in some.items()] for some in (REFUSALS, REFERRALS))


@lru_cache(maxsize=20_000)
def _role(sentence: str) -> str | None:
    """``refuses``, ``refers`` or None, by the templates of the sentence's script."""
    zh = _CJK.search(sentence) is not None
    fits = lambda some: any(t.align(sentence) for t in some if (t.code == "zh") == zh)
    if _SPEAKER.search(sentence) and fits(_REFUSING):
        return "refuses"
    return "refers" if fits(_REFERRING) else None


def is_refusal(value: str) -> bool:
    """Whether the answer declines to answer: a sentence of its opening aligns with a refusal, or refusals and referrals are half of it. Quoted speech is not the answer's own."""
    if not _SPEAKER.search(value):
        return False
    own = _QUOTED.sub(" ", _TAGS.sub(" ", value))
    if not _SPEAKER.search(own):
        return False
    sentences = [s.strip() for s in _SENTENCE.findall(own) if s.strip()]
    roles = [_role(s) for s in sentences]
    if "refuses" not in roles:
        return False
    return "refuses" in roles[:OPENING] or 2 * (len(roles) - roles.count(None)) >= len(roles)


def defect_of(field: str, value: str | None, instruction: str, prompt: str, plain_instruction: str, plain_prompt: str) -> str | None:
    """The defect of a field besides truncation, or None."""
    if is_placeholder(value):
        return "empty" if field == "output" else None
    if is_copy(plain_form(value), plain_instruction, plain_prompt):
        return "copy"
    if is_refusal(value):
        return "refusal"
    asked, given = language_asked(instruction), language_of(value)
    if asked and given and asked != given and not (given == "latin" and asked in ("en", "fr")):
        return "other_lang"
    return None


def examined_values(df: DataFrame) -> DataFrame:
    """Per record and field: the state of the ending as in problem 1, and ``defect`` besides truncation. One pass over the texts."""
    picked = df.filter("record_id is not null").select("record_id", source_key(F.col("source"), F.col("_source_file")).alias("source"), "instruction", "input", *FIELDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, src, ins, inp, *values in b.itertuples(index=False, name=None):
                ins, inp = ins or "", inp or ""
                pi, pp = plain_form(ins), plain_form(inp)
                for field, value in zip(FIELDS, values):
                    defect = defect_of(field, value, ins, inp, pi, pp)
                    state = ending(value, ins, inp) if value is not None else NONE
                    rows.append((rid, src, field, len(value or ""), len((value or "").encode("utf-8", "replace")), state, defect))
            yield pd.DataFrame(rows, columns=["record_id", "source", "field", "n_chars", "n_bytes", "state", "defect"])

    return picked.mapInPandas(run, "record_id long, source string, field string, n_chars int, n_bytes int, state string, defect string")


def defective_fields(df: DataFrame) -> DataFrame:
    """(record_id, field, defect); a record delivered twice counts once."""
    seen = cut_lineage(examined_values(df).dropDuplicates(["record_id", "field"]))
    judged = judge(seen, source_baselines(seen))
    found = F.coalesce(F.col("defect"), F.when(F.col("is_cut"), F.lit("truncated")))
    return judged.select("record_id", "field", found.alias("defect")).filter("defect is not null")


def defect_rates(df: DataFrame) -> DataFrame:
    """Per source, field and defect: how many records have it."""
    seen = cut_lineage(examined_values(df).dropDuplicates(["record_id", "field"]))
    judged = judge(seen, source_baselines(seen))
    found = F.coalesce(F.col("defect"), F.when(F.col("is_cut"), F.lit("truncated")), F.lit("none"))
    return judged.groupBy("source", "field", found.alias("defect")).agg(F.count(F.lit(1)).alias("n_records"))
