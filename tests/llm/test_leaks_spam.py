"""Problems 7 and 8."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveworks.llm.plain import plain_form
from sieveworks.llm import leaks, spam

DOCS = "doc_id long, text string, item_id string, run string"
ITEMS = "item_id long, passage string, run int"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab", min_size=0, max_size=60), st.text(alphabet="ab", min_size=6, max_size=30), st.integers(6, 12))
def test_shared_runs_are_found_exactly(doc, passage, run):
    share = any(passage[i : i + run] in doc for i in range(len(passage) - run + 1))
    assert bool(leaks.Index.of([(1, passage)], run).leaked(doc)) == share


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 9))
def test_winnow_keeps_the_least_of_each_window(values, w):
    h = np.array(values, np.uint64)
    kept = set(leaks.winnow(h, w).tolist())
    for i in range(len(h) - w + 1):
        assert any(j in kept and h[j] == h[i : i + w].min() for j in range(i, i + w))


def test_repetitive_texts_take_no_squared_time():
    assert leaks.Index.of([(1, "a" * 20_000), (2, "ab" * 10_000)], 80).leaked("a" * 300_000 + "ab" * 50_000) == {1, 2}
    assert leaks.Index.of([(1, "a" * 79)], 80).leaked("a" * 1000) == set()


def test_both_ways_agree_with_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    passages = [(i, " ".join(word() for _ in range(30)), 28 if i % 2 else 80) for i in range(20)]
    docs = []
    for i in range(120):
        t = " ".join(word() for _ in range(60))
        if i % 3 == 0:
            p = passages[rng.randrange(20)][1]
            a = rng.randrange(60)
            t += " " + p[a : a + rng.choice([20, 34, 90, 130])].upper().replace(" ", ", ") + " " + word()
        docs.append((i, t, "x", "y"))
    docs += [(200, None, "x", "y"), (201, "", "x", "y"), (202, passages[0][1] * 2000, "x", "y"), (202, passages[0][1] * 2000, "x", "y"), (None, passages[1][1], "x", "y")]
    items = passages + [(50, None, 28), (51, "", 28), (52, "short", 80), (1, passages[1][1], 28)]
    df, held = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = set()
    for i, t, *_ in docs:
        for j, p, run in items:
            a, b = plain_form(t), plain_form(p)
            if i is not None and any(b[x : x + run] in a for x in range(len(b) - run + 1)):
                want.add((i, j))
    assert {tuple(r) for r in leaks.leaked_passages(df, held).collect()} == want
    assert {tuple(r) for r in leaks.leaked_passages(df, held, max_index_chars=0).collect()} == want
    assert leaks.leaked_passages(df.limit(0), held).count() == 0 and leaks.leaked_passages(df, held.limit(0)).count() == 0


PROSE_EN = "The court held that the claim was not made out, and it ordered each of the parties to bear its own costs. The appeal was dismissed because the notice had been sent too late."
PROSE_ZH = "本院认为，原告的请求缺乏事实依据，应当予以驳回。被告已经在期限内履行了付款的义务，双方对此没有争议。"


def _spam(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(1000 + i, f"{PROSE_EN} {PROSE_ZH} {i}", "x", "y") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spam string, chars string")
    return {r["doc_id"] for r in spam.spam_pages(df).collect()}


def test_spam_and_ordinary_pages(spark):
    bad = [
        "找离婚律师就到翎原县离婚律师，翎原县离婚律师专业离婚律师。" * 8,
        "\n".join(f"http://aldford-{i}.example/p/{i}\n#probate" for i in range(12)),
        " ".join(f"<a>custody{i}</a>" for i in range(20)),
        "，".join(f"{x}劳动仲裁" for x in "甲乙丙丁戊己庚辛壬癸子丑寅卯"),
        "Call visa help Aldford now, visa help lawyer visa help. Best visa help Corby visa help near Corby cheap visa help. " * 6,
        "\n".join(f"Aldford cheap notary ${i}9 ref 4{i}" for i in range(15)),
        PROSE_EN + "\n" + "\n".join(f"Vinford local attorney\nhttp://corby-{i}.test/tag/{i}" for i in range(20)),
    ]
    good = [
        PROSE_EN, PROSE_ZH, PROSE_EN * 300, None, "", "404",
        PROSE_EN + "\n\n[1] http://aldford.example/a\n[2] http://aldford.example/b\n#notes",
        "\n".join(f"201{i % 10}年{i % 12 + 1}月5日 一审法院 唐某诉孙某 盗窃罪" for i in range(20)),
        "\n".join(f"Torowski v Aldford Logistics SA (6030{i}/26), {i + 1} September 2001: stayed" for i in range(20)),
        "\n".join(f"{i}. 复印的扣押物品清单" for i in range(1, 15)),
        PROSE_ZH * 3 + "\n相关：离婚律师，劳动仲裁，债务纠纷",
    ]
    found = _spam(spark, bad + good)
    assert found == set(range(len(bad)))


def test_repeated_sentences(spark):
    en, zh = "The best of the lawyers in Aldford will call you back on the same day.", "本所的律师已经为翎原县的客户办理了各类案件，欢迎来电咨询。"
    prose = [f"On day {i} of the hearing the witness said that he had seen {i + 3} of the boxes in the yard." for i in range(12)]
    bad = ["\n".join([en] * 20), "\n".join([zh] * 20), "\n".join(f"{en} {p}" for p in prose[:3]) + f"\n{en}" * 9]
    good = ["\n".join(prose), "\n".join(p + "\nPage of the file" for p in prose), "\n".join([en, *prose, en])]
    assert _spam(spark, bad + good) == set(range(len(bad)))


def test_lists_of_keywords_and_offers(spark):
    """What ends no sentence is one list: by the length of its items, or by what recurs in it."""
    towns = ["Aldford", "Corby", "Vinley", "Marlgate", "Pelbrook", "Halmere", "Yelcombe", "Ostercross", "Lamstead", "Tarnholm", "Wexilham", "Grisdale"]
    bad = [
        "; ".join(f"{t} power of attorney sale {i}7 / No.{i}4711" for i, t in enumerate(towns)),
        "\n".join(f"{t} no win no fee" for t in towns),
        PROSE_EN + "\n" + " | ".join(f"{t} will template ${i}9 / No.88{i}" for i, t in enumerate(towns)),
        "，".join(f"{t}{k}" for t in ("澹溪镇", "蕤湾县", "岫桥县", "琅墩乡", "栖渡镇") for k in ("婚前协议", "取保候审", "婚前协议")),
        " ".join(f"{t}婚前协议" for t in ("澹溪镇", "蕤湾县", "岫桥县", "琅墩乡", "栖渡镇", "滟坞县", "砚洲县", "霂塘市", "昀原乡")),
    ]
    good = [
        PROSE_EN[:-1], PROSE_ZH[:-1], "\n".join(f"{t} v Torowski, file {i}, 3 May 2011" for i, t in enumerate(towns)), PROSE_EN + "\nNo.88 / Aldford\nNo.89 / Corby",
    ]
    assert _spam(spark, bad + good) == set(range(len(bad)))


def test_usual_pages_are_calibrated(spark):
    rows = [(i, lang, 100, n, 600, k, r) for lang, n, k, r in (("en", 35, 10, 20.0), ("fr", 90, 20, 90.0), ("zh", 0, 50, -1.0)) for i in range(40)]
    got = spam.usual_pages(spark.createDataFrame(rows, "doc_id long, language string, chars int, repeated int, prose int, clauses int, prose_recurs double"))
    assert {tuple(r) for r in got.select("language", "repeats", "clause", "recurs").collect()} == {("en", 0.35, 60.0, 0.2), ("fr", 0.5, 30.0, 0.5), ("zh", 0.2, 12.0, 0.15)}


def test_spam_of_nothing(spark):
    assert spam.spam_pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_pages_take_no_squared_time():
    for v in ("word" + " " * 400_000 + "word", "<a>" * 100_000, "# " * 100_000, "| " * 100_000, "a. " * 100_000, "word " * 200_000):
        spam.page_profile(v)
