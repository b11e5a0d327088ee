import numpy as np
from conftest import by_hand

from lexforge.llm import quality as q

PROSE = "这里的“分化”不是日常用语中的含义，而是特指初级溃疡所引起的改变。实验表明，当节律超过{}纳摩尔时，梗死区明显减弱。与孢子相比，液泡的机制更稳定，但建立所需的时间也更长。"
ENGLISH = "Note that the manifold is only measurable when the polynomial has been kept constant for {} days. It follows that this theorem is not enough to explain the effect."


def texts():
    prose = [PROSE.format(i) for i in range(60)] + [ENGLISH.format(i) for i in range(40)]
    return prose, {
        "list": ["\n".join(f"- 液泡{c}分布" for c in "甲乙丙丁戊己庚辛"), "\n".join(f"({i}) 渗出液。" for i in range(1, 12))],
        "table": ["| 介质 | 光栅 |\n|---|---|\n" + "\n".join(f"| 热机 | {i}.5 |" for i in range(9)), "<table>" + "<tr><td>a</td><td>+</td></tr>" * 9 + "</table>"],
        "junk": ["#*~ }{ <>| ~~ ^^ \\\\ ]] [[ {{ == && %% $$ ##" * 3, "点击这里 " * 30, "var p0=document.getElementById('c3');if(p0){p0.style.display='none';}\n" * 8],
        "empty": [None, "", " \n　", "​"],
    }


def test_types(spark):
    prose, others = texts()
    rows = [(i, t, "clash", 1.0) for i, t in enumerate([*prose, *(t for ts in others.values() for t in ts)])]
    got = {r.doc_id: r for r in q.describe(spark.createDataFrame(rows, "doc_id long, text string, text_type string, n_chars double")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text_type == "prose" for i in range(len(prose)))
    assert not any(got[i].text_type == "prose" for i in range(len(prose), len(rows)))
    blank = [got[i] for i in range(len(rows) - 4, len(rows))]
    assert all(r.text_type == "empty" and r.n_chars is None and r.p_prose is None for r in blank)
    assert abs(sum(got[0][f"p_{t}"] for t in q.TYPES) - 1) < 1e-9


def plain(text):
    """Some statistics, written out plainly."""
    lines = [x for x in text.split("\n") if x.strip()]
    solid = [c for c in text if not c.isspace()]
    return {"n_chars": len(text), "n_lines": len(lines), "digit_share": sum(c.isascii() and c.isdigit() for c in text) / len(solid), "mean_line_length": len(solid) / len(lines), "line_end_share": sum(x.rstrip()[-1] in q.ENDS + "”」）)：" for x in lines) / len(lines), "distinct_line_share": len({x.strip() for x in lines}) / len(lines)}


def test_statistics_against_plain_ones():
    prose, others = texts()
    some = [prose[0], prose[70] + "\n\n" + prose[1], *others["list"], *others["table"], "x", "a。\na。\n\n b 1"]
    got = q.statistics(some, np.zeros(2 * q.BUCKETS, bool))
    for i, text in enumerate(some):
        for name, value in plain(text).items():
            assert abs(got[name][i] - value) < 1e-9, (name, text)


def test_a_batch_and_single_texts_give_the_same():
    prose, others = texts()
    some = [*prose[:3], *others["list"], *others["junk"]]
    common = np.ones(2 * q.BUCKETS, bool)
    whole = q.statistics(some, common)
    for i, text in enumerate(some):
        one = q.statistics([text], common)
        assert all(abs(one[n][0] - whole[n][i]) < 1e-9 for n in q.STATS)


def test_very_long_repeated_and_no_rows(spark):
    long = "".join(PROSE.format(i) for i in range(3000))
    rows = spark.createDataFrame([(1, long), (1, long), (2, "x" * 300_000), (3, "😀 " * 50)], "doc_id long, text string")
    got = by_hand(q.describe(rows).select("doc_id", "n_chars"))
    assert got == [(1, float(len(long))), (1, float(len(long))), (2, 300_000.0), (3, 100.0)]
    assert q.describe(rows.limit(0)).count() == 0


def test_learning_finds_planted_accuracies():
    """Rates that differ from those it starts from come out for every kind, those of one in a hundred too."""
    rng = np.random.default_rng(0)
    start = np.array([r[2] for r in q.RULES])
    theta = np.clip(start + np.where(start < 0.5, 1, -1) * rng.uniform(0.02, 0.09, start.shape), 0.01, 0.99)
    share = [0.75, 0.05, 0.04, 0.05, 0.03, 0.03, 0.04, 0.01]
    kind = rng.choice(len(q.KINDS), 200_000, p=share)
    fires = rng.random((len(kind), len(q.RULES))) < theta[:, kind].T
    patterns, counts = np.unique((fires * (1 << np.arange(len(q.RULES)))).sum(1), return_counts=True)
    found, learnt = q.learn(patterns, counts.astype(float))
    assert np.abs(found - share).max() < 0.01
    assert np.abs(learnt - theta).max() < 0.05 and np.abs(start - theta).max() > 0.08


def test_letters_of_all_scripts_and_whole_words():
    texts = ["Это предложение о линейных операторах.", "Voilà une phrase très française, déjà vérifiée.", "これは日本語の文章です。", "이것은 문장입니다.", "𠀀𠀁是字。"]
    got = q.statistics(texts, np.zeros(2 * q.BUCKETS, bool))
    assert (got["symbol_share"] == 0).all()
    assert got["n_words"].tolist() == [5, 7, 11, 2, 4]
    assert got["listed_share"][0] == 0 and got["listed_share"][1] > 0.8 and got["listed_share"][3] == 0
    # words that differ only far behind
    long = ["a" * 300 + "b", "a" * 300 + "c"]
    assert q.word_hash(long[0]) != q.word_hash(long[1]) and q.word_hash("ПРИВЕТ") == q.word_hash("привет")
    for w in (*long, "слово", "the"):
        assert q.Points([w]).words()[1].tolist() == [q.word_hash(w)]


def test_agreement_with_raters(spark):
    said = spark.createDataFrame([(1, "prose"), (1, "prose"), (2, "list"), (3, "junk")], "doc_id long, text_type string")
    labels = spark.createDataFrame([(1, " Prose", "a"), (1, "prose", "a"), (1, "prose", "b"), (2, "TABLE", "a"), (3, None, "a"), (9, "junk", "a")], "doc_id long, kind string, rater string")
    assert by_hand(q.agreement(said, labels)) == [("prose", "prose", 2), ("table", "list", 1)]


def test_long_texts_that_repeat_a_phrase_have_a_small_share_of_distinct_windows():
    # as many distinct windows as the period, and one with the line end: below and above the former limit of 4,000 characters
    for phrase in ("欢迎关注我们的公众号。", "This is the end. ", "这是在做什么呢。", "转载请注明出处 "):
        for size in (3_999, 5_000, 50_000):
            text = (phrase * (size // len(phrase) + 1))[:size]
            got = q.statistics([text], np.zeros(2 * q.BUCKETS, bool))
            assert got["distinct_windows"][0] == len(phrase) + 1, (phrase, size)
            assert abs(got["distinct_window_share"][0] - (len(phrase) + 1) / (size - q.WINDOW + 2)) < 1e-9
