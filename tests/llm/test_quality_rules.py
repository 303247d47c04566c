"""Quality rules against plain Python."""

import random
import re

import pytest

from docketry.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    stop = {w for some in Q.STOP_WORDS.values() for w in some}
    stop = {w + s for w in stop | {w.capitalize() for w in stop} for s in ["", *".,;:!?"]}
    runs = re.findall(r"[^\W\d_]+", text)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_loud": text.count("!"), "n_stop_words": sum(w in stop for w in words), "n_letter_runs": len(runs),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
            "n_bullet_lines": sum(line.lstrip(" ")[:1] in Q.BULLETS for line in lines),
            "n_ellipsis_lines": sum(line.rstrip(" ").endswith(("...", "…")) for line in lines),
            "n_repeat_words": len(inside)}


def texts():
    rng = random.Random(13)
    parts = ["the", "of", "The,", "und", "für.", "la", "a|b", "##", "$", "!!", "é", "🙂", "x" * 40, "- ", "•", "...", "…", "7", "_"]
    gaps = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", " \n "]
    out = ["".join(rng.choice(parts[:rng.randrange(2, len(parts))]) + rng.choice(gaps) for _ in range(rng.randrange(60)))
           for _ in range(300)]
    phrase = "one two three four five six "
    return out + [None, "", " \t\n", "a b c d", "a b c d e", "a " * 9, "a " * 300, phrase * 2, phrase + "x " + phrase, "w" * 100_000,
                  " ".join(map(str, range(400))), "same line\nsame line\nother", "   x  ", "nul\x00 b"]


def test_measures_and_verdicts(spark):
    cases = list(enumerate(texts()))
    frame = spark.createDataFrame(cases, "doc_id long, text string")
    for row in Q.judge(frame).collect():
        want = brute(cases[row.doc_id][1])
        assert {m: row[m] for m in Q.MEASURES} == want, cases[row.doc_id]
        broken = [rule.name for rule in (*Q.BASE, *Q.RULES) if not (
            100 * want[rule.measure] >= rule.percent * (want[rule.per] if rule.per else 1) if rule.side == "least"
            else 100 * want[rule.measure] <= rule.percent * (want[rule.per] if rule.per else 1))]
        assert row.failed == broken and row.kept == (not broken)
        assert row.base_failed == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])


def test_one_projection(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = Q.judge(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Generate|Join", plan)


def test_table_shapes(spark):
    rows = [(1, "the a", None, 2), (1, "the a", "x", 3), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = Q.judge(frame).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and not any(r.kept for r in got)
    assert Q.judge(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="id column"):
        Q.judge(frame, id="kept")
    with pytest.raises(ValueError, match="unknown measure"):
        Q.judge(frame, rules=[Q.Rule("x", "n_nothing", "least", 1)])
    only = Q.judge(frame, rules=[], base=[Q.Rule("stop", "n_stop_words", "least", 50, "n_words")]).where("doc_id = 1")
    assert [r.kept for r in only.collect()] == [True, True]


def test_default_rules_by_hand(spark):
    clean = "The court of the town and the people in it wrote a long letter to the mayor of Rome."
    rows = [("clean", clean), ("symbols", clean.replace(" ", "# ")), ("shouting", clean.upper().replace(" ", "!! ")),
            ("letters", " ".join(["the", "and", "of", *[str(n) for n in range(20, 40)]])),
            ("lines", "\n".join(["the one line that comes again"] * 3 + ["and a last one of its own here"]))]
    got = {r.doc_id: r.failed for r in Q.judge(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got["clean"] == [] and got["symbols"] == ["symbols", "stop_words"]
    assert got["shouting"] == ["shouting", "stop_words"] and got["letters"] == ["without_letters"]
    assert "repeats" in got["lines"]
