"""Reading answers, on pairs of input and expected value."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalanvil.functions import keys, text


def ask(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


STRIP = [
    ("no markers at all", "no markers at all"), ("<think>count the legs</think>Eight.", "Eight."), ("[THINK]two\nlines[/THINK]\n\nParis ", "Paris"), ("<Think>mixed case</tHINK>ok", "ok"),
    ("the opening tag was lost</think>42", "42"), ("lost here too[/THINK]43", "43"), ("Done.<think>and then the text ended", "Done."), ("One.[THINK]again", "One."),
    ("pre <think>a</think>mid<think>b</think> post", "pre mid post"), ("first[/THINK]second</think>third", "third"), ("first</think>second[/THINK]third", "second[/THINK]third"),
    ("first</think>second</think>third", "second</think>third"), ("first[/THINK]second[/THINK]third", "second[/THINK]third"), ("<think>x</think>y[/THINK]z", "z"), ("<think>never closed [/THINK] it</think>out", "out"),
    ("analysis weigh both.assistantfinal[1, 2]", "[1, 2]"), ("<|channel|>analysis<|message|>hm<|start|>assistant<|channel|>final<|message|>Yes<|return|>", "Yes"), ("Bye<|end|>\n", "Bye"), ("", ""), (None, None), ("\u00a0 wide \u2003", "wide"),
]


def test_strip_reasoning(spark):
    assert ask(spark, [a for a, _ in STRIP], text.strip_reasoning) == [b for _, b in STRIP]


MCQ = [
    ("C", "C", "single_letter"), ("d", "D", "single_letter"), ("Answer: D, or rather\nAnswer: B", "B", "primary"), ("_Answer_: C", "C", "primary"), ("hence \\boxed{D}", "D", "boxed"),
    ("I think the answer is a", "A", "answer_is"), ("The answer is (B", "B", "answer_is_paren"), ("A) the first one", "A", "choice_format"), ("clearly C is the correct answer", "C", "explicit"),
    ("which leaves\nD", "D", "standalone_end"), ("B. it is", "B", "letter_period"), ("D; no doubt", "D", "letter_nonword"), ("Answer: G", None, None), ("none of them", None, None), ("", None, None), (None, None, None),
]


def test_mcq(spark):
    got = ask(spark, [a for a, *_ in MCQ], lambda c: text.mcq_answer(c, "ABCD"))
    assert [(g["extracted"], g["pattern"]) for g in got] == [(b, c) for _, b, c in MCQ]


def test_numbers(spark):
    assert ask(spark, ["\\boxed{1} \\boxed{\\frac{1}{2}}", "\\fbox{ 3 }", "none", None], text.boxed_answer) == ["\\frac{1}{2}", "3", None, None]
    assert ask(spark, ["1,000", "3-2", "a 1.50 b", "x"], text.last_number) == ["000", "-2", "1.50", None]
    cases = ["2,750", "9.810", "15km", "none", "", None, "inf", ".750", "-0.125", "+8", "nan", "+4e15", "+123456789012345678", "+5e20", ".5e1"]
    assert ask(spark, cases, text.normalize_numeric) == ["2750", "9", "15", None, None, None, None, "0.75", "-0", "8", None, "4000000000000000", "123456789012345680", "500000000000000000000", "5"]


def test_long_and_hostile(spark):
    nested = "\\boxed{" + "{a}" * 80_000 + "}"
    assert len(ask(spark, [nested], text.boxed_answer)[0]) == 240_000
    assert ask(spark, ["<think>" * 50_000 + "x"], text.strip_reasoning) == [""]
    assert ask(spark, ["y" * 300_000 + "[/THINK]b", "y" * 300_000 + "</think>" * 9 + "b"], text.strip_reasoning) == ["b", "</think>" * 8 + "b"]


def test_keys(spark):
    assert ask(spark, [" AbC\n", " x#1 ", None], keys.norm_id) == ["abc", "x#1", None]
    assert ask(spark, ["a#1", "a#b#2", "a", "#"], keys.logical_id) == ["a", "a#b", "a", ""]
    assert ask(spark, ["", "é", None], keys.short_hash) == ["e3b0c44298fc", "4a99557e4033", None]
    assert ask(spark, ["a--b", "a/b"], keys.model_key) == ["a/b", "a/b"]


@pytest.mark.parametrize(("name", "want"), [("not_unanimous", "not-unanimous"), ("x", "x")])
def test_stage_name(name, want):
    assert text.stage_name(name) == want
