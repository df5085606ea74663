from __future__ import annotations

import random

import pytest

from evalanvil.llm.answers import _BREAKS, Languages, ending, is_blank, lower_words, split_reasoning


@pytest.mark.parametrize(
    ("text", "answer", "unfinished"),
    [
        ("plain", "plain", False), ("<think>a</think>b", "b", False), ("<think>a", "", True), ("x</think>b", "b", False), ("[THINK]a[/THINK]\nb", "\nb", False),
        ("analysisHe waits.assistantfinalYes.", "Yes.", False), ("analysisHe waits", "analysisHe waits", True), ("analysis of data.", "analysis of data.", False), ("a<b and c", "a<b and c", False), ("hi<|end|>", "hi", False),
        ("one[/THINK]two</think>three", "three", False), ("one</think>two[/THINK]three", "two[/THINK]three", False), ("one</think>two</think>three", "two</think>three", False),
    ],
)
def test_split(text, answer, unfinished):
    assert split_reasoning(text) == (answer, unfinished)


@pytest.mark.parametrize(("text", "blank"), [("", True), (" \n\t", True), ("​\n﻿", True), ("```json\n\n```", True), ("```\n```", True), ("...", True), ("5", False), ("```\nx\n```", False), ("é", False), (" " * 999, True)])
def test_blank(text, blank):
    assert is_blank(text) is blank


@pytest.mark.parametrize(
    ("text", "whole"),
    [
        ("It rains.", True), ("It rains and the", False), ("Answer: C", True), ("Therefore I choose B", True), ("\\boxed{12}", True), ("42", True), ("B)", True), ("The Old Mill In Spring", True), ("Done. ✨", True),
        ("Fine. :)", True), ('[{"a": 1}]', True), ('[{"a": 1}, {"b"', False), ("```json\n{}", False), ("```json\n{}\n```", True), ("<a><b>x</b></a>", True), ("<a><b>x", False), ("name,n\na,1\nb,", False), ("It rains. (So they say)", True), ("It rains (so they say)", False), ("```\nrun(1)\n```", True), ("See `run --all`", True), ("See `run", False), ("It rains. [3]", True), ("He said \"no.\"", True),
    ],
)
def test_ending(text, whole):
    e = ending(text)
    assert (bool(e["stop"] or e["title"] or e["formula"] == 1) and not e["open"]) is whole


def test_languages():
    known = Languages()
    for lang, text in {
        "en": "It is not clear whether the road is closed.", "de": "Es ist nicht klar, ob die Straße noch offen ist.", "fr": "Il est clair que la route est dans la vallée.", "es": "No está claro si la calle es para todos.",
        "it": "Non è chiaro se la strada è per tutti.", "zh": "这条路已经关闭了。", "ru": "Неясно, закрыта ли дорога.",
    }.items():
        assert known.of(lower_words(text), text) == lang
    assert known.of([], "") == ""


def test_lower_words_above_ascii():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choices("aBÉß İ’'—…。，\n\t\x1c\u3000_-.;你🙂\ud800\x00", k=rng.randint(1, 30)))
        assert lower_words(t) == t.lower().translate(_BREAKS).split()


def test_unfinished_reasoning_that_names_an_assistant():
    text = "analysisThe user asks the assistant for a list. He waits."
    assert split_reasoning(text) == (text, True) and split_reasoning(text + "assistantfinalYes.") == ("Yes.", False)
    assert split_reasoning("The assistant waits.") == ("The assistant waits.", False)
