"""The classifier of broken pairs on pairs that it has not seen, and its edges."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import numpy as np
import pytest

from evalanvil.llm import pairs as P
from evalanvil.llm.answers import ending, is_blank, split_reasoning
from evalanvil.llm.pairs import refusing
from evalanvil.llm.queries import with_prompts
from evalanvil.llm.truncation import at_spikes, flag_truncated, length_spikes

SUBJECTS = ("the harbour", "an old mill", "the north road", "a small library", "the winter market", "a ferry", "the quarry", "the garden wall", "a copper bell", "the long canal")
VERBS = ("was repaired by the farmers", "cannot hold more boats", "is closed in early spring", "stands near the river", "belongs to nobody", "needs a new roof", "was painted twice", "feeds the valley")
ENDS = ("after the rain", "during the winter", "for many years", "because the wood is dry", "although it is late", "and nobody knows why")
GERMAN = ("Der Hafen ist im Winter nicht offen, weil das Eis zu dick ist.", "Die Mühle am Fluss wurde von den Bauern wieder aufgebaut.", "Es ist nicht klar, ob die Straße noch offen ist.")
FRENCH = ("Le moulin est fermé depuis des années parce que le toit est cassé.", "Il est clair que la route est dans la vallée.", "Les pêcheurs ne sont pas contents de la pluie.")


def world(n, seed):
    rng = random.Random(seed)
    sentence = lambda: f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(ENDS)}.".capitalize()
    out = []
    for i in range(n):
        prompt = f"Write {rng.randint(2, 9)} sentences about {rng.choice(SUBJECTS)} and say who {rng.choice(VERBS)}. Case {rng.randint(1000, 9999)}."
        x = rng.random()
        answer = " ".join(sentence() for _ in range(rng.randint(1, 6)))
        if x < 0.1:
            answer = "- " + "\n- ".join(f"{rng.choice(SUBJECTS)} {rng.choice(ENDS)}" for _ in range(rng.randint(2, 5)))
        elif x < 0.2:
            answer = f"{answer} Answer: {rng.choice('ABCD')}"
        elif x < 0.25:
            prompt, answer = "Beschreibe den Hafen und die Mühle in zwei Sätzen. Nr. " + str(i), " ".join(rng.sample(GERMAN, 2))
        out.append((prompt, answer))
    return out


@pytest.fixture(scope="module")
def model():
    return P.PairModel.fit(world(1200, 1))


def label(model, rows):
    p, _ = model.score([P.read_prompt(a, model.langs) for a, _ in rows], [b for _, b in rows])
    r = p / model.linear.threshold
    return [P.LABELS[k] if r[i, k] >= 1 else "" for i, k in enumerate(r.argmax(axis=1))]


def test_held_out(model):
    rng = random.Random(9)
    sound = world(400, 2)
    broken = []
    for prompt, answer in sound[:200]:
        cut = P.cut(rng, answer)
        broken += [((prompt, cut), "truncated")] if cut else []
        broken += [((prompt, prompt.lower()), "copy"), ((prompt, "Sure! " + prompt), "copy")]
        if "Beschreibe" not in prompt:
            broken.append(((prompt, " ".join(rng.sample(FRENCH, 2))), "language"))
        broken += [((prompt, "I'm sorry, but I am unable to do that for you."), "refusal"), ((prompt, "​"), "empty"), ((prompt, "<think>" + answer), "truncated")]
    false = sum(bool(x) for x in label(model, sound))
    right = sum(a == b for a, (_, b) in zip(label(model, [x for x, _ in broken]), broken))
    assert false <= 0.02 * len(sound) and right >= 0.97 * len(broken)


def test_traps(model):
    prompt = "Write 3 sentences about the harbour and say who was painted twice. Case 1234."
    answer = "The harbour was repaired by the farmers after the rain."
    for text in (f'You asked: "{prompt}"\n{answer}', f"{prompt}\n\n{answer}", f"<think>I cannot help with that</think>{answer}", answer + " ✨"):
        assert label(model, [(prompt, text)]) == [""], text
    assert label(model, [(None, "I refuse to answer."), (None, None), (None, "")]) == ["refusal", "empty", "empty"]


def test_spark(spark, model):
    rows = [(i, "src", "e/d", p, t, len(t), len(t.encode()), 64) for i, (p, t) in enumerate(world(60, 4))]
    rows += [(100, None, None, None, None, None, None, None), (101, "src", "e/d", "", "x" * 50_000, 50_000, 50_000, 0)]
    schema = "row_id long, source string, dataset string, prompt string, text string, chars long, bytes long, max_tokens int"
    df = spark.createDataFrame(rows, schema)
    scored = P.score_pairs(df.repartition(3), model)
    got = {r["row_id"]: r for r in scored.collect()}
    assert len(got) == 62 and got[100]["empty"] == 1.0
    flagged = flag_truncated(scored, 0.5)
    assert flagged.count() == 62 and P.score_pairs(df.limit(0), model).count() == 0
    assert P.sample_pairs(df, 10) == P.sample_pairs(df.repartition(5), 10) and len(P.sample_pairs(df, 10)) == 10


SPIKES = "source string, chars long, bytes long, max_tokens int, stop boolean"


def test_spikes(spark):
    """A field's width in characters and bytes; natural crowds with an end, and null lengths, are none."""
    rows = [("s", 100 + i % 50, 100 + i % 50, None, i % 7 > 0) for i in range(500)] + [("s", 256, 300, None, False)] * 40 + [("s", 90, 90, None, True)] * 60
    rows += [(None, None, None, 7, False), ("few", 256, 256, None, False), ("s", 700, 700, None, None)]
    found = length_spikes(spark.createDataFrame(rows, SPIKES)).collect()
    assert {(r["source"], r["measure"], r["length"], r["open_texts"]) for r in found} == {("s", "chars", 256, 40), ("s", "bytes", 300, 40)}
    assert length_spikes(spark.createDataFrame([], SPIKES)).count() == 0


def test_spikes_at_a_token_limit(spark):
    """Cut at about the same ratio of characters to tokens, whatever the limit; only at the upper end."""
    rng = random.Random(5)
    rows = [("m", n, n, limit, rng.random() > 0.02) for limit in (100, 400) for n in (rng.randint(5, 3 * limit) for _ in range(900))]
    rows += [("m", n, n, limit, False) for limit in (100, 400) for n in (int(limit * rng.uniform(4.25, 4.35)) for _ in range(30))]
    found = {(r["measure"], r["length"]) for r in length_spikes(spark.createDataFrame(rows, SPIKES)).collect()}
    assert found == {("token_chars", 21), ("token_bytes", 21)}


def test_a_source_without_spikes_keeps_its_rows(spark):
    texts = spark.createDataFrame([("a", 256, 256, 0, False)] * 20 + [("b", 256, 256, 0, False), (None, None, None, None, None)], SPIKES)
    placed = at_spikes(texts, length_spikes(texts))
    assert placed.count() == 22 and {(r["source"], r["spike"]) for r in placed.collect()} == {("a", "chars"), ("b", None), (None, None)}


def test_samples_are_bounded_in_bytes(spark):
    from evalanvil.llm.sampling import lowest

    df = spark.createDataFrame([(i, "é" * 50 if i % 2 else None) for i in range(40)], "i int, t string").repartition(5)
    assert sorted(r["i"] for r in lowest(df, ["i"], ["t"], 30, 1000).collect()) == list(range(21))  # ten texts of 100 bytes
    assert lowest(df, ["i"], ["t"], 7).count() == 7 and lowest(df.limit(0), ["i"], ["t"], 7).count() == 0


def test_prompts(spark):
    lines = spark.createDataFrame([(1, "abc"), (2, "zzz"), (3, None)], "row_id long, sid string")
    m = "messages array<struct<role:string,content:string>>"
    samples = spark.createDataFrame([(" ABC", [("system", "x"), ("user", "ask")]), ("abc", [("user", "ask")]), ("q", None), ("r", [])], f"id string, {m}")
    assert {r["row_id"]: r["prompt"] for r in with_prompts(lines, samples).collect()} == {1: "ask", 2: None, 3: None}


def test_determinism():
    a, b = P.PairModel.fit(world(150, 3)), P.PairModel.fit(world(150, 3))
    assert np.array_equal(a.linear.w, b.linear.w) and P.PairModel.fit([]).langs is not None


_FIT = """
import sys, hashlib
sys.path[:0] = {path}
from test_pairs import world
from evalanvil.llm.pairs import PairModel
m = PairModel.fit(world(200, 3))
print(hashlib.sha256(m.linear.w.tobytes() + m.linear.threshold.tobytes() + repr(sorted(m.langs.votes.items())).encode()).hexdigest())
"""


def test_processes_with_other_hash_seeds_agree():
    """Sets of strings iterate differently under another seed; no result may follow them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = _FIT.format(path=[root, os.path.join(root, "tests", "llm")])
    runs = [subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": s}, capture_output=True, text=True, check=True) for s in "123"]
    assert len({r.stdout for r in runs}) == 1 and runs[0].stdout.strip()


def test_long_answers_follow_the_rules_of_short_ones(model):
    """Blank marks, empty code blocks, late markers and refusals after a long preamble, on both sides of any length."""
    assert is_blank("." * 300) and is_blank("." * 5000) and is_blank("```\n```") and is_blank("```" + "\n" * 5000 + "```")
    for lead in ("", "\n" * 500):
        assert split_reasoning(lead + "analysisHe waits") == (lead + "analysisHe waits", True)
    near, far = ending("So it is.\nAnswer: C"), ending("So it is. " * 500 + "\nAnswer: C")
    assert near["formula"] == far["formula"] == 1 and ending("x" * 300 + " and the")["last"][-2:] == ["and", "the"]
    assert refusing("The mill is old. " * 300 + "I'm sorry, but I cannot go on.")[2] == 2
    listed = "Steps for the old mill:\n" + "a, b, c\n" * 3
    assert ending(listed)["form"] == ending("Steps " + "for the very old mill " * 20 + ":\n" + "a, b, c\n" * 3)["form"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables to train on")
def test_pairs_of_another_hand(spark):
    """Trained as the queries train it, on hand-written pairs of other subjects: at least 0.9 in every class."""
    from independent_pairs import PAIRS

    from evalanvil.llm.queries import _model

    model = _model(spark, "/root/testdata/sf0.01")
    for kind, rows in PAIRS.items():
        got = label(model, list(rows))
        assert np.mean([g == kind for g in got]) >= 0.9, (kind, [(g, r[1]) for g, r in zip(got, rows) if g != kind])
