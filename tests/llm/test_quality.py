from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest

from evalanvil.llm import quality as Q
from evalanvil.llm.holdout import HOLDOUT

from prose_world import prose


@pytest.fixture(scope="module")
def model():
    return Q.QualityModel.fit([prose(random.Random(i)) for i in range(300)])


def judged(model, texts):
    x = np.array([Q.document_stats(t, model.familiar) for t in texts])
    return [Q.KINDS[i] for i in model.trees.probabilities(x).argmax(axis=1)]


def test_held_out(model):
    rng = random.Random(77)
    texts, kinds = [], []
    bank = [s + "." for s in prose(rng, 60).split(". ")]
    for i in range(80):
        for make, kind in ((lambda: prose(rng), "prose"), (lambda: Q.make_list(rng, bank), "list"), (lambda: Q.make_table(rng, bank), "table"), (lambda: Q.make_junk(rng, bank), "junk")):
            texts.append(make())
            kinds.append(kind)
    assert np.mean([a == b for a, b in zip(judged(model, texts), kinds)]) > 0.95


def test_hand_checked(model):
    """On the half of the hand-checked texts that does not calibrate; the temperature lies inside its grid."""
    unseen = HOLDOUT[1::2]
    right = [a == k for a, (_, k) in zip(judged(model, [t for t, _ in unseen]), unseen)]
    assert np.mean(right) >= 0.9 and 0.06 < model.trees.temperature < 19


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables to train on")
def test_texts_of_another_hand(spark):
    """Trained as the queries train it, on hand-written texts of other subjects: at least 0.9 of every kind."""
    from independent_texts import TEXTS

    from evalanvil.plans.session import read_table

    documents = read_table(spark, "/root/testdata/sf0.01", "documents")
    model = Q.QualityModel.fit(Q.sample_texts(documents), familiar=Q.familiar_of(documents))
    got = judged(model, [t for t, _ in TEXTS])
    assert len(TEXTS) >= 150
    for kind in Q.KINDS:
        found = [(a, t) for a, (t, k) in zip(got, TEXTS) if k == kind and t.strip()]
        assert np.mean([a == kind for a, _ in found]) >= 0.9, [t for a, t in found if a != kind]


def test_a_corpus_without_prose_still_gives_a_model():
    few = Q.QualityModel.fit(["1;2;3\n4;5;6\n7;8;9"] * 5)
    assert judged(few, ["| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 9, prose(random.Random(1))]) == ["table", "prose"]


def test_ends_are_found_whatever_follows():
    """A line's end is judged behind any number of quotes, brackets and blanks."""
    blind = Q.Familiar(np.zeros((64, 64), np.float32), np.zeros(1 << Q.Familiar.BITS, bool), np.zeros(0))
    for tail in ("", '"', ")" * 40, " " * 400):
        assert Q.document_stats(f"The mill is old.{tail}\nIt stands{tail}", blind)[Q.STATS.index("line_end_share")] == 0.5
    assert Q.document_stats("." * 200_000 + "x", blind)[0] == 200_001  # in linear time


def test_batches_and_chunks_change_nothing(monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng), "", None, "a", "x" * 5000, Q.make_table(rng, ["one two three four."] * 4), "\n\n", "é🙂 #a#b 7", prose(rng)] * 3
    fam = Q.Familiar.of(*Q.corpus_counts(texts))
    one = np.array([Q.document_stats(t, fam) for t in texts])
    assert np.allclose(Q.batch_stats(texts, fam), one) and Q.batch_stats([], fam).shape == (0, len(Q.STATS))
    counts = Q.corpus_counts(texts)
    monkeypatch.setattr(Q, "CHUNK", 50)
    assert np.allclose(Q.batch_stats(texts, fam), one) and all((a == b).all() for a, b in zip(counts, Q.corpus_counts(texts)))


def test_stats_by_hand():
    blind = Q.Familiar(np.zeros((64, 64), np.float32), np.zeros(1 << Q.Familiar.BITS, bool), np.zeros(0))
    s = dict(zip(Q.STATS, Q.document_stats("The mill is old.\n- a #1 road\n", blind)))
    assert s["words"] == 7 and s["lines"] == 2 and s["line_end_share"] == 0.5 and s["chars"] == 29
    assert abs(s["mean_word_length"] - 18 / 7) < 1e-9 and s["digit_ratio"] == 1 / 29 and s["symbol_ratio"] == 1 / 29
    assert Q.document_stats(None, blind) == Q.document_stats(" \n", blind) == [0.0] * len(Q.STATS)
    for odd in ("\ud800x", "x" * 300_000, "\n" * 1000 + "a", "🙂", "a\x00b"):
        assert len(Q.document_stats(odd, blind)) == len(Q.STATS)


def test_spark(spark, model):
    rows = [(1, prose(random.Random(5)), "k"), (2, None, "k"), (3, "", "k"), (4, "- two barrels\n- the north gate\n- three maps\n- salt\n- a lantern", "k"), (5, "- two barrels\n- the north gate\n- three maps\n- salt\n- a lantern", "k")]
    out = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, kind string"), model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["kind"] == "prose" and got[2]["kind"] == got[3]["kind"] == "junk" and got[4]["kind"] == got[5]["kind"] == "list"
    assert got[2]["probability"] == 1.0 and got[1]["words"] > 0
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    assert len(Q.sample_texts(spark.createDataFrame(rows, "doc_id long, text string, kind string"), rows=2)) == 2


def test_characters_of_all_unicode():
    blind = Q.Familiar(np.zeros((64, 64), np.float32), np.zeros(1 << Q.Familiar.BITS, bool), np.zeros(0))
    of = lambda t: dict(zip(Q.STATS, Q.document_stats(t, blind)))
    for symbols in ("\ufffd", "🙂", "\ue000", "\U000f0000"):
        assert of(f"ab{symbols}{symbols}")["symbol_ratio"] == 0.5 and of(f"ab{symbols}cd")["mixed_word_share"] == 1
    s = of("你好，世界！（好）")
    assert s["punctuation_ratio"] == 4 / 9 and s["symbol_ratio"] == 0
    assert of("한국 힣𠀀")["symbol_ratio"] == of("हिन्दी")["symbol_ratio"] == 0 and of("ÄÖ Жж")["upper_ratio"] == 0.75
    assert of(" ".join(sorted(Q._COMMON_ANY)))["common_kinds"] > 40


def test_counts_are_those_of_the_patterns():
    blind = Q.Familiar(np.zeros((64, 64), np.float32), np.zeros(1 << Q.Familiar.BITS, bool), np.zeros(0))
    mixed, number = re.compile(r"\w[^\w\s.,'’/;:()\"-]+\w"), re.compile(r"\b\d[\w.,]*")
    rng = random.Random(4)
    for text in ["a;5 (7) 1,234.5 x9", "a##b", "a#b#c#d", "#a# #", "7", *("".join(rng.choices("ab19 ##!_.,;/-é\ufffd你，½🙂", k=rng.randint(1, 60))) for _ in range(400))]:
        if text.strip():
            s = dict(zip(Q.STATS, Q.document_stats(text, blind)))
            assert s["mixed_word_share"] == len(mixed.findall(text)) / len(text.split()), text
            assert s["number_word_share"] == len(number.findall(text)) / max(1, s["words"]), text


def test_corpus_counts_cover_all_documents(spark):
    texts = [prose(random.Random(i)) for i in range(60)] + ["x" * 25_000 + " the zebra quietly hummed"] * 2 + ["a b", "a b a b", "", None]
    letters, pairs = np.zeros((64, 64), np.int64), np.zeros(1 << Q.Familiar.BITS, np.int64)
    for t in filter(None, texts):
        folded = Q._fold_all([t])[0]
        np.add.at(letters, (folded[:-1], folded[1:]), 1)
        np.add.at(pairs, np.unique(Q._word_pairs([Q.lower_words(t)])[0]), 1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got, want = Q.familiar_of(df.repartition(7)), Q.Familiar.of(letters.ravel(), pairs)
    assert (got.letters == want.letters).all() and (got.pairs == want.pairs).all()
    assert got.pairs[Q._word_pairs([["quietly", "hummed"]])[0]].all()  # at the end of long texts that are no clear prose
    assert Q.familiar_of(df.limit(0)).pairs.sum() == 0
    assert Q.Familiar.of(letters.ravel(), pairs + 1000).pairs.mean() < 0.01  # chance alone makes no pair known


def test_queries_count_all_documents(spark, tmp_path, monkeypatch):
    from evalanvil.llm import queries

    rows = [(i, prose(random.Random(i)) if i < 200 else f"The zebra hummed. {prose(random.Random(i))}") for i in range(210)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sample = [t for _, t in rows[:200]]
    monkeypatch.setattr(queries, "sample_texts", lambda documents: sample)
    got = {r["doc_id"]: r["known_pair_share"] for r in queries.p8_stats(spark, str(tmp_path)).collect()}
    want = Q.Familiar.of(*Q.corpus_counts(t for _, t in rows))
    assert got == {i: dict(zip(Q.STATS, Q.document_stats(t, want)))["known_pair_share"] for i, t in rows}


def test_wide_rows_are_tables():
    blind = Q.Familiar(np.zeros((64, 64), np.float32), np.zeros(1 << Q.Familiar.BITS, bool), np.zeros(0))
    rng = random.Random(6)
    for separator in (",", ";", "\t", " | ", "    "):
        text = "\n".join(separator.join(f"{rng.random() * 100:.2f}" for _ in range(500)) for _ in range(5))
        s = dict(zip(Q.STATS, Q.document_stats(text, blind)))
        assert s["mean_line_length"] > 2000 and s["table_share"] == 1, separator
    long = " ".join(prose(rng, 60).split())
    assert len(long) > 2000 and dict(zip(Q.STATS, Q.document_stats(f"{long}\n{long}", blind)))["table_share"] == 0
