from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evalanvil.operators.instructions import CHECKERS, follows, grade_instructions, tiers, variants
from evalanvil.operators.mathgrade import grade_answer, grade_math, read_answer
from evalanvil.operators.scoring import score
from evalanvil.operators.structured import grade_structured, schema_errors, structured_summary, validate

MATH = [
    ("0.25", "1/4", True), ("3/9", "1/3", False), ("17ab", "17", False), ("\\frac34", "\\frac{3}{4}", True), ("2,500", "2500", True), ("(3,8)", "(3,8]", False),
    ("[ 3 , 8 )", "[3,8)", True), ("y+y+y", "3y", True), ("\\sqrt{18}", "3\\sqrt{2}", True), ("5\\pi", "5pi", True), ("2 1/3", "7/3", True), ("n=12", "12", True),
    ("35\\%", "35", True), ("90 degrees", "90", True), ("90^\\circ", "90", True), ("\\text{north}", "North", True), ("(y-2)^2", "y^2-4y+4", True), ("inf", "7", False), ("", "7", False), ("", "", False),
    (None, "7", False), ("7", None, False), ("__import__('sys')", "2", False), ("3/0", "1.5", False), ("8" * 500, "2", False), ("(" * 6000, "z", False),
    ("3^(1/2)", "sqrt(3)", False), ("p+q+r", "r+q+p", False), ("\\frac", "\\sqrt", False), ("4.0", "4", True), ("6/2", "3", False), ("4 million", "4000000", True),
    ("\\sqrt{x^2}", "x", False), ("|x|", "x", False), ("x^2", "(-x)^2", True), ("1 or 2", "1, 2", True), ("2, 1", "1, 2", False), ("-\\frac{1}{2}", "-0.5", True), ("5 cm^2", "5", True),
    ("12 \\text{ apples}", "12", True), ("\\left( 1, \\tfrac12 \\right)", "(1, \\frac{1}{2})", True), ("\\$18.90", "18.9", True), ("x \\ge 3", "x>=3", False), ("(1,2),(3,4)", "(1,2), (3,4)", True),
    (" + ".join(["x"] * 400), "400x", True), ("x^9", "x*x*x*x*x*x*x*x*x", True), ("10^20 + 1", "10^20 + 1", True), ("123456789012345678901", "123456789012345678902", False),
]


@pytest.mark.parametrize(("given", "gold", "right"), MATH)
def test_grade_answer(given, gold, right):
    assert grade_answer(given, gold) is right


def test_reading():
    same = lambda *spellings: len({read_answer(s) for s in spellings}) == 1
    assert same("\\dfrac12", "\\frac{1}{2}", "1/2", "\\frac{1}2") and same("\\sqrt3", "\\sqrt{3}", "sqrt(3)", "√3") and same("3 miles", "3", "$3", "{3}", "3.0", "x = 3")
    assert same("2x", "2*x", "2\\cdot x") and same("7 3/4", "7\\frac{3}{4}", "7+3/4") and not same("7 3", "73")
    assert [e.text for e in read_answer("(1, 2,345, x)").elements] == ["1", "2345", "x"] and read_answer("(1,2]").brackets == ("(", "]")
    assert read_answer("no such thing!").elements[0].tree is None and read_answer("").elements == (read_answer("   ").elements)


def test_methods(spark):
    rows = [("\\boxed{0.5}", "1/2"), ("\\boxed{2/4}", "1/2"), ("\\boxed{12abc}", "12"), ("no digits", "5"), (None, "5"), ("it is 5", None), ("\\boxed{} 7", "7")]
    df = spark.createDataFrame(rows, "r string, g string")
    got = [(r["method"], r["is_correct"]) for r in grade_math(df, F.col("r"), F.col("g")).collect()]
    assert got == [("prm800k", True), ("no_match", False), ("robust_boxed", True), ("failed", False), ("failed", False), ("no_match", False), ("prm800k", True)]


SCHEMA = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "n": {"type": "integer", "minimum": 0, "maximum": 5.5}}}


@pytest.mark.parametrize(
    ("value", "good"),
    [({"name": "a"}, True), ({"name": 1}, False), ({}, False), ({"name": "a", "n": 6}, False), ({"name": "a", "n": -1}, False), ({"name": "a", "n": 5}, True), ({"name": "a", "n": True}, False), ([], False)],
)
def test_schema(value, good):
    assert (schema_errors(value, SCHEMA) == []) is good


def test_validate():
    spec = {"json_schema": SCHEMA, "top_level_count": 1}
    assert validate('[{"name": "a"}]', spec) == []
    assert validate('text [{"name": "a"}]', spec) == []
    assert validate("nothing", spec) == ["no valid JSON"]
    assert validate('[{"name": "a"}]', {**spec, "require_code_block": True}) == ["no code block"]
    assert validate('x\n```json\n[{"name": "a"}]\n```', {**spec, "require_no_commentary": True}) == ["commentary"]
    assert validate('{"items": [{"name": "a"}]}', {**spec, "require_wrapper_key": True, "top_level_key": "items"}) == []
    assert validate('[{"name": "a"}]', {**spec, "require_wrapper_key": True, "top_level_key": "items"}) == ["no wrapper key"]
    assert validate('[{"name": "a"}, {"name": 2}]', {**spec, "top_level_count": [2, 3]}) == ["schema"]
    assert validate("- name: a", {**spec, "output_format": "yaml"}) in ([], ["YAML can't be read here"])
    as_csv, as_xml = {**spec, "output_format": "csv"}, {**spec, "output_format": "xml", "top_level_key": "items", "require_wrapper_key": True}
    assert validate('name,n\n"a, b",3', as_csv) == [] and validate("name,n\na,9", as_csv) == ["schema"] and validate("name,n\na,1,2", as_csv) == validate("just text", as_csv) == ["no valid CSV"]
    assert validate("name,n\na,1\nb,2", as_csv) == ["wrong number of items"]
    assert validate("<items><item><name>a</name><n>3</n></item></items>", as_xml) == [] and validate("<list><item><name>a</name></item></list>", as_xml) == ["no wrapper key"]
    assert validate("<r><item><name>a</name></item></r>", {**as_xml, "require_wrapper_key": False}) == [] and validate("<items><item>", as_xml) == ["no valid XML"]
    assert validate('<!DOCTYPE x [<!ENTITY a "b">]><items/>', as_xml) == ["no valid XML"]


def test_grade_structured(spark):
    spec = json.dumps({"json_schema": SCHEMA})
    rows = [("a", '<think>x</think>[{"name": "a"}]', spec, 1), ("b", None, spec, 2), ("c", "[]", None, 3), ("d", "{}", "not json", 4)]
    got = {r["id"]: r for r in grade_structured(spark.createDataFrame(rows, "id string, completion string, spec string, answer int"), "completion", "spec").collect()}
    assert [got[k]["is_correct"] for k in "abcd"] == [True, False, True, False] and got["b"]["errors"] == ["no valid JSON"]
    assert got["d"]["errors"] == ["invalid requirements"] and got["a"]["answer"] == 1
    empty = spark.createDataFrame([], "id string, completion string, spec string, output_format string, require_wrapper_key boolean, entity_type string")
    assert structured_summary(grade_structured(empty, "completion", "spec")).count() == 0


def test_follows():
    words = {f"keyword{i + 1}": k for i, k in enumerate(("one", "two", "three", "four", "five"))}
    text = " ".join(k for k, n in zip(("one", "two", "three", "four", "five"), (1, 2, 3, 5, 7)) for _ in range(n))
    assert follows(text, ["count:keywords_multiple"], [words]) == ([("count:keywords_multiple", True, True)], "ok")
    assert follows("a, b\nfine", ["punctuation:no_comma"], [{"x": None}]) == ([("punctuation:no_comma", False, True)], "ok")
    assert follows("", ["punctuation:no_comma"], [{}]) == ([("punctuation:no_comma", False, False)], "ok")
    assert len(variants("a\nb")) == 8 and "change_case:english_capital" in CHECKERS
    flags, status = follows("x", ["no:such", "punctuation:no_comma", "count:numbers"], [{}])
    assert flags == [("no:such", False, False), ("punctuation:no_comma", True, True), ("count:numbers", False, False)] and status == "no:such: no checker"
    assert follows("1", ["count:numbers"], [{"N": "many"}])[1] == "count:numbers: arguments (ValueError)"


@pytest.mark.parametrize(
    ("iid", "args", "good", "bad"),
    [
        ("count:word_count_range", {"min_words": 2, "max_words": 3}, "two words", "one"), ("count:unique_word_count", {"N": 3}, "a b c", "a b A"), ("count:numbers", {"N": 2}, "3 and 14", "3"),
        ("count:punctuation", {}, "a.b,c!d?e;f:", "a.b"), ("sentence:keyword", {"N": 2, "word": "mill"}, "No. The mill.", "The mill. No."), ("words:no_consecutive", {}, "big cat", "big bat"),
        ("words:prime_lengths", {}, "to the house", "four"), ("words:repeats", {"small_n": 1}, "a b", "a A"), ("format:newline", {}, "a\nb", "a b"), ("format:no_whitespace", {}, "a-b", "a b"),
        ("format:title_case", {}, "The Mill 7", "The mill"),
    ],
)
def test_further_checkers(iid, args, good, bad):
    assert follows(good, [iid], [args])[0] == [(iid, True, True)] and follows(bad, [iid], [args])[0][0][1] is False


def test_instruction_scores(spark):
    samples = spark.createDataFrame([("p#0", ["punctuation:no_comma", "change_case:english_lowercase"], "[{}, {}]"), ("p#1", ["punctuation:no_comma"], None)], "id string, instruction_id_list array<string>, kwargs string")
    done = spark.createDataFrame([("p#0", "all small"), ("p#1", "a, b")], "id string, completion string")
    scores, metrics = score("ifbench", done, samples)
    assert {r["id"]: r["is_correct"] for r in scores.collect()} == {"p#0": True, "p#1": False}
    m = {r["metric"]: r["value"] for r in metrics.collect()}
    assert m["ifbench_pass_at_1"] == 0.5 and m["strict/punctuation"] == 0.5 and m["loose/change_case:english_lowercase"] == 1.0 and m["ifbench_pass_at_1_per_sample/p"] == 0.5
    assert tiers(spark.createDataFrame([], "iid string, strict boolean, loose boolean")).count() == 0
    assert grade_instructions(done.limit(0).withColumn("i", F.array().cast("array<string>")).withColumn("k", F.lit("[]")), "completion", "i", "k").count() == 0


def test_choice_scores(spark):
    samples = spark.createDataFrame([("q#0", "A"), ("q#1", "A"), ("q#2", "A"), ("q#3", "A"), ("q#4", "A")], "id string, answer string")
    done = spark.createDataFrame([("q#0", "Answer: A"), ("q#1", "Answer: B"), ("q#2", "no idea ..."), ("q#3", "A")], "id string, completion string")
    _, metrics = score("gpqa_diamond", done, samples)
    m = {r["metric"]: r["value"] for r in metrics.collect()}
    assert m["gpqa_diamond_pass_at_1"] == 0.4 and abs(m["gpqa_diamond_pass_at_1_stderr"] - (0.4 * 0.6 / 5) ** 0.5) < 1e-12
    assert [m[f"gpqa_diamond_choice/{c}"] for c in ("A", "B", "C", "D", "none")] == [2, 1, 0, 0, 1] and m["gpqa_diamond_unparsed_rate"] == 0.25
    none = {r["metric"]: r["value"] for r in score("gpqa_diamond", done.limit(0), samples)[1].collect()}
    assert set(none) == set(m) and none["gpqa_diamond_pass_at_1"] == 0.0
    with pytest.raises(KeyError):
        score("nothing", done, samples)
