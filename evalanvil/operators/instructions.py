"""Instruction following: checkers by instruction id, strict and loose.

Loose passes if any of eight variants of the answer passes: as it is or without asterisks, each whole,
without its first line, without its last line, or without both (as published with IFEval).
A checker is any callable (text, arguments) -> bool. An instruction id that has none, or whose arguments
its checker can't use, is not followed, and the row's status says so; the job goes on.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalanvil.functions.text import accuracy, category, strip_reasoning

Checker = Callable[[str, dict], bool]
CHECKERS: dict[str, Checker] = {}


def checker(instruction_id: str) -> Callable[[Checker], Checker]:
    """Registers a checker under an id."""

    def add(f: Checker) -> Checker:
        CHECKERS[instruction_id] = f
        return f

    return add


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text)


def _compares(n: int, relation: str | None, bound: int) -> bool:
    if relation == "less than":
        return n < bound
    return n <= bound if relation == "at most" else n >= bound


# How often each of the five keywords has to occur.
_KEYWORD_TIMES = (1, 2, 3, 5, 7)


@checker("count:keywords_multiple")
def _keywords_multiple(text: str, a: dict) -> bool:
    words = [w.lower() for w in _words(text)]
    return all(words.count(str(a[f"keyword{i + 1}"]).lower()) == n for i, n in enumerate(_KEYWORD_TIMES))


@checker("punctuation:no_comma")
def _no_comma(text: str, a: dict) -> bool:
    return "," not in text


@checker("length_constraints:number_words")
def _number_words(text: str, a: dict) -> bool:
    return _compares(len(_words(text)), a.get("relation"), int(a["num_words"]))


@checker("length_constraints:number_sentences")
def _number_sentences(text: str, a: dict) -> bool:
    return _compares(len([s for s in re.split(r"[.!?]+(?:\s+|$)", text) if s.strip()]), a.get("relation"), int(a["num_sentences"]))


@checker("length_constraints:number_paragraphs")
def _number_paragraphs(text: str, a: dict) -> bool:
    return len([p for p in re.split(r"\s*\*\*\*\s*", text) if p.strip()]) == int(a["num_paragraphs"])


@checker("keywords:existence")
def _existence(text: str, a: dict) -> bool:
    return all(re.search(re.escape(k), text, re.I) for k in a["keywords"])


@checker("keywords:forbidden_words")
def _forbidden(text: str, a: dict) -> bool:
    return not any(re.search(rf"\b{re.escape(k)}\b", text, re.I) for k in a["forbidden_words"])


@checker("keywords:frequency")
def _frequency(text: str, a: dict) -> bool:
    return _compares(len(re.findall(re.escape(a["keyword"]), text, re.I)), a.get("relation"), int(a["frequency"]))


@checker("keywords:letter_frequency")
def _letter_frequency(text: str, a: dict) -> bool:
    return _compares(text.lower().count(str(a["letter"]).lower()), a.get("let_relation"), int(a["let_frequency"]))


@checker("change_case:english_lowercase")
def _lowercase(text: str, a: dict) -> bool:
    return text.islower()


@checker("change_case:english_capital")
def _capital(text: str, a: dict) -> bool:
    return text.isupper()


@checker("detectable_format:number_bullet_lists")
def _bullets(text: str, a: dict) -> bool:
    return len(re.findall(r"^\s*(?:\*[^*]|-)", text, re.M)) == int(a["num_bullets"])


@checker("detectable_format:title")
def _title(text: str, a: dict) -> bool:
    return any(t.strip() for t in re.findall(r"<<([^\n]+?)>>", text))


@checker("detectable_format:json_format")
def _json_format(text: str, a: dict) -> bool:
    body = re.sub(r"\A\s*```(?:json)?|```\s*\Z", "", text, flags=re.I).strip()
    try:
        json.loads(body)
        return True
    except ValueError:
        return False


@checker("detectable_content:postscript")
def _postscript(text: str, a: dict) -> bool:
    return str(a.get("postscript_marker", "P.S.")).lower() in text.lower()


@checker("detectable_content:number_placeholders")
def _placeholders(text: str, a: dict) -> bool:
    return len(re.findall(r"\[.*?\]", text)) >= int(a["num_placeholders"])


@checker("startend:end_checker")
def _end(text: str, a: dict) -> bool:
    return text.strip().strip('"').lower().endswith(str(a["end_phrase"]).strip().lower())


@checker("startend:quotation")
def _quotation(text: str, a: dict) -> bool:
    t = text.strip()
    return len(t) > 1 and t[0] == t[-1] == '"'


@checker("combination:two_responses")
def _two_responses(text: str, a: dict) -> bool:
    parts = [p.strip() for p in text.split("******")]
    return len(parts) == 2 and all(parts) and parts[0] != parts[1]


@checker("combination:repeat_prompt")
def _repeat(text: str, a: dict) -> bool:
    return text.strip().lower().startswith(str(a["prompt_to_repeat"]).strip().lower())


@checker("count:word_count_range")
def _word_range(text: str, a: dict) -> bool:
    return int(a["min_words"]) <= len(text.split()) <= int(a["max_words"])


@checker("count:unique_word_count")
def _unique_words(text: str, a: dict) -> bool:
    return len({w.lower() for w in _words(text)}) >= int(a["N"])


@checker("count:numbers")
def _numbers(text: str, a: dict) -> bool:
    return len(re.findall(r"\b\d+\b", text)) == int(a["N"])


@checker("count:punctuation")
def _all_punctuation(text: str, a: dict) -> bool:
    return all(mark in text for mark in ".,!?;:")


@checker("sentence:keyword")
def _keyword_in_sentence(text: str, a: dict) -> bool:
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    n = int(a["N"])
    return 0 < n <= len(sentences) and str(a["word"]).lower() in [w.lower() for w in _words(sentences[n - 1])]


@checker("words:no_consecutive")
def _no_consecutive_letters(text: str, a: dict) -> bool:
    first = [w[0].lower() for w in _words(text)]
    return all(x != y for x, y in zip(first, first[1:]))


@checker("words:prime_lengths")
def _prime_lengths(text: str, a: dict) -> bool:
    lengths = {len(w) for w in _words(text)}
    return all(n > 1 and all(n % k for k in range(2, int(n**0.5) + 1)) for n in lengths)


@checker("words:repeats")
def _few_repeats(text: str, a: dict) -> bool:
    return max(Counter(w.lower() for w in _words(text)).values(), default=0) <= int(a["small_n"])


@checker("format:newline")
def _word_a_line(text: str, a: dict) -> bool:
    lines = [x.strip() for x in text.strip().split("\n")]
    return all(len(x.split()) == 1 for x in lines)


@checker("format:no_whitespace")
def _no_whitespace(text: str, a: dict) -> bool:
    return not re.search(r"\s", text.strip())


@checker("format:title_case")
def _title_case(text: str, a: dict) -> bool:
    return all(w[0].isupper() or not w[0].isalpha() for w in text.split())


def variants(text: str) -> list[str]:
    """The eight variants of an answer that the loose check tries."""
    lines = text.split("\n")
    cuts = (text, "\n".join(lines[1:]).strip(), "\n".join(lines[:-1]).strip(), "\n".join(lines[1:-1]).strip())
    return [*cuts, *(c.replace("*", "") for c in cuts)]


def follows(text: str, instruction_ids: list[str], arguments: list[dict]) -> tuple[list[tuple[str, bool, bool]], str]:
    """((instruction id, strict, loose) of one answer without reasoning, status); a blank answer follows nothing.

    status is 'ok', or names the first instruction that has no checker or can't be checked with its
    arguments; such an instruction is not followed.
    """
    out, status = [], "ok"
    for i, name in enumerate(instruction_ids):
        f = CHECKERS.get(name)
        a = {k: v for k, v in ((arguments[i] if i < len(arguments) else {}) or {}).items() if v is not None}
        strict = loose = False
        try:
            if f is None:
                raise LookupError("no checker")
            strict = bool(text.strip()) and bool(f(text, a))
            loose = strict or any(bool(v.strip()) and bool(f(v, a)) for v in variants(text))
        except (LookupError, ValueError, TypeError) as e:
            why = "no checker" if f is None else f"arguments ({type(e).__name__})"
            status = f"{name}: {why}" if status == "ok" else status
        out.append((name, strict, loose))
    return out, status


def grade_instructions(df: DataFrame, completion: str, ids: str, arguments: str) -> DataFrame:
    """df with flags (array of id, strict, loose), strict_all, loose_all, is_correct (the loose one) and instruction_status.

    `ids` is an array of instruction ids, `arguments` a JSON array of objects in their order. A null
    completion follows nothing; without instructions all are followed. See `follows` for ids without a checker.
    """
    added = "flags array<struct<id:string,strict:boolean,loose:boolean>>, strict_all boolean, loose_all boolean, is_correct boolean, instruction_status string"
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns="__answer")
            flags, status = [], []
            for text, names, args in zip(pdf["__answer"], pdf[ids], pdf[arguments]):
                given = json.loads(args) if isinstance(args, str) else []
                one, how = follows(text if isinstance(text, str) else "", [] if names is None else list(names), given if isinstance(given, list) else [])
                flags.append(one)
                status.append(how)
            out["flags"] = [[{"id": n, "strict": s, "loose": loose} for n, s, loose in f] for f in flags]
            out["strict_all"] = [all(s for _, s, _ in f) for f in flags]
            out["loose_all"] = [all(loose for *_, loose in f) for f in flags]
            out["is_correct"] = out["loose_all"]
            out["instruction_status"] = status
            yield out

    return df.withColumn("__answer", strip_reasoning(F.col(completion))).mapInPandas(run, schema)


def tiers(flags: DataFrame, instruction: str = "iid", by: list[str] | None = None) -> DataFrame:
    """(by, level, name, pass_kind, passed, total, accuracy) per category and per instruction, strict and
    loose, from (iid, strict, loose) rows, by one aggregation over grouping sets."""
    keys = by or []
    base = flags.select(*keys, F.col(instruction).alias("iid"), category(F.col(instruction)).alias("cat"), "strict", "loose")
    expanded = base.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.col("iid").alias("name")), F.struct(F.lit(0).alias("tier"), F.col("cat").alias("name")))).alias("g"), "strict", "loose")
    counted = expanded.groupBy(*keys, "g.tier", "g.name").agg(
        F.count_if(F.coalesce("strict", F.lit(False))).alias("s"), F.count_if(F.coalesce("loose", F.lit(False))).alias("l"), F.count(F.lit(1)).alias("total")
    )
    stacked = counted.select(*keys, "tier", "name", "total", F.expr("stack(2, 'strict', s, 'loose', l) as (pass_kind, passed)"))
    return stacked.withColumn("accuracy", accuracy(F.col("passed"), F.col("total")))
