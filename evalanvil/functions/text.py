"""Column functions that read answers out of completions. All native expressions, no Python per row.

Patterns run in Java's dialect: `(?U)` for Unicode classes, `(?s)` for dot-all, `\\z` for the very
end, and possessive quantifiers wherever a group repeats, so long or hostile texts can't overflow
the regex engine's stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalanvil.functions.keys import py_strip

# The markers of reasoning and of the final channel.
_PAIRS = r"(?is)<think>.*?</think>|\[THINK\].*?\[/THINK\]"
_MARKED = r"(?i)think|assistantfinal|<\|"  # what any text with markers has
_FIRST_CLOSERS = (r"(?is)\A.*?</think>", r"(?is)\A.*?\[/THINK\]")  # the second kind counts only where the first doesn't occur
_UP_TO_LAST_CLOSER = r"(?is)\A.*(?:</think>|\[/THINK\])"
_STEPS = (
    (r"(?is)(?:<think>|\[THINK\]).*\z", ""),
    (r"(?s)\A.*?(?:<\|start\|>)?assistant(?:<\|channel\|>)?final(?:<\|message\|>)?", ""),
    (r"(?U)<\|(?:end|return)\|>\s*\z", ""),
)

# The ways to state an option, in order of precedence, with their names.
MCQ_PATTERNS = (
    ("primary", r"(?i)[\*\_]{0,2}Answer[\*\_]{0,2}\s*:[\s\*\_]{0,2}\s*([A-Z])(?![a-zA-Z0-9])"),
    ("boxed", r"\\boxed\{[^}]*([A-Z])[^}]*\}"),
    ("answer_is", r"(?i)answer is ([A-Za-z])"),
    ("answer_is_paren", r"(?i)answer is \(([A-Za-z])"),
    ("choice_format", r"([A-Z])\)\s*[^A-Z]*"),
    ("explicit", r"(?i)([A-Z])\s+is\s+the\s+correct\s+answer"),
    ("standalone_end", r"([A-Z])\s*$"),
    ("letter_period", r"([A-Z])\s*\."),
    ("letter_nonword", r"([A-Z])\s*[^\w]"),
)
_BOXED = r"\\(?:boxed|fbox|framebox)\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}"
_NUMBER = r"(-?\d++(?:\.\d++)?)"


def strip_reasoning(c: Column) -> Column:
    """The answer without reasoning: complete pairs, what precedes an orphan closer, what follows an
    orphan opener, everything up to the final channel, a closing marker; stripped. Null stays null.

    Pairs are sought up to the last closer only, so many openers without one cost no repeated scans.
    """

    def after_closer(text: Column) -> Column:
        first, second = (F.regexp_replace(text, F.lit(p), F.lit("")) for p in _FIRST_CLOSERS)
        return F.when(text.rlike("(?i)</think>"), first).otherwise(second)

    def read(text: Column) -> Column:
        head = F.regexp_extract(text, _UP_TO_LAST_CLOSER, 0)
        tail = F.substring(text, F.length(head) + 1, F.length(text))
        out = F.when(head == "", text).otherwise(F.concat(F.regexp_replace(head, F.lit(_PAIRS), F.lit("")), tail))
        out = _once(out, after_closer)
        for pattern, to in _STEPS:
            out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
        return py_strip(F.when(text.rlike(_MARKED), out).otherwise(text))

    return _once(c, read)


def _last(c: Column, pattern: str) -> Column:
    """Group 1 of the last match, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1))


def mcq_answer(response: Column, options: str = "ABCDEFGHIJ") -> Column:
    """STRUCT<extracted, pattern> of the stated option; both null if none of `options` is stated.

    A response of one character states itself. Otherwise each pattern's last match counts, and a
    last match that is no option gives way to the next pattern, not to an earlier match.
    """
    none = F.lit(None).cast("string")
    nothing = F.struct(none.alias("extracted"), none.alias("pattern"))

    def stated(name: str):
        def result(letter: Column) -> Column:
            """The result if a letter is an option, else null."""
            good = (F.length(letter) == 1) & F.contains(F.lit(options), letter)
            return F.when(good, F.struct(letter.alias("extracted"), F.lit(name).alias("pattern")))

        return result

    def read(r: Column) -> Column:
        found = [F.when(F.length(r) == 1, stated("single_letter")(F.upper(r)))]
        found += [_once(F.upper(_last(r, "(?U)" + pattern)), stated(name)) for name, pattern in MCQ_PATTERNS]
        return F.coalesce(*found, nothing)

    return F.coalesce(_once(py_strip(response), read), nothing)


def _once(value: Column, f) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def mcq_correct(extracted: Column, gold: Column) -> Column:
    """Whether the stated option is the expected one; false if none is stated."""
    return F.coalesce(extracted == F.upper(py_strip(gold)), F.lit(False))


def boxed_answer(c: Column) -> Column:
    """The last boxed answer (braces nested once), stripped; null if there is none."""
    return py_strip(_last(c, _BOXED))


def last_number(c: Column) -> Column:
    """The last integer or decimal; null if there is none."""
    return _last(c, "(?U)" + _NUMBER)


def math_extract(c: Column) -> Column:
    """The boxed answer if there is a non-empty one, else the last number."""
    boxed = boxed_answer(c)
    return F.when(F.length(boxed) > 0, boxed).otherwise(last_number(c))


def normalize_numeric(c: Column) -> Column:
    """A number as text: without commas, a leading integer alone if there is one, else the parsed
    value without trailing zeros. Null for empty, non-numeric and non-finite text."""
    bare = py_strip(F.replace(c, F.lit(","), F.lit("")))
    lead = F.regexp_extract(bare, r"(?U)\A-?\d+", 0)
    value = F.when(bare.rlike(r"(?i)\A[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?\z"), bare.try_cast("double"))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    whole = finite & (value == F.rint(value))
    digits = F.when(F.abs(value) < 2.0**63, value.cast("long").cast("string")).otherwise(F.format_string("%.0f", value))
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"0+\z", ""), r"\.\z", "")
    return F.when(F.length(c) == 0, None).otherwise(
        F.when(F.length(lead) > 0, lead).when(whole, digits).when(finite, text)
    )


def category(instruction_id: Column) -> Column:
    """An instruction's category: its id up to the first colon."""
    return F.substring_index(instruction_id, ":", 1)


def model_slug(c: Column) -> Column:
    """A model name as a folder name."""
    return F.replace(c, F.lit("/"), F.lit("--"))


def job_slug(c: Column) -> Column:
    """A model name as a job name."""
    return F.replace(c, F.lit("/"), F.lit("_"))


def stage_name(filter_name: str) -> str:
    """A filter's name as a stage name."""
    return filter_name.replace("_", "-")


def is_blank(c: Column) -> Column:
    """Whether a completion holds nothing but white space, or is null."""
    return py_strip(F.coalesce(c, F.lit(""))) == ""


def choice_prompt(instruction: str, question: Column, options: Column) -> Column:
    """A multiple-choice prompt: instruction, question, and the options as `A) …` lines."""
    letters = F.transform(options, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(") "), o))
    return F.concat(F.lit(instruction + "\n\n"), question, F.lit("\n\n"), F.array_join(letters, "\n"))


def math_prompt(instruction: str, problem: Column) -> Column:
    """A mathematics prompt: instruction and problem."""
    return F.concat(F.lit(instruction + "\n\n"), problem)


def user_message(prompt: Column) -> Column:
    """A prompt as the messages of one user turn."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def allowed_tokens(ids: Column) -> Column:
    """The token ids that a constrained answer may begin with: each once, in order, without nulls."""
    return F.sort_array(F.array_distinct(F.array_compact(ids)))


def accuracy(correct: Column, total: Column) -> Column:
    """correct / total, 0 if there is nothing."""
    return F.coalesce(F.try_divide(correct.cast("double"), total), F.lit(0.0))


def stderr(p: Column, n: Column) -> Column:
    """The binomial standard error of a share, 0 if there is nothing."""
    return F.coalesce(F.sqrt(F.try_divide(p * (1 - p), n)), F.lit(0.0))


def verdict(correct: Column) -> Column:
    """PASS or FAIL; null fails."""
    return F.when(F.coalesce(correct, F.lit(False)), "PASS").otherwise("FAIL")


def shown_number(value: Column) -> Column:
    """A metric as it is shown: whole numbers plainly, others with four digits; null is empty."""
    whole = value == F.floor(value)
    return F.when(value.isNull(), "").when(whole, F.format_string("%d", value.cast("long"))).otherwise(F.format_string("%.4f", value))


def shown_share(value: Column) -> Column:
    """A share in per cent with two digits; null is empty."""
    return F.when(value.isNull(), "").otherwise(F.format_string("%.2f%%", value * 100))
