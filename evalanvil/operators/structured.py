"""Validation of structured answers (JSON, YAML, CSV or XML) against a sample's requirements."""

from __future__ import annotations

import csv
import io
import json
import operator
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalanvil.functions.text import accuracy, strip_reasoning

_FENCE = re.compile(r"```[\w+-]*[ \t]*\n(.*?)\n?[ \t]*```", re.S)
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """What breaks a JSON schema: type, enum, const, bounds, lengths, pattern, required, properties,
    additionalProperties, items and the combinations allOf, anyOf, oneOf, not. Other keywords are ignored."""
    if not isinstance(schema, dict):
        return [] if schema in (True, None) else [f"{at}: not allowed"]
    out = []
    types = schema.get("type")
    if types is not None:
        names = types if isinstance(types, list) else [types]
        if not any(_is_type(value, t) for t in names):
            return [f"{at}: not of type {'/'.join(map(str, names))}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not an allowed value")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the required value")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        bounds = (("minimum", operator.ge), ("maximum", operator.le), ("exclusiveMinimum", operator.gt), ("exclusiveMaximum", operator.lt))
        out += [f"{at}: breaks {k}" for k, holds in bounds if isinstance(schema.get(k), (int, float)) and not isinstance(schema[k], bool) and not holds(value, schema[k])]
        step = schema.get("multipleOf")
        if step and abs(value / step - round(value / step)) > 1e-9:
            out.append(f"{at}: breaks multipleOf")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: breaks its length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: breaks its pattern")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            out.append(f"{at}: breaks its number of items")
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            out.append(f"{at}: items repeat")
        if "items" in schema:
            out += [e for i, v in enumerate(value) for e in schema_errors(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: lacks {k}" for k in schema.get("required", []) if k not in value]
        out += [e for k, v in value.items() if k in known for e in schema_errors(v, known[k], f"{at}.{k}")]
        more = schema.get("additionalProperties", True)
        if more is False:
            out += [f"{at}: has {k}" for k in value if k not in known]
        elif isinstance(more, dict):
            out += [e for k, v in value.items() if k not in known for e in schema_errors(v, more, f"{at}.{k}")]
    for s in schema.get("allOf", []):
        out += schema_errors(value, s, at)
    for key, holds in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if key in schema and not holds(sum(not schema_errors(value, s, at) for s in schema[key])):
            out.append(f"{at}: breaks {key}")
    if "not" in schema and not schema_errors(value, schema["not"], at):
        out.append(f"{at}: breaks not")
    return out


def _is_type(value, name: str) -> bool:
    if name == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if name == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(name, object))


def parse(text: str, output_format: str):
    """(value, error): the answer's data. YAML is read with the safe loader if it is installed.

    CSV gives a list of objects by its header, XML an object of its root's name and a list of its
    children; as neither knows types, text that is a number counts as one. XML that declares a
    document type is refused.
    """
    form = (output_format or "json").lower()
    if form == "csv":
        try:
            rows = list(csv.reader(io.StringIO(text.strip()), strict=True))
        except csv.Error:
            rows = []
        if len(rows) < 2 or len(rows[0]) < 2 or any(len(r) != len(rows[0]) for r in rows):
            return None, "no valid CSV"
        return [dict(zip(map(str.strip, rows[0]), map(_typed, r))) for r in rows[1:]], ""
    if form == "xml":
        try:
            root = None if "<!" in text else ElementTree.fromstring(text.strip())
        except (ElementTree.ParseError, ValueError):
            root = None
        if root is None:
            return None, "no valid XML"
        return {root.tag: [{c.tag: _typed(c.text or "") for c in item} if len(item) else _typed(item.text or "") for item in root]}, ""
    if form == "yaml":
        try:
            import yaml
        except ImportError:
            return None, "YAML can't be read here"
        try:
            value = yaml.safe_load(text)
            return value, "" if isinstance(value, (dict, list)) else "no valid YAML"
        except yaml.YAMLError:
            return None, "no valid YAML"
    try:
        return json.loads(text), ""
    except (ValueError, RecursionError):
        return None, "no valid JSON"


def _typed(text: str):
    """A number if the text is one, else the text."""
    t = text.strip()
    if re.fullmatch(r"-?\d{1,18}", t):
        return int(t)
    return float(t) if re.fullmatch(r"-?\d+\.\d+", t) else t


def validate(answer: str, spec: dict) -> list[str]:
    """Errors of an answer without reasoning; none means it passes.

    Rules: a code block if required; nothing around it if commentary is forbidden; valid data; a
    top-level list, or an object with the wrapper key; the number of items; the schema of each item.
    """
    out = []
    fences = _FENCE.findall(answer)
    body = fences[0] if fences else answer.strip()
    if spec.get("require_code_block") and not fences:
        out.append("no code block")
    if spec.get("require_no_commentary"):
        rest = _FENCE.sub("", answer, count=1).strip() if fences else ""
        if rest:
            out.append("commentary")
    if not fences and not spec.get("require_no_commentary"):
        m = re.search(r"[\[{].*[\]}]", answer, re.S)
        body = m.group(0) if m and (spec.get("output_format") or "json").lower() == "json" else body
    value, error = parse(body, spec.get("output_format"))
    if error:
        return [*out, error]
    key = spec.get("top_level_key")
    items = value
    if spec.get("require_wrapper_key"):
        if not isinstance(value, dict) or key not in value:
            return [*out, "no wrapper key"]
        items = value[key]
    elif isinstance(value, dict) and key and set(value) == {key}:
        items = value[key]
    elif isinstance(value, dict) and (spec.get("output_format") or "").lower() == "xml":
        items = next(iter(value.values()))  # a root must have some name
    count = spec.get("top_level_count")
    if count is not None:
        if not isinstance(items, list):
            out.append("not a list")
        elif len(items) not in (count if isinstance(count, list) else [count]):
            out.append("wrong number of items")
    schema = spec.get("json_schema")
    if schema is not None:
        each = items if isinstance(items, list) and (not isinstance(schema, dict) or schema.get("type") != "array") else [items]
        out += sorted({"schema" for v in each if schema_errors(v, schema)})
    return out


SPEC = ("prompt", "json_schema", "top_level_key", "top_level_count", "require_wrapper_key", "require_code_block", "require_no_commentary", "output_format", "entity_type")


def grade_structured(df: DataFrame, completion: str, spec: str) -> DataFrame:
    """df with errors and is_correct; `spec` is a JSON object of requirements (null: valid JSON is enough).

    Reasoning is stripped natively first. A null completion has the error 'no valid JSON'.
    """
    names = [*df.columns, "errors", "is_correct"]
    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + ["errors array<string>", "is_correct boolean"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for text, s in zip(pdf["__answer"], pdf[spec]):
                try:
                    errors.append(validate(text if isinstance(text, str) else "", json.loads(s) if isinstance(s, str) else {}))
                except (ValueError, TypeError, re.error, RecursionError):
                    errors.append(["invalid requirements"])
            out = pdf.drop(columns="__answer")
            out["errors"] = errors
            out["is_correct"] = [not e for e in errors]
            yield out[names]

    return df.withColumn("__answer", strip_reasoning(F.col(completion))).mapInPandas(run, schema)


def structured_summary(graded: DataFrame) -> DataFrame:
    """(facet, value, passed, total, pass_rate): in total, by format, by structure and by entity, in one pass."""
    facets = F.array(
        F.struct(F.lit("all").alias("facet"), F.lit("").alias("value")),
        F.struct(F.lit("by_format").alias("facet"), F.coalesce("output_format", F.lit("json")).alias("value")),
        F.struct(F.lit("by_top_level_structure").alias("facet"), F.when(F.coalesce("require_wrapper_key", F.lit(False)), "wrapped").otherwise("list").alias("value")),
        F.struct(F.lit("by_entity_type").alias("facet"), F.coalesce("entity_type", F.lit("")).alias("value")),
    )
    each = graded.select(F.explode(facets).alias("f"), "is_correct").select("f.*", "is_correct")
    counted = each.groupBy("facet", "value").agg(F.count_if(F.col("is_correct")).alias("passed"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("pass_rate", accuracy(F.col("passed"), F.col("total")))


def common_errors(graded: DataFrame) -> DataFrame:
    """(error, n), the most frequent first."""
    return graded.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error")
