"""Explicit schemas of everything that is read; nothing is inferred."""

from __future__ import annotations

MESSAGES = "array<struct<role:string,content:string>>"
COMPLETIONS = "id string, completion string"
PAYLOAD = f"completions array<struct<{'id:string,completion:string'}>>"
METADATA = "repeats int, content_sha256 string, eval_id string, dataset string, source_dataset string, num_samples long"

#: Ground truth per eval: where it lies and which columns it has. Free-form values are JSON text.
EVALS = {
    "ifbench": ("train", "parquet", "key string, instruction_id_list array<string>, prompt string, kwargs string, n_constraints long"),
    "ifstruct": (
        "test",
        "json",
        "seed long, entity_type string, prompt string, json_schema string, top_level_count string, top_level_key string, "
        "require_wrapper_key boolean, require_code_block boolean, require_no_commentary boolean, output_format string",
    ),
    "gpqa_diamond": ("test", "parquet", "prompt string, answer string"),
    "math_500": ("test", "parquet", "prompt string, answer string"),
}

# Tokens to generate and temperature per eval.
GENERATION = {
    "ifbench": {"max_tokens": 2048, "temperature": 0.0, "mcq_choices": None},
    "ifstruct": {"max_tokens": 4096, "temperature": 0.0, "mcq_choices": None},
    "gpqa_diamond": {"max_tokens": 2048, "temperature": 0.0, "mcq_choices": None},
    "math_500": {"max_tokens": 4096, "temperature": 0.0, "mcq_choices": None},
}
