"""Checks of JSON records: a schema subset, model verdicts, length guards, frame splices."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Schema keywords that are understood; annotations are let through.
CHECKED = "type const enum minLength pattern minimum maximum required properties additionalProperties minItems items allOf if then else not".split()
ANNOTATIONS = "$schema $id title description".split()
# Fields of a judge's verdict and of a mapper's answer.
VERDICTS = ["pass", "fail", "uncertain"]
VERDICT_FLAGS = ["supported", "citations_valid", "complete", "refusal_correct"]
STRING_LIMIT = 500

_KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "null": lambda v: v is None,
    "boolean": lambda v: isinstance(v, bool), "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
}


def _equal(a, b) -> bool:
    """JSON equality: true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(a[k], b[k]) for k in a)
    return a == b


def _pattern(source: str) -> re.Pattern:
    """A trailing dollar sign that isn't escaped means the very end, not before a last line feed."""
    slashes = len(source[:-1]) - len(source[:-1].rstrip("\\"))
    return re.compile(source[:-1] + r"\Z" if source.endswith("$") and slashes % 2 == 0 else source)


def unsupported(schema, at: str = "") -> list[str]:
    """Paths of keywords that the checks don't know."""
    if not isinstance(schema, dict):
        return []
    out = [f"{at}/{k}" for k in schema if k not in CHECKED and k not in ANNOTATIONS]
    for k in ("items", "additionalProperties", "if", "then", "else", "not"):
        out += unsupported(schema.get(k), f"{at}/{k}")
    for name, own in schema.get("properties", {}).items():
        out += unsupported(own, f"{at}/properties/{name}")
    for i, own in enumerate(schema.get("allOf", [])):
        out += unsupported(own, f"{at}/allOf/{i}")
    return out


def problems(value, schema: dict, at: str = "$") -> Iterator[str]:
    """Each violated keyword with its place; a value of a wrong type isn't looked at further.  1.0 is no integer."""
    if not isinstance(schema, dict):  # true: anything
        return
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[k](value) for k in kinds):
        yield f"{at}: type"
        return
    if "const" in schema and not _equal(value, schema["const"]):
        yield f"{at}: const"
    if "enum" in schema and not any(_equal(value, x) for x in schema["enum"]):
        yield f"{at}: enum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            yield f"{at}: minLength"
        if "pattern" in schema and not _pattern(schema["pattern"]).search(value):
            yield f"{at}: pattern"
    if _KINDS["number"](value):
        if value < schema.get("minimum", value):
            yield f"{at}: minimum"
        if value > schema.get("maximum", value):
            yield f"{at}: maximum"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        yield from (f"{at}.{k}: required" for k in schema.get("required", []) if k not in value)
        for k, v in value.items():
            if k in own:
                yield from problems(v, own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}.{k}: additionalProperties"
            else:
                yield from problems(v, schema.get("additionalProperties", True), f"{at}.{k}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            yield f"{at}: minItems"
        for i, v in enumerate(value if "items" in schema else []):
            yield from problems(v, schema["items"], f"{at}[{i}]")
    for part in schema.get("allOf", []):
        yield from problems(value, part, at)
    if "if" in schema:
        branch = "else" if any(problems(value, schema["if"], at)) else "then"
        yield from problems(value, schema.get(branch, {}), at)
    if "not" in schema and not any(problems(value, schema["not"], at)):
        yield f"{at}: not"




def schema_problems(text: Column, schema: dict) -> Column:
    """Sorted violations of a JSON text (array<string>); text that isn't JSON, null included, has one: not json."""
    strange = unsupported(schema)
    if strange:
        raise ValueError(f"unsupported keywords: {', '.join(strange)}")

    @F.arrow_udf("array<string>")
    def check(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                value = json.loads(t)
            except (TypeError, ValueError, RecursionError):
                out.append(["$: not json"])
                continue
            out.append(sorted(problems(value, schema)))
        return pa.array(out, pa.list_(pa.string()))

    return check(text)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def verdict(text: Column) -> Column:
    """A judge's strict verdict as a struct; null where the text isn't exactly such an object.

    verdict is one of three words, four flags are booleans, issues a list of
    strings and reason a string; other keys are let through.
    """
    v = F.try_parse_json(text)
    flags = [(_kind(v, f"$.{k}") == "BOOLEAN") for k in VERDICT_FLAGS]
    issues = F.try_variant_get(v, "$.issues", "array<variant>")
    good = (_kind(v, "$.verdict") == "STRING") & F.try_variant_get(v, "$.verdict", "string").isin(VERDICTS) & (_kind(v, "$.reason") == "STRING")
    good = good & _kind(v, "$.issues").startswith("ARRAY") & F.forall(issues, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    for f in flags:
        good = good & f
    fields = [F.try_variant_get(v, "$.verdict", "string").alias("verdict"), *[F.try_variant_get(v, f"$.{k}", "boolean").alias(k) for k in VERDICT_FLAGS]]
    return F.when(F.coalesce(good, F.lit(False)), F.struct(*fields, F.try_variant_get(v, "$.issues", "array<string>").alias("issues"), F.try_variant_get(v, "$.reason", "string").alias("reason")))


def mapper_answer(text: Column) -> Column:
    """A mapper's answer: the longest {...} of the text; null where it breaks the rules; blank keys become null."""
    v = F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    key = lambda name: F.when(F.trim(F.try_variant_get(v, f"$.{name}", "string")) != "", F.try_variant_get(v, f"$.{name}", "string"))
    keys_fine = [_kind(v, f"$.{k}").isin("STRING", "VOID") for k in ("chunk_key", "alternative_chunk_key")]
    confidence = _kind(v, "$.confidence")
    good = (confidence.isin("BIGINT", "DOUBLE") | confidence.startswith("DECIMAL")) & (_kind(v, "$.reason") == "STRING") & (F.trim(F.try_variant_get(v, "$.reason", "string")) != "")
    for k in keys_fine:
        good = good & k
    out = F.struct(key("chunk_key").alias("chunk_key"), key("alternative_chunk_key").alias("alternative_chunk_key"), F.try_variant_get(v, "$.confidence", "double").alias("confidence"), F.try_variant_get(v, "$.reason", "string").alias("reason"))
    return F.when(F.coalesce(good, F.lit(False)), out)


def longest_string(text: Column) -> Column:
    """Code points of the longest string value at any depth of a JSON text; null for other text."""

    def longest(v) -> int:
        if isinstance(v, str):
            return len(v)
        return max(map(longest, v.values() if isinstance(v, dict) else v if isinstance(v, list) else []), default=0)

    @F.arrow_udf("int")
    def measure(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(longest(json.loads(t)))
            except (TypeError, ValueError, RecursionError):
                out.append(None)
        return pa.array(out, pa.int32())

    return measure(text)


def guarded(text: Column, limit: int = STRING_LIMIT) -> Column:
    """The text, or an error where one of its strings is longer than limit."""
    return F.when(longest_string(text) > limit, F.raise_error(F.lit(f"a string has more than {limit} characters")).cast("string")).otherwise(text)


def splice(frame: Column, **fields: Column) -> Column:
    """A JSON object with more fields before its closing brace; other payloads stay as they are."""
    body = F.rtrim(frame)
    more = F.substring(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])), 2, 2**31 - 1)
    inner = F.trim(F.substr(body, F.lit(2), F.length(body) - 2))
    return F.when(F.ltrim(body).startswith("{") & body.endswith("}"), F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.when(inner == "", "").otherwise(","), more)).otherwise(frame)


def overrides(defaults: dict, given: dict) -> dict:
    """Run parameters with overrides; unknown names and values that contradict each other are refused."""
    strange = sorted(given.keys() - defaults.keys())
    if strange:
        raise ValueError(f"unknown parameters: {', '.join(strange)}")
    out = defaults | given
    for k in ("dense_k", "kw_k", "rrf_k", "rerank_k", "rerank_output", "ask_top_k"):
        if out.get(k, 1) <= 0:
            raise ValueError(f"{k} must be positive")
    if "ask_top_k" in out and out["ask_top_k"] > out["ask_max_chapters"] * out["ask_chunks_per_chapter"]:
        raise ValueError("ask_top_k exceeds what its chapters can hold")
    if out.get("budget", 4800) < 4800:
        raise ValueError("budget must be 4800 or more")
    return out


def parameters(stored: Column, defaults: dict[str, tuple[str, object]], version: int) -> Column:
    """Run parameters as a struct from a stored VARIANT record.

    defaults: name: (long, double, boolean or string; value).  A name that the
    record lacks has its default, as an older run may not have known it.  What
    this code can't honour ends the job: a record of a newer schema_version, a
    name that isn't known, a value of another kind (null too), and a record
    that is none.
    """
    keys = F.json_object_keys(F.to_json(stored))
    strange = F.array_except(keys, F.array(*[F.lit(n) for n in ("schema_version", *defaults)]))
    written = F.coalesce(F.try_variant_get(stored, "$.schema_version", "long"), F.lit(1))
    bad = [F.when(F.array_contains(keys, n) & ~F.coalesce(reduce(or_, [kind_of(stored, n).startswith(k) for k in _fits(kind)]), F.lit(False)), F.lit(n)) for n, (kind, _) in defaults.items()]
    wrong = F.array_compact(F.array(*bad))
    message = (
        F.when(keys.isNull(), "the record has no parameters").when(written > version, F.concat(F.lit("schema_version "), written.cast("string"), F.lit(" is newer than this code")))
        .when(F.size(strange) > 0, F.concat(F.lit("unknown parameters: "), F.array_join(F.array_sort(strange), ", "))).when(F.size(wrong) > 0, F.concat(F.lit("values of another kind: "), F.array_join(wrong, ", ")))
    )
    fields = [F.coalesce(F.try_variant_get(stored, f"$.{n}", kind), F.lit(value).cast(kind)).alias(n) for n, (kind, value) in defaults.items()]
    return F.when(message.isNotNull(), F.raise_error(message).cast(T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, (k, _) in defaults.items()]))).otherwise(F.struct(*fields))


def kind_of(stored: Column, name: str) -> Column:
    return F.coalesce(_kind(stored, f"$.{name}"), F.lit("VOID"))


def _fits(kind: str) -> list[str]:
    """How schema_of_variant's names begin for values that fit a type."""
    return {"long": ["BIGINT"], "double": ["DOUBLE", "BIGINT", "DECIMAL"], "boolean": ["BOOLEAN"], "string": ["STRING"]}[kind]


def as_record(params: dict[str, Column], version: int) -> Column:
    """Parameters as a VARIANT record with its schema_version."""
    return F.parse_json(F.to_json(F.struct(F.lit(version).cast("long").alias("schema_version"), *[c.alias(n) for n, c in params.items()])))
