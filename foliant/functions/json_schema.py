"""JSON schemas as column expressions: documents are checked where they lie, without Python.

``errors`` compiles a schema into an expression over a variant that says the same as ``documents.schema_errors`` says
of one document.  References are put in place when the expression is built, so one that contains itself is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "CAST(array() AS array<string>)"
#: References within references that are followed.
NESTED = 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _of_kind(kind: Column, name: str) -> Column:
    # whole numbers beyond 64 bits are decimals of more than 18 digits; 1.0 is a decimal of few
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return {
        "object": kind.startswith("OBJECT<"), "array": kind.startswith("ARRAY<"), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID",
        "integer": whole, "number": kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL("),
    }[name]


def _equals(value: Column, kind: Column, wanted) -> Column:
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & F.coalesce(F.try_variant_get(value, "$", "boolean") == wanted, F.lit(False))
    if isinstance(wanted, (int, float)):
        return _of_kind(kind, "number") & F.coalesce(F.try_variant_get(value, "$", "decimal(38,18)" if isinstance(wanted, float) else "decimal(38,0)") == F.lit(str(wanted)).cast("decimal(38,18)"), F.lit(False)) & F.coalesce(F.try_variant_get(value, "$", "double") == float(wanted), F.lit(False))
    if isinstance(wanted, str):
        return (kind == "STRING") & F.coalesce(F.try_variant_get(value, "$", "string") == wanted, F.lit(False))
    return F.to_json(value) == json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _resolved(schema: dict, root: dict) -> dict:
    for part in schema["$ref"].lstrip("#/").split("/"):
        root = root[part]
    return root


def _one(bad: Column, text: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(text)).otherwise(F.expr(_NONE))


def errors(value: Column, schema: dict, root: dict | None = None, path: Column | None = None, depth: int = 0) -> Column:
    """array<string> of what a variant breaks of ``schema``; a null column gives null, a JSON null is a value."""
    if depth > NESTED:
        raise ValueError("a reference contains itself; use schema_errors")
    root, path = schema if root is None else root, F.lit("$") if path is None else path
    deeper = lambda s, v=value, p=path: errors(v, s, root, p, depth + ("$ref" in schema))
    if "$ref" in schema:
        rest = {k: v for k, v in schema.items() if k != "$ref"}
        return F.concat(deeper(_resolved(schema, root)), deeper(rest)) if rest else deeper(_resolved(schema, root))
    return _let(F.schema_of_variant(value), lambda kind: _checked(value, kind, schema, path, deeper))


def _checked(value: Column, kind: Column, schema: dict, path: Column, deeper: Callable[..., Column]) -> Column:
    said = lambda text: F.concat(path, F.lit(f": {text}"))
    found: list[Column] = []
    if "const" in schema:
        found.append(_one(~_equals(value, kind, schema["const"]), said("not the constant")))
    if "enum" in schema:
        known = F.lit(False)
        for wanted in schema["enum"]:
            known = known | _equals(value, kind, wanted)
        found.append(_one(~known, said("not in enum")))
    if schema.keys() & {"required", "properties", "additionalProperties"}:
        members = F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.expr("CAST(map() AS map<string,variant>)"))
        inner = _let(members, lambda m: F.concat(F.expr(_NONE), *_members(m, schema, path, deeper)))
        found.append(F.when(_of_kind(kind, "object"), inner).otherwise(F.expr(_NONE)))
    for name, low, high in (("array", "minItems", "maxItems"), ("string", "minLength", "maxLength")):
        if low in schema or high in schema:
            length = F.size(F.try_variant_get(value, "$", "array<variant>")) if name == "array" else F.length(F.try_variant_get(value, "$", "string"))
            bad = (length < schema.get(low, 0)) | ((length > schema[high]) if high in schema else F.lit(False))
            found.append(_one(_of_kind(kind, name) & bad, F.concat(path, F.lit(": length "), length.cast("string"))))
    if "items" in schema:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, n: deeper(schema["items"], x, F.concat(path, F.lit("["), n.cast("string"), F.lit("]"))))
        found.append(F.when(_of_kind(kind, "array"), F.flatten(each)).otherwise(F.expr(_NONE)))
    if "pattern" in schema:
        found.append(_one((kind == "STRING") & ~F.try_variant_get(value, "$", "string").rlike(schema["pattern"]), said("pattern")))
    if "minimum" in schema or "maximum" in schema:
        number = F.try_variant_get(value, "$", "double")
        bad = (number < schema.get("minimum", float("-inf"))) | (number > schema.get("maximum", float("inf")))
        found.append(_one(_of_kind(kind, "number") & bad, said("out of bounds")))
    fits = lambda s: F.size(deeper(s)) == 0
    found += [deeper(s) for s in schema.get("allOf", [])]
    if "anyOf" in schema:
        found.append(_one(~F.exists(F.array(*map(fits, schema["anyOf"])), lambda ok: ok), said("fits none")))
    if "oneOf" in schema:
        found.append(_one(F.size(F.filter(F.array(*map(fits, schema["oneOf"])), lambda ok: ok)) != 1, said("fits not exactly one")))
    if "if" in schema:
        branch = lambda name: deeper(schema[name]) if name in schema else F.expr(_NONE)
        found.append(F.when(fits(schema["if"]), branch("then")).otherwise(branch("else")))
    whole = F.concat(F.expr(_NONE), *found)
    wanted = schema.get("type")
    if not wanted:
        return whole
    right = F.lit(False)
    for name in [wanted] if isinstance(wanted, str) else wanted:
        right = right | _of_kind(kind, name)
    return F.when(right, whole).otherwise(F.array(said(f"expected {wanted}")))


def _members(members: Column, schema: dict, path: Column, deeper: Callable[..., Column]) -> list[Column]:
    known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
    below = lambda key: F.concat(path, F.lit("."), key)
    out = [_one(~F.map_contains_key(members, k), F.concat(path, F.lit(f".{k}: missing"))) for k in schema.get("required", [])]
    out += [F.when(F.map_contains_key(members, k), deeper(s, F.element_at(members, k), below(F.lit(k)))).otherwise(F.expr(_NONE)) for k, s in known.items()]
    other = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(*known) if known else F.lit(True))
    if more is False:
        out.append(F.transform(other, lambda e: F.concat(below(e["key"]), F.lit(": unknown"))))
    elif isinstance(more, dict):
        out.append(F.flatten(F.transform(other, lambda e: deeper(more, e["value"], below(e["key"])))))
    return out


def json_errors(text: Column, schema: dict) -> Column:
    """array<string> of a JSON text: what its document breaks, or that it is none; null for null."""
    broken = F.array(F.lit("$: no JSON"))
    return F.when(text.isNotNull(), _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), broken).otherwise(errors(v, schema))))
