"""Text documents the engine reads and writes: commented JSON, manifests, undo logs, exports."""

from __future__ import annotations

import csv
import io
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of an undo log.
UNDO = ("action", "source", "destination", "size", "sha256", "timestamp")
_JSONC = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)


def without_comments(text: str) -> str:
    """JSON text without // and /* */ comments; those in strings stay."""
    return _JSONC.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)


def load_config(text: str) -> dict:
    return json.loads(without_comments(text))


def extension_groups(groups: dict[str, list[str]]) -> dict[str, str]:
    """Extension to group; the first group that names one has it, and ``archives_optional`` counts as archives."""
    out: dict[str, str] = {}
    for name, suffixes in groups.items():
        for s in suffixes:
            out.setdefault(("." + s.lstrip(".")).lower(), "archives" if name == "archives_optional" else name)
    return out


def parse_manifest(lines: DataFrame) -> DataFrame:
    """line, rel, size, sha256, error of manifest lines (line, value): three fields, a safe path, digits, 64 hex digits,
    and each path once."""
    f = F.split("value", "\t")
    rel, size, sha = F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.get(f, F.lit(2))
    bad_path = (rel == "") | rel.startswith("/") | rel.contains("\\") | F.exists(F.split(rel, "/"), lambda p: p.isin("", ".", ".."))
    first = lines.groupBy(rel.alias("_rel")).agg(F.min("line").alias("_first"))
    own = lines.withColumn("_rel", rel).join(first, "_rel")
    error = (
        F.when(F.size(f) != 3, "fields").when(bad_path, "path").when(~size.rlike("^[0-9]+$"), "size").when(~sha.rlike("^[0-9a-f]{64}$"), "sha256").when(F.col("line") > F.col("_first"), "duplicate")
    )
    return own.select("line", rel.alias("rel"), size.try_cast("bigint").alias("size"), sha.alias("sha256"), error.alias("error"))


def render_manifest(rows: DataFrame) -> DataFrame:
    """Lines of (rel, size, sha256), in the order of rel."""
    return rows.orderBy("rel").select(F.concat_ws("\t", "rel", F.col("size").cast("string"), "sha256").alias("value"))


def read_undo(text: str) -> list[dict[str, str]]:
    """Rows of an undo log: any case in the header, a byte-order mark allowed, blank rows passed over, short ones filled up."""
    rows = [r for r in csv.reader(io.StringIO(text.lstrip("\ufeff"))) if any(x.strip() for x in r)]
    if not rows or tuple(x.strip().lower() for x in rows[0][:6]) != UNDO:
        raise ValueError("not an undo log")
    return [dict(zip(UNDO, [*r, *[""] * 6][:6])) for r in rows[1:]]


def export_cell(column: Column, kind: T.DataType) -> Column:
    """A table cell: empty for null, true/false, lists joined by `` | ``, lists of structs as JSON."""
    if isinstance(kind, T.BooleanType):
        text = F.when(column, "true").otherwise("false")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        text = F.to_json(column)
    elif isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(column, lambda x: x.cast("string")), " | ")
    elif isinstance(kind, T.StructType):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.when(column.isNull(), "").otherwise(text)


def export_table(frame: DataFrame) -> DataFrame:
    """All columns as export cells."""
    return frame.select(*[export_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in frame.schema])


def redacted(column: Column, secret_keys: str = "cookie|token|secret|password|session_id") -> Column:
    """JSON text with the values of secret keys, and cookie values in texts, masked."""
    values = F.regexp_replace(column, rf'(?i)("(?:[^"]*(?:{secret_keys})[^"]*)"\s*:\s*)"(?:[^"\\]|\\.)*"', r'$1"[redacted]"')
    return F.regexp_replace(values, r"session_id=[^;\s\"]+", "session_id=[redacted]")


def log_lines(events: DataFrame, floor: str = "info") -> DataFrame:
    """JSON lines of events at or above a level, secrets masked."""
    order = {"debug": 0, "info": 1, "warning": 2, "error": 3}
    rank = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in order.items()], F.lit(1))
    return events.filter(rank >= order[floor]).select(redacted(F.to_json(F.struct("*"))).alias("value"))


def validated(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """frame with ``errors``: the names of the rules that do not hold, in order."""
    return frame.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])))


def schema_errors(value, schema: dict, root: dict | None = None, path: str = "$") -> list[str]:
    """What a document breaks of a JSON schema: type, enum, const, required, properties, items, lengths, bounds, pattern,
    references and the combinators."""
    root = root or schema
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].lstrip("#/").split("/"):
            target = target[part]
        # what stands beside a reference holds as well
        rest = {k: v for k, v in schema.items() if k != "$ref"}
        return schema_errors(value, target, root, path) + (schema_errors(value, rest, root, path) if rest else [])
    out: list[str] = []
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

    def is_kind(kind: str) -> bool:
        if kind in ("integer", "number"):
            return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
        return isinstance(value, kinds[kind])

    wanted = schema.get("type")
    if wanted and not any(map(is_kind, [wanted] if isinstance(wanted, str) else wanted)):
        return [f"{path}: expected {wanted}"]
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: not the constant")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += schema_errors(v, known[k], root, f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += schema_errors(v, schema["additionalProperties"], root, f"{path}.{k}")
    for size, low, high in ((list, "minItems", "maxItems"), (str, "minLength", "maxLength")):
        if isinstance(value, size) and not schema.get(low, 0) <= len(value) <= schema.get(high, len(value)):
            out.append(f"{path}: length {len(value)}")
    if isinstance(value, list) and "items" in schema:
        out += [e for n, v in enumerate(value) for e in schema_errors(v, schema["items"], root, f"{path}[{n}]")]
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{path}: pattern")
    if is_kind("number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{path}: out of bounds")
    fits = lambda s: not schema_errors(value, s, root, path)
    out += [e for s in schema.get("allOf", []) for e in schema_errors(value, s, root, path)]
    if "anyOf" in schema and not any(map(fits, schema["anyOf"])):
        out.append(f"{path}: fits none")
    if "oneOf" in schema and sum(map(fits, schema["oneOf"])) != 1:
        out.append(f"{path}: fits not exactly one")
    if "if" in schema:
        branch = schema.get("then" if fits(schema["if"]) else "else")
        out += schema_errors(value, branch, root, path) if branch else []
    return out


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents in permissive mode; what doesn't fit is in _corrupt_record."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).json(path)
