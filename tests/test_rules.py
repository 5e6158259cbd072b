"""Compiled schemas, containment, first fits and orders, against plain forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import json_schema
from foliant.operators import containment, geometry, parts
from foliant.plans.rule_queries import TURN_SCHEMA
from foliant.sources.documents import schema_errors

SCHEMAS = [
    TURN_SCHEMA,
    {"type": ["object", "array", "null"], "items": {"type": "number", "minimum": -1.5, "maximum": 7}, "minItems": 1, "maxItems": 3, "additionalProperties": {"type": "string", "minLength": 2, "maxLength": 3}},
    {"anyOf": [{"enum": [1, "a", None, True, 1.5]}, {"type": "object", "properties": {"a": {"$ref": "#/$defs/n", "maximum": 5}}, "required": ["a"]}], "$defs": {"n": {"type": "integer"}}},
    {"oneOf": [{"type": "integer"}, {"minimum": 3}, {"const": {"b": [1], "a": None}}], "if": {"type": "string"}, "then": {"pattern": "^x"}},
    {"allOf": [{"type": "object"}, {"properties": {"a": {"properties": {"a": {"items": {"items": {"const": 0}}}}}}}]},
]


def made(rng, depth=0):
    kind = rng.randrange(10 if depth < 3 else 7)
    if kind < 7:
        return [rng.randrange(-2, 9), rng.choice([1.5, -0.25, 7.5]), rng.choice(["a", "ab", "x", "user", "assistant", "Ü" * 3, ""]), None, rng.random() < 0.5, 2**70, 0][kind]
    if kind == 7:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {k: made(rng, depth + 1) for k in rng.sample(["a", "b", "id", "role", "text", "turn", "tags", "note"], rng.randrange(6))}


@pytest.mark.parametrize("number", range(len(SCHEMAS)))
def test_compiled_schemas_say_the_same(spark, number):
    rng = random.Random(number)
    docs = [made(rng) for _ in range(150)] + [{"id": 3, "role": "user", "text": "t", "turn": t, "tags": [0, "ok"]} for t in range(5)] + [{"b": [1], "a": None}, [], {}]
    frame = spark.createDataFrame([(n, json.dumps(d, ensure_ascii=False)) for n, d in enumerate(docs)], "n int, doc string")
    got = {r.n: sorted(r.e) for r in frame.select("n", json_schema.json_errors(F.col("doc"), SCHEMAS[number]).alias("e")).collect()}
    for n, doc in enumerate(docs):
        assert got[n] == sorted(schema_errors(doc, SCHEMAS[number])), doc


def test_what_is_no_document(spark):
    frame = spark.createDataFrame([("{",), (None,), ("null",), ("",)], "doc string")
    assert [r.e for r in frame.select(json_schema.json_errors(F.col("doc"), {"type": "object"}).alias("e")).collect()] == [["$: no JSON"], None, ["$: expected object"], ["$: no JSON"]]
    with pytest.raises(ValueError, match="contains itself"):
        json_schema.errors(F.col("v"), {"$ref": "#/$defs/t", "$defs": {"t": {"items": {"$ref": "#/$defs/t"}}}})


def test_containment(spark):
    roots = spark.createDataFrame([("/a/b/", "source"), ("/A", "destination"), ("C:\\x", "source"), ("/a/bc", "source"), ("/", "all"), (None, "x"), ("", "x")], "root string, role string")
    rows = spark.createDataFrame([("/a/B/c.txt",), ("/a/b",), ("/a/bcd",), ("c:/X/y",), (None,), ("",)], "path string")
    got = sorted((r.path, r.root) for r in containment.holding(rows, roots).collect())
    assert got == sorted([("/a/B/c.txt", "/a/b/"), ("/a/B/c.txt", "/A"), ("/a/B/c.txt", "/"), ("/a/b", "/a/b/"), ("/a/b", "/A"), ("/a/b", "/"), ("/a/bcd", "/A"), ("/a/bcd", "/"), ("c:/X/y", "C:\\x"), ("c:/X/y", "/")])
    assert {(r.path, r.root) for r in containment.innermost(rows, roots).collect()} == {("/a/B/c.txt", "/a/b/"), ("/a/b", "/a/b/"), ("/a/bcd", "/A"), ("c:/X/y", "C:\\x")}


def test_setting_problems(spark):
    roots = spark.createDataFrame([("/s", "source", True, True), ("/s/out", "destination", True, True), ("/gone", "source", False, None), ("/file", "destination", True, False), ("/new", "destination", False, None)], "root string, role string, exists boolean, is_folder boolean")
    config = spark.createDataFrame([("/s/settings.json",), ("/etc/settings.json",)], "path string")
    got = {(r.path, r.problem) for r in containment.setting_problems(roots, config).collect()}
    assert got == {("/gone", "missing"), ("/file", "no folder"), ("/s", "overlap"), ("/s/out", "overlap"), ("/s/settings.json", "config inside")}


def test_first_fit_is_what_trying_finds(spark):
    rng = random.Random(4)
    rows = [(n, rng.randrange(1, 10**7), rng.choice([rng.randrange(1, 12000), None]), rng.randrange(1, 12000), rng.choice([".png", ".jpg", ".WEBP"]), rng.randrange(1, 10**6)) for n in range(300)]
    got = {r.id: (r.edge, r.quality, r.bytes) for r in parts.standin_choice(spark.createDataFrame(rows, "id int, size bigint, width int, height int, ext string, cap bigint"), 3000, 60).collect()}
    for n, size, width, height, ext, cap in rows:
        want = (None, None, None)
        for edge in [3000, *[e for e in parts.STANDIN_EDGES if e < 3000]]:
            for quality in [60] if ext == ".png" else [50, 30, 15, 5]:
                shrink = min(1.0, edge / max(width or 0, height))
                came = int(size * shrink * shrink * (1.0 if ext == ".png" else quality / 100))
                if came <= cap and want[0] is None:
                    want = (edge, quality, came)
        assert got[n] == want


def test_first_true(spark):
    frame = spark.createDataFrame([(n, k) for n in (0, 1, 2, 7, 100) for k in range(0, n + 1)], "n int, k int")
    assert all(r.at == r.k for r in frame.select("k", parts.first_true(F.col("n"), lambda m: m >= F.col("k")).alias("at")).collect())


def test_siblings_without_an_index(spark):
    missing = spark.createDataFrame([("s", "c", 4, 10, 10)], "sheet string, cell string, cell_index int, x int, y int")
    located = spark.createDataFrame([("s", "far", 1, 1, 0, 0), ("s", "near", -1, 2, 9, 10), ("s", "tie", -1, 3, 10, 9)], "sheet string, part string, part_index int, part_order int, x int, y int")
    assert geometry.nearest_sibling(missing, located, "sheet").first().sibling == "near"
