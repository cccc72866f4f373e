"""Nested JSON of any depth becomes property rows."""

import json
import random

import pytest

from vellumine.operators import metadata


def plain(value, path=""):
    """Leaves of a parsed text by recursion."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from plain(v, f"{path}:{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from plain(v, f"{path}[{i}]")
    elif value is not None:
        text = str(value).lower() if isinstance(value, bool) else str(value)
        if text.strip():
            yield path, text.strip()


def made(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind < 4:
        return rng.choice([rng.randrange(-99, 99), True, False, None, "", " ", "a b", 'q"]}\\', "é\n[{", "1.5", "null"])
    if kind == 4:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", 'k"', "x:y", "é", "[0]", "}"]) + str(i): made(rng, depth - 1) for i in range(rng.randrange(4))}


def flat(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, j string")
    return metadata.flatten_json(df, "k", "j").collect()


def test_brackets_in_strings_are_no_nesting(spark):
    assert {(r.property, r.value) for r in flat(spark, ['{"t":"]]]]","x":{"y":{"z":1}}}'])} == {("t", "]]]]"), ("x:y:z", "1")}
    assert {(r.property, r.value) for r in flat(spark, ['{"t":"[[[[[[[["}', '{"q\\\\":"a\\"]]]","x":1}'])} == {("t", "[[[[[[[["), ("q\\", 'a"]]]'), ("x", "1")}


@pytest.mark.parametrize("space", [None, 2])
def test_leaves_are_those_of_a_parser(spark, space):
    rng = random.Random(8)
    values = [made(rng, d % 7) for d in range(300)]
    got = sorted((r.evidence_id, r.property, r.value) for r in flat(spark, [json.dumps(v, indent=space, ensure_ascii=bool(space)) for v in values]))
    assert got == sorted((i, *leaf) for i, v in enumerate(values) for leaf in plain(v))


def test_depth_changes_no_plan(spark):
    deep = '{"a":' * 400 + '["x"]' + "}" * 400
    rows = flat(spark, [deep, '{"b":1}', "no json", None, "{", '{"c":1,"c":2}', "7", "[]", "{}", "null", '{"f":1.50,"g":1e2}'])
    assert {(r.evidence_id, r.property, r.value) for r in rows} == {
        (0, ":".join("a" * 400) + "[0]", "x"), (1, "b", "1"), (6, "", "7"), (10, "f", "1.5"), (10, "g", "100.0")}
