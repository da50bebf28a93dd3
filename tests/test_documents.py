"""Documents of any depth against a recursive walk."""

from __future__ import annotations

import json

import numpy as np

from cadenza.operators import documents


def grown(rng, depth):
    pick = int(rng.integers(0, 9 if depth else 6))
    if pick < 6:
        return [None, True, int(rng.integers(0, 99)), "text", "x" * 300, {} if rng.random() < 0.5 else []][pick]
    if pick == 6:
        return [grown(rng, depth - 1) for _ in range(int(rng.integers(1, 4)))]
    return {str(rng.choice(["a", "b", "Token", "nested", "secret"])) + ("" if rng.random() < 0.8 else "1"): grown(rng, depth - 1) for _ in range(int(rng.integers(1, 4)))}


def walked(x, path="$", hide=False):
    if hide:
        yield path, "redacted", "[redacted]"
    elif isinstance(x, dict) and x:
        for k, v in x.items():
            yield from walked(v, f"{path}.{k}", k.lower() in documents.HIDDEN)
    elif isinstance(x, list) and x:
        for k, v in enumerate(x):
            yield from walked(v, f"{path}[{k}]")
    else:
        kind = "object" if x == {} and isinstance(x, dict) else "array" if isinstance(x, list) else "string" if isinstance(x, str) else "null" if x is None else "boolean" if isinstance(x, bool) else "number"
        yield path, kind, (x[:200] + "..." if len(x) > 200 else x) if kind == "string" else json.dumps(x)


def test_any_depth(spark):
    rng = np.random.default_rng(9)
    docs = [(k, grown(rng, 6)) for k in range(80)]
    deep: object = "end"
    for _ in range(12):
        deep = {"d": [deep]}
    docs += [(100, deep), (101, {"password": {"a": [1, 2]}, "x": {"API_KEY": None}})]
    rows = [(k, json.dumps(x)) for k, x in docs] + [(200, None), (201, "not json"), (202, "")]
    found = documents.leaves(spark.createDataFrame(rows, "id long, json string"))
    got = sorted((r.id, r.path, r.kind, r.value) for r in found.collect() if r.kind != "invalid")
    assert got == sorted((k, *row) for k, x in docs for row in walked(x))
    assert {r.id for r in found.filter("kind = 'invalid'").collect()} == {201, 202}
    counts = {(r.id, r.kind): r.n for r in documents.summary(found).collect()}
    assert counts[101, "redacted"] == 2 and counts[100, "string"] == 1
