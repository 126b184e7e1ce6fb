"""JSON parts against a plain walk that says each part anew."""

import json
import random

from cairnflow.operators import json_parts as jp

say = lambda v: json.dumps(v, ensure_ascii=False)


def plain(doc, most, least):
    parts = [{}]

    def put(path, value):
        at = parts[-1]
        for k in path[:-1]:
            at = at.setdefault(k, {})
        at[path[-1]] = value

    def walk(value, path):
        for k, v in value.items():
            size = len(say(parts[-1]))
            if len(say({k: v})) < most - size:
                put([*path, k], v)
                continue
            if size >= least:
                parts.append({})
            if isinstance(v, dict) and v:
                walk(v, [*path, k])
            else:
                put([*path, k], v)

    walk(doc, [])
    return [say(p) for p in parts if p]


def value(rnd, depth):
    kind = rnd.choice(["leaf", "leaf", "dict", "list"] if depth < 4 else ["leaf"])
    if kind == "leaf":
        return rnd.choice([1, None, True, 2.5, "é" * rnd.randint(0, 30), 'say "x"\n', [], {}])
    if kind == "list":
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 5))]
    return {rnd.choice(["a", "key", "ключ", '"']) + str(i): value(rnd, depth + 1) for i in range(rnd.randint(0, 6))}


def test_parts():
    rnd = random.Random(41)
    cut = 0
    for _ in range(600):
        doc = rnd.choice([value(rnd, 0), {str(i): value(rnd, 0) for i in range(8)}])
        size, least = rnd.choice([10, 25, 60, 2000]), rnd.choice([5, 30])
        got = jp.parts_of(say(doc), size, least)
        keyed = jp._keyed(doc)
        assert got == (plain(keyed, 2 * size, least) if isinstance(doc, (dict, list)) else []), doc
        cut += len(got) > 1
        # no value is lost
        leaves = lambda v: sum(map(leaves, v.values())) if isinstance(v, dict) and v else 1  # noqa: E731, B023
        assert not keyed or not isinstance(keyed, dict) or sum(leaves(json.loads(p)) for p in got) == leaves(keyed)
    assert cut > 100


def test_lines(spark):
    rows = [None, "", "  ", "5", "{broken", '{"a": 1}\n{"b": [2]}\n\n', '{"a": 1}\nno', '{"a": 1}\n{"b": 2}\n{"c": 3}\n{"d": 4}\nno', "[" * 100_000]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    got = {}
    for r in jp.json_parts(df, "id", "t").collect():
        got.setdefault(r.id, []).append((r.pos, r.part))
    assert got == {5: [(0, '{"a": 1}'), (1, '{"b": {"0": 2}}')], 7: [(k, say({c: k + 1})) for k, c in enumerate("abcd")]}
