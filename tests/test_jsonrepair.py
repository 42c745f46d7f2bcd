import json
import random

from lexmill.functions.jsonrepair import repair_json, repaired


def made(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind == 5 and depth:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 6 or not depth:
        return {f"k{i}" + rng.choice(["", '"', "\\", ":,{[", "ñ"]): made(rng, depth + 1) for i in range(rng.randrange(1, 4))}
    return [rng.randrange(-99, 999), rng.random() * 1e-9, rng.choice([True, False, None]), rng.choice(["", "a,b", 'say "x" }', "]\\", "línea\n"]), "z"][kind]


def part_of(part, whole):
    """Whether what is left is a beginning of the whole: entries in order, all but the last one equal."""
    if isinstance(whole, dict) and isinstance(part, dict):
        pairs = list(zip(part.items(), whole.items(), strict=False))
        return len(part) <= len(whole) and all(a[0] == b[0] for a, b in pairs) and all(a == b for a, b in pairs[:-1]) and (not pairs or part_of(pairs[-1][0][1], pairs[-1][1][1]))
    if isinstance(whole, list) and isinstance(part, list):
        pairs = list(zip(part, whole, strict=False))
        return len(part) <= len(whole) and all(a == b for a, b in pairs[:-1]) and (not pairs or part_of(*pairs[-1]))
    return part == whole


def leaves(x):
    inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else None
    return 1 if inner is None else sum(map(leaves, inner))


def test_every_prefix_gives_the_whole_entries_before_it():
    rng = random.Random(6)
    for _ in range(60):
        whole = {"x": made(rng, 1), **made(rng, 0)} if rng.random() < 0.5 else {"y": [made(rng, 1)]}
        for text in (json.dumps(whole), json.dumps(whole, indent=1, ensure_ascii=False)):
            assert json.loads(repaired("Here it is: " + text + " that is all")) == whole
            before = 0
            for n in range(1, len(text)):
                got = json.loads(repaired(text[:n]))
                assert part_of(got, whole)
                assert leaves(got) >= before  # nothing whole is lost as the text goes on
                before = leaves(got)
            assert before >= leaves(whole) - 1


def test_odd_texts(spark):
    assert repaired(None) is None and repaired("") is None and repaired("no object") is None
    assert repaired("{") == "{}" and repaired('{"a') == "{}" and repaired('{"a": tru') == "{}" and repaired('{"a": 1') == "{}" and repaired('{"a": 1,') == '{"a": 1}'
    assert json.loads(repaired('{"a": [1, {"b": "x", "c": [2')) == {"a": [1, {"b": "x", "c": []}]}
    assert json.loads(repaired('{"a": 1]')) == {"a": 1} and json.loads(repaired('{"a": nan, "b": 1}')) == {}
    assert json.loads(repaired("{" + '"a": {' * 50)) is not None
    df = spark.createDataFrame([('x {"a": {"b": "c"',), (None,)], "t string")
    assert [r[0] for r in df.select(repair_json("t")).collect()] == ['{"a": {"b": "c"}}', None]
