"""Broken answers with the values that they mean."""

import json
import random

import pytest

from larkspur.functions import jsonx
from larkspur.functions.json_repair import repair

BROKEN = [
    ('{"a": 1}', {"a": 1}),
    ("{'a': 'b', 'c': [1, 2,],}", {"a": "b", "c": [1, 2]}),
    ("{a: true, b: None, c: undefined}", {"a": True, "b": None, "c": None}),
    ('{"a": "one "two" three", "b": 2}', {"a": 'one "two" three', "b": 2}),
    ('{"a": "line\nbreak"}', {"a": "line\nbreak"}),
    ('{"a": [1, 2', {"a": [1, 2]}),
    ('{"a": "open', {"a": "open"}),
    ('{"a": {"b": [{"c": "d"', {"a": {"b": [{"c": "d"}]}}),
    ('{"a" 1, "b": 2}', None),
    ('{"a": , "b": 2}', {"a": None, "b": 2}),
    ('{"a": 1 "b": 2}', None),
    ('[{"index": 0, "category": "x"} {"index": 1}]', [{"index": 0, "category": "x"}, {"index": 1}]),
    ('Sure, here it is:\n```json\n{"same": true,}\n```\nThat is all.', {"same": True}),
    ('{“a”: “b”}', {"a": "b"}),
    ('{"a": 1, // a note\n "b": 2 /* more */, # last\n "c": .5}', {"a": 1, "b": 2, "c": 0.5}),
    ('{"u": "\\u4f60\\n\\"x\\""}', {"u": '你\n"x"'}),
    ('{"a":: 1,, "b": 2}', {"a": 1, "b": 2}),
    ("{title: Open day in the hall, room: B12}", {"title": "Open day in the hall", "room": "B12"}),
    ('{"n": -1.5e3, "m": 12abc}', {"n": -1500.0, "m": "12abc"}),
    ("[]", []),
]


@pytest.mark.parametrize(("text", "want"), [x for x in BROKEN if x[1] is not None])
def test_values(text, want):
    assert repair(text) == want


def test_strict_json_keeps_its_value():
    rng = random.Random(2)

    def made(depth=0):
        kind = rng.randrange(7 if depth < 4 else 5)
        if kind == 5:
            return {f"k{rng.randrange(9)}": made(depth + 1) for _ in range(rng.randrange(4))}
        if kind == 6:
            return [made(depth + 1) for _ in range(rng.randrange(4))]
        return [rng.randrange(-99, 99), rng.random(), True, None, rng.choice(["", "a b", 'q"uote', "back\\slash", "é你", "1,2:3"])][kind]

    for _ in range(400):
        v = {"v": made()}
        assert repair("text before " + json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) == v


def test_any_text_ends_in_a_value_or_an_error():
    rng = random.Random(6)
    for _ in range(3000):
        text = "{" + "".join(rng.choice("{}[]:,'\"\\ab1 \n/#“é") for _ in range(rng.randrange(40)))
        json.dumps(repair(text))
    with pytest.raises(ValueError):
        repair("no value here")
    with pytest.raises(ValueError):
        repair("[" * 5000)
    assert repair("[" + "1," * 200_000) == [1] * 200_000


def test_column(spark):
    rows = [(t, False, json.dumps(w, ensure_ascii=False)) for t, w in BROKEN if w is not None] + [('{"a": "op', True, None), ('{"a": 1}', True, '{"a": 1}'), (None, False, None), ("plain", False, None)]
    got = spark.createDataFrame(rows, "text string, cut boolean, want string").select("want", jsonx.repaired_json("text", "cut").alias("got")).collect()
    assert all((r.got is None) if r.want is None else json.loads(r.got) == json.loads(r.want) for r in got)
