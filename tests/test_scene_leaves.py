"""Leaves of a scene text whose kind counts, and texts that never parse."""

import json

from pyspark.sql import functions as F

from verdikt.functions import parse as P
from verdikt.operators import scenes as C


def test_leaves_of_every_kind_in_one_batch(spark):
    """A leaf's text may look like another kind's; each row is read by its own kinds."""
    names = ["key", " key ", "Key", "true", "5", "", "null", "NaN", "[1]", "{}", "ä", True, 5, None, [1], {"a": "key"}]
    states = ["open", "1", "01", " 2 ", "3.0", "true", "-0", 1, 1.0, -4, True, False, None, 123456789012345678, "x y ", [2]]
    texts = []
    for name, state in zip(names, states):
        for k in range(4):
            o = {"type": name if k == 0 else "door", "pos": [1, 2], "color": name if k == 1 else "red", "state": state if k == 2 else 0}
            front = {"pos": [1, 2], "type": name if k == 3 else "door", "state": state}
            texts.append(json.dumps({"front_cell": front, "objects": [o, {"type": "ball", "pos": [3, 3], "color": "red"}]}))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in C.read_scene(rows, F.col("t")).collect()}

    def word(v):
        return v.strip() if isinstance(v, str) else None

    def state_text(v):
        if isinstance(v, str):
            return v.strip()
        if isinstance(v, bool):
            return str(int(v))
        return None if v is None else json.dumps(v) if isinstance(v, list) else str(int(v))

    for i, t in enumerate(texts):
        scene = json.loads(t)
        keys = []
        for o in scene["objects"]:
            if word(o["type"]) is not None:
                state = state_text(o.get("state")) if word(o["type"]) == "door" else None
                keys.append("|".join("-" if x is None else str(x) for x in (word(o["type"]), *o["pos"], word(o["color"]), state)))
        assert got[i].p_keys == keys, t
        f = scene["front_cell"]
        kind = word(f["type"])
        want = None if kind is None else (1, 2, kind, state_text(f["state"]) if kind == "door" else None)
        assert (got[i].p_front and tuple(got[i].p_front)) == want, t
        assert got[i].p_mode == "strict"


def test_repeated_field_inside_a_leaf(spark):
    text = '{"objects": [{"type": {"a": 1, "a": 2}, "pos": [1, 1], "color": "red"}]}'
    r = C.read_scene(spark.createDataFrame([(text,)], "t string"), F.col("t")).first()
    assert (r.p_mode, r.p_keys, r.p_has_objects) == ("strict", [], True)


def test_parses_no_text_that_cannot_change(spark):
    """A trailing comma at the end is dropped before the first parse; without commas to drop there is no second one."""
    rows = [('{"a": "x", }', "x", "recoverable"), ('{"a": "x,}"}', "x,}", "strict"), ('{"a": oops }', None, "fail_json"), ('{"a": ["x",], "b": 1,\n}', '["x"]', "recoverable"), ('{"a": "x",}}', None, "fail_json")]
    d = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "i int, t string")
    got = P.find_json_object(d, F.col("t"), "a: string", keep_text=True).orderBy("i").collect()
    assert [(r.j_value and r.j_value.a, r.j_mode) for r in got] == [x[1:] for x in rows]
    assert [r.j_text for r in got] == ['{"a": "x" }', '{"a": "x,}"}', None, '{"a": ["x"], "b": 1\n}', None]
