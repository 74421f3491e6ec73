"""Scene descriptions: canonical form, view coordinates, signatures, Jaccard and the weighted scene score."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parse as P
from ..functions.text import json_int, ratio, strip

# Component weights, the weights used when none is positive, and the pass mark.
WEIGHTS = {"agent_pos": 0.30, "agent_dir": 0.00, "carrying": 0.15, "front_cell": 0.25, "objects_jaccard": 0.20}
FALLBACK_WEIGHTS = {"agent_pos": 0.30, "agent_dir": 0.10, "carrying": 0.15, "front_cell": 0.25, "objects_jaccard": 0.20}
PASS_MARK = 0.9
STATEFUL = "door"
UNKNOWN = "<unknown>"

#: What ``read_scene`` adds.
READ_COLUMNS = ["p_mode", "p_fence", "p_pos", "p_dir", "p_carry", "p_front", "p_keys", "p_has_carry", "p_has_objects"]


def parse_weights(text: str | None) -> dict[str, float]:
    """``k=v,…`` over the default weights; parts that are no number are left out."""
    out = dict(WEIGHTS)
    for part in (text or "").split(","):
        key, eq, value = part.partition("=")
        try:
            if eq:
                out[key.strip()] = float(value)
        except ValueError:
            continue
    return out


def semantic_state(kind: Column, state: Column) -> Column:
    """Only doors have a state that counts."""
    return F.when(kind == STATEFUL, state.cast("string"))


def object_key(kind: Column, x: Column, y: Column, color: Column, state: Column) -> Column:
    """One object as text, so that set operations hash instead of comparing structs pairwise."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.concat_ws("|", part(kind), part(x), part(y), part(color), part(semantic_state(kind, state)))


def canonical_objects(objects: DataFrame, key: str = "scene_id") -> DataFrame:
    """Objects of a scene as a sorted set.  A scene has no more distinct objects than cells times looks."""
    o = F.struct("type", "px", "py", "color", semantic_state(F.col("type"), F.col("state")).alias("state"))
    return objects.groupBy(key).agg(F.array_sort(F.collect_set(o)).alias("objects"))


def scenes(heads: DataFrame, objects: DataFrame, key: str = "scene_id") -> DataFrame:
    """Scene rows; a scene without objects has an empty list."""
    empty = F.array().cast("array<struct<type:string,px:bigint,py:bigint,color:string,state:string>>")
    return heads.join(canonical_objects(objects, key), key, "left").withColumn("objects", F.coalesce("objects", empty))


def object_keys(objects: str | Column = "objects") -> Column:
    c = F.col(objects) if isinstance(objects, str) else objects
    return F.transform(c, lambda o: object_key(o["type"], o["px"], o["py"], o["color"], o["state"]))


def state_signature(pos: Sequence[Column], direction: Column, carry: Sequence[Column], front: Sequence[Column], keys: Column) -> Column:
    """Order-free fingerprint of a state."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    head = [part(c) for c in (*pos, direction, *carry, *front)]
    return F.md5(F.concat_ws("|", *head, F.array_join(F.array_sort(keys), ";")).cast("binary"))


# ---------------------------------------------------------------- view coordinates

# Where the agent stands in its own view, and the visible range.
VIEW_AGENT = (4, 1)
VIEW_RANGE = (1, 7)
# Size of the state encoding, and the type and colour code of a cell that is not seen.
ENCODING_SIZE = 7
UNSEEN = (0, 0)


def view_xy(wx: Column, wy: Column, ax: Column, ay: Column, direction: Column) -> tuple[Column, Column]:
    """World cell → cell of the agent's view, by the direction it looks."""
    dx, dy = wx - ax, wy - ay
    along = F.when(direction == 0, dx).when(direction == 1, dy).when(direction == 2, -dx).when(direction == 3, -dy)
    across = F.when(direction == 0, dy).when(direction == 1, -dx).when(direction == 2, -dy).when(direction == 3, dx)
    return across + VIEW_AGENT[0], along + VIEW_AGENT[1]


def view_direction(ax: Column, ay: Column, fx: Column, fy: Column) -> Column:
    """Direction in the view, from the agent to the cell in front of it."""
    dx, dy = fx - ax, fy - ay
    return (
        F.when((dx == 1) & (dy == 0), 0).when((dx == 0) & (dy == -1), 1).when((dx == -1) & (dy == 0), 2).when((dx == 0) & (dy == 1), 3)
    )


def seen_cells(encoding: str | Column) -> Column:
    """The cells that a state encoding (array of columns of (type, colour, …) cells) shows, as bits of one number.

    Bit 7x + y stands for cell (x, y).  Cells beyond 7 × 7, null cells and cells too short to tell are not seen; a
    null encoding gives null.
    """
    enc = F.col(encoding) if isinstance(encoding, str) else encoding
    inside = lambda i: i < ENCODING_SIZE

    def bit(cell: Column, x: Column, y: Column) -> Column:
        kind, color = F.get(cell, F.lit(0)), F.get(cell, F.lit(1))
        shown = inside(x) & inside(y) & ~((kind == UNSEEN[0]) & (color == UNSEEN[1]))
        return F.when(shown, F.call_function("shiftleft", F.lit(1).cast("bigint"), x * ENCODING_SIZE + y)).otherwise(F.lit(0).cast("bigint"))

    total = lambda bits: F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a + b)
    column = lambda cells, x: F.when(cells.isNull(), F.lit(0).cast("bigint")).otherwise(total(F.transform(cells, lambda c, y: bit(c, x, y))))
    return total(F.transform(enc, column))


def cell_is_seen(cells: Column, vx: Column, vy: Column) -> Column:
    """Whether view cell (vx, vy) is among the ``seen_cells``; the encoding counts its columns from 0 and its rows from the far end."""
    x, y = vx - VIEW_AGENT[0] + 3, 6 - (vy - VIEW_AGENT[1])
    inside = x.between(0, ENCODING_SIZE - 1) & y.between(0, ENCODING_SIZE - 1)
    at = F.when(inside, x * ENCODING_SIZE + y).cast("int")
    return F.coalesce(F.getbit(cells, at) == 1, F.lit(False))


def to_view(heads: DataFrame, objects: DataFrame, visible: Column | None = None, key: str = "scene_id", encoding: str | None = None) -> DataFrame:
    """Objects in view coordinates: in range, visible, and not the cell in front of the agent.

    ``heads`` gives agent cell (ax, ay), dir and front cell (fx, fy) per scene.  Repeated objects are dropped
    first, so a scene has at most as many rows as it can hold objects.  ``encoding`` names the state encoding in ``heads``:
    objects in cells that it does not show are left out.  It travels as one number, not as an array per object.
    """
    once = objects.select(key, "type", "px", "py", "color", "state").distinct()
    shown = [seen_cells(encoding).alias("_cells")] if encoding else []
    j = once.join(heads.select(key, "ax", "ay", "dir", "fx", "fy", *shown), key)
    at = lambda x, y: view_xy(F.col(x), F.col(y), F.col("ax"), F.col("ay"), F.col("dir"))
    (vx, vy), (fx, fy), (gx, gy) = at("px", "py"), at("fx", "fy"), at("ax", "ay")
    j = j.withColumns({"vx": vx, "vy": vy, "_fx": fx, "_fy": fy, "view_dir": view_direction(gx, gy, fx, fy)})
    seen = F.col("vx").between(*VIEW_RANGE) & F.col("vy").between(*VIEW_RANGE)
    if visible is not None:
        seen = seen & visible
    if encoding:
        seen = seen & cell_is_seen(F.col("_cells"), F.col("vx"), F.col("vy"))
    ahead = (F.col("vx") == F.col("_fx")) & (F.col("vy") == F.col("_fy"))
    return j.filter(seen & ~ahead).select(
        key, "type", "vx", "vy", "color", F.when(F.col("type") == STATEFUL, F.coalesce("state", F.lit(0))).alias("state"), "view_dir"
    )


# ---------------------------------------------------------------- Jaccard and end points


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two key sets; two empty sets agree, an empty and a filled one do not."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
    )


def jaccard_rows(left: DataFrame, right: DataFrame, key: str, item: str = "item") -> DataFrame:
    """Jaccard per key over long tables: one aggregation over both sides, whatever the set sizes."""
    tag = lambda df, l, r: df.select(key, item, F.lit(l).alias("l"), F.lit(r).alias("r"))
    per = tag(left, 1, 0).unionByName(tag(right, 0, 1)).groupBy(key, item).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.groupBy(key).agg(
        F.sum("l").alias("n_left"),
        F.sum("r").alias("n_right"),
        F.sum(F.col("l") * F.col("r")).alias("n_both"),
        F.round(ratio(F.sum(F.col("l") * F.col("r")), F.count("*")), 6).alias("jaccard"),
    )


def endpoint_picks(df: DataFrame, objects: str = "objects") -> DataFrame:
    """Cue at the smallest x, two ends at the largest x, and which end matches the cue.

    Needs three objects.  With fewer than two at the largest x the last two by (x, y) are the ends.
    """
    o = F.col(objects)
    order = lambda x: F.struct(x["py"].alias("py"), x["type"].alias("type"), x["color"].alias("color"), x["px"].alias("px"))
    d = df.filter(F.size(o) >= 3).withColumns(
        {"_min": F.array_min(F.transform(o, lambda x: x["px"])), "_max": F.array_max(F.transform(o, lambda x: x["px"]))}
    )
    d = d.withColumns(
        {
            "cue": F.array_min(F.transform(F.filter(o, lambda x: x["px"] == F.col("_min")), order)),
            "_far": F.filter(o, lambda x: x["px"] == F.col("_max")),
            "_tail": F.slice(
                F.array_sort(
                    F.transform(o, lambda x: F.struct(x["px"].alias("px"), x["py"].alias("py"), x["type"].alias("type"), x["color"].alias("color")))
                ),
                -2,
                2,
            ),
        }
    )
    ends = F.when(F.size("_far") >= 2, F.transform("_far", order)).otherwise(F.transform("_tail", order))
    d = d.withColumn("_ends", F.array_sort(ends)).withColumns({"a": F.get("_ends", F.lit(0)), "b": F.get("_ends", F.lit(1))})
    same = lambda e: (F.col(f"{e}.type") == F.col("cue.type")) & F.col(f"{e}.color").eqNullSafe(F.col("cue.color"))
    kind = lambda e: F.col(f"{e}.type") == F.col("cue.type")
    good = (
        F.when(same("a") & ~same("b"), F.lit("a"))
        .when(same("b") & ~same("a"), F.lit("b"))
        .when(kind("a") & ~kind("b"), F.lit("a"))
        .when(kind("b") & ~kind("a"), F.lit("b"))
        .otherwise(F.lit("ambiguous"))
    )
    return d.withColumn("good_end", good).drop("_min", "_max", "_far", "_tail", "_ends")


# ---------------------------------------------------------------- scene score


def _whole(pair: Column) -> Column:
    """Two numbers and nothing else."""
    return (F.size(pair) == 2) & F.get(pair, F.lit(0)).isNotNull() & F.get(pair, F.lit(1)).isNotNull()


def _place(pos: Column) -> tuple[Column, Column, Column]:
    """Whether a place read as texts is two numbers and nothing else, and the two."""
    x, y = json_int(F.get(pos, F.lit(0))), json_int(F.get(pos, F.lit(1)))
    return (F.size(pos) == 2) & x.isNotNull() & y.isNotNull(), x, y


def _text(v: Column) -> Column:
    """A variant that is a text; values of other types do not count."""
    return F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string")))


def _state(v: Column) -> Column:
    """State as text: a number or a truth value in its shortest form."""
    value = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "STRING", strip(value)).otherwise(F.coalesce(json_int(value).cast("string"), value))


def _is_word(t: Column) -> Column:
    """Whether a leaf read as text begins as only JSON texts do: no number, truth value, list or object."""
    return (t >= "a") & (t < "{") & (t != "true") & (t != "false")


def _is_whole(t: Column) -> Column:
    """Whether a leaf read as text is a whole number in its shortest form, which reads the same as a number and as a text."""
    return ((F.length(t) == 1) & t.between("0", "9")) | t.rlike(r"^(0|-?[1-9][0-9]{0,14})$")


#: Objects of a scene that are read one by one in compiled code; longer lists are read by functions of lists, which Spark interprets.
UNROLLED = 8


def _name_told(t: Column) -> Column:
    return F.coalesce(_is_word(t), F.lit(True))


def _state_told(t: Column) -> Column:
    return F.coalesce(_is_word(t) | _is_whole(t), F.lit(True))


def _objects_told(objects: Column) -> Column:
    """Whether the texts of all leaves tell their kinds."""
    told = lambda o: _name_told(o["type"]) & _name_told(o["color"]) & _state_told(o["state"])
    few = F.lit(True)
    for k in range(UNROLLED):
        few = few & ((F.size(objects) <= k) | told(F.get(objects, F.lit(k))))
    return F.when(objects.isNull(), True).when(F.size(objects) <= UNROLLED, few).otherwise(F.forall(objects, told))


def _each(values: Column, fn: Callable[[Column], Column]) -> Column:
    """``transform``, in compiled code for short lists; they are filled up with what ``fn`` makes of null.

    The interpreted way for longer lists also keeps the projection out of whole-stage code, whose methods Spark cannot split.
    """
    few = F.array(*[fn(F.get(values, F.lit(k))) for k in range(UNROLLED)])
    return F.when(F.size(values) <= UNROLLED, few).otherwise(F.transform(values, fn))


def _leaf(o: Column) -> Column:
    """An object with its leaves read, for leaves read as texts; null without a type or a place."""
    good, x, y = _place(o["pos"])
    # a state is stripped where it counts, at doors
    read = F.struct(strip(o["type"]).alias("type"), x.alias("x"), y.alias("y"), strip(o["color"]).alias("color"), o["state"].alias("state"))
    return F.when(good & o["type"].isNotNull(), read)


def _keys(leaves: Column) -> Column:
    """Different keys of the objects that are not null."""
    key = lambda o: F.when(o.isNotNull(), object_key(o["type"], o["x"], o["y"], o["color"], strip(o["state"])))
    return F.array_except(_each(leaves, key), F.array(F.lit(None).cast("string")))


def _exact_keys(objects: Column) -> Column:
    """``_keys`` for leaves read as variants."""
    leaves = lambda o: F.struct(_text(o["type"]).alias("type"), F.transform(o["pos"], json_int).alias("at"), _text(o["color"]).alias("color"), _state(o["state"]).alias("state"))
    good = F.filter(F.transform(objects, leaves), lambda o: _whole(o["at"]) & o["type"].isNotNull())
    return F.array_distinct(F.transform(good, lambda o: object_key(o["type"], F.get(o["at"], F.lit(0)), F.get(o["at"], F.lit(1)), o["color"], strip(o["state"]))))


def read_scene(df: DataFrame, text: Column) -> DataFrame:
    """Canonical columns of the scene found in an answer text; ``p_mode`` says how it was found.

    The text is parsed once, with leaves as texts.  Where the kind of a leaf counts and its text does not tell it, the text is
    parsed again, with variants as leaves (``_exact``); that also refuses leaves that are no valid variant.
    """
    d = P.find_json_object(df, text, P.SCENE_TEXTS, keep_text=True)
    front, odd = F.col("j_value.front_cell"), F.col("_odd")
    d = d.withColumn("_odd", ~(_name_told(front["type"]) & _state_told(front["state"]) & _objects_told(F.col("j_value.objects"))))
    d = d.withColumn("_exact", F.when(odd, F.get(P.json_listed(F.col("j_text"), f"struct<{P.SCENE_PARTS}>"), F.lit(0))))
    refused = odd & F.col("_exact").isNull()
    d = d.withColumns({"j_mode": F.when(refused, F.lit("fail_json")).otherwise(F.col("j_mode")), "j_value": F.when(~refused, F.col("j_value"))})
    exact, carry = F.col("_exact.front_cell"), F.col("j_value.agent.carrying")
    d = d.withColumns({"_ftype": F.when(odd, _text(exact["type"])).otherwise(strip(front["type"])), "_ckind": F.schema_of_variant(carry)})
    d = d.withColumn("_leaves", F.when(~odd, _each(F.col("j_value.objects"), _leaf)))
    field = lambda name: _text(F.try_variant_get(carry, f"$.{name}", "variant"))
    as_obj = F.col("_ckind").startswith("OBJECT")
    carry_type = F.when(as_obj, F.coalesce(field("type"), F.lit(UNKNOWN))).when(F.col("_ckind") == "STRING", _text(carry)).otherwise(F.lit(UNKNOWN))
    keys = F.when(odd, _exact_keys(F.col("_exact.objects"))).otherwise(_keys(F.col("_leaves")))
    front_state = F.when(odd, _state(exact["state"])).otherwise(strip(front["state"]))
    (placed, x, y), (fplaced, fx, fy) = _place(F.col("j_value.agent.pos")), _place(front["pos"])
    cell = F.struct(fx.alias("x"), fy.alias("y"), F.col("_ftype").alias("type"), semantic_state(F.col("_ftype"), front_state).alias("state"))
    return d.withColumns(
        {
            "p_pos": F.when(placed, F.struct(x.alias("x"), y.alias("y"))),
            "p_dir": json_int(F.col("j_value.agent.dir")),
            "p_carry": F.when(F.col("_ckind") != "VOID", F.struct(carry_type.alias("type"), F.when(as_obj, field("color")).alias("color"))),
            "p_front": F.when(fplaced & F.col("_ftype").isNotNull(), cell),
            "p_keys": F.coalesce(keys, F.array().cast("array<string>")),
            "p_has_carry": F.col("_ckind").isNotNull(),
            "p_has_objects": F.col("j_value.objects").isNotNull(),
        }
    ).withColumnsRenamed({"j_mode": "p_mode", "j_fence": "p_fence"}).drop("j_value", "j_text", "_odd", "_exact", "_ftype", "_ckind", "_leaves")


def score_scenes(df: DataFrame, weights: Mapping[str, float] = WEIGHTS, pass_mark: float = PASS_MARK) -> DataFrame:
    """Components, weighted score and failure of rows that hold a gold scene (g_*) and a read one (p_*)."""
    total = sum(max(0.0, v) for v in weights.values())
    if total <= 0:
        weights, total = FALLBACK_WEIGHTS, sum(FALLBACK_WEIGHTS.values())
    hit = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    comp = {
        "agent_pos": hit(F.col("p_pos") == F.col("g_pos")),
        "agent_dir": hit(F.col("p_dir") == F.col("g_dir")),
        "carrying": hit(F.col("p_carry").eqNullSafe(F.col("g_carry"))),
        "front_cell": hit(F.col("g_front").isNotNull() & F.col("p_front").eqNullSafe(F.col("g_front"))),
        "objects_jaccard": jaccard(F.col("p_keys"), F.col("g_keys")),
    }
    d = df.withColumns(comp)
    score = sum((F.lit(weights.get(k, 0.0)) * F.col(k) for k in comp), F.lit(0.0)) / F.lit(total)
    tags = [
        F.when(F.col("p_pos").isNull(), F.lit("B_missing_agent_pos")),
        F.when(F.col("p_dir").isNull() & F.lit(weights.get("agent_dir", 0.0) > 0), F.lit("B_missing_agent_dir")),
        F.when(~F.col("p_has_carry"), F.lit("B_missing_carrying")),
        F.when(F.col("p_front").isNull(), F.lit("B_missing_front_cell")),
        F.when(~F.col("p_has_objects"), F.lit("B_missing_objects")),
    ]
    readable = F.col("p_mode").isin("strict", "recoverable")
    d = d.withColumn("_tags", F.array_compact(F.array(*tags))).withColumn("_score", score)
    partial = F.when(F.size("_tags") > 0, F.concat("_tags", F.array(F.lit("B_partial_schema")))).otherwise(F.col("_tags"))
    return d.withColumns(
        {
            "score": F.when(readable, F.col("_score")).otherwise(0.0),
            "correct": readable & (F.col("_score") >= pass_mark),
            "failure": F.when(~readable, F.lit("B_json_parse_error")).otherwise(F.get("_tags", F.lit(0))),
            "failure_tags": F.when(readable, partial),
        }
    ).drop("_tags", "_score")
