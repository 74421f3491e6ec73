"""Queries: scene tables, scene scores, repairs of exam B and content duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import parse as P
from ..operators import gates as G, joins as J, scenes as C, scoring as S, terms as N
from .fixtures import MODELS, Fixtures
from .registry import query


COMPONENTS = S.COMPONENTS


def _front_state(kind, state):
    return F.struct((F.col("ax") + 1).alias("x"), F.col("ay").alias("y"), kind.alias("type"), C.semantic_state(kind, state).alias("state"))


def gold_scenes(fx: Fixtures) -> DataFrame:
    s = C.scenes(fx("scene_heads"), fx("scene_objects"))
    return s.select(
        "scene_id", "uid", "env_task", "group_id", "fmt", "objects",
        F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("g_pos"), F.col("dir").alias("g_dir"),
        F.when(F.col("carry_type").isNotNull(), F.struct(F.col("carry_type").alias("type"), F.col("carry_color").alias("color"))).alias("g_carry"),
        _front_state(F.col("front_type"), F.col("front_state")).alias("g_front"),
        C.object_keys().alias("g_keys"),
    )


def scene_responses(fx: Fixtures) -> DataFrame:
    """Judges' scene texts: some objects left out or recoloured, and eight ways of writing them down."""
    seen = fx("scene_objects").filter("NOT dropped_by_judge").withColumn("color", F.when(F.col("recoloured_by_judge"), F.lit("grey")).otherwise(F.col("color")))
    o = F.struct("type", F.array("px", "py").alias("pos"), "color", "state")
    lists = seen.groupBy("scene_id").agg(F.collect_set(o).alias("objects"))
    h = fx("scene_heads")
    k = F.col("scene_id")
    pos = F.array(F.when(k % 13 == 0, F.col("ax") + 1).otherwise(F.col("ax")), F.col("ay"))
    carrying = F.when(F.col("carry_type").isNotNull() & (k % 17 != 0), F.struct(F.col("carry_type").alias("type"), F.col("carry_color").alias("color")))
    front = F.struct(
        F.array(F.col("ax") + 1, F.col("ay")).alias("pos"),
        F.when(k % 19 == 0, F.lit("lava")).otherwise(F.col("front_type")).alias("type"), F.col("front_state").alias("state"),
    )
    empty = F.array().cast("array<struct<type:string,pos:array<bigint>,color:string,state:bigint>>")
    d = h.join(lists, "scene_id", "left").withColumn("objects", F.coalesce("objects", empty))
    options = {"ignoreNullFields": "false"}
    body = F.to_json(F.struct(F.struct(pos.alias("pos"), F.col("dir"), carrying.alias("carrying")).alias("agent"), front.alias("front_cell"), "objects"), options)
    no_agent = F.to_json(F.struct(front.alias("front_cell"), "objects"), options)
    raw = (
        F.when(F.col("fmt") == 0, F.concat(F.lit("  "), body))
        .when(F.col("fmt") == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("fmt") == 2, F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(", }")))
        .when(F.col("fmt") == 3, F.concat(F.lit("Here it is: "), body, F.lit(" That is all.")))
        .when(F.col("fmt") == 4, F.lit("[1, 2, 3]"))
        .when(F.col("fmt") == 5, F.lit('{"agent": oops }'))
        .when(F.col("fmt") == 6, no_agent)
        .otherwise(F.lit(""))
    )
    return d.select("uid", "scene_id", raw.alias("raw"))


def scored_scenes(fx: Fixtures, **options) -> DataFrame:
    """Texts are dealt by uid, as the join with gold needs them, and read there: a scene's canonical parts are no smaller."""
    read = C.read_scene(scene_responses(fx).drop("scene_id").repartition("uid"), F.col("raw")).drop("raw")
    return C.score_scenes(gold_scenes(fx).drop("objects").join(read, "uid"), **options)


def exam_b(fx: Fixtures) -> DataFrame:
    """The exam of scenes with its answers as JSON objects; some rows have none."""
    pos = lambda c: F.array(f"{c}.x", f"{c}.y").alias("pos")
    objects = F.transform("objects", lambda o: F.struct(o["type"].alias("type"), F.array(o["px"], o["py"]).alias("pos"), o["color"].alias("color"), o["state"].alias("state")))
    scene = F.struct(
        F.struct(pos("g_pos"), F.col("g_dir").alias("dir"), F.col("g_carry").alias("carrying")).alias("agent"),
        F.struct(pos("g_front"), F.col("g_front.type").alias("type"), F.col("g_front.state").alias("state")).alias("front_cell"), objects.alias("objects"),
    )
    return gold_scenes(fx).select("uid", F.lit("B").alias("task"), "env_task", "group_id", F.when(F.col("scene_id") % 29 != 0, scene).alias("answer_json"))


def responses_b(fx: Fixtures) -> DataFrame:
    """Each judge's scenes; m1 leaves some out and some calls of m2 fail."""
    d = scene_responses(fx).withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(len(MODELS))])))
    ok = ~((F.col("m") == 2) & (F.col("scene_id") % 7 == 0))
    d = d.filter(~((F.col("m") == 1) & (F.col("scene_id") % 5 == 0)))
    return d.select(
        "uid", F.concat(F.lit("m"), "m").alias("model"), F.lit(0).cast("bigint").alias("attempt"), F.lit(0).cast("bigint").alias("ingest_seq"), "raw",
        F.col("raw").alias("pred"), ok.alias("ok"), F.when(~ok, F.lit("timeout")).alias("error"),
    )


@query("a4_scene_exam")
def _(fx):
    """Scenes through the scorer of all tasks: missing, failed and unreadable answers, and rows without gold."""
    gold = exam_b(fx).select("uid", "task", "env_task", F.lit(None).cast("string").alias("gold"), F.to_json("answer_json", {"ignoreNullFields": "false"}).alias("answer_json"))
    s = S.score(gold, responses_b(fx), MODELS)
    return s.select(
        "uid", "model", "failure", "parse_mode", "correct", F.round("score", 6).alias("score"), *[F.round(f"b_components.{c}", 6).alias(c) for c in COMPONENTS],
        "b_components.n_gold_objects", "b_components.n_pred_objects", F.array_join("failure_tags", ",").alias("failure_tags"),
    )


@query("p12_view_coords")
def _(fx):
    step = {0: (1, 0), 1: (0, 1), 2: (-1, 0), 3: (0, -1)}
    fxy = [F.coalesce(*[F.when(F.col("dir") == d, F.col(a) + v[i]) for d, v in step.items()]) for i, a in enumerate(("ax", "ay"))]
    heads = fx("scene_heads").withColumns({"fx": fxy[0], "fy": fxy[1]})
    # every tenth cell shows nothing; some encodings lack their last columns, some are missing
    width = F.when(F.col("scene_id") % 16 == 3, 4).otherwise(6)
    code = lambda x, y: F.pmod(F.col("scene_id") * (x + 2) + F.col("ax") + 3 * y, F.lit(10)).cast("int")
    cell = lambda x, y: F.array(code(x, y) % 5, F.floor(code(x, y) / 5).cast("int"), F.lit(0))
    grid = F.transform(F.sequence(F.lit(0), width), lambda x: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda y: cell(x, y)))
    heads = heads.withColumn("encoding", F.when(F.col("scene_id") % 29 != 5, grid))
    return C.to_view(heads, fx("scene_objects"), encoding="encoding")


@query("p13_canonical_scene")
def _(fx):
    s = C.scenes(fx("scene_heads"), fx("scene_objects"))
    return s.select("uid", F.size("objects").alias("n_objects"), F.array_join(C.object_keys(), ";").alias("objects"))


@query("p14_state_signature")
def _(fx):
    s = C.scenes(fx("scene_heads"), fx("scene_objects"))
    sig = C.state_signature(
        [F.col("ax"), F.col("ay")], F.col("dir"), [F.col("carry_type"), F.col("carry_color")], [F.col("front_type"), F.col("front_state")], C.object_keys()
    )
    return s.select("uid", sig.alias("signature"))


@query("x5_scene_json")
def _(fx):
    r = C.read_scene(scene_responses(fx), F.col("raw"))
    return r.select(
        "uid", "p_mode", "p_fence", F.col("p_pos.x").alias("px"), "p_dir", F.col("p_carry.type").alias("carry_type"),
        F.col("p_front.type").alias("front_type"), F.col("p_front.state").alias("front_state"), F.size("p_keys").alias("n_objects"),
        "p_has_carry",
    )


@query("a4_scene_score")
def _(fx):
    s = scored_scenes(fx)
    return s.select(
        "uid", *[F.round(c, 6).alias(c) for c in COMPONENTS], F.round("score", 6).alias("score"), "correct", "failure",
        F.array_join("failure_tags", ",").alias("failure_tags"), F.size("g_keys").alias("n_gold_objects"), F.size("p_keys").alias("n_pred_objects"),
    )


@query("a4_scene_score_custom")
def _(fx):
    s = scored_scenes(fx, weights=C.parse_weights("agent_pos=0.4, agent_dir=0.1,objects_jaccard=0.3,bad=x"), pass_mark=0.8)
    return s.groupBy("env_task").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.count(F.when(F.col("correct"), 1)).alias("n_correct")
    )


@query("u4_jaccard")
def _(fx):
    o = fx("scene_objects")
    key = lambda color: C.object_key(F.col("type"), F.col("px"), F.col("py"), color, F.col("state"))
    left = o.select("scene_id", key(F.col("color")).alias("item"))
    right = o.filter("NOT dropped_by_judge").select(
        "scene_id", key(F.when(F.col("recoloured_by_judge"), F.lit("grey")).otherwise(F.col("color"))).alias("item")
    )
    return C.jaccard_rows(left, right, "scene_id")


@query("w13_endpoint_picks")
def _(fx):
    p = C.endpoint_picks(C.scenes(fx("scene_heads"), fx("scene_objects")))
    name = lambda e: F.concat_ws("|", f"{e}.type", f"{e}.color", f"{e}.px", f"{e}.py").alias(e)
    return p.select("uid", name("cue"), name("a"), name("b"), "good_end")


@query("j8_repair")
def _(fx):
    exam = fx("scene_heads").select("uid", "env_task", (F.col("scene_id") % 20).alias("step"), F.col("front_type").alias("answer"))
    patch = fx("scene_heads").filter("scene_id % 10 = 0").select("uid", (F.col("scene_id") % 7).alias("step"), F.lit("repaired").alias("answer"))
    return J.repair(exam, patch, ["step", "answer"])


@query("j8_repair_counts")
def _(fx):
    exam = fx("scene_heads").select("uid", "env_task", F.col("front_type").alias("answer"))
    patch = fx("scene_heads").filter("scene_id % 10 = 0").select("uid", F.lit("repaired").alias("answer"))
    return J.repair(exam, patch, ["answer"]).groupBy("env_task", "provenance").agg(F.count("*").alias("n"))


@query("j9_patch_subset")
def _(fx):
    d = fx("exam_d").select("uid", "env_task", "variant", "n_frames", "image")
    rows = F.ceil((F.col("n_frames") + 1) / 4)
    out = J.patch_subset(
        d, F.col("env_task") == "memory",
        {"n_frames": F.col("n_frames") + 1, "hybrid_first_frame": F.lit(True), "layout_rows": rows, "image": F.regexp_replace("image", r"\.png$", "_hybrid.png")},
    )
    return out


@query("v14_asset_duplicates")
def _(fx):
    return G.asset_duplicates(fx("documents"), ["lang"], "text")


@query("v14_colliding_assets")
def _(fx):
    return G.colliding_assets(fx("documents"), ["lang"], "text", "doc_id")


@query("v16_payload_scan")
def _(fx):
    c = fx("conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    s = G.payload_scan(c, ["the", "reward", "que", "success", "terminated"])
    return s.select("conv_id", "turn", F.array_join("violations", ",").alias("violations"), "blocked", "error", "finish_reason")


@query("v16_term_automaton")
def _(fx):
    """Every turn against all longer words of the benchmark, in one pass a turn."""
    words = fx("benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).filter("length(w) >= 5")
    c = fx("conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    s = N.automaton_scan(c, N.term_list(words, "w"))
    return s.select("conv_id", "turn", F.size("violations").alias("n_terms"), F.array_join("violations", ",").alias("violations"), "blocked", "finish_reason")


@query("v13_exam_gates")
def _(fx):
    e = fx("exam_e").withColumn("selected_steps", F.array(F.lit(0), F.col("anchor_step"), F.col("query_step")))
    assets = fx("exam_e").filter("item_no % 101 <> 0").select(F.col("image").alias("path"))
    return G.exam_gates(e, assets, ["holding", "dropped", "key_red"])


@query("v18_filter_members")
def _(fx):
    e = fx("exam_d")
    return G.filter_members(
        e, {"variant": ["full", "nocue"], "subtask": ["BUILDING", "MACHINERY", "FURNITURE"]}, [{"env_task": "memory", "variant": "nocue"}]
    ).select("uid", "env_task", "variant", "subtask")


@query("x5_mode_report")
def _(fx):
    r = P.find_json_object(scene_responses(fx), F.col("raw"))
    return r.groupBy(F.col("j_mode").alias("parse_mode"), F.col("j_fence").alias("has_fence")).agg(F.count("*").alias("n"))
