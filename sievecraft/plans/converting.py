"""Conversions of samples and actions between corpora, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert as V
from ..session import table
from .boxes import ELEMENTS, elements
from .judging import STEPS, steps
from .registry import Registry

_registry = Registry()
query = _registry.query

# points on a scale of 1000 of the steps' shares
_P = "p as (select *, cast(round_even(px * 1000, 0) as int) as ix, cast(round_even(py * 1000, 0) as int) as iy, cast(round_even(gx2 * 1000, 0) as int) as jx, cast(round_even(gy2 * 1000, 0) as int) as jy from s)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.bround(F.col(c) * 1000, 0).cast("int")
    return steps(spark, sf_dir).withColumns({"ix": at("px"), "iy": at("py"), "jx": at("gx2"), "jy": at("gy2")})


_PLAIN = "'{\"action_type\": \"' || truth || '\"}'"
_TYPE = "when truth = 'input_text' then '{\"action_type\": \"type\", \"text\": \"' || true_text || '\"}'"


@query(f"""{STEPS}, {_P} select event_id, case when truth = 'swipe' then '{{"action_type": "scroll", "direction": "' || true_direction || '"}}' when truth in ('click', 'long_press') then '{{"action_type": "' || truth || '", "x": ' || ix || ', "y": ' || iy || '}}'
    {_TYPE} when truth = 'open_app' then '{{"action_type": "open_app", "app_name": "' || true_text || '"}}' when truth = 'status' then '{{"action_type": "status", "goal_status": "' || true_status || '"}}' else {_PLAIN} end as phone,
    case when truth = 'swipe' then '{{"action_type": "dual_point_gesture", "start": (' || ix || ',' || iy || '), "end": (' || jx || ',' || jy || ')}}' when truth in ('click', 'long_press') then '{{"action_type": "dual_point_gesture", "start": (' || ix || ',' || iy || '), "end": (' || ix || ',' || iy || ')}}' {_TYPE} else {_PLAIN} end as gesture,
    case when truth = 'swipe' then '{{"action_type": "swipe", "direction": "' || true_direction || '"}}' when truth = 'click' then '{{"action_type": "click", "coord_y": ' || iy || ', "coord_x": ' || ix || '}}' {_TYPE}
    when truth = 'navigate_home' then '{{"action_type": "press", "key": "home"}}' when truth = 'enter' then '{{"action_type": "press", "key": "enter"}}' when truth = 'status' then '{{"action_type": "stop", "task_state": "' || true_status || '"}}' else {_PLAIN} end as keyed,
    case when truth = 'swipe' then '{{"action_type": "scroll", "touch": (' || ix || ',' || iy || '), "lift": (' || jx || ',' || jy || ')}}' when truth = 'click' then '{{"action_type": "tap", "target": (' || ix || ',' || iy || ')}}' when truth = 'long_press' then '{{"action_type": "long_press", "x": ' || ix || ', "y": ' || iy || '}}' {_TYPE}
    when truth = 'navigate_home' then '{{"action_type": "press_home"}}' when truth = 'enter' then '{{"action_type": "press_enter"}}' when truth = 'status' then case when true_status = 'successful' then '{{"action_type": "status_complete"}}' else '{{"action_type": "status_impossible"}}' end else {_PLAIN} end as tapped from p""")
def native_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified actions in the spaces of four corpora."""
    c = F.col
    kind, at, to, text, status = c("truth"), (c("ix"), c("iy")), (c("jx"), c("jy")), c("true_text"), c("true_status")
    forms = {"phone": V.phone_action(kind, *at, text, c("true_direction"), status), "gesture": V.gesture_action(kind, at, to, text), "keyed": V.keyed_action(kind, *at, text, c("true_direction"), status), "tapped": V.tapped_action(kind, at, to, text, status)}
    return _points(spark, sf_dir).select("event_id", *[v.alias(k) for k, v in forms.items()])


_NATIVE = "case s % 10 when 0 then 'TAP' when 1 then 'type' when 2 then 'select_text' when 3 then 'copy' when 4 then 'press_enter' when 5 then 'press_back' when 6 then 'press_recent' when 7 then 'input' when 8 then 'scroll' else 'press_home' end"


@query(f"""{STEPS}, {_P}, n as (select *, {_NATIVE} as native from p) select event_id, case lower(native) when 'tap' then 'click' when 'type' then 'input_text' when 'input' then 'input_text' when 'select_text' then 'drag' when 'copy' then 'hotkey' when 'press_enter' then 'press_key' when 'press_back' then 'navigate_back'
    when 'press_recent' then 'navigate_recent' when 'press_home' then 'navigate_home' else native end as unified, case when abs(ix - jx) > abs(iy - jy) then case when ix > jx then 'right' else 'left' end else case when iy > jy then 'down' else 'up' end end as touched,
    case when s % 3 <> 0 then case when s % 3 - 1 > 0 then 'down' else 'down' end else case when user_id % 5 - 2 > 0 then 'right' else 'left' end end as offset_direction from n""")
def unified_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native kinds under their unified names, scrolls from touches and from offsets."""
    c = F.col
    return _points(spark, sf_dir).select("event_id", V.unified_kind(F.expr(_NATIVE)).alias("unified"), V.scroll_of_touch(c("ix"), c("iy"), c("jx"), c("jy")).alias("touched"), V.scroll_of_offsets(c("s") % 3, c("user_id") % 5 - 2).alias("offset_direction"))


_CENTRE = "cast(floor((x1 + x2) / 2) as int)", "cast(floor((y1 + y2) / 2) as int)"


@query(ELEMENTS + """, b as (select image, idx, kind, x1, y1, x2, y2, '(' || x1 || ',' || y1 || ')' as point, '(' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ')' as box from e)
select image, idx, '<|box_start|>' || point || ',' || point || '<|box_end|>' as marked_point, '<|box_start|>(' || x1 || ',' || y1 || '),(' || x2 || ',' || y2 || ')<|box_end|>' as marked_box,
    idx || ' <|object_ref_start|>' || 'item of ' || kind || '<|object_ref_end|> <|box_start|>(' || x1 || ',' || y1 || '),(' || x2 || ',' || y2 || ')<|box_end|>' as line,
    '{"point_2d": [' || cast(round_even(x1 / 1000.0::double * 1280, 0) as int) || ', ' || cast(round_even(y1 / 1000.0::double * 720, 0) as int) || ']}' as point_json,
    '{"bbox_2d": [' || cast(round_even(x1 / 1000.0::double * 1280, 0) as int) || ', ' || cast(round_even(y1 / 1000.0::double * 720, 0) as int) || ', ' || cast(round_even(x2 / 1000.0::double * 1280, 0) as int) || ', ' || cast(round_even(y2 / 1000.0::double * 720, 0) as int) || ']}' as box_json from b""")
def location_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and boxes in box markup, lists with object references, and JSON in pixels."""
    point = F.format_string("(%d,%d)", "x1", "y1")
    box = F.format_string("(%d,%d,%d,%d)", "x1", "y1", "x2", "y2")
    line = F.concat_ws(" ", F.col("idx").cast("string"), F.concat(F.lit("item of "), F.col("kind")), box)
    size = (F.lit(1280.0), F.lit(720.0))
    return elements(spark, sf_dir).select("image", "idx", V.boxed(point).alias("marked_point"), V.boxed(box).alias("marked_box"), V.listed(line).alias("line"), V.pixel_json(point, *size).alias("point_json"), V.pixel_json(box, *size).alias("box_json"))


# task, query and answer of each sample; places are named in braces
_MAKERS = {
    "elemgnd": ("Where is {text}? (with point)", "{point}"), "elemref": ("Please generate a brief description for the element at {point}", "{text}"), "elemclass": ("Classify the type of the element located at {point} (with point)?", "{kind}"),
    "textloc": ("Locate the text \"{text}\" (with point).", "{point}"), "ocr": ("Recognize the text at {box}.", "{text}"), "intentgnd": ("I want to click on {text}. Please locate the target element I should interact with. (with point)", "{point}"),
}
_FILLED = "replace(replace(replace(replace('{0}', '{{text}}', 'item of ' || kind), '{{point}}', '(' || x1 || ',' || y1 || ')'), '{{box}}', '(' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ')'), '{{kind}}', kind)"


@query(ELEMENTS + " union all ".join(f"select '{k}_' || image || '_' || idx as id, 'human' as role1, '<image>' || chr(10) || {_FILLED.format(q)} as value1, 'gpt' as role2, {_FILLED.format(a)} as value2 from e" for k, (q, a) in _MAKERS.items()))
def made_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element as samples of six tasks: whole conversations from templates, in one pass over the elements."""
    places = {"text": F.concat(F.lit("item of "), F.col("kind")), "point": F.format_string("(%d,%d)", "x1", "y1"), "box": F.format_string("(%d,%d,%d,%d)", "x1", "y1", "x2", "y2"), "kind": F.col("kind")}

    def filled(template: str):
        out = F.lit(template)
        for k, v in places.items():
            out = F.replace(out, F.lit("{" + k + "}"), v)
        return out

    made = F.array(*[F.struct(F.concat_ws("_", F.lit(k), F.col("image").cast("string"), F.col("idx").cast("string")).alias("id"), V.sample(q, filled(a), **places).alias("turns")) for k, (q, a) in _MAKERS.items()])
    rows = elements(spark, sf_dir).select(F.explode(made).alias("m"))
    return rows.select("m.id", F.col("m.turns")[0]["from"].alias("role1"), F.col("m.turns")[0]["value"].alias("value1"), F.col("m.turns")[1]["from"].alias("role2"), F.col("m.turns")[1]["value"].alias("value2"))


_CORNER = "case when x1 < 100 and y1 < 100 then ' at the top left corner' when x1 > 900 and y1 < 100 then ' at the top right corner' when x1 < 100 and y1 > 900 then ' in the bottom left corner' when x1 > 900 and y1 > 900 then ' at the bottom right corner' when x1 > 400 and x1 < 600 and y1 > 400 and y1 < 600 then ' in the center of the screen' else '' end"


@query(ELEMENTS + f"""select image, idx, 'I want to ' || case when kind = 'A' then 'type into' else 'click on' end || replace(' the element' || {_CORNER} || ' that ' || case when idx % 2 = 0 then 'serves as a ' || kind else 'opens ' || kind end, 'the element that serves as ', '') || '.' as intent,
    'Find: This element ' || case when idx % 2 = 0 then 'serves as a ' || kind else 'opens ' || kind end || '.' as described from e""")
def intents_of_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of what elements do, as intents and as another prompt."""
    what = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("serves as a "), F.col("kind"))).otherwise(F.concat(F.lit("opens "), F.col("kind")))
    text = F.concat(F.lit("This element "), what, F.lit("."))
    role = F.when(F.col("kind") == "A", "textbox").otherwise("button")
    return elements(spark, sf_dir).select("image", "idx", V.intent_of(text, role, F.col("x1"), F.col("y1")).alias("intent"), V.described(F.concat(F.lit("Locate it. "), text), "Find: {description}").alias("described"))


_TRACE = "case p_partkey % 6 when 0 then 'CLICK' when 1 then 'HOVER' when 2 then 'ENTER' when 3 then 'TYPE: ' || p_name || ' ' when 4 then 'SELECT: ' || p_brand else 'DRAG' end"


@query(f"""with t as (select *, {_TRACE} as act, '[' || p_type || ']  ' || p_name as element from part) select p_partkey, case when p_partkey % 6 = 3 then 'type "' || p_name || '" into the ' when p_partkey % 6 = 2 then 'press enter on ' when p_partkey % 6 = 0 then 'click on ' when p_partkey % 6 = 1 then 'hover over ' when p_partkey % 6 = 4 then 'select ' || p_brand || ' in the ' end
    || '[' || p_type || '] ' || p_name as step, '[step] ' || p_name || ' first then done' as thought from t""")
def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded traces as sentences, and thoughts without the names of their phases."""
    line = F.concat(F.lit("["), F.col("p_type"), F.lit("]  "), F.col("p_name"), F.lit(" -> "), F.expr(_TRACE))
    thought = F.concat(F.lit("**[step]** "), F.col("p_name"), F.lit(" (Planning) first PLANNING: then (reflection and planning) done"))
    return table(spark, sf_dir, "part").select("p_partkey", V.step_of_trace(line).alias("step"), F.replace(V.without_phases(thought), F.lit("then  "), F.lit("then ")).alias("thought"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
