"""Predicted actions judged by five evaluations: `events` rows are steps, with truth and prediction from their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching as A
from ..operators import metrics as M
from ..session import table
from .registry import Registry

_registry = Registry()
query = _registry.query


def _pick(index: str, options: list[str]) -> str:
    return f"case {index} " + " ".join(f"when {i} then {v}" for i, v in enumerate(options)) + " end"


def _names(*names: str) -> list[str]:
    return [f"'{n}'" for n in names]


# expressions that Spark and other engines read alike
_FIRST = {
    "event_id": "event_id", "user_id": "user_id", "m": "event_id % 8", "s": "cast(floor(event_id / 8) as bigint)",
    "px": "cast(user_id * 37 % 1000 as double) / 1000", "py": "cast(event_id * 91 % 1000 as double) / 1000",
}
_SECOND = {
    "event_id": "event_id", "user_id": "user_id", "px": "px", "py": "py", "s": "s", "m": "m",
    "truth": _pick("m", _names("click", "long_press", "input_text", "swipe", "status", "open_app", "enter", "navigate_home")),
    "guess": "case when s % 7 = 0 then 'scroll' else " + _pick("m", [*_names("click", "long_press"), _pick("s % 2", _names("type", "input_text")), _pick("s % 2", _names("scroll", "swipe")), _pick("s % 3", _names("terminate", "answer", "status")), _pick("s % 2", _names("open", "open_app")), _pick("s % 2", _names("press_key", "enter")), _pick("s % 2", _names("system_button", "navigate_home"))]) + " end",
    "web_truth": _pick("m", _names("click", "hover", "input_text", "swipe", "status", "drag", "hotkey", "scroll")),
    "web_guess": "case when s % 7 = 0 then 'scroll' else " + _pick("m", _names("click", "hover", "input_text", "swipe", "status", "drag", "hotkey", "scroll")) + " end",
    "desk_truth": _pick("m", _names("click", "double_click", "input_text", "scroll", "press_key", "hotkey", "right_click", "wait")),
    "desk_guess": "case when s % 7 = 0 then 'wait' else " + _pick("m", _names("click", "double_click", "input_text", "scroll", "press_key", "hotkey", "right_click", "wait")) + " end",
    "page_truth": _pick("m % 4", _names("click", "input_text", "select", "enter")),
    "page_guess": "case when s % 7 = 0 then 'click' else " + _pick("m % 4", [_pick("s % 2", _names("click", "hover")), *_names("input_text", "select", "enter")]) + " end",
    "x1": "case when s % 5 = 0 then null else greatest(px - cast(s % 200 as double) / 1000, 0.0) end", "y1": "case when s % 5 = 0 then null else greatest(py - cast(s % 150 as double) / 1000, 0.0) end",
    "x2": "case when s % 5 = 0 then null else least(px + cast(s % 90 - 20 as double) / 1000, 1.0) end", "y2": "case when s % 5 = 0 then null else least(py + cast(s % 70 - 10 as double) / 1000, 1.0) end",
    "tx": "px + cast(s % 40 - 20 as double) / 100", "ty": "py + cast(s % 30 - 15 as double) / 100",
    "gx2": "case when s % 3 = 0 then px else px + cast(s % 50 - 10 as double) / 100 end", "gy2": "case when s % 4 = 0 then py else py + cast(s % 37 - 12 as double) / 100 end",
    "true_text": _pick("s % 3", _names("The red button", "search for cats", " Open, the settings! ")), "text": _pick("s % 4", _names("red button", "search cats now", "open settings task complete", "the")),
    "true_direction": _pick("user_id % 4", _names("up", "down", "left", "right")), "direction": _pick("s % 4", _names("down", "up", "left", "right")),
    "true_status": _pick("user_id % 2", _names("successful", "infeasible")), "status": _pick("s % 2", _names("successful", "infeasible")),
    "true_answer": _pick("user_id % 3", _names("Task complete.", "\"Blue; sky\"", "it is 42")), "answer": _pick("s % 3", _names("blue sky!", "42", "no")),
    "true_app": _pick("user_id % 3", _names("maps", "mail", "music")), "app": _pick("s % 4", [*_names("maps", "mail", "music"), "null"]),
    "true_key": _pick("user_id % 3", _names("ctrl+c", "Enter", "alt-tab")), "key": _pick("s % 4", _names("ctrl_c", "enter", "ALT + tab", "Enter")), "button": _pick("s % 2", _names("Home", "back")),
}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{v} as {k}" for k, v in columns.items()]


STEPS = f"with s0 as (select {', '.join(_select(_FIRST))} from events), s as (select {', '.join(_select(_SECOND))} from s0)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(_FIRST)).selectExpr(*_select(_SECOND))


_BOX = ("x1", "y1", "x2", "y2")


def _box() -> tuple:
    return tuple(F.col(c) for c in _BOX)


def _truth(kind: str) -> A.Action:
    c = F.col
    return A.Action(c(kind), c("tx"), c("ty"), c("gx2"), c("gy2"), c("true_text"), c("true_direction"), c("true_status"), c("true_answer"), c("true_app"), c("true_key"))


def _guess(kind: str) -> A.Action:
    c = F.col
    return A.Action(c(kind), c("px"), c("py"), c("gx2"), c("gy2"), c("text"), c("direction"), c("status"), c("answer"), c("app"), c("key"), c("button"))


def _words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+'), lambda w: w <> '')"


def _f1(a: str, b: str) -> str:
    a, b = _words(a), _words(b)
    both = f"coalesce(list_sum(list_transform(list_distinct({a}), lambda v: least(len(list_filter({a}, lambda u: u = v)), len(list_filter({b}, lambda u: u = v))))), 0)"
    return f"(case when len({a}) + len({b}) = 0 then 1.0::double else 2.0::double * {both} / (len({a}) + len({b})) end)"


_INSIDE = "(x1 <= px and px <= x2 and y1 <= py and py <= y2)"
_FAR = "sqrt((tx - px) * (tx - px) + (ty - py) * (ty - py))"


def _flags(kind: str, same: str, pointing: str, element: str, others: dict[str, str], rest: str) -> str:
    good = f"case when {kind} in ({pointing}) then {element} " + " ".join(f"when {kind} = '{k}' then {v}" for k, v in others.items()) + f" else {rest} end"
    return f"""coalesce({same}, false) as type_match, coalesce({same} and {kind} in ({pointing}), false) as need_element, coalesce({same} and {kind} in ({pointing}) and {element}, false) as element_match, coalesce({same} and coalesce({good}, false), false) as action_match"""


_PHONE_KIND = "case when guess = 'open' then 'open_app' when guess = 'type' then 'input_text' when guess = 'answer' then 'status' when guess = 'system_button' then case lower(button) when 'home' then 'navigate_home' when 'back' then 'navigate_back' else guess end else guess end"
_PHONE_SAME = f"(truth = {_PHONE_KIND} or (truth = 'enter' and guess = 'press_key' and lower(key) = 'enter') or (truth = 'status' and guess = 'terminate') or (truth = 'swipe' and guess = 'scroll'))"
_PHONE = _flags("truth", _PHONE_SAME, "'click', 'long_press'", _INSIDE, {
    "input_text": f"{_f1('true_text', 'text')} > 0.5", "swipe": "case true_direction when 'up' then 'down' when 'down' then 'up' when 'left' then 'right' else 'left' end = direction",
    "status": "true_status = case when guess = 'answer' then case when contains(text, 'complete') then 'successful' else 'infeasible' end else status end", "open_app": "true_app = coalesce(app, text)",
}, "true")


@query(f"{STEPS} select event_id, truth, {_PHONE} from s")
def phone_step_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps on phones, with other names for the same action."""
    return steps(spark, sf_dir).select("event_id", "truth", A.phone_match(_truth("truth"), _guess("guess"), _box()).alias("r")).select("event_id", "truth", "r.*")


@query(f"""{STEPS}, r as (select truth, {_PHONE} from s) select coalesce(truth, 'all') as truth, count(*) as n, count(*) filter (where type_match) as types, count(*) filter (where need_element) as pointing,
    count(*) filter (where element_match) as elements, count(*) filter (where action_match) as steps, round(count(*) filter (where element_match)::double / nullif(count(*) filter (where need_element), 0), 6) as element_accuracy,
    round(count(*) filter (where action_match)::double / count(*), 6) as step_accuracy from r group by rollup(truth)""")
def phone_step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step, type and element accuracy by action and over all; elements count only where the type was right."""
    r = phone_step_match(spark, sf_dir).rollup("truth").agg(F.count("*").alias("n"), *[M.count_if(F.col(c)).alias(k) for k, c in (("types", "type_match"), ("pointing", "need_element"), ("elements", "element_match"), ("steps", "action_match"))])
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return r.select(F.coalesce("truth", F.lit("all")).alias("truth"), "n", "types", "pointing", "elements", "steps", share("elements", "pointing").alias("element_accuracy"), share("steps", "n").alias("step_accuracy"))


def _clean(c: str) -> str:
    return f"translate(trim(lower(coalesce({c}, '')), ' .?!'), '\"'',;', '')"


_UPRIGHT = "case when px = gx2 then 0.01::double else 0.0::double end"
_LEVEL = "case when py = gy2 and px <> gx2 then 0.01::double else 0.0::double end"
_ASKED = ("least(tx, gx2)", "least(ty, gy2)", "greatest(tx, gx2)", "greatest(ty, gy2)")
_SPAN = (f"(px - {_UPRIGHT})", f"(py - {_LEVEL})", f"(gx2 + {_UPRIGHT})", f"(gy2 + {_LEVEL})")
_SHARED = f"(greatest(least({_ASKED[2]}, {_SPAN[2]}) - greatest({_ASKED[0]}, {_SPAN[0]}), 0) * greatest(least({_ASKED[3]}, {_SPAN[3]}) - greatest({_ASKED[1]}, {_SPAN[1]}), 0))"
_AREAS = " + ".join(f"({b[2]} - {b[0]}) * ({b[3]} - {b[1]})" for b in (_ASKED, _SPAN))
_WEB = _flags("web_truth", "web_truth = web_guess", "'click', 'hover'", f"(case when x1 is not null then {_INSIDE} else {_FAR} < 0.14 end)", {
    "input_text": f"{_f1('true_text', 'text')} > 0.5", "scroll": "true_direction = direction", "swipe": "true_direction = direction",
    "status": f"(true_status = status and ({_clean('true_answer')} in ('', 'task complete', 'task impossible') or {_f1(_clean('true_answer'), _clean('answer'))} > 0.5))",
    "drag": f"coalesce({_SHARED} / nullif({_AREAS} - {_SHARED}, 0), 0) > 0.5", "hotkey": "translate(true_key, '_-+', '') = translate(key, '_-+', '')",
}, "false")


@query(f"{STEPS} select event_id, web_truth, {_WEB} from s")
def web_step_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps on web pages: boxes or centres, drags by overlap, answers by F1."""
    return steps(spark, sf_dir).select("event_id", "web_truth", A.web_match(_truth("web_truth"), _guess("web_guess"), _box()).alias("r")).select("event_id", "web_truth", "r.*")


_GROWN = "(x1 - 0.14 <= px and px <= x2 + 0.14 and y1 - 0.14 <= py and py <= y2 + 0.14)"
_DESK = _flags("desk_truth", "desk_truth = desk_guess", "'click', 'double_click', 'right_click', 'hover'", f"(case when x1 is not null then {_GROWN} else {_FAR} <= 0.14 end)", {
    "input_text": "(contains(trim(lower(true_text)), trim(lower(text))) or contains(trim(lower(text)), trim(lower(true_text))))", "scroll": "true_direction = direction",
    "press_key": "true_key = key", "hotkey": "lower(translate(true_key, '+-', '')) = lower(translate(key, '+- ', ''))",
}, "true")


@query(f"{STEPS} select event_id, desk_truth, {_DESK} from s")
def desktop_step_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps on desktops: boxes grown by a share of the screen."""
    return steps(spark, sf_dir).select("event_id", "desk_truth", A.desktop_match(_truth("desk_truth"), _guess("desk_guess"), _box()).alias("r")).select("event_id", "desk_truth", "r.*")


_KIND = "case when page_guess = 'hover' then 'click' else page_guess end"


def _with_value(k: str, v: str) -> str:
    return f"case when {k} in ('input_text', 'select') then {k} || ' ' || lower(coalesce({v}, '')) else {k} end"


@query(f"""{STEPS}, r as (select event_id, user_id, {_KIND} = page_truth as operation_match, case when {_KIND} = 'enter' then {_KIND} = page_truth else coalesce({_INSIDE}, false) end as element_match,
    round(case when {_KIND} = 'enter' then 1.0::double else {_f1(_with_value(_KIND, 'text'), _with_value('page_truth', 'true_text'))} end, 6) as operation_f1 from s)
select user_id, count(*) as steps, count(*) filter (where operation_match) as operations, count(*) filter (where element_match) as elements, round(avg(operation_f1), 6) as f1, count(*) filter (where element_match and operation_f1 = 1) as successes,
    bool_and(element_match and operation_f1 = 1) as episode_success from r group by user_id""")
def browser_episode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps in a browser by element and operation F1; an episode succeeds if all its steps do."""
    box = tuple(F.coalesce(b, F.lit(9.0)) for b in _box())  # no box: nothing is inside
    r = steps(spark, sf_dir).select("user_id", A.element_step(_truth("page_truth"), F.col("page_truth"), _guess("page_guess"), box).alias("r")).select("user_id", "r.*")
    return r.groupBy("user_id").agg(F.count("*").alias("steps"), M.count_if(F.col("operation_match")).alias("operations"), M.count_if(F.col("element_match")).alias("elements"), F.round(F.avg("operation_f1"), 6).alias("f1"), M.count_if(F.col("step_success")).alias("successes"), F.bool_and("step_success").alias("episode_success"))


_TAP = "sqrt(({0} - {2}) * ({0} - {2}) + ({1} - {3}) * ({1} - {3})) <= 0.04"
_TRUE_TAP, _GUESS_TAP = _TAP.format("tx", "ty", "gx2", "gy2"), _TAP.format("px", "py", "gx2", "gy2")
_GROW = ("greatest(x1 - (x2 - x1) * 0.2, 0)", "greatest(y1 - (y2 - y1) * 0.2, 0)", "least(x2 + (x2 - x1) * 0.2, 1)", "least(y2 + (y2 - y1) * 0.2, 1)")
_IN = "({0} <= {4} and {4} <= {2} and {1} <= {5} and {5} <= {3})"


@query(f"""{STEPS}, g as (select event_id, case when user_id % 9 = 0 then 'type' else 'gesture' end as a, case when s % 9 = 0 then 'type' else 'gesture' end as b, * exclude (event_id) from s)
select event_id, case when a <> 'gesture' or b <> 'gesture' then a = b when {_TRUE_TAP} and {_GUESS_TAP} then coalesce({_IN.format(*_GROW, 'tx', 'ty')} and {_IN.format(*_GROW, 'px', 'py')}, false) or {_FAR} <= 0.14
    when {_TRUE_TAP} or {_GUESS_TAP} then false else (abs(gy2 - ty) >= abs(gx2 - tx)) = (abs(gy2 - py) >= abs(gx2 - px)) end as same from g""")
def gesture_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taps and drags by where they lie and how they run."""
    g = steps(spark, sf_dir).selectExpr("*", "case when user_id % 9 = 0 then 'type' else 'gesture' end as a", "case when s % 9 = 0 then 'type' else 'gesture' end as b")
    boxes = F.when(F.col("x1").isNotNull(), F.array(F.struct(*_BOX))).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    return g.select("event_id", A.gesture_match(_truth("a"), _guess("b"), boxes).alias("same"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
