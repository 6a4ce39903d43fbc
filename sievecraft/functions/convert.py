"""Samples and action texts between corpora's forms. Conversations are arrays of (role, content)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

# fixed values: markup of boxes and object references
BOX_START, BOX_END = "<|box_start|>", "<|box_end|>"
REF_START, REF_END = "<|object_ref_start|>", "<|object_ref_end|>"


def _json(kind: str, **fields: Column) -> Column:
    """Action text of a kind and its fields; text fields are quoted by the caller."""
    parts = [F.lit(f'{{"action_type": "{kind}"')]
    for k, v in fields.items():
        parts += [F.lit(f', "{k}": '), v.cast("string")]
    return F.concat(*parts, F.lit("}"))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _pair(x: Column, y: Column) -> Column:
    return F.concat(F.lit("("), x.cast("string"), F.lit(","), y.cast("string"), F.lit(")"))


def phone_action(kind: Column, x: Column, y: Column, text: Column, direction: Column, status: Column) -> Column:
    """A unified action in the phone corpus' own space; other kinds have no fields."""
    return (
        F.when(kind == "swipe", _json("scroll", direction=quoted(direction)))
        .when(kind == "click", _json("click", x=x, y=y))
        .when(kind == "long_press", _json("long_press", x=x, y=y))
        .when(kind == "input_text", _json("type", text=quoted(text)))
        .when(kind == "open_app", _json("open_app", app_name=quoted(text)))
        .when(kind == "status", _json("status", goal_status=quoted(status)))
        .otherwise(F.concat(F.lit('{"action_type": "'), kind, F.lit('"}')))
    )


def gesture_action(kind: Column, start: tuple[Column, Column], end: tuple[Column, Column], text: Column) -> Column:
    """Clicks and swipes as gestures with a start and an end."""
    return (
        F.when(kind == "swipe", _json("dual_point_gesture", start=_pair(*start), end=_pair(*end)))
        .when(kind.isin("click", "long_press"), _json("dual_point_gesture", start=_pair(*start), end=_pair(*start)))
        .when(kind == "input_text", _json("type", text=quoted(text)))
        .otherwise(F.concat(F.lit('{"action_type": "'), kind, F.lit('"}')))
    )


def keyed_action(kind: Column, x: Column, y: Column, text: Column, direction: Column, status: Column) -> Column:
    """Keys as one action `press`, the end of a task as `stop`."""
    key = F.when(kind == "navigate_back", "back").when(kind == "navigate_home", "home").when(kind == "enter", "enter")
    return (
        F.when(kind == "swipe", _json("swipe", direction=quoted(direction)))
        .when(kind == "click", _json("click", coord_y=y, coord_x=x))
        .when(kind == "input_text", _json("type", text=quoted(text)))
        .when(key.isNotNull(), _json("press", key=quoted(key)))
        .when(kind == "status", _json("stop", task_state=quoted(F.when(status == "successful", "successful").otherwise("infeasible"))))
        .otherwise(F.concat(F.lit('{"action_type": "'), kind, F.lit('"}')))
    )


def tapped_action(kind: Column, start: tuple[Column, Column], end: tuple[Column, Column], text: Column, status: Column) -> Column:
    """Taps and touch-to-lift scrolls; each key and each end of a task is a kind of its own."""
    name = F.when(kind == "navigate_back", "press_back").when(kind == "navigate_home", "press_home").when(kind == "enter", "press_enter")
    name = name.when(kind == "status", F.when(status == "successful", "status_complete").otherwise("status_impossible")).otherwise(kind)
    return (
        F.when(kind == "swipe", _json("scroll", touch=_pair(*start), lift=_pair(*end)))
        .when(kind == "click", _json("tap", target=_pair(*start)))
        .when(kind == "long_press", _json("long_press", x=start[0], y=start[1]))
        .when(kind == "input_text", _json("type", text=quoted(text)))
        .otherwise(F.concat(F.lit('{"action_type": "'), name, F.lit('"}')))
    )


def unified_kind(kind: Column) -> Column:
    """A corpus' own kind under the unified name."""
    names = {"tap": "click", "input": "input_text", "type": "input_text", "select_text": "drag", "copy": "hotkey", "press_enter": "press_key", "press_back": "navigate_back", "press_home": "navigate_home", "press_recent": "navigate_recent"}
    k = F.lower(kind)
    out = F
    for a, b in names.items():
        out = out.when(k == a, b)
    return out.otherwise(kind)


def scroll_of_touch(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """Where the content goes when a finger moves from touch to lift: against the move; on equal parts vertical."""
    across = F.when(x > x2, "right").otherwise("left")
    return F.when(F.abs(x - x2) > F.abs(y - y2), across).otherwise(F.when(y > y2, "down").otherwise("up"))


def scroll_of_offsets(down: Column, right: Column) -> Column:
    return F.when(down != 0, F.when(down > 0, "down").otherwise("up")).otherwise(F.when(right > 0, "right").otherwise("left"))


def boxed(location: Column) -> Column:
    """A point or a box in brackets, in box markup; a point becomes a box of no size."""
    n = F.regexp_extract_all(location, F.lit(r"\d+"), 0)
    point = F.concat(F.lit(BOX_START), location, F.lit(","), location, F.lit(BOX_END))
    corners = F.concat(F.lit(BOX_START + "("), n[0], F.lit(","), n[1], F.lit("),("), F.get(n, F.lit(2)), F.lit(","), F.get(n, F.lit(3)), F.lit(")" + BOX_END))
    return F.when(F.size(n) == 2, point).otherwise(corners)


def listed(answer: Column) -> Column:
    """Lines `number words box` with the words as an object reference and the box in box markup."""
    line = lambda s: F.concat(F.regexp_extract(s, r"^(\S+) ", 1), F.lit(f" {REF_START}"), F.regexp_extract(s, r"^\S+ (.*) \S+$", 1), F.lit(f"{REF_END} "), boxed(F.regexp_extract(s, r" (\S+)$", 1)))
    return F.array_join(F.transform(F.split(answer, "\n"), line), "\n")


def pixel_json(location: Column, width: Column, height: Column, scale: int = G.SCALE) -> Column:
    """A point or box on a scale as JSON in the picture's pixels."""
    n = F.transform(F.regexp_extract_all(location, F.lit(r"\d+"), 0), lambda x: x.cast("int"))
    at = lambda i, extent: G.denormalise(F.get(n, F.lit(i)), extent, scale).cast("string")
    box = F.concat(F.lit('{"bbox_2d": ['), F.concat_ws(", ", at(0, width), at(1, height), at(2, width), at(3, height)), F.lit("]}"))
    return F.when(F.size(n) == 2, F.concat(F.lit('{"point_2d": ['), F.concat_ws(", ", at(0, width), at(1, height)), F.lit("]}"))).otherwise(box)


def sample(query: str, answer: Column, **fields: Column) -> Column:
    """A two-turn conversation from a template with {name} places."""
    text = F.lit(f"<image>\n{query}")
    for k, v in fields.items():
        text = F.replace(text, F.lit("{" + k + "}"), v)
    return F.array(F.struct(F.lit("human").alias("from"), text.alias("value")), F.struct(F.lit("gpt").alias("from"), answer.alias("value")))


def intent_of(description: Column, role: Column, x: Column, y: Column) -> Column:
    """`This element ...` as an intent with the corner where the element lies."""
    corner = (
        F.when((x < 100) & (y < 100), " at the top left corner").when((x > 900) & (y < 100), " at the top right corner").when((x < 100) & (y > 900), " in the bottom left corner")
        .when((x > 900) & (y > 900), " at the bottom right corner").when((x > 400) & (x < 600) & (y > 400) & (y < 600), " in the center of the screen").otherwise("")
    )
    what = F.btrim(F.get(F.split(description, "his element "), F.lit(1)), F.lit(" ."))
    verb = F.when(role == "textbox", "type into").otherwise("click on")
    return F.concat(F.lit("I want to "), verb, F.replace(F.concat(F.lit(" the element"), corner, F.lit(" that "), what), F.lit("the element that serves as "), F.lit("")), F.lit("."))


def described(query: Column, template: str) -> Column:
    """The part from `This element` on, put into a template's {description}."""
    at = F.instr(query, "This element")
    return F.replace(F.lit(template), F.lit("{description}"), F.when(at > 0, F.substr(query, at)).otherwise(F.right(query, F.lit(1))))


def step_of_trace(line: Column) -> Column:
    """A recorded `element -> ACTION` as a sentence; null for an action that isn't known."""
    parts = F.split(line, "->")
    element, act = F.btrim(F.replace(parts[0], F.lit("  "), F.lit(" "))), F.btrim(F.get(parts, F.lit(1)))
    after = F.substr(act, F.instr(act, ":") + 1)
    typed = F.replace(F.replace(F.btrim(after, F.lit(" \n\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return (
        F.when(F.contains(act, F.lit("TYPE:")), F.concat(F.lit('type "'), typed, F.lit('" into the '), element))
        .when(act == "ENTER", F.concat(F.lit("press enter on "), element))
        .when(act == "CLICK", F.concat(F.lit("click on "), element))
        .when(act == "HOVER", F.concat(F.lit("hover over "), element))
        .when(F.contains(act, F.lit("SELECT:")), F.concat(F.lit("select "), F.btrim(after), F.lit(" in the "), element))
    )


def without_phases(text: Column) -> Column:
    """Reasoning without the names of its phases and without bold marks."""
    # fixed values: the phases that models name
    tags = "planning|planung|planning again|reflection|causality|causal|cause|common sense|dividing-and-conquering|dividing and conquering|progress check|divide-and-conquer|execution|summarization|summary|exploration|backtracking|backtrack|reflecting|recognition|backtracking to planning|reflection and planning"
    heads = "Planning|Reflection|Divide-and-Conquer|nCausality|Backtracking|Summarization"
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("**"), F.lit("")), rf"(?i) \((?:{tags})\)", ""), rf"(?i)(?:{heads}): ", "")
