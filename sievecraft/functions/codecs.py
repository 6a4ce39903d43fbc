"""Forms in which models and scripts write actions, locations and histories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# fixed values: calls of recorded scripts and the actions they stand for
SCRIPT_ACTIONS = {
    "click": "click", "rightClick": "right_click", "doubleClick": "double_click", "dragTo": "drag", "moveTo": "hover",
    "write": "input_text", "press": "press_key", "hotkey": "hotkey", "scroll": "scroll", "hscroll": "scroll",
}


def mapped(key: Column, names: dict[str, str], otherwise: Column | None = None) -> Column:
    """A small fixed table as an expression: no join, no shuffle."""
    out = F
    for k, v in names.items():
        out = out.when(key == k, v)
    return out.otherwise(key if otherwise is None else otherwise)


def script_action(line: Column) -> Column:
    """A line `pyautogui.<call>(...)` as a struct: kind, x, y, text, direction; kind is null for other lines."""
    call = F.regexp_extract(line, r"^pyautogui\.(\w+)\(", 1)
    numbers = T.integers(F.regexp_extract(line, r"\(([^\"']*)\)\s*$", 1))
    kind = mapped(call, SCRIPT_ACTIONS, F.lit(None))
    quoted = F.regexp_extract_all(line, F.lit(r"[\"']([^\"']*)[\"']"), 1)
    amount = F.get(numbers, F.lit(0))
    turned = F.when(call == "scroll", F.when(amount > 0, "up").otherwise("down")).when(call == "hscroll", F.when(amount > 0, "right").otherwise("left"))
    at = F.size(numbers) >= 2
    return F.struct(kind.alias("kind"), F.when(at, amount).alias("x"), F.when(at, F.get(numbers, F.lit(1))).alias("y"), F.when(F.size(quoted) > 0, F.array_join(quoted, "+")).alias("text"), turned.alias("direction"))


def loc_tokens(text: Column) -> Column:
    """Numbers as location tokens."""
    return F.regexp_replace(text, r"\b(\d+)\b", "<loc_$1>")


def from_loc_tokens(text: Column) -> Column:
    return F.regexp_replace(text, r"<loc_(\d+)>", "$1")


def swipe_points(direction: Column, centre: int = 500, reach: int = 300) -> tuple[Column, Column, Column, Column]:
    """Start and end of a swipe about the centre."""
    dx = F.when(direction == "right", reach).when(direction == "left", -reach).otherwise(0)
    dy = F.when(direction == "down", reach).when(direction == "up", -reach).otherwise(0)
    return tuple(x.cast("int") for x in (centre - dx, centre - dy, centre + dx, centre + dy))


def scroll_wording(text: Column) -> Column:
    """`Scroll up` and `swipe UP` alike."""
    return F.regexp_replace(text, r"(?i)(scroll|swipe)\s+(up|down|left|right)", "scroll the page $2")


def last_steps(history: Column, most: int) -> Column:
    """A numbered history `Step 1. a Step 2. b`, of which the last so many steps stay."""
    steps = F.filter(F.split(history, r" ?(?=Step \d+\. )"), lambda s: s != "")
    return F.array_join(F.slice(steps, F.greatest(F.size(steps) - most + 1, F.lit(1)), F.lit(most)), " ")


def hotkey(text: Column) -> Column:
    """Keys of a combination by lower case, without blanks and in order."""
    return F.array_join(F.array_sort(F.split(F.lower(F.translate(text, " ", "")), r"\+")), "+")


def bag_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of words, each occurrence counted; two empty ones give 1."""
    def times(words: Column, w: Column) -> Column:
        return F.size(F.filter(words, lambda x: x == w))

    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(2.0 * both / F.greatest(F.size(a) + F.size(b), F.lit(1)))
