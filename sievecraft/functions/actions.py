"""Actions of agents: text forms, conversions, equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: a scroll moves the content against the swipe
OPPOSITE = {"up": "down", "down": "up", "left": "right", "right": "left"}


def as_json(text: Column) -> Column:
    """Action text with tuples as JSON text; nothing is ever evaluated."""
    return F.regexp_replace(text, r"\(([-0-9., ]+)\)", "[$1]")


def parsed(text: Column) -> Column:
    """The action as a variant; null if it is none."""
    return F.try_parse_json(as_json(text))


def field(text: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(parsed(text), path, kind)


def action_type(text: Column) -> Column:
    return F.regexp_extract(text, r'"action_type":\s*"([^"]+)"', 1)


def opposite(direction: Column) -> Column:
    return F.coalesce(*[F.when(direction == k, v) for k, v in OPPOSITE.items()], direction)


def canonical(kind: Column) -> Column:
    """One name for what matchers treat alike."""
    return F.when(kind == "scroll", "swipe").when(kind == "terminate", "status").when(kind == "press_enter", "enter").otherwise(kind)


def texts_match(a: Column, b: Column) -> Column:
    """Equal, or one within the other; an empty one is within any."""
    return (a == b) | F.contains(a, b) | F.contains(b, a)


def point_text(x: Column, y: Column, style: str = "plain") -> Column:
    """Location markup: plain, box (a box of no size) or loc."""
    return {
        "plain": F.format_string("(%d,%d)", x, y),
        "box": F.format_string("<|box_start|>(%d,%d),(%d,%d)<|box_end|>", x, y, x, y),
        "loc": F.format_string("(<loc_%d>,<loc_%d>)", x, y),
    }[style]
