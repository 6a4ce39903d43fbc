"""Actions in the forms that other agents write and read, and texts that models are given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import actions as A

# fixed values: names of actions that carry nothing but a name and a position or a value
_POSITIONED = {"hover": "HOVER", "long_press": "LONG_PRESS"}
_VALUED = {"input_text": "INPUT", "answer": "ANSWER", "status": "ANSWER", "open_app": "OPEN_APP"}
_BARE = {"enter": "ENTER", "navigate_back": "NAVIGATE_BACK", "navigate_home": "NAVIGATE_HOME", "wait": "WAIT"}
_KEYS = {"ctrlc": "COPY", "ctrlv": "PASTE"}
# fixed values: entities that are read back, in this order
_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&ndash;", "-"), ("&rsquo;", "'"), ("&lsquo;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&#39;", "'"), ("&#40;", "("), ("&#41;", ")")]
# blanks of any script
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def _said(name: Column | str, value: Column | None, position: Column | None) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    value = F.lit("None") if value is None else F.concat(F.lit("'"), value, F.lit("'"))
    return F.concat(F.lit("{'action': '"), name, F.lit("', 'value': "), value, F.lit(", 'position': "), F.lit("None") if position is None else position, F.lit("}"))


def position_form(kind: Column, x: Column, y: Column, text: Column, direction: Column, web: bool = False, scale: float = 1000.0) -> Column:
    """A unified action as {'action', 'value', 'position'}; null for kinds that the form doesn't have.

    Points on a scale of 1000 go to `scale`, with two decimals. On the web a swipe is a scroll
    the other way; elsewhere it is left out, as its two points depend on the screen.
    """
    at = F.concat(F.lit("["), F.format_string("%.2f", x / 1000.0 * scale), F.lit(", "), F.format_string("%.2f", y / 1000.0 * scale), F.lit("]"))
    out = F.when(kind == "click", _said("CLICK" if web else "TAP", None, at)).when(kind == "scroll", _said("SCROLL", direction, None))
    for k, name in _POSITIONED.items():
        out = out.when(kind == k, _said(name, None, at))
    for k, name in _VALUED.items():
        out = out.when(kind == k, F.concat(F.lit(f"{{'action': '{name}', 'value': '"), text, F.lit("'}")))
    for k, name in _BARE.items():
        out = out.when(kind == k, _said(name, None, None))
    if web:
        out = out.when(kind == "swipe", _said("SCROLL", A.opposite(direction), None))
    combination = F.lower(F.regexp_replace(text, r"[-_ +]", ""))
    for k, name in _KEYS.items():
        out = out.when((kind == "hotkey") & (combination == k), _said(name, None, None))
    return out


def call_form(kind: Column, x: Column, y: Column, text: Column) -> Column:
    """click, type and select as calls with a boxed start; null for other kinds."""
    at = F.concat(F.lit("(start_box='<|box_start|>("), x.cast("string"), F.lit(","), y.cast("string"), F.lit(")<|box_end|>'"))
    return (
        F.when(kind == "click", F.concat(F.lit("click"), at, F.lit(")")))
        .when(kind == "input_text", F.concat(F.lit("type"), at, F.lit(", content='"), text, F.lit("')")))
        .when(kind == "select", F.concat(F.lit("select"), at, F.lit(", option='"), text, F.lit("')")))
    )


def _action(kind: str, x: Column | None, y: Column | None, text: Column | None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), (none if x is None else x).cast("double").alias("x"), (none if y is None else y).cast("double").alias("y"), (none if text is None else text).cast("string").alias("text"))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def read_call(text: Column) -> Column:
    """kind, x, y and text of a call; the first name found decides, null if none is."""
    mark = r"\((-?[\d.]+),\s*(-?[\d.]+)\)"
    x, y = _number(text, mark), _number(text, mark, 2)
    typed = F.trim(F.regexp_extract(text, r"(?s)content='(.*)'", 1))
    chosen = F.trim(F.regexp_extract(text, r"(?s)option='(.*)'", 1))
    return F.when(text.startswith("click"), _action("click", x, y, None)).when(text.startswith("type"), _action("input_text", x, y, typed)).when(text.startswith("select"), _action("select", x, y, chosen))


def read_script(text: Column) -> Column:
    """kind, x, y and text of a script line by the name that is called: click, write, select or scroll; typed texts have no place and stand at (-1, -1)."""
    called = F.regexp_extract(text, r"^([^(]*)\(", 1)
    mark = r"x=([\d.]+),\s*y=([\d.]+)"
    x, y = _number(text, mark), _number(text, mark, 2)
    written = F.trim(F.regexp_extract(text, r"(?s)=['\"](.*)['\"]\)$", 1))
    chosen = F.trim(F.regexp_extract(text, r"(?s)value='(.*)'\)", 1))
    way = F.when(_number(text, r"page=\s*(-?[\d.]+)") > 0, "up").otherwise("down")
    return (
        F.when(F.contains(called, F.lit("click")), _action("click", x, y, None)).when(F.contains(called, F.lit("write")), _action("input_text", F.lit(-1), F.lit(-1), written))
        .when(F.contains(called, F.lit("select")), _action("select", x, y, chosen)).when(F.contains(called, F.lit("scroll")), _action("scroll", None, None, way))
    )


def friendly(tag: Column, names: dict[str, str]) -> Column:
    """A tag under the name that people know; others stay."""
    if not names:
        return tag
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(tag)), tag)


def parenthesised(html: Column) -> Column:
    """Serialised html with round brackets for tags, entities read back and blanks collapsed."""
    t = F.regexp_replace(html, r"<text>([^\n]*?)</text>", "$1")
    t = F.replace(t, F.lit("/>"), F.lit("$/$>"))
    t = F.regexp_replace(F.regexp_replace(t, r"</([^\n]+?)>", ")"), r"<([^\n]+?)>", "($1")
    t = F.replace(t, F.lit("$/$"), F.lit(")"))
    for k, v in _ENTITIES:
        t = F.replace(t, F.lit(k), F.lit(v))
    t = F.btrim(F.regexp_replace(t, BLANK + "+", " "))
    return F.regexp_replace(F.regexp_replace(t, r"\) +\)", "))"), r"\( +\(", "((")


def masked(ids: Column, header: Column, lengths: Column, human: Column, ignore: int = -100, marks: int = 2) -> Column:
    """Target ids with the header and what the human says masked, but for the first `marks` ids of a turn.

    lengths and human are arrays by turn; ids after the last turn stay. The work is linear in
    the ids, but for the turns' ends, whose array is copied once a turn.
    """
    ends = F.aggregate(lengths, F.array(header.cast("int")), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n.cast("int"))))

    def turn(n: Column, i: Column) -> Column:
        shown = F.when(F.get(human, i), F.least(n.cast("int"), F.lit(marks))).otherwise(n.cast("int"))
        return F.concat(F.slice(ids, F.get(ends, i) + 1, shown), F.array_repeat(F.lit(ignore).cast("long"), n.cast("int") - shown))

    last = F.element_at(ends, -1)
    rest = F.slice(ids, last + 1, F.greatest(F.size(ids) - last, F.lit(0)))
    return F.concat(F.array_repeat(F.lit(ignore).cast("long"), header.cast("int")), F.flatten(F.transform(lengths, turn)), rest)
