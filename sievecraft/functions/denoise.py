"""Predicates that keep or drop elements, instructions and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# fixed values: status lines of pages that failed to load
BROKEN_PAGES = [
    "400 Bad Request", "403 Forbidden", "404 Not Found", "405 Method Not Allowed", "406 Not Acceptable", "408 Request Timeout", "409 Conflict", "410 Gone", "411 Length Required", "412 Precondition Failed", "413 Payload Too Large", "414 URI Too Long",
    "415 Unsupported Media Type", "416 Range Not Satisfiable", "417 Expectation Failed", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "505 HTTP Version Not Supported", "506 Variant Also Negotiates", "507 Insufficient Storage", "508 Loop Detected",
    "510 Not Extended", "511 Network Authentication Required",
]
# fixed values: what a model says that won't answer
REFUSALS = ["I can't", "sorry"]
# fixed values: views that only hold others
CONTAINERS = ["LinearLayout", "FrameLayout", "GridView", "View", "ViewGroup", "TextView"]
BRACKETED_BOX = r"\[\s*-?\d+\.\d+\s*,\s*-?\d+\.\d+\s*,\s*-?\d+\.\d+\s*,\s*-?\d+\.\d+\s*\]"
IMAGE_TOKENS = 576


def has_any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return F.coalesce(out, F.lit(False))


def box_inside(x1: Column, y1: Column, x2: Column, y2: Column, width: Column | int, height: Column | int, least: float = 0.005) -> Column:
    """On the picture, of positive area and not too small on either side."""
    on = x1.between(0, width) & x2.between(0, width) & y1.between(0, height) & y2.between(0, height)
    return on & (x1 < x2) & (y1 < y2) & ((x2 - x1) / width > least) & ((y2 - y1) / height > least)


def share_box(*box: Column) -> Column:
    """All coordinates are shares, 0 to 1."""
    out = F.lit(True)
    for c in box:
        out = out & c.between(0, 1)
    return out


def area_between(area: Column, least: float, most: float) -> Column:
    return (area > least) & (area < most)


def empty_container(kind: Column, text: Column, description: Column) -> Column:
    blank = lambda c: F.length(F.coalesce(c, F.lit(""))) == 0
    return kind.isin(*CONTAINERS) & blank(text) & blank(description)


def generic_name(text: Column, names: list[str]) -> Column:
    return F.lower(F.trim(text)).isin(*names)


def without_function(text: Column) -> Column:
    """No description of what an element does, or one that says it does nothing."""
    return (F.coalesce(text, F.lit("")) == "") | F.contains(text, F.lit("Non-interactive"))


def tells_motion(text: Column) -> Column:
    return F.coalesce(text.rlike("flip|swipe"), F.lit(False))


def tokens_with_image(text: Column) -> Column:
    return T.word_count(text) + IMAGE_TOKENS


def mentions_action(thought: Column, description: Column) -> Column:
    """Whether a thought names the action, but for its first letter, in either verb form."""
    rest = F.substr(description, F.lit(2))
    return F.contains(thought, rest) | F.contains(thought, F.replace(rest, F.lit("e "), F.lit("ing ")))


def in_scale(task: Column, question: Column, answer: Column, scale: int = 1000) -> Column:
    """Whether the coordinates of a pair lie on the scale: the answer's for grounding tasks, the question's for references."""
    numbers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"-?\d+"), 0), lambda x: x.cast("int"))
    good = lambda a: F.forall(a, lambda x: (x >= 0) & (x < scale))
    point, box = F.regexp_extract(question, r"\((\d+),\s*(\d+)\)", 0), F.regexp_extract(question, r"\((\d+,\d+,\d+,\d+)\)", 0)
    return F.when(task.rlike("gnd|loc|ground"), good(numbers(answer))).when(F.contains(task, F.lit("ref")), good(numbers(F.when(point != "", point).otherwise(box)))).otherwise(True)


def first_point(text: Column) -> Column:
    """[x, y] between the first and the last bracket; [-1, -1] where there is none."""
    inside = F.btrim(F.regexp_extract(text, r"(?s)\((.*)\)", 1), F.lit(" ,"))
    both = F.transform(F.split(inside, ","), lambda x: F.btrim(x).try_cast("double"))
    return F.when((F.size(both) == 2) & both[0].isNotNull() & F.get(both, F.lit(1)).isNotNull(), both).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def some_words(text: Column, seed: Column) -> Column:
    """A contiguous part of a text's words, chosen by the bits of a hash."""
    words = F.split(text, " ")
    n = F.size(words)
    start = F.pmod(F.conv(F.substring(F.md5(seed), 1, 7), 16, 10).cast("int"), n)
    length = F.pmod(F.conv(F.substring(F.md5(seed), 8, 7), 16, 10).cast("int"), n - start) + 1
    return F.array_join(F.slice(words, start + 1, length), " ")


def choice_letter(text: Column, choices: int) -> Column:
    """The letter of a choice: a lone character, else X. and then X: at a word's start, beyond the first; none is '-'."""
    t = F.trim(text)
    marked = lambda mark: F.regexp_extract(t, rf"(^|[^\w])([A-Z])\{mark}", 2)
    good = lambda x: (x != "") & (F.ascii(x) > 65) & (F.ascii(x) - 65 < choices)
    return F.when(F.contains(t, F.lit("None")), "-").when(F.length(t) == 1, t).when(good(marked(".")), marked(".")).when(good(marked(":")), marked(":"))


def nullish(text: Column) -> Column:
    return text.isNull() | F.lower(text).isin("nan", "none")


def until_null(items: Column) -> Column:
    """The items before the first that is null or says so."""
    return F.aggregate(items, F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open")), lambda s, x: F.when(s.open & ~nullish(x), F.struct(F.array_append(s.kept, x).alias("kept"), F.lit(True).alias("open"))).otherwise(F.struct(s.kept.alias("kept"), F.lit(False).alias("open"))), lambda s: s.kept)


def balanced_quotes(text: Column) -> Column:
    """Odd quotes go from the ends; what is left is trimmed and escaped."""
    odd = lambda c, q: F.when(F.regexp_count(c, F.lit(q)) % 2 != 0, F.btrim(c, F.lit(q))).otherwise(c)
    t = F.btrim(odd(odd(text, '"'), "'"), F.lit(" \\"))
    return F.replace(F.replace(t, F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def without_lines(text: Column, n: int) -> Column:
    """A text without its first n lines and the blanks round them."""
    t = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    for _ in range(n):
        t = F.btrim(F.regexp_extract(t, r"(?s)^[^\n]*\n(.*)$", 1), F.lit(" \t\n\r\x0b\x0c"))
    return t


def spelled(text: Column, typos: dict[str, str]) -> Column:
    for k, v in typos.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def without_repeated_static_text(tree: Column) -> Column:
    """A tree's lines without static texts that stand in one of the three lines kept before."""
    said = lambda line: F.regexp_extract(line, r"(?s)\[\d+\] StaticText .(.*).$", 1)

    def keep(kept: Column, line: Column) -> Column:
        before = F.when(F.size(kept) > 3, F.slice(kept, -3, 3)).otherwise(kept)
        new = (said(line) != "") & ~F.exists(before, lambda b: F.contains(b, said(line)))
        return F.when(~F.contains(F.lower(line), F.lit("statictext")) | new, F.array_append(kept, line)).otherwise(kept)

    return F.array_join(F.aggregate(F.split(tree, "\n"), F.array().cast("array<string>"), keep), "\n")
