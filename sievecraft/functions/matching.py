"""Whether a predicted action is the one that a corpus asks for, by each evaluation's rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codecs, geometry
from .actions import opposite

_PUNCTUATION = r"[!-/:-@\[-`{-~]"
_NEAR = 0.14  # fixed value: the distance, as a share of the screen, within which points count as one


def _none(kind: str = "string"):
    return field(default_factory=lambda: F.lit(None).cast(kind))


@dataclass
class Action:
    """An action's columns; points are shares of the screen."""

    kind: Column
    x: Column = _none("double")
    y: Column = _none("double")
    x2: Column = _none("double")
    y2: Column = _none("double")
    text: Column = _none()
    direction: Column = _none()
    status: Column = _none()
    answer: Column = _none()
    app: Column = _none()
    key: Column = _none()
    button: Column = _none()


def answer_words(text: Column) -> Column:
    """Lower-case words without punctuation and articles."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _PUNCTUATION, "")
    return F.filter(F.split(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+"), lambda w: w != "")


def text_f1(a: Column, b: Column) -> Column:
    return codecs.bag_f1(answer_words(a), answer_words(b))


def clean_answer(text: Column) -> Column:
    """Lower-case without marks at the ends and quotes, commas and semicolons inside."""
    return F.translate(F.btrim(F.lower(text), F.lit(" .?!")), "\"',;", "")


def _outcome(kind: Column, same: Column, pointing: list[str], element: Column, others: dict[str, Column], rest: bool) -> Column:
    """A struct of flags: whether the kind is right, an element had to be found and was, and the action as a whole."""
    points = same & kind.isin(pointing)
    good = F.when(kind.isin(pointing), element)
    for k, v in others.items():
        good = good.when(kind == k, v)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(yes(same).alias("type_match"), yes(points).alias("need_element"), yes(points & element).alias("element_match"), yes(same & yes(good.otherwise(F.lit(rest)))).alias("action_match"))


def phone_kind(guess: Action) -> Column:
    """The predicted kind under the phone corpus' names."""
    button = F.lower(guess.button)
    pressed = F.when(button == "home", "navigate_home").when(button == "back", "navigate_back").otherwise(guess.kind)
    return F.when(guess.kind == "open", "open_app").when(guess.kind == "type", "input_text").when(guess.kind == "answer", "status").when(guess.kind == "system_button", pressed).otherwise(guess.kind)


def phone_match(truth: Action, guess: Action, box: tuple[Column, ...]) -> Column:
    """Phone steps: clicks inside the element's box, texts by F1, swipes against the content's move."""
    kind = phone_kind(guess)
    alike = ((truth.kind == "enter") & (guess.kind == "press_key") & (F.lower(guess.key) == "enter")) | ((truth.kind == "status") & (guess.kind == "terminate")) | ((truth.kind == "swipe") & (guess.kind == "scroll"))
    same = (truth.kind == kind) | F.coalesce(alike, F.lit(False))
    status = F.when(guess.kind == "answer", F.when(F.contains(F.coalesce(guess.text, F.lit("")), F.lit("complete")), "successful").otherwise("infeasible")).otherwise(guess.status)
    others = {
        "input_text": text_f1(F.trim(truth.text), F.trim(guess.text)) > 0.5,
        "swipe": opposite(truth.direction) == guess.direction,
        "status": truth.status == status,
        "open_app": truth.app == F.coalesce(guess.app, guess.text),
    }
    return _outcome(truth.kind, same, ["click", "long_press"], geometry.contains(box, guess.x, guess.y), others, True)


def web_match(truth: Action, guess: Action, box: tuple[Column, ...]) -> Column:
    """Web steps: inside the box or, without one, near the centre; drags by the overlap of what they span; key names without joints."""
    inside = F.when(box[0].isNotNull(), geometry.contains(box, guess.x, guess.y)).otherwise(geometry.distance(truth.x, truth.y, guess.x, guess.y) < _NEAR)
    joints = lambda c: F.translate(c, "_-+", "")
    answer = clean_answer(F.coalesce(truth.answer, F.lit("")))
    said = answer.isin("", "task complete", "task impossible") | (text_f1(answer, clean_answer(F.coalesce(guess.answer, F.lit("")))) > 0.5)
    level, upright = guess.y == guess.y2, guess.x == guess.x2
    dx, dy = F.when(upright, 0.01).otherwise(0.0), F.when(level & ~upright, 0.01).otherwise(0.0)
    span = (guess.x - dx, guess.y - dy, guess.x2 + dx, guess.y2 + dy)
    asked = (F.least(truth.x, truth.x2), F.least(truth.y, truth.y2), F.greatest(truth.x, truth.x2), F.greatest(truth.y, truth.y2))
    others = {
        "input_text": text_f1(truth.text, guess.text) > 0.5,
        "scroll": truth.direction == guess.direction,
        "swipe": truth.direction == guess.direction,
        "status": (truth.status == guess.status) & said,
        "drag": geometry.iou(asked, span) > 0.5,
        "hotkey": joints(truth.key) == joints(guess.key),
    }
    return _outcome(truth.kind, truth.kind == guess.kind, ["click", "hover"], inside, others, False)


def element_step(truth: Action, original: Column, guess: Action, box: tuple[Column, ...]) -> Column:
    """Browser steps judged by element and by the F1 of operation and value; a step succeeds if both are right."""
    kind = F.when(guess.kind == "hover", "click").otherwise(guess.kind)
    operation = (kind == truth.kind) | (kind == F.lower(original))
    with_value = lambda k, v: F.when(k.isin("input_text", "select"), F.concat(k, F.lit(" "), F.lower(F.coalesce(v, F.lit(""))))).otherwise(k)
    f1 = F.when(kind == "enter", 1.0).otherwise(text_f1(with_value(kind, guess.text), with_value(truth.kind, truth.text)))
    found = F.when(kind == "enter", operation).otherwise(geometry.contains(box, F.coalesce(guess.x, F.lit(-1.0)), F.coalesce(guess.y, F.lit(-1.0))))
    return F.struct(operation.alias("operation_match"), found.alias("element_match"), F.round(f1, 6).alias("operation_f1"), ((f1 == 1.0) & found).alias("step_success"))


def desktop_match(truth: Action, guess: Action, box: tuple[Column, ...]) -> Column:
    """Desktop steps: the box grown on all sides or, without one, near the point; texts within each other."""
    grown = (box[0] - _NEAR, box[1] - _NEAR, box[2] + _NEAR, box[3] + _NEAR)
    inside = F.when(box[0].isNotNull(), geometry.contains(grown, guess.x, guess.y)).otherwise(geometry.distance(truth.x, truth.y, guess.x, guess.y) <= _NEAR)
    a, b = F.trim(F.lower(truth.text)), F.trim(F.lower(guess.text))
    others = {
        "input_text": F.contains(a, b) | F.contains(b, a),
        "scroll": truth.direction == guess.direction,
        "press_key": truth.key == guess.key,
        "hotkey": F.lower(F.translate(truth.key, "+-", "")) == F.lower(F.translate(guess.key, "+- ", "")),
    }
    return _outcome(truth.kind, truth.kind == guess.kind, ["click", "double_click", "right_click", "hover"], inside, others, True)


def gesture_match(truth: Action, guess: Action, boxes: Column) -> Column:
    """Gestures with a start and an end: two taps in one grown box or near each other, two drags along one axis.

    boxes is an array of structs x1, y1, x2, y2. Where either is no gesture the kinds decide.
    """
    tap = lambda a: geometry.is_tap(a.x, a.y, a.x2, a.y2)

    def both_inside(b: Column) -> Column:
        grown = geometry.resized(b.x1, b.y1, b.x2, b.y2)
        return geometry.contains(grown, truth.x, truth.y) & geometry.contains(grown, guess.x, guess.y)

    taps = F.exists(boxes, both_inside) | (geometry.distance(truth.x, truth.y, guess.x, guess.y) <= _NEAR)
    axes = geometry.main_axis(truth.x, truth.y, truth.x2, truth.y2) == geometry.main_axis(guess.x, guess.y, guess.x2, guess.y2)
    gestures = (truth.kind == "gesture") & (guess.kind == "gesture")
    return F.when(~gestures, truth.kind == guess.kind).when(tap(truth) & tap(guess), taps).when(tap(truth) | tap(guess), F.lit(False)).otherwise(axes)
