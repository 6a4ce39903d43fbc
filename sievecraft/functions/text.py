"""Text as column expressions: scripts, cleaning, scores and answer parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ranges of the scripts that are told apart
SCRIPTS = {
    "zh": r"[\x{4e00}-\x{9fff}]",
    "ja": r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{ff00}-\x{ffef}]",
    "ru": r"[\x{0400}-\x{04ff}]",
    "ar": r"[\x{0600}-\x{06ff}]",
    "ko": r"[\x{ac00}-\x{d7af}]",
}


def has_script(text: Column, script: str) -> Column:
    return text.rlike(SCRIPTS[script])


def has_other_script(text: Column) -> Column:
    """Any script but Latin."""
    return F.coalesce(text.rlike("|".join(SCRIPTS.values())), F.lit(False))


def has_english(text: Column) -> Column:
    return text.rlike("[A-Za-z]") & ~has_other_script(text)


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column, chars: str = " .") -> Column:
    return F.btrim(text, F.lit(chars))


def without_control(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{C}", "")


def xml_escape(text: Column) -> Column:
    """& first, so that what is put in isn't escaped again."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_unescape(text: Column) -> Column:
    for a, b in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def base64(text: Column) -> Column:
    """The UTF-8 bytes in base64, in one line: Spark breaks lines after 76 characters, as mails do."""
    return F.translate(F.base64(F.encode(text, "utf-8")), "\r\n", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words between blanks; the default length in tokens."""
    return F.size(words(F.coalesce(text, F.lit(""))))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def shorten(text: Column, most: int, where: str = "right", mark: str = "...") -> Column:
    """Texts over `most` characters with a mark left, center or right of what is kept."""
    keep = most - len(mark)
    left = F.substring(text, 1, keep)
    cut = {
        "right": F.concat(left, F.lit(mark)),
        "left": F.concat(F.lit(mark), F.right(text, F.lit(keep))),
        "center": F.concat(F.substring(text, 1, keep // 2), F.lit(mark), F.right(text, F.lit(keep - keep // 2))),
    }[where]
    return F.when(F.length(text) > most, cut).otherwise(text)


def integers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+)"), 1), lambda x: x.cast("long"))


def last_box(text: Column) -> Column:
    """The coordinates of the last (x,y),(x,y), null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(\(\d+,\s*\d+\),\s*\(\d+,\s*\d+\))"), 1)
    return F.when(F.size(found) > 0, integers(F.element_at(found, -1)))


def anls(a: Column, b: Column, least: float = 0.5) -> Column:
    """1 less the edit distance by the longer length, below `least` 0; two empty texts give 1."""
    longest = F.greatest(F.length(a), F.length(b))
    score = F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
    return F.when(score < least, F.lit(0.0)).otherwise(score)


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays taken as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(2.0 * both, (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))).cast("double")), F.lit(0.0))


def number(text: Column) -> Column:
    """A number, per cent as its share; null if it is none."""
    return F.when(text.endswith("%"), F.btrim(text, F.lit("%")).try_cast("double") / 100).otherwise(text.try_cast("double"))


def relaxed_equal(target: Column, prediction: Column, most: float = 0.05) -> Column:
    """Numbers within `most` of the target; other texts, and a target of 0, by lower case."""
    t, p = number(target), number(prediction)
    close = F.abs(p - t) / F.abs(t) <= most
    return F.when(p.isNotNull() & t.isNotNull() & (t != 0), close).otherwise(F.lower(prediction) == F.lower(target))


def soft_accuracy(times: Column, answers: int = 10) -> Column:
    """Leave-one-out accuracy of an answer that `times` of the annotators gave."""
    part = lambda n: F.least(F.lit(1.0), n / 3)
    return F.when(times > 0, (times * part(times - 1) + (answers - times) * part(times)) / answers).otherwise(0.0)


def option_letter(text: Column, letters: str = "ABCDE") -> Column:
    """`A`, `A. ...` or `The answer is A.`; null otherwise."""
    return F.when(text.rlike(f"^[{letters}]$"), text).when(text.rlike(rf"^[{letters}]\. "), F.substring(text, 1, 1)).when(text.rlike(rf"The answer is [{letters}]\."), F.regexp_extract(text, rf"The answer is ([{letters}])\.", 1))


def score_pair(text: Column) -> Column:
    """Two numbers of the first line, [-1, -1] otherwise."""
    parts = F.split(F.btrim(F.replace(F.substring_index(text, "\n", 1), F.lit(","), F.lit(" "))), r" +")
    pair = F.array(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    good = (F.size(parts) == 2) & pair[0].isNotNull() & pair[1].isNotNull()
    return F.when(good, pair).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def rating(text: Column) -> Column:
    """The only k of 0..6 with `rating: k`; 0 if none or several are found."""
    found = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda k: F.contains(F.lower(text), F.concat(F.lit("rating: "), k.cast("string"))))
    return F.when(F.size(found) == 1, found[0]).otherwise(0)


def yes_no(text: Column) -> Column:
    """no if the first sentence has No, not or no as a word, else yes."""
    first = F.replace(F.substring_index(text, ".", 1), F.lit(","), F.lit(""))
    return F.when(F.arrays_overlap(F.split(first, " "), F.array(F.lit("No"), F.lit("not"), F.lit("no"))), "no").otherwise("yes")


def section(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)


# fixed values: characters that a text may have, beside blanks
_ALLOWED = r"A-Za-z0-9\u4e00-\u9fff.,!?;:()\[\]{}<>@#$%^&*+\-=_~\s\x0b\x1c-\x1f\x85\p{Z}"


def valid_chars(text: Column) -> Column:
    """Latin letters, Chinese characters, digits, common marks and blanks only; an empty text is valid."""
    return text.rlike(rf"^[{_ALLOWED}]*\z")
