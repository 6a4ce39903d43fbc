"""Filters and repairs on single values, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from sievecraft.functions import convert as V
from sievecraft.functions import denoise as D
from sievecraft.functions import text as T


def values(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


def cleaned(tree):
    kept = []
    for line in tree.split("\n"):
        if "statictext" in line.lower():
            m = re.search(r"\[\d+\] StaticText (.+)", line, re.S)
            said = m.group(1)[1:-1] if m else ""
            if said and all(said not in x for x in kept[-3:]):
                kept.append(line)
        else:
            kept.append(line)
    return "\n".join(kept)


def test_static_texts_of_the_lines_before_go(spark):
    rng = random.Random(4)
    lines = ["[1] button 'ok'", "[2] StaticText 'ok'", "\t[3] StaticText 'cancel'", "[4] link 'cancel all'", "[5] statictext 'x'", "[6] StaticText ''", "plain"]
    trees = ["\n".join(rng.choices(lines, k=rng.randint(1, 9))) for _ in range(60)]
    assert values(spark, D.without_repeated_static_text, trees) == [cleaned(t) for t in trees]


def test_characters_and_pages(spark):
    assert values(spark, T.valid_chars, ["", "Hello, world!", "中文 ok", "it's", 'say "x"', "a/b", "naïve", "a\nb c"]) == [True, True, True, False, False, False, False, True]
    assert values(spark, lambda t: D.has_any(t, D.BROKEN_PAGES), ["404 Not Found", "room 404", "not found", "x 503 Service Unavailable y", None]) == [True, False, False, True, False]
    assert values(spark, T.without_control, ["a​b\x07c"]) == ["abc"] and values(spark, T.lower_first, ["Abc", ""]) == ["abc", ""]
    assert values(spark, lambda t: T.section(t, "thought"), ["x <thought>a\nb</thought>"]) == ["a\nb"]


def test_lists_and_lines(spark):
    rows = spark.createDataFrame([(["a", "b", "NaN", "c"],), ([None, "a"],), ([],)], "x array<string>").select(D.until_null(F.col("x"))).collect()
    assert [r[0] for r in rows] == [["a", "b"], [], []]
    assert values(spark, lambda t: D.without_lines(t, 2), [" \nfirst\nsecond\n third \n"]) == ["third"]
    assert values(spark, V.listed, ["1 button 'a b' (1,2,3,4)\n2 link (5,6)"]) == ["1 <|object_ref_start|>button 'a b'<|object_ref_end|> <|box_start|>(1,2),(3,4)<|box_end|>\n2 <|object_ref_start|>link<|object_ref_end|> <|box_start|>(5,6),(5,6)<|box_end|>"]
    assert values(spark, V.boxed, ["(1,2)", "(1,2,3,4)"]) == ["<|box_start|>(1,2),(1,2)<|box_end|>", "<|box_start|>(1,2),(3,4)<|box_end|>"]


def test_choices(spark):
    texts = ["B", " C. (1,2)", "x D: y", "None", "A. first", "Z. far", "no letter", "aB. x"]
    assert values(spark, lambda t: D.choice_letter(t, 6), texts) == ["B", "C", "D", "-", None, None, None, None]
