"""Answers of models against plain Python."""

import math
import random

from pyspark.sql import functions as F

from sievecraft.functions import answers as W


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_points(spark):
    p = lambda s: one(spark, W.predicted_point(F.lit(s)))
    assert p("at [[100,200,300,400]]") == [0.2, 0.3]
    assert p("[a] first [0.1, 0.2] then [0.3,0.4]") == [0.3, 0.4]
    assert p("click (500, 20)") == [0.5, 0.02]
    assert p("nothing") is None and p("1 2 3") is None and p("") is None


def test_label_probability(spark):
    t = F.array(*[F.struct(F.lit(a).alias("token"), F.lit(b).alias("logprob")) for a, b in ((" yes", -9.0), ("Summary", -1.0), (":", -0.1), (" Yes", -0.5), ("yes", -2.0))])
    assert math.isclose(one(spark, W.label_probability(t)), math.exp(-0.5))
    assert one(spark, W.label_probability(t, label="no")) == 0.0


def test_nodes(spark):
    n = lambda *a: one(spark, W.node_label(*[F.lit(x).cast("string") for x in a]))
    assert n("4.0", "media volume", None) == "media volume, 4.0"
    assert n("long text", "abc", None) == "abc" and n("t", " ", None) == "t"
    assert n("", None, "app:id/save ") == "save" and n(None, None, None) is None
    k = lambda *a: one(spark, W.node_kind(*[F.lit(x).cast("string") for x in a]))
    assert (k("a", None, "View"), k("a", "b", "View"), k("a", None, "ImageView"), k(None, None, None)) == ("Text", "Icon", "Image", "Icon")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if not b else row
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_fuzz_ratio_equals_the_table(spark):
    rng = random.Random(1)
    cases = [("".join(rng.choices("abcé", k=rng.randint(0, 30))), "".join(rng.choices("abcé", k=rng.randint(0, 30)))) for _ in range(80)] + [("", ""), (None, "a")]
    for r in spark.createDataFrame(cases, "a string, b string").select("a", "b", W.fuzz_ratio("a", "b").alias("f")).collect():
        if r.a is None:
            assert r.f is None
        else:
            assert math.isclose(r.f, 200 * lcs(r.a, r.b) / (len(r.a) + len(r.b)) if r.a or r.b else 100.0)


def slow(text, times=3):
    w = text.split()
    return any(w[i : i + n] * times == w[i : i + n * times] for n in range(1, len(w) // times + 1) for i in range(len(w) - n * times + 1))


def test_repeated_phrases(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 14))) for _ in range(300)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", W.has_repeated_phrase("t").alias("r")).collect()
    assert len(found) == 300 and all(r.r == slow(r.t) for r in found)
    assert W.repeats_phrase("x " * 20_000) and not W.repeats_phrase(None)


def test_model_hook(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"p{i}") for i in range(9)], "id long, prompt string")
    found = {r.id: r.response for r in W.with_model(df, "prompt", lambda xs: [x.upper() for x in xs], batch=2).collect()}
    assert found == {i: None if i == 3 else f"P{i}" for i in range(9)}
