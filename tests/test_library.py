"""The library's queries against their SQL on the smallest tables, and properties of its operators."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sievecraft import catalog
from sievecraft.functions import actions as A
from sievecraft.functions import geometry as G
from sievecraft.functions import text as T
from sievecraft.operators import quality as Q
from sievecraft.operators import windows as O

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def rows(data):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(found.fetchall())


def test_long_urls_match_the_sql(spark, tmp_path):
    urls = [None, "", "x" * 56, "x" * 57, "x" * 58, "ü" * 29, "http://a.example/?q=<&>\"" + "日本😀" * 100, "x" * 30, "x" * 31, "a b\r\nc" * 20]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert rows(catalog.QUERIES["url_forms"](spark, str(tmp_path)).collect()) == rows(c.execute(catalog.ORACLES["url_forms"]).fetchall())


@pytest.mark.parametrize("name", ["iou_overlap_pairs", "mean_iou", "nms_drop_larger", "smallest_containing_box", "negative_boxes_top9"])
def test_spatial_joins_have_keys_and_no_python(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def pack(lengths, budget):
    out, sample, used = [], 0, 0
    for i, x in enumerate(lengths):
        if i and (used + x >= budget or i == len(lengths) - 1):
            sample, used = sample + 1, x
        else:
            used += x
        out.append(sample)
    return out


def test_packing_equals_a_loop(spark):
    rng = random.Random(3)
    cases = [[rng.randint(1, 120) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, lengths array<long>")
    for r in df.select("lengths", O.packed(F.col("lengths"), 200).alias("p")).collect():
        assert r.p == pack(r.lengths, 200)


def test_collapse_skips_blanks(spark):
    df = spark.createDataFrame([(["a", "a", "", "a", "b", None, "a"],), ([],)], "x array<string>")
    assert [r[0] for r in df.select(O.collapsed(F.col("x"))).collect()] == [["a", "b", "a"], []]


def test_rounding_is_half_even_and_clamped(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-3.0,), (1000.0,)], "x double")
    assert [r[0] for r in df.select(G.normalise(F.col("x"), F.lit(1000.0))).collect()] == [0, 2, 2, 0, 999]


def test_rejects_and_kept_are_all(spark):
    df = spark.createDataFrame([(0, 0, 10, 10), (5, 5, 5, 9), (0, 0, 900, 900), (0, 0, 2, 500), (0, 0, 300, 6)], "x1 int, y1 int, x2 int, y2 int")
    df = df.withColumn("reject_reason", Q.first_reason(Q.box_checks(*(F.col(c) for c in df.columns), 1000, 1000)))
    kept, bad = Q.split_rejects(df)
    assert kept.count() == 1
    assert sorted(r.reject_reason for r in bad.collect()) == ["extreme_aspect", "invalid_box", "oversize", "too_small"]


def test_text_edges(spark):
    df = spark.createDataFrame([("", ""), ("abc", "abd"), ("abc", "xyz")], "a string, b string")
    assert [r[0] for r in df.select(F.round(T.anls(F.col("a"), F.col("b")), 4)).collect()] == [1.0, 0.6667, 0.0]
    one = lambda col: spark.range(1).select(col).first()[0]
    assert one(T.relaxed_equal(F.lit("10%"), F.lit("0.102")))
    assert not one(T.relaxed_equal(F.lit("0"), F.lit("0.0")))
    assert one(T.last_box(F.lit("(1,2),(3,4) then (5,6),(7,8)"))) == [5, 6, 7, 8]
    assert one(T.last_box(F.lit("none"))) is None
    assert one(T.yes_no(F.lit("No, there is not. Yes"))) == "no"
    assert one(T.rating(F.lit("rating: 4"))) == 4 and one(T.rating(F.lit("rating: 4 rating: 5"))) == 0
    assert one(T.xml_unescape(T.xml_escape(F.lit('<a b="&amp;">')))) == '<a b="&amp;">'
    assert one(T.shorten(F.lit("abcdefghij"), 7, "center")) == "ab...ij"


def test_actions(spark):
    one = lambda col: spark.range(1).select(col).first()[0]
    text = F.lit('{"action_type": "click", "target": (12,34)}')
    assert one(A.field(text, "$.target[1]", "int")) == 34
    assert one(A.action_type(text)) == "click"
    assert one(A.field(F.lit("{broken"), "$.x")) is None
    assert one(A.opposite(F.lit("up"))) == "down"
    assert one(A.point_text(F.lit(1), F.lit(2), "loc")) == "(<loc_1>,<loc_2>)"
