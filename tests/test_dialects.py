"""Actions in other agents' forms, targets and pruned trees on small cases."""

from pyspark.sql import functions as F

from sievecraft.functions import dialects as L
from sievecraft.operators import trees
from sievecraft.operators import windows as O


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_calls_round_trip_and_unknown_kinds_are_null(spark):
    text = F.lit("it's (1,2)")
    for kind, said in (("click", None), ("input_text", "it's (1,2)"), ("select", "it's (1,2)")):
        assert tuple(one(spark, L.read_call(L.call_form(F.lit(kind), F.lit(7), F.lit(9), text)))) == (kind, 7.0, 9.0, said)
    assert one(spark, L.call_form(F.lit("drag"), F.lit(1), F.lit(1), text)) is None
    assert one(spark, L.read_call(F.lit("wait()"))) is None
    assert one(spark, L.read_call(F.lit(None).cast("string"))) is None


def test_scripts_are_read_by_the_name_called(spark):
    assert tuple(one(spark, L.read_script(F.lit("pyautogui.write(message='click x=1, y=2')")))) == ("input_text", -1.0, -1.0, "click x=1, y=2")
    assert tuple(one(spark, L.read_script(F.lit("pyautogui.scroll(page=-0.2)")))) == ("scroll", None, None, "down")


def test_positions(spark):
    form = lambda kind, text="", **more: one(spark, L.position_form(F.lit(kind), F.lit(490), F.lit(420), F.lit(text), F.lit("up"), **more))
    assert form("click", scale=1.0) == "{'action': 'TAP', 'value': None, 'position': [0.49, 0.42]}"
    assert form("swipe", web=True) == "{'action': 'SCROLL', 'value': 'down', 'position': None}"
    assert form("hotkey", "CTRL_V") == "{'action': 'PASTE', 'value': None, 'position': None}"
    assert form("swipe") is None and form("hotkey", "alt f4") is None


def test_targets_are_masked_by_turn(spark):
    ids = F.array(*[F.lit(i).cast("long") for i in range(12)])
    lengths, human = F.array(F.lit(4), F.lit(3), F.lit(1)), F.array(F.lit(True), F.lit(False), F.lit(True))
    assert one(spark, L.masked(ids, F.lit(2), lengths, human)) == [-100, -100, 2, 3, -100, -100, 6, 7, 8, 9, 10, 11]
    empty = F.array().cast("array<long>")
    assert one(spark, L.masked(empty, F.lit(0), F.array().cast("array<int>"), F.array().cast("array<boolean>"))) == []


def test_children_take_the_place_of_a_pruned_node(spark):
    # 1 > (2 gone > (5 gone > 6), 3), 4 gone > 7; 8 and 9 are a cycle
    nodes = [(1, None, False), (2, 1, True), (3, 1, False), (4, None, True), (5, 2, True), (6, 5, False), (7, 4, False), (8, 9, False), (9, 8, False)]
    df = spark.createDataFrame([(0, *n) for n in nodes], "tree int, node long, parent long, bad boolean")
    assert sorted(tuple(r) for r in trees.pruned(df, "tree", "node", "parent", "bad").collect()) == [(0, 1, None, 0), (0, 3, 1, 2), (0, 6, 1, 1), (0, 7, None, 3)]
    assert trees.pruned(df.limit(0), "tree", "node", "parent", "bad").count() == 0


def test_running_totals(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    got = sorted((r.before, r.v, r.id) for r in O.running(df, O.hash_rank("t", "id"), "v", "before").collect())
    order = [r.id for r in df.orderBy(O.hash_rank("t", "id")).collect()]
    total, want = 0, []
    for i in order:
        want.append((total, i % 7, i))
        total += i % 7
    assert got == sorted(want)


def test_parenthesised(spark):
    html = '<div a="1"> <p> <text>x &amp; y</text></p> <br/> </div>'
    assert one(spark, L.parenthesised(F.lit(html))) == '(div a="1" (p x & y) (br))'
