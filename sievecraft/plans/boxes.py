"""Screens and elements: `lineitem` rows are elements of the screen l_orderkey, boxes follow from their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import quality as Q
from ..operators import windows as O
from ..session import table
from .registry import Registry

_registry = Registry()
query = _registry.query

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, idx, kind, x1, y1, x2, y2 on a screen of 1000 x 1000; some boxes leave it."""
    x1, y1 = F.pmod(F.col("l_partkey") * 37, F.lit(1000)), F.pmod(F.floor("l_quantity") * 53 + F.col("l_linenumber") * 7, F.lit(1000))
    w, h = 1 + F.pmod(F.col("l_suppkey") * 13, F.lit(300)), 1 + F.pmod(F.floor("l_extendedprice"), F.lit(300))
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), idx.alias("idx"), F.col("l_returnflag").alias("kind"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), w.cast("int").alias("w"), h.cast("int").alias("h"))
    return rows.select("image", "idx", "kind", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))


ELEMENTS = f"""
with e0 as (
    select l_orderkey as image, row_number() over (partition by l_orderkey order by {', '.join(_ORDER)}) as idx, l_returnflag as kind,
        cast(l_partkey * 37 % 1000 as int) as x1, cast((cast(floor(l_quantity) as bigint) * 53 + l_linenumber * 7) % 1000 as int) as y1,
        cast(1 + l_suppkey * 13 % 300 as int) as w, cast(1 + cast(floor(l_extendedprice) as bigint) % 300 as int) as h from lineitem
), e as (select image, idx, kind, x1, y1, x1 + w as x2, y1 + h as y2 from e0)
"""
_REASON = """case when x1 < 0 or y1 < 0 or x2 > 1000 or y2 > 1000 or x1 >= x2 or y1 >= y2 then 'invalid_box'
    when (x2 - x1) * (y2 - y1) >= 0.65 * 1000000 then 'oversize' when x2 - x1 <= 5 or y2 - y1 <= 5 then 'too_small'
    when (x2 - x1)::double / (y2 - y1) < 0.05 or (x2 - x1)::double / (y2 - y1) > 20 then 'extreme_aspect' end"""
BOX = ("x1", "y1", "x2", "y2")


def _box(prefix: str = "") -> tuple:
    return tuple(F.col(prefix + c) for c in BOX)


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).withColumn("reject_reason", Q.first_reason(Q.box_checks(*_box(), 1000, 1000)))


@query(ELEMENTS + """select image, idx, cast(least(greatest(round_even(x1 / 1280.0::double * 1000, 0), 0), 999) as int) as nx, cast(least(greatest(round_even(y1 / 720.0::double * 1000, 0), 0), 999) as int) as ny,
    cast(round_even(cast(least(greatest(round_even(x1 / 1280.0::double * 1000, 0), 0), 999) as int) / 1000.0::double * 1280, 0) as int) as bx from e""")
def norm_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates on a scale of 1000, clamped, and back on a screen of 1280."""
    nx = G.normalise(F.col("x1"), F.lit(1280.0))
    return elements(spark, sf_dir).select("image", "idx", nx.alias("nx"), G.normalise(F.col("y1"), F.lit(720.0)).alias("ny"), G.denormalise(nx, F.lit(1280.0)).alias("bx"))


@query(ELEMENTS + f", r as (select *, {_REASON} as reject_reason from e) select coalesce(reject_reason, 'kept') as reason, count(*) as n, round(count(*)::double / (select count(*) from r), 6) as share from r group by 1")
def reject_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _reasons(spark, sf_dir).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(ELEMENTS + f", r as (select *, {_REASON} as reject_reason from e) select image, idx from r where image not in (select image from r group by image having count(reject_reason) > 0.4 * count(*))")
def group_level_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screens with more than 40 % bad elements go as a whole."""
    return Q.drop_groups(_reasons(spark, sf_dir), ["image"], F.col("reject_reason").isNotNull(), most_share=0.4).select("image", "idx")


@query(ELEMENTS + ", r as (select *, row_number() over (partition by image, x1, y1 order by idx) as k from e) select image, idx, x1, y1 from r where k = 1")
def dup_box_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_of(elements(spark, sf_dir), ["image", "x1", "y1"], ["idx"]).select("image", "idx", "x1", "y1")


@query(ELEMENTS + ", r as (select *, count(*) over (partition by image, kind) as k from e) select image, idx, kind from r where k = 1")
def unique_text_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.unique_only(elements(spark, sf_dir), ["image", "kind"]).select("image", "idx", "kind")


@query(ELEMENTS + "select image, string_agg(idx || ':' || kind, ',' order by y1 + y2, x1 + x2, idx) as reading_order from e group by image")
def reading_order_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct((F.col("y1") + F.col("y2")).alias("a"), (F.col("x1") + F.col("x2")).alias("b"), "idx", "kind")))
    return elements(spark, sf_dir).groupBy("image").agg(F.array_join(F.transform(items, lambda s: F.concat(s["idx"].cast("string"), F.lit(":"), s["kind"])), ",").alias("reading_order"))


_PAIRS = """, p as (
    select a.image, a.idx as i, b.idx as j, (a.x2 - a.x1) * (a.y2 - a.y1) as sa, (b.x2 - b.x1) * (b.y2 - b.y1) as sb,
        greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as o
    from e a join e b on a.image = b.image and a.idx < b.idx
), q as (select *, coalesce(o::double / nullif(sa + sb - o, 0), 0) as iou from p)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a screen's elements; the screen is the join's key, and a screen holds few elements."""
    e = elements(spark, sf_dir)
    a = e.select("image", F.col("idx").alias("i"), *[F.col(c).alias("a_" + c) for c in BOX])
    b = e.select("image", F.col("idx").alias("j"), *[F.col(c).alias("b_" + c) for c in BOX])
    return a.join(b, "image").where("i < j").withColumn("iou", G.iou(_box("a_"), _box("b_")))


@query(ELEMENTS + _PAIRS + "select image, i, j, round(iou, 6) as iou from q where iou > 0.01")
def iou_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("iou > 0.01").select("image", "i", "j", F.round("iou", 6).alias("iou"))


@query(ELEMENTS + _PAIRS + "select image, count(*) as pairs, round(avg(iou), 6) as mean_iou from q group by image")
def mean_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("image").agg(F.count("*").alias("pairs"), F.round(F.avg("iou"), 6).alias("mean_iou"))


@query(ELEMENTS + _PAIRS + ", d as (select image, case when sa > sb or (sa = sb and i > j) then i else j end as idx from q where iou > 0.2) select image, idx from e where (image, idx) not in (select (image, idx) from d)")
def nms_drop_larger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two elements that overlap by over 0.2 the larger goes; on equal areas the later."""
    sa, sb = G.area(*_box("a_")), G.area(*_box("b_"))
    larger = F.when((sa > sb) | ((sa == sb) & (F.col("i") > F.col("j"))), F.col("i")).otherwise(F.col("j"))
    gone = _pairs(spark, sf_dir).where("iou > 0.2").select("image", larger.alias("idx"))
    return elements(spark, sf_dir).select("image", "idx").join(gone, ["image", "idx"], "left_anti")


_POINTS = ", pts as (select distinct image, (image * 131) % 1000 as px, (image * 71) % 1000 as py from e)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click on each screen."""
    images = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image")).distinct()
    return images.select("image", F.pmod(F.col("image") * 131, F.lit(1000)).alias("px"), F.pmod(F.col("image") * 71, F.lit(1000)).alias("py"))


@query(ELEMENTS + _POINTS + """, r as (select pts.image, px, py, idx, row_number() over (partition by pts.image order by (x2 - x1) * (y2 - y1), idx) as k
    from pts join e on e.image = pts.image and px between x1 and x2 and py between y1 and y2) select image, px, py, idx from r where k = 1""")
def smallest_containing_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _points(spark, sf_dir).join(elements(spark, sf_dir), "image").where(G.contains(_box(), F.col("px"), F.col("py")))
    best = F.min(F.struct(G.area(*_box()).alias("area"), F.col("idx"))).alias("best")
    return inside.groupBy("image", "px", "py").agg(best).select("image", "px", "py", "best.idx")


@query(ELEMENTS + _POINTS + """, r as (select e.image, idx, row_number() over (partition by e.image order by md5('neg|' || e.image || '|' || idx), idx) as k
    from pts join e on e.image = pts.image and not (px between x1 and x2 and py between y1 and y2)) select image, idx from r where k <= 9""")
def negative_boxes_top9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to nine elements, in hash order, that a click doesn't meet."""
    outside = _points(spark, sf_dir).join(elements(spark, sf_dir), "image").where(~G.contains(_box(), F.col("px"), F.col("py")))
    return O.capped(outside, ["image"], [O.hash_rank("neg", "image", "idx"), "idx"], 9).select("image", "idx")


@query(ELEMENTS + "select cast(floor((x1 + x2) / 2 / 10) as bigint) as cx, cast(floor((y1 + y2) / 2 / 10) as bigint) as cy, count(*) as n from e group by 1, 2")
def coord_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / 10)
    return elements(spark, sf_dir).groupBy(cell("x1", "x2").alias("cx"), cell("y1", "y2").alias("cy")).agg(F.count("*").alias("n"))


@query(ELEMENTS + _POINTS + "select cast(floor(sqrt(power(px - x1, 2) + power(py - y1, 2)) / 100) as bigint) as bin, count(*) as n from e join pts using (image) group by 1")
def click_distance_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.distance(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"))
    return _points(spark, sf_dir).join(elements(spark, sf_dir), "image").groupBy(F.floor(d / 100).alias("bin")).agg(F.count("*").alias("n"))


@query(ELEMENTS + """, c as (select image, cast(floor((y1 + y2) / 2.0 / 250) as bigint) as block, count(*) filter (where kind = 'R') as icons from e group by 1, 2
), r as (select *, row_number() over (partition by image order by icons desc, block) as k from c where icons > 0) select image, block, icons from r where k = 1""")
def best_block_by_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a page's blocks of fixed height the first with most icons."""
    blocks = elements(spark, sf_dir).groupBy("image", F.floor((F.col("y1") + F.col("y2")) / 2 / 250).alias("block")).agg(F.sum((F.col("kind") == "R").cast("long")).alias("icons"))
    return O.first_of(blocks.where("icons > 0"), ["image"], [F.desc("icons"), "block"])


@query(ELEMENTS + """select image, idx, case when abs(y2 - 500) > abs(x2 - 500) then case when y2 - 500 > 0 then 'down' else 'up' end else case when x2 - 500 > 0 then 'right' else 'left' end end as direction,
    case when greatest(abs(x2 - 500), abs(y2 - 500)) / 1000.0::double < 0.3 then 'short' when greatest(abs(x2 - 500), abs(y2 - 500)) / 1000.0::double < 0.5 then 'medium' else 'long' end as distance from e""")
def swipe_direction_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = F.col("x2") - 500, F.col("y2") - 500
    return elements(spark, sf_dir).select("image", "idx", G.direction(dx, dy).alias("direction"), G.length_class(F.greatest(F.abs(dx), F.abs(dy)) / 1000).alias("distance"))


@query(ELEMENTS + _POINTS + """, m as (
    select image, idx, px / 1000.0::double as ax, py / 1000.0::double as ay, x1 / 1000.0::double as bx, y1 / 1000.0::double as by_, x2 / 1000.0::double as cx, y2 / 1000.0::double as cy from e join pts using (image)
) select image, idx, sqrt((bx - cx) * (bx - cx) + (by_ - cy) * (by_ - cy)) <= 0.04 as is_tap, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) <= 0.14
    or (ax between bx - (cx - bx) * 0.2 and cx + (cx - bx) * 0.2 and ay between by_ - (cy - by_) * 0.2 and cy + (cy - by_) * 0.2) as tap_match, case when abs(cy - by_) >= abs(cx - bx) then 'y' else 'x' end as axis from m""")
def tap_drag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicted tap matches within 0.14 or in the enlarged box; drags match by main axis."""
    m = _points(spark, sf_dir).join(elements(spark, sf_dir), "image").select("image", "idx", *[(F.col(a) / 1000).alias(b) for a, b in (("px", "ax"), ("py", "ay"), ("x1", "bx"), ("y1", "by"), ("x2", "cx"), ("y2", "cy"))])
    ax, ay, bx, by, cx, cy = (F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy"))
    grown = (bx - (cx - bx) * 0.2, by - (cy - by) * 0.2, cx + (cx - bx) * 0.2, cy + (cy - by) * 0.2)
    return m.select("image", "idx", G.is_tap(bx, by, cx, cy).alias("is_tap"), ((G.distance(ax, ay, bx, by) <= 0.14) | G.contains(grown, ax, ay)).alias("tap_match"), G.main_axis(bx, by, cx, cy).alias("axis"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
