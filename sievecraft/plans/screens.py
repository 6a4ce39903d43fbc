"""What is made of screens' elements: gates over a screen, other coordinates, phrases, task samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import codecs as C
from ..functions import geometry as G
from ..operators import quality as Q
from ..operators import windows as O
from ..session import table
from .boxes import _REASON, ELEMENTS, _reasons, elements
from .registry import Registry

_registry = Registry()
query = _registry.query


@query(ELEMENTS + f", r as (select *, {_REASON} as reject_reason from e) select image, idx from r where image not in (select image from r group by image having count(reject_reason) > 0.6::double * count(*)) and reject_reason is null")
def ratio_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid elements of screens where no more than six in ten are bad."""
    return Q.drop_groups(_reasons(spark, sf_dir), ["image"], F.col("reject_reason").isNotNull(), most_share=0.6).where("reject_reason is null").select("image", "idx")


@query(ELEMENTS + f", r as (select *, {_REASON} as reject_reason from e) select image, count(*) as n from r group by image having count(reject_reason) <= 2")
def count_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screens with at most two bad elements."""
    return Q.drop_groups(_reasons(spark, sf_dir), ["image"], F.col("reject_reason").isNotNull(), most_rows=2).groupBy("image").agg(F.count("*").alias("n"))


@query(ELEMENTS + "select image, idx, x2 - x1 as w, y2 - y1 as h, cast(trunc(x1 / 1280.0::double * 1000) as int) as tx, cast(trunc(y1 / 720.0::double * 1000) as int) as ty from e")
def xywh_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, and the coordinates of sources that cut instead of rounding."""
    c = F.col
    return elements(spark, sf_dir).select("image", "idx", (c("x2") - c("x1")).alias("w"), (c("y2") - c("y1")).alias("h"), G.truncated(c("x1"), F.lit(1280.0)).alias("tx"), G.truncated(c("y1"), F.lit(720.0)).alias("ty"))


@query(ELEMENTS + "select image, idx, '(' || x1 || ',' || y1 || ')' as plain, '<|box_start|>(' || x1 || ',' || y1 || '),(' || x1 || ',' || y1 || ')<|box_end|>' as box, '(<loc_' || x1 || '>,<loc_' || y1 || '>)' as loc, '(' || x1 || ',' || y1 || ')' as back from e")
def location_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point in three markups; location tokens are read back."""
    x, y = F.col("x1"), F.col("y1")
    plain = A.point_text(x, y)
    return elements(spark, sf_dir).select("image", "idx", plain.alias("plain"), A.point_text(x, y, "box").alias("box"), C.loc_tokens(plain).alias("loc"), C.from_loc_tokens(C.loc_tokens(plain)).alias("back"))


_MOVE = ELEMENTS + ", m as (select *, x2 - 500 as dx, y2 - 500 as dy from e)"


@query(_MOVE + "select image, idx, abs(dx) > abs(dy) as horizontal from m where not coalesce(abs(dy)::double / nullif(abs(dx), 0) > 0.39 and abs(dy)::double / nullif(abs(dx), 0) < 2.4, false)")
def ambiguous_swipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swipes whose angle leaves no doubt, and whether they are horizontal."""
    dx, dy = F.abs(F.col("x2") - 500), F.abs(F.col("y2") - 500)
    slope = F.try_divide(dy.cast("double"), dx.cast("double"))
    unclear = F.coalesce((slope > 0.39) & (slope < 2.4), F.lit(False))
    return elements(spark, sf_dir).where(~unclear).select("image", "idx", (dx > dy).alias("horizontal"))


@query(_MOVE + """, d as (select image, idx, greatest(abs(dx), abs(dy)) / 1000.0::double as share, case when abs(dy) > abs(dx) then case when dy > 0 then 'down' else 'up' end else case when dx > 0 then 'right' else 'left' end end as way from m)
select way, case when share < 0.3 then 'short' when share < 0.5 then 'medium' else 'long' end as coarse, case when share < 0.1 then 'short' when share < 0.3 then 'medium' else 'long' end as fine, count(*) as n,
    case way when 'right' then 200 when 'left' then 800 else 500 end as from_x, case way when 'down' then 200 when 'up' then 800 else 500 end as from_y from d group by all""")
def swipe_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swipes by direction and both binnings of their length, with the point where they would start."""
    dx, dy = F.col("x2") - 500, F.col("y2") - 500
    share = F.greatest(F.abs(dx), F.abs(dy)) / 1000
    x, y, _, _ = C.swipe_points(F.col("way"))
    d = elements(spark, sf_dir).select(G.direction(dx, dy).alias("way"), G.length_class(share).alias("coarse"), G.length_class(share, 0.1, 0.3).alias("fine"))
    return d.groupBy("way", "coarse", "fine").agg(F.count("*").alias("n")).withColumns({"from_x": x, "from_y": y})


_GRIDS = [(c, r) for c in range(1, 7) for r in range(1, 7) if c * r <= 6]


@query(ELEMENTS + f", g as (select * from (values {', '.join(f'({c}, {r}, {math.log(c / r)!r}::double)' for c, r in _GRIDS)}) v(cols, rows_, ratio)), " + "s as (select image, idx, min(struct_pack(a := round(abs(ln((x2 - x1)::double / (y2 - y1)) - ratio), 9), b := cols * rows_, c := cols, d := rows_)) as best from e, g group by image, idx) select image, idx, best.c as cols, best.d as rows from s")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of at most six tiles whose shape is nearest to the box's."""
    shape = F.log((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    grids = F.array(*[F.struct(F.round(F.abs(shape - math.log(c / r)), 9).alias("a"), F.lit(c * r).alias("b"), F.lit(c).alias("c"), F.lit(r).alias("d")) for c, r in _GRIDS])
    return elements(spark, sf_dir).select("image", "idx", F.array_min(grids).alias("best")).select("image", "idx", F.col("best.c").alias("cols"), F.col("best.d").alias("rows"))


@query(ELEMENTS + ", s as (select image, idx, x2 - x1 as w, y2 - y1 as h, least(336.0::double / (x2 - x1), 336.0::double / (y2 - y1)) as k from e) select image, idx, cast(round_even(w * k, 0) as int) as nw, cast(round_even(h * k, 0) as int) as nh, 336 - cast(round_even(w * k, 0) as int) as pad_x, 336 - cast(round_even(h * k, 0) as int) as pad_y from s")
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size on a square of 336 with the shape kept, and what is padded."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    k = F.least(336.0 / w, 336.0 / h)
    nw, nh = F.bround(w * k, 0).cast("int"), F.bround(h * k, 0).cast("int")
    return elements(spark, sf_dir).select("image", "idx", nw.alias("nw"), nh.alias("nh"), (336 - nw).alias("pad_x"), (336 - nh).alias("pad_y"))


@query(ELEMENTS + """select image, idx, ['tap', 'press', 'select'][ascii(md5('intent|' || image || '|' || idx)) % 3 + 1] || ' the element' ||
    case when y2 < 300 and x2 < 300 then ' at the top left' when y2 < 300 and x1 > 700 then ' at the top right' when y1 > 700 and x2 < 300 then ' at the bottom left' when y1 > 700 and x1 > 700 then ' at the bottom right' else '' end as phrase from e""")
def intent_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase with a verb by hash and the corner that the element is in."""
    c = F.col
    verb = F.element_at(F.array(F.lit("tap"), F.lit("press"), F.lit("select")), F.ascii(O.hash_rank("intent", "image", "idx")) % 3 + 1)
    top, bottom, left, right = c("y2") < 300, c("y1") > 700, c("x2") < 300, c("x1") > 700
    corner = F.when(top & left, " at the top left").when(top & right, " at the top right").when(bottom & left, " at the bottom left").when(bottom & right, " at the bottom right").otherwise("")
    return elements(spark, sf_dir).select("image", "idx", F.concat(verb, F.lit(" the element"), corner).alias("phrase"))


@query(ELEMENTS + f", r as (select *, {_REASON} as reject_reason from e), v as (select * from r where reject_reason is null) select image, idx, 'elemgnd' as task from v union all select image, idx, 'textloc' from v where kind = 'A' union all select image, idx, 'icongnd' from v where kind = 'R' union all select image, idx, 'intentgnd' from v where (x2 - x1) * (y2 - y1) > 20000")
def task_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks that each valid element serves, in one pass."""
    kind = F.col("kind")
    large = G.area(*(F.col(x) for x in ("x1", "y1", "x2", "y2"))) > 20000
    tasks = F.array_compact(F.array(F.lit("elemgnd"), F.when(kind == "A", "textloc"), F.when(kind == "R", "icongnd"), F.when(large, "intentgnd")))
    return _reasons(spark, sf_dir).where("reject_reason is null").select("image", "idx", F.explode(tasks).alias("task"))


@query(ELEMENTS + ", n as (select *, image % 4 + 1 = idx as hit from e), r as (select image, idx, hit, row_number() over (partition by image, hit order by md5('cand|' || image || '|' || idx)) as k from n) select image, idx, hit::int as label from r where hit or k <= 3")
def turn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target among its screen's elements with at most three others: the cap is the operator."""
    n = elements(spark, sf_dir).withColumn("hit", F.pmod("image", F.lit(4)) + 1 == F.col("idx"))
    k = F.row_number().over(Window.partitionBy("image", "hit").orderBy(O.hash_rank("cand", "image", "idx")))
    return n.select("image", "idx", "hit", k.alias("k")).where("hit or k <= 3").select("image", "idx", F.col("hit").cast("int").alias("label"))


@query("""with s as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n from events)
select user_id, string_agg('Step ' || k || '. scroll the page ' || case when event_type = 'view' then 'up' else 'down' end, ' ' order by k) as recent from s where k > n - 3 group by user_id""")
def trim_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three steps of a history that is given as text, in one wording."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    word = lambda t: F.when(t == "view", "Swipe  up").otherwise("scroll down")
    steps = F.transform("s", lambda x, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(". "), word(x["event_type"])))
    return e.select("user_id", C.scroll_wording(C.last_steps(F.array_join(steps, " "), 3)).alias("recent"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
