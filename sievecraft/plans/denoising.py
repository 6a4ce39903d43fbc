"""Filters on elements, instructions and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import denoise as D
from ..functions import matching as A
from ..functions import text as T
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import windows as O
from ..session import table
from .boxes import _REASON, BOX, ELEMENTS, _reasons, elements
from .registry import Registry

_registry = Registry()
query = _registry.query


@query(ELEMENTS + """select image, idx, x2 <= 1000 and y2 <= 1000 and (x2 - x1) / 1000.0::double > 0.005 and (y2 - y1) / 1000.0::double > 0.005 as inside, x2 <= 1000 and y2 <= 1000 as shares,
    (x2 - x1) * (y2 - y1) / 1000000.0::double > 0.001 and (x2 - x1) * (y2 - y1) / 1000000.0::double < 0.65 as hover_target, (x2 - x1) * (y2 - y1) / 1000000.0::double > 0.0006 and (x2 - x1) * (y2 - y1) / 1000000.0::double < 0.65 as tree_node from e""")
def element_area_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on the picture, as shares, and of areas that targets and nodes may have."""
    c = tuple(F.col(x) for x in BOX)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 1000000.0
    return elements(spark, sf_dir).select("image", "idx", D.box_inside(*c, 1000, 1000).alias("inside"), D.share_box(*[x / 1000.0 for x in c]).alias("shares"), D.area_between(area, 0.001, 0.65).alias("hover_target"), D.area_between(area, 0.0006, 0.65).alias("tree_node"))


@query(ELEMENTS + f", r as (select *, {_REASON} as reject_reason from e) select image, idx from r where image not in (select image from r where reject_reason is not null)")
def any_invalid_drops_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A screen with any bad element goes as a whole."""
    return Q.drop_groups(_reasons(spark, sf_dir), ["image"], F.col("reject_reason").isNotNull()).select("image", "idx")


_GATE = "case when n <= 5 then 'few nodes' when bad >= 0.25 * n then 'invalid boxes' when named < 7 then 'few texts' else 'kept' end"


@query(ELEMENTS + f""", t as (select cast(floor(image / 5) as bigint) as tree, (x2 - x1) * (y2 - y1) / 1000000.0::double as area, kind from e
), g as (select tree, count(*) as n, count(*) filter (where not (area > 0.0006 and area < 0.65)) as bad, count(*) filter (where area > 0.0006 and area < 0.65 and kind <> 'N') as named from t group by tree) select tree, {_GATE} as gate from g""")
def tree_level_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees by their nodes: enough of them, few with odd areas, enough with text."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 1000000.0
    good = D.area_between(area, 0.0006, 0.65)
    t = elements(spark, sf_dir).select(F.floor(F.col("image") / 5).alias("tree"), good.alias("good"), "kind")
    g = t.groupBy("tree").agg(F.count("*").alias("n"), M.count_if(~F.col("good")).alias("bad"), M.count_if(F.col("good") & (F.col("kind") != "N")).alias("named"))
    return g.select("tree", F.expr(_GATE).alias("gate"))


@query("""with i as (select vec_id, i % 3 as channel, embedding[i + 1] * 20 as v from embeddings, unnest(range(0, 63)) as t(i)), d as (select vec_id, channel, stddev_pop(v) as s, min(v) = max(v) as same from i group by all)
select vec_id, max(round(s, 4)) < 5 as blank, bool_and(same) as uniform from d group by vec_id""")
def blank_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of three channels whose values hardly vary in any, or not at all."""
    def channel(c: int) -> Column:
        return F.transform(F.filter("embedding", lambda v, i: (i < 63) & (i % 3 == c)), lambda v: v.cast("double") * 20)

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)

    def deviation(a: Column) -> Column:
        return F.sqrt(mean(F.transform(a, lambda v: (v - mean(a)) * (v - mean(a)))))

    values = [channel(c) for c in range(3)]
    spread = [deviation(a) for a in values]
    uniform = [F.array_min(a) == F.array_max(a) for a in values]
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.greatest(*[F.round(s, 4) for s in spread]) < 5).alias("blank"), (uniform[0] & uniform[1] & uniform[2]).alias("uniform"))


@query("""with c as (select conv_id, turn, role, coalesce(text, '') as t from conversations), w as (select *, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) as n from c)
select conv_id, turn, role, md5(t) as text, case when regexp_matches(t, 'flip|swipe') then 'motion' when n + 576 > 700 then 'tokens' when length(t) > 120 then 'long' when t = '' or contains(t, 'Non-interactive') then 'no function' when contains(t, 'I can''t') or contains(t, 'sorry') then 'refusal' else 'kept' end as reason from w""")
def instruction_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by the first reason against them: motions, tokens with the picture's, length, no function, refusals."""
    t = F.coalesce(F.col("text"), F.lit(""))
    checks = [("motion", D.tells_motion(t)), ("tokens", D.tokens_with_image(t) > 700), ("long", F.length(t) > 120), ("no function", D.without_function(t)), ("refusal", D.has_any(t, D.REFUSALS))]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(t).alias("text"), F.coalesce(Q.first_reason(checks), F.lit("kept")).alias("reason"))


_KINDS = "case p_size % 4 when 0 then 'View' when 1 then 'Button' when 2 then 'TextView' else 'LinearLayout' end"


@query(f"""with p as (select p_partkey, {_KINDS} as view, case when p_partkey % 3 = 0 then '' else p_name end as t, case when p_partkey % 5 = 0 then p_type end as d, p_type, p_brand from part)
select p_partkey, view in ('LinearLayout', 'FrameLayout', 'GridView', 'View', 'ViewGroup', 'TextView') and t = '' and coalesce(d, '') = '' as container, lower(trim(p_type)) in ('economy', 'standard', 'button') as generic, contains(p_brand, '#1') as listed, not contains(p_type, 'PROMO') as allowed from p""")
def node_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty containers, generic names, paths and tasks by substrings."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_KINDS).alias("view"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("t"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).alias("d"), "p_type", "p_brand")
    return p.select("p_partkey", D.empty_container(F.col("view"), F.col("t"), F.col("d")).alias("container"), D.generic_name(F.col("p_type"), ["economy", "standard", "button"]).alias("generic"), F.contains("p_brand", F.lit("#1")).alias("listed"), (~F.contains("p_type", F.lit("PROMO"))).alias("allowed"))


_TASK = "case idx % 3 when 0 then 'elemgnd' when 1 then 'elemref' else 'widgetcap' end"


@query(ELEMENTS + f""", t as (select image, idx, {_TASK} as task, (idx % 3 = 2 or (x1 < 1000 and y2 < 1000)) as good from e) select image, count(*) as n, count(*) filter (where good) as kept, coalesce(string_agg(task || '_' || idx, ' ' order by task || '_' || idx) filter (where not good), '') as invalid from t group by image""")
def coordinates_in_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose coordinates lie on the scale, and the ids of the others, by screen."""
    point = F.format_string("(%d, %d)", "x1", "y2")
    task = F.expr(_TASK)
    good = D.in_scale(F.col("task"), F.concat(F.lit("What is at "), point, F.lit("?")), point)
    t = elements(spark, sf_dir).withColumn("task", task).select("image", good.alias("good"), F.concat_ws("_", F.col("task"), F.col("idx").cast("string")).alias("id"))
    return t.groupBy("image").agg(F.count("*").alias("n"), M.count_if(F.col("good")).alias("kept"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("good"), F.col("id")))), " ").alias("invalid"))


@query("""with o as (select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events), t as (select *, 'I will ' || case when event_id % 3 = 0 then event_type || 'ing it' else 'wait' end as thought from o)
select event_id, before is not null and before = event_type as repeats, event_id % 3 = 0 as told, case when event_type = 'click' then 'stay' else 'go' end as terminal from t""")
def step_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that repeat the last instruction, whose thought names them, and that end nothing."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events")
    thought = F.concat(F.lit("I will "), F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("ing it"))).otherwise("wait"))
    told = D.mentions_action(thought, F.concat(F.lit("X"), F.col("event_type")))
    return e.select("event_id", (before.isNotNull() & (before == F.col("event_type"))).alias("repeats"), told.alias("told"), F.when(F.contains("event_type", F.lit("click")), "stay").otherwise("go").alias("terminal"))


_ANSWER = "case p_partkey % 8 when 0 then 'B. ' || p_name when 1 then '(C: ' || p_name when 2 then 'D' when 3 then 'None of these' when 4 then 'nan' when 5 then 'tap at (' || p_size || ', ' || p_partkey % 100 || ')' when 6 then 'no (x,y) here' else '\"' || p_name || ''' ' end"
_CHOICE = "case when p_partkey % 8 = 0 then 'B' when p_partkey % 8 = 1 then 'C' when p_partkey % 8 = 2 then 'D' when p_partkey % 8 = 3 then '-' end"


@query(f"""with p as (select *, {_ANSWER} as a from part) select p_partkey, {_CHOICE} as letter, case when p_partkey % 8 = 5 then p_size::double else -1.0::double end as x, case when p_partkey % 8 = 5 then (p_partkey % 100)::double else -1.0::double end as y, lower(a) = 'nan' as nullish,
    translate(trim(lower(a), ' .?!'), '"'',;', '') as cleaned, case when p_partkey % 8 = 7 then p_name || '''' when p_partkey % 8 in (0, 1, 2, 3, 4, 5, 6) then trim(a, ' \\') end as quoted, replace(replace(a, 'ring', 'rang'), 'nan', 'NaN') as spelled from p""")
def answer_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters, points and nulls read from answers; marks, quotes and spelling set right."""
    a = F.expr(_ANSWER)
    point = D.first_point(a)
    return table(spark, sf_dir, "part").select("p_partkey", D.choice_letter(a, 6).alias("letter"), point[0].alias("x"), point[1].alias("y"), D.nullish(a).alias("nullish"), A.clean_answer(a).alias("cleaned"), D.balanced_quotes(a).alias("quoted"), D.spelled(a, {"ring": "rang", "nan": "NaN"}).alias("spelled"))


@query(r"""with c as (select conv_id, min_by(text, (turn, text)) filter (where text is not null) as t from conversations group by conv_id), w as (select conv_id, string_split(t, ' ') as w, md5('part|' || conv_id) as h, t from c where t is not null
), s as (select *, cast(('0x' || h[1:7])::bigint % len(w) as int) as s0 from w)
select conv_id, md5(array_to_string(w[s0 + 1:s0 + cast(('0x' || h[8:14])::bigint % (len(w) - s0) as int) + 1], ' ')) as part, md5(trim(regexp_extract(trim(t, ' ' || chr(9) || chr(10) || chr(13)), '(?s)^[^\n]*\n(.*)$', 1), ' ' || chr(9) || chr(10) || chr(13))) as rest from s""")
def parts_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of each dialogue's first words chosen by hash, and the text without its first line."""
    c = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("t"))
    return c.select("conv_id", F.md5(D.some_words(F.col("t"), F.concat(F.lit("part|"), F.col("conv_id").cast("string")))).alias("part"), F.md5(D.without_lines(F.col("t"), 1)).alias("rest"))


@query("""select coalesce(source, 'all') as source, count(*) as n, count(*) filter (where l.quality = 1) as good, count(*) filter (where l.quality = 1 and lang = 'en') as good_english, round(count(*) filter (where l.quality = 1)::double / count(*), 6) as accuracy,
    round(count(*) filter (where l.quality = 1 and lang = 'en')::double / nullif(count(*) filter (where lang = 'en'), 0), 6) as english_accuracy from documents join labels l using (doc_id) where source is not null group by rollup(source)""")
def accuracy_with_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over all and over a subset."""
    d = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    good, english = F.col("quality") == 1, F.col("lang") == "en"
    a = d.rollup("source").agg(F.count("*").alias("n"), M.count_if(good).alias("good"), M.count_if(good & english).alias("good_english"), M.count_if(english).alias("english"))
    share = lambda x, y: F.round(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), 6)
    return a.select(F.coalesce("source", F.lit("all")).alias("source"), "n", "good", "good_english", share("good", "n").alias("accuracy"), share("good_english", "english").alias("english_accuracy"))


@query("""with u as (select doc_id, source, unnest(string_split(text, ' ')) as w from documents), c as (select doc_id, source, w, count(*) as n from u group by all), t as (select doc_id, source, sum(n) as total, sum(n * ln(n)) as s from c group by all)
select coalesce(source, '') as source, cast(floor(round(exp(ln(total) - s / total), 6) / 50) as bigint) as bin, count(*) as n from t group by all""")
def perplexity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by the perplexity of their own word counts, in bins of 50."""
    u = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.explode(F.split("text", " ")).alias("w")).groupBy("doc_id", "source", "w").agg(F.count("*").alias("n"))
    t = u.groupBy("doc_id", "source").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("s"))
    value = F.round(F.exp(F.log("total") - F.col("s") / F.col("total")), 6)
    return t.groupBy(F.coalesce("source", F.lit("")).alias("source"), F.floor(value / 50).alias("bin")).agg(F.count("*").alias("n"))


@query("select conv_id, role, text, turn from (select *, row_number() over (partition by conv_id, role, text order by turn) as k from conversations) where k = 1")
def first_of_repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instruction that a dialogue has before is left out."""
    return O.first_of(table(spark, sf_dir, "conversations").select("conv_id", "role", "text", "turn"), ["conv_id", "role", "text"], ["turn"])


@query("select item_id, text, cast(row_number() over (order by md5('id|' || item_id)) as bigint) as id from benchmark")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from 1 in hash order, numbered by blocks rather than in one task."""
    return O.ranked(table(spark, sf_dir, "benchmark").select("item_id", "text").withColumn("all", F.lit(0)), ["all"], O.hash_rank("id", "item_id"), "id").drop("all").withColumn("id", F.col("id").cast("long"))


@query("select o_orderkey, o_orderpriority, n_name, c_name from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_orderpriority is not null")
def mapped_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screens with their hierarchy by a mapping table, and nodes with their boxes; rows without one go."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").where("o_orderpriority is not null")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_name")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return o.join(c, "o_custkey").join(n, "c_nationkey").select("o_orderkey", "o_orderpriority", "n_name", "c_name")


QUERIES, ORACLES = _registry.queries, _registry.oracles
