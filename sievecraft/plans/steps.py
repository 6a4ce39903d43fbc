"""Trajectories: an agent's steps are `events`, an episode is a user, in order of (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import actions as A
from ..operators import metrics as M
from ..operators import windows as O
from ..session import table
from .registry import Registry

_registry = Registry()
query = _registry.query


@query("""
with p as (
    select user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as pred from events
)
select user_id, event_type, count(*) as num_steps, count(*) filter (where pred = event_type) as n_match, count(*) filter (where pred is null) as n_missing,
    round(count(*) filter (where pred = event_type)::double / count(*), 6) as match_ratio
from p group by rollup(user_id, event_type)
""")
def step_metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step accuracy by episode and action, by episode, and over all: counts are kept, so they can be summed again."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select("user_id", "event_type", F.lead("event_type").over(order).alias("pred"))
    hit = (F.col("pred") == F.col("event_type")).cast("int")
    return steps.rollup("user_id", "event_type").agg(
        F.count("*").alias("num_steps"),
        F.coalesce(F.sum(hit), F.lit(0)).alias("n_match"),
        F.sum(F.col("pred").isNull().cast("int")).alias("n_missing"),
        F.round(F.coalesce(F.sum(hit), F.lit(0)) / F.count("*"), 6).alias("match_ratio"),
    )


_STEPS = """
with s as (
    select user_id, event_id, ts, event_type, props, value, row_number() over (partition by user_id order by ts, event_id) as k, lag(event_type) over (partition by user_id order by ts, event_id) as prev,
        lead(event_type) over (partition by user_id order by ts, event_id) as next from events
)
"""
_ORDER = ["ts", "event_id"]


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(*_ORDER)
    return table(spark, sf_dir, "events").select("*", F.row_number().over(order).alias("k"), F.lag("event_type").over(order).alias("prev"), F.lead("event_type").over(order).alias("next"))


@query(_STEPS + """, e as (select user_id, count(*) as n, count(*) filter (where next = event_type) as m from s group by user_id)
select cast(sum(m) as bigint) as num, cast(sum(n) as bigint) as den, round(sum(m)::double / sum(n), 6) as micro, round(avg(m::double / n), 6) as macro, count(*) filter (where m = n) as perfect from e""")
def episode_macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over steps and over episodes; an episode succeeds if all its steps do."""
    e = _steps(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), M.count_if(F.col("next") == F.col("event_type")).alias("m"))
    return e.agg(F.sum("m").alias("num"), F.sum("n").alias("den"), M.ratio(F.sum("m"), F.sum("n")).alias("micro"), F.round(F.avg(F.col("m") / F.col("n")), 6).alias("macro"), M.count_if(F.col("m") == F.col("n")).alias("perfect"))


@query(_STEPS + """, c as (select *, row_number() over (partition by user_id order by k) as g from s where prev is null or prev <> event_type
), p as (select s.user_id, s.event_id, s.k, (select max(g) from c where c.user_id = s.user_id and c.k < s.k) as upto from s)
select p.event_id, coalesce(string_agg('Step ' || c.g || '. ' || c.event_type, ' ' order by c.g), '') as history
from p left join c on c.user_id = p.user_id and c.g <= p.upto and c.g > p.upto - 6 group by p.event_id""")
def history_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six distinct steps before each step, numbered."""
    return O.history(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], _ORDER, "event_type", 6).select("event_id", "history")


@query(_STEPS + "select user_id, string_agg(event_type, '>' order by k) as path from s where prev is null or prev <> event_type group by user_id")
def history_prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode's steps without consecutive repeats."""
    items = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(O.collapsed(F.transform(items, lambda s: s["event_type"])), ">").alias("path"))


@query(_STEPS + """, r as (select *, k - row_number() over (partition by user_id, event_type order by k) as run from s
), l as (select user_id, event_type, run, count(*) as n from r group by all) select user_id, max(n) as longest, count(*) filter (where n >= 2) as repeats from l group by user_id""")
def consecutive_repeat_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of one action, and how many runs repeat it."""
    return O.runs(table(spark, sf_dir, "events"), ["user_id"], _ORDER, "event_type").groupBy("user_id").agg(F.max("length").alias("longest"), M.count_if(F.col("length") >= 2).alias("repeats"))


@query(_STEPS + "select event_id, last_value(case when event_type <> 'view' then event_type end ignore nulls) over (partition by user_id order by k rows between unbounded preceding and 1 preceding) as last_act from s")
def last_non_scroll_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") != "view", F.col("event_type")), ignorenulls=True).over(before).alias("last_act"))


@query(_STEPS + "select event_id, prev, next, coalesce(prev, '-') || '>' || event_type as pair from s")
def next_prev_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("event_id", "prev", "next", F.concat(F.coalesce("prev", F.lit("-")), F.lit(">"), "event_type").alias("pair"))


@query(_STEPS + "select event_id, event_type from s where not (event_type = 'signup' and coalesce(prev, '') = 'signup')")
def openapp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without openings that directly follow another."""
    return _steps(spark, sf_dir).where(~((F.col("event_type") == "signup") & (F.coalesce("prev", F.lit("")) == "signup"))).select("event_id", "event_type")


@query(_STEPS + ", l as (select *, max(case when event_type = 'signup' then k end) over (partition by user_id order by k) as last_load from s) select event_id, cast(k - coalesce(last_load, 0) as int) as since_load from l")
def history_since_last_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = Window.partitionBy("user_id").orderBy("k")
    return _steps(spark, sf_dir).select("event_id", (F.col("k") - F.coalesce(F.max(F.when(F.col("event_type") == "signup", F.col("k"))).over(upto), F.lit(0))).alias("since_load"))


@query("with r as (select event_id, event_type, row_number() over (partition by event_type order by md5('cap|' || event_id), event_id) as k from events) select event_id, event_type from r where k <= 100")
def per_class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred steps of each class, in hash order: the cap is the operator."""
    return O.capped(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], [O.hash_rank("cap", "event_id"), "event_id"], 100)


@query("select event_id, cast(regexp_extract(props, '\"k\":\\s*(-?[0-9]+)', 1) as int) as k from events")
def action_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the action text, which may hold tuples; null where it can't be read."""
    return table(spark, sf_dir, "events").select("event_id", A.field(F.col("props"), "$.k", "int").alias("k"))


@query("with l as (select user_id, max(ts) as seen from events group by user_id) select user_id, seen, seen < (select max(ts) from events) - interval 6 hour as expired from l")
def worker_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who has been silent for longer than the limit before the last beat of all."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    top = last.agg(F.max("seen").alias("now"))
    return last.crossJoin(F.broadcast(top)).select("user_id", "seen", (F.col("seen") < F.col("now") - F.expr("interval 6 hours")).alias("expired"))


@query("select s_nationkey, arg_min(s_suppkey, struct_pack(a := s_acctbal / (1 + s_suppkey % 7), b := s_suppkey)) as worker from supplier group by s_nationkey")
def shortest_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worker with the least load by speed."""
    load = F.struct((F.col("s_acctbal") / (1 + F.col("s_suppkey") % 7)).alias("a"), F.col("s_suppkey").alias("b"))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min_by("s_suppkey", load).alias("worker"))


@query(_STEPS + "select event_type, coalesce(next, 'none') as predicted, count(*) as n, count(*) filter (where event_type = next or contains(event_type, next) or contains(next, event_type)) as text_match from s group by 1, 2")
def action_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _steps(spark, sf_dir)
    return s.groupBy("event_type", F.coalesce("next", F.lit("none")).alias("predicted")).agg(F.count("*").alias("n"), M.count_if(F.coalesce(A.texts_match(F.col("event_type"), F.col("next")), F.lit(False))).alias("text_match"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
