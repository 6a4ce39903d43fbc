"""Resampling with exact sizes, and tables of scores by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import windows as O
from ..session import table
from .registry import Registry

_registry = Registry()
query = _registry.query


@query("""with c as (select lang, count(*) as n from documents group by lang), t as (select lang, n, cast((select round_even(quantile_cont(n, 0.75), 0) from c) as bigint) as target from c
), r as (select doc_id, lang, row_number() over (partition by lang order by md5('resample|' || doc_id)) as k from documents
), m as (select doc_id, r.lang, target // n + case when k <= target % n then 1 else 0 end as copies from r join t on r.lang = t.lang)
select doc_id, lang, unnest(range(1, copies + 1)) as copy from m""")
def resample_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classes brought to the 75th percentile of their sizes, up or down."""
    d = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang")
    c = d.groupBy("lang").agg(F.count("*").alias("n"))
    target = c.crossJoin(F.broadcast(c.agg(F.bround(F.percentile("n", 0.75), 0).cast("long").alias("target"))))
    return O.resampled(d, "lang", O.hash_rank("resample", "doc_id"), target)


@query("select event_id, unnest(case when event_type = 'signup' then range(1, 12) else range(1, 2) end) as copy from events")
def rare_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rare action eleven times, others once."""
    times = F.when(F.col("event_type") == "signup", 11).otherwise(1)
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(1), times)).alias("copy"))


@query(" union all ".join(f"(select {r} as repeat, event_id from events order by md5('repeat{r}|' || event_id), event_id limit 50)" for r in range(3)))
def repeat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three independent samples of fifty steps: each a top-k, not a sort of all."""
    e = table(spark, sf_dir, "events").select("event_id")
    parts = [e.orderBy(O.hash_rank(f"repeat{r}", "event_id"), "event_id").limit(50).select(F.lit(r).alias("repeat"), "event_id") for r in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select p_type, count(*) as n, round(avg(p_size), 6) as first, round(avg(p_retailprice), 6) as second, round(sum(p_size)::double / sum(p_retailprice), 6) as relative from part group by rollup(p_type)")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of two models by category and over all, and their ratio."""
    return table(spark, sf_dir, "part").rollup("p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("first"), F.round(F.avg("p_retailprice"), 6).alias("second"), M.ratio(F.sum("p_size"), F.sum("p_retailprice")).alias("relative"))


@query("select p_partkey % 8 as slot, count(*) as n, round(avg(p_size % 7), 6) as rating, round(count(*) filter (where p_size % 7 < 3)::double / count(*), 6) as low from part group by 1")
def rating_by_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rating and share of ratings below three, by the question's slot of eight."""
    score = F.col("p_size") % 7
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 8).alias("slot")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("rating"), M.ratio(M.count_if(score < 3), F.count("*")).alias("low"))


@query("select r_name, c_mktsegment, count(*) as customers, count(distinct n_nationkey) as nations from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def multiway_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact table with two lookups, one behind the other; their sizes let the optimizer broadcast them."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("customers"), F.countDistinct("n_nationkey").alias("nations"))


@query("select 'supplier' as origin, s_nationkey as nation, count(*) as n from supplier group by 2 union all select 'customer', c_nationkey, count(*) from customer group by 2")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with a column that names them, counted together."""
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_nationkey").alias("nation"))
    return s.unionByName(c).groupBy("origin", "nation").agg(F.count("*").alias("n"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
