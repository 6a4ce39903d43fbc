"""Text quality, sampling and scores over `documents`, `labels`, `benchmark`, `pages` and the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import denoise as D
from ..functions import text as T
from ..operators import metrics as M
from ..operators import windows as O
from ..session import table
from .registry import Registry
from .samples import _PAIRS, pairs

_registry = Registry()
query = _registry.query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# fixed values: as in functions.text.SCRIPTS
_SCRIPT_SQL = {"zh": r"[\x{4e00}-\x{9fff}]", "ja": r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{ff00}-\x{ffef}]", "ru": r"[\x{0400}-\x{04ff}]", "ar": r"[\x{0600}-\x{06ff}]", "ko": r"[\x{ac00}-\x{d7af}]"}


@query("select lang, " + ", ".join(f"count(*) filter (where regexp_matches(text, '{v}')) as {k}" for k, v in _SCRIPT_SQL.items()) + ", count(*) filter (where regexp_matches(text, '[A-Za-z]') and not regexp_matches(text, '" + "|".join(_SCRIPT_SQL.values()) + "')) as english, count(*) as n from documents group by lang")
def language_script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping counts of scripts; English only where there is no other."""
    t = F.col("text")
    return _docs(spark, sf_dir).groupBy("lang").agg(*[M.count_if(T.has_script(t, k)).alias(k) for k in T.SCRIPTS], M.count_if(T.has_english(t)).alias("english"), F.count("*").alias("n"))


@query(r"select doc_id from documents where regexp_full_match(text, '[A-Za-z0-9\x{4e00}-\x{9fff}.,!?;:()\[\]{}<>@#$%^&*+\-=_~\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]*')")
def valid_string_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(T.valid_chars(F.col("text"))).select("doc_id")


@query("""select lang, round(avg(length(text)), 6) as mean, quantile_cont(length(text), 0.5) as median, min(length(text)) as least, max(length(text)) as most, round(stddev_pop(length(text)), 4) as deviation from documents group by lang""")
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return _docs(spark, sf_dir).groupBy("lang").agg(F.round(F.avg(n), 6).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.stddev_pop(n), 4).alias("deviation"))


@query("select least(length(text) // 500, 40) as bin, count(*) as n from documents group by 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(F.least(F.floor(F.length("text") / 500), F.lit(40)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by sha256(text)")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each text; texts travel as their hashes."""
    return _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("select source, lang, arg_min(doc_id, md5('pick|' || doc_id)) as doc_id from documents group by source, lang")
def dedup_key_md5_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each key, the smallest hash: repeatable, unlike a random choice."""
    return _docs(spark, sf_dir).groupBy("source", "lang").agg(F.min_by("doc_id", O.hash_rank("pick", "doc_id")).alias("doc_id"))


@query("""with c as (select lang, count(*) as n from documents group by lang), t as (select cast(round_even(quantile_cont(n, 0.75), 0) as bigint) as target from c
), r as (select d.doc_id, d.lang, c.n, t.target, row_number() over (partition by d.lang order by md5('bal|' || d.doc_id), d.doc_id) as k from documents d join c using (lang), t)
select lang, doc_id, target // n + case when k <= target % n then 1 else 0 end as copies from r where target // n + case when k <= target % n then 1 else 0 end > 0""")
def class_balance_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class cut or repeated to the third quartile of class sizes: how often each row is taken."""
    d = _docs(spark, sf_dir).select("doc_id", "lang")
    counts = d.groupBy("lang").agg(F.count("*").alias("n"))
    target = counts.agg(F.bround(F.percentile("n", F.lit(0.75)), 0).cast("long").alias("target"))
    r = O.ranked(d, ["lang"], O.hash_rank("bal", "doc_id"), "k").join(counts, "lang").crossJoin(F.broadcast(target))
    copies = F.floor(F.col("target") / F.col("n")) + F.when(F.col("k") <= F.col("target") % F.col("n"), 1).otherwise(0)
    return r.select("lang", "doc_id", copies.alias("copies")).where("copies > 0")


@query("select doc_id, md5('sample|' || doc_id) as rank from documents order by rank limit 100")
def hash_sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows without replacement, in hash order: the limit is the operator."""
    return _docs(spark, sf_dir).select("doc_id", O.hash_rank("sample", "doc_id").alias("rank")).orderBy("rank").limit(100)


@query("select doc_id, md5('shuffle|' || doc_id) as rank from documents")
def hash_shuffle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", O.hash_rank("shuffle", "doc_id").alias("rank"))


@query("with r as (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents) select doc_id, cast(i // cast(ceil(n / 8.0::double) as bigint) as bigint) as chunk from r")
def chunk_k_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous chunks; ranks come from counts of id blocks, so no single task sorts all rows."""
    d = _docs(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 10_000).alias("block"))
    blocks = d.groupBy("block").agg(F.count("*").alias("b"))
    before = blocks.select("block", F.coalesce(F.sum("b").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = blocks.agg(F.sum("b").alias("n"))
    i = F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("doc_id")) - 1
    return d.join(before, "block").crossJoin(F.broadcast(total)).select("doc_id", F.floor(i / F.ceil(F.col("n") / 8)).alias("chunk"))


@query("select source, count(*) as n, round(sqrt(count(*)) / sum(sqrt(count(*))) over (), 6) as weight from documents group by source")
def sqrt_sampling_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return c.withColumn("weight", F.round(F.sqrt("n") / F.sum(F.sqrt("n")).over(Window.partitionBy()), 6))


@query("select doc_id, sha256(source || '/' || doc_id) as image_id from documents")
def sha256_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.concat_ws("/", "source", F.col("doc_id").cast("string")), 256).alias("image_id"))


@query(r"select doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) as cleaned from documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.collapse(F.col("text"))).alias("cleaned"))


@query("select doc_id, length(trim(text, ' .')) as n, right(trim(text, ' .'), 5) as tail from documents")
def strip_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.strip(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(s).cast("long").alias("n"), F.right(s, F.lit(5)).alias("tail"))


@query("""with c as (select lang, count(*) filter (where quality = 1 and length(text) > 1000) as tp, count(*) filter (where quality = 0 and length(text) > 1000) as fp, count(*) filter (where quality = 1 and length(text) <= 1000) as fn,
    count(*) filter (where quality = 0 and length(text) <= 1000) as tn from labels join documents using (doc_id) group by lang)
select *, round(tp::double / nullif(tp + fp, 0), 6) as precision, round(tp::double / nullif(tp + fn, 0), 6) as recall, round(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from c""")
def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir), "doc_id")
    c = d.groupBy("lang").agg(*M.confusion(F.col("quality") == 1, F.length("text") > 1000))
    return c.select("*", *[v.alias(k) for k, v in M.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])


@query("select d.doc_id, coalesce(cast(l.quality as varchar), 'FAILED') as answer from documents d left join labels l using (doc_id)")
def left_join_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("FAILED")).alias("answer"))


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey and lower(left(o_orderpriority, 1)) = cast(c_nationkey % 5 + 1 as varchar)")
def composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.lower(F.left("o_orderpriority", F.lit(1))).alias("p"))
    c = table(spark, sf_dir, "customer").select("c_name", F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 5 + 1).cast("string").alias("p"))
    return o.join(c, ["k", "p"]).select("o_orderkey", "c_name")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where quality = 0)")
def anti_known_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels where toxic = 1)")
def semi_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("select doc_id from documents where lang <> 'de' intersect select doc_id from labels where quality = 1 intersect select doc_id from documents where length(text) > 500")
def intersect_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.where("lang <> 'de'").select("doc_id").intersect(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")).intersect(d.where(F.length("text") > 500).select("doc_id"))


_NEAR = "case when greatest(length(p_name), length({0})) = 0 then 1.0::double when 1 - levenshtein(p_name, {0})::double / greatest(length(p_name), length({0})) < 0.5 then 0.0::double else 1 - levenshtein(p_name, {0})::double / greatest(length(p_name), length({0})) end"


@query(f"""with a as (select *, lower(p_type) as a1, left(p_name, length(p_name) - 2) || 'xy' as a2, p_brand as a3 from part) select p_brand, count(*) as n, round(avg(greatest({', '.join(_NEAR.format(x) for x in ('a1', 'a2', 'a3'))})), 6) as anls, round(avg(case when p_name in (a1, a2, a3) then 1.0::double else 0 end), 6) as exact from a group by p_brand""")
def anls_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over answers of the best similarity to any of the accepted ones, and of exact hits."""
    accepted = F.array(F.lower("p_type"), F.concat(F.expr("left(p_name, length(p_name) - 2)"), F.lit("xy")), F.col("p_brand"))
    best = F.array_max(F.transform(accepted, lambda x: T.anls(F.col("p_name"), x)))
    exact = F.array_contains(accepted, F.col("p_name")).cast("double")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg(best), 6).alias("anls"), F.round(F.avg(exact), 6).alias("exact"))


@query(_PAIRS + """, d as (select conv_id, k, list_distinct(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')) as w, list_distinct(list_filter(regexp_split_to_array(answer, '\\s+'), lambda x: x <> '')) as v from p)
select conv_id, k, case when len(w) + len(v) = 0 then 0.0::double else round(2.0::double * len(list_intersect(w, v)) / (len(w) + len(v)), 6) end as f1 from d""")
def token_set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of the sets of words of each question and its answer."""
    return pairs(spark, sf_dir).select("conv_id", "k", F.coalesce(F.round(T.set_f1(T.words(F.col("question")), T.words(F.col("answer"))), 6), F.lit(0.0)).alias("f1"))


@query("select l_orderkey, count(*) as n, count(*) filter (where l_quantity <> 0 and abs(l_quantity * (1 + l_discount) - l_quantity) / l_quantity <= 0.05) as close from lineitem group by l_orderkey")
def relaxed_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read from text are close within 5 % of the target."""
    q = F.col("l_quantity")
    good = T.relaxed_equal(q.cast("string"), (q * (1 + F.col("l_discount"))).cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), M.count_if(good).alias("close"))


@query("""with a as (select p_brand, p_type, count(*) % 11 as t from part group by 1, 2)
select p_brand, p_type, round(case when t > 0 then (t * least(1.0, (t - 1) / 3.0::double) + (10 - t) * least(1.0, t / 3.0::double)) / 10 else 0 end, 6) as accuracy from a""")
def soft_vqa_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg((F.count("*") % 11).alias("t"))
    return a.select("p_brand", "p_type", F.round(T.soft_accuracy(F.col("t")), 6).alias("accuracy"))


_LETTERS = "case p_partkey % 4 when 0 then chr(65 + cast(p_size % 5 as int)) when 1 then chr(65 + cast(p_size % 5 as int)) || '. ' || p_name when 2 then 'The answer is ' || chr(65 + cast(p_size % 5 as int)) || '.' else p_name end"


@query(f"with t as (select p_partkey, {_LETTERS} as text from part) select p_partkey, case when regexp_full_match(text, '[A-E]') then text when regexp_matches(text, '^[A-E]\\. ') then left(text, 1) when regexp_matches(text, 'The answer is [A-E]\\.') then regexp_extract(text, 'The answer is ([A-E])\\.', 1) end as letter from t")
def option_letter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_LETTERS.replace("cast(p_size % 5 as int)", "p_size % 5").replace("chr(65 + p_size % 5)", "char(65 + p_size % 5)")).alias("text")).select("p_partkey", T.option_letter(F.col("text")).alias("letter"))


@query("select p_partkey, case when p_partkey % 3 = 0 then -1.0::double else p_size::double end as a, case when p_partkey % 3 = 0 then -1.0::double else (p_partkey % 10)::double end as b from part")
def score_pair_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("p_partkey") % 3 == 0, F.lit("none given")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(", "), (F.col("p_partkey") % 10).cast("string"), F.lit("\nbecause")))
    pair = T.score_pair(line)
    return table(spark, sf_dir, "part").select("p_partkey", pair[0].alias("a"), pair[1].alias("b"))


_TASK = "case when length(text) < 500 then 'short' when contains(text, chr(10)) then 'lines' else 'block' end"


@query(f"select source, {_TASK} as task, count(*) as n from documents group by cube(1, 2)")
def source_task_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source and task with all totals."""
    task = F.when(F.length("text") < 500, "short").when(F.contains("text", F.lit("\n")), "lines").otherwise("block")
    return _docs(spark, sf_dir).select("source", task.alias("task")).cube("source", "task").agg(F.count("*").alias("n"))


@query("select page_id, regexp_matches(html || case when page_id % 9 = 0 then ' <h1>' || (400 + page_id % 120) || ' Gone</h1>' else '' end, '" + "|".join(D.BROKEN_PAGES) + "') as failed from pages where html is not null")
def network_error_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold a status line of a failed request; some get one here."""
    line = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit(" <h1>"), (400 + F.col("page_id") % 120).cast("string"), F.lit(" Gone</h1>"))).otherwise("")
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", D.has_any(F.concat("html", line), D.BROKEN_PAGES).alias("failed"))


@query(r"select page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) as stripped from pages")
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.regexp_replace("html", r"(?s)<!--.*?-->", "")).alias("stripped"))


@query(r"select page_id, len(list_filter(regexp_extract_all(html, '>([^<]*)<', 1), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) as n from pages")
def html_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.regexp_extract_all("html", F.lit(">([^<]*)<"), 1), lambda x: F.btrim(x, F.lit(" \t\n\r")) != "")
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n"))


@query("select vec_id, round(list_stddev_pop(embedding), 4) < 0.1 as blank, round(list_min(embedding), 4) = round(list_max(embedding), 4) as uniform from embeddings")
def pixel_blank_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank regions by the population deviation of their values, as a fold over the array."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total(x) / F.size(x)
    deviation = F.sqrt(total(F.transform(x, lambda v: (v - mean) * (v - mean))) / F.size(x))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(deviation, 4) < 0.1).alias("blank"), (F.round(F.array_min(x), 4) == F.round(F.array_max(x), 4)).alias("uniform"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
